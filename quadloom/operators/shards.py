"""Splits of a key table: chunks, rank shards, batches, and job manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .archives import ordinal


def split(rows: DataFrame, key: str, chunks: int) -> DataFrame:
    """``rows`` with chunk: ``chunks`` runs of equal size in order of ``key``; the first ones hold one more."""
    numbered = ordinal(rows, key)
    total = rows.agg(F.count("*").alias("_t"))
    q, r = F.floor(F.col("_t") / chunks), F.col("_t") % chunks
    big = r * (q + 1)
    chunk = F.when(F.col("ordinal") < big, F.floor(F.col("ordinal") / (q + 1))).otherwise(F.floor(F.try_divide(F.col("ordinal") - big, q)) + r)
    # One row of one number.
    return numbered.join(F.broadcast(total)).withColumn("chunk", chunk.cast("int")).drop("_t")


def merge_tree(chunks: DataFrame, groups: int) -> DataFrame:
    """(node, inputs): chunk archives merged in ``groups`` intermediate archives of neighbouring chunks."""
    names = chunks.select("chunk").distinct().withColumn("chunk_key", F.col("chunk").cast("long"))
    grouped = split(names.drop("chunk"), "chunk_key", groups).withColumnRenamed("chunk", "node")
    listed = F.transform(F.sort_array(F.collect_list("chunk_key")), lambda c: F.format_string("chunk_%d.tiles", c))
    return grouped.groupBy("node").agg(F.array_join(listed, " ").alias("inputs"))


def shuffle_slot(key: Column, epoch: int) -> Column:
    """One of 1,000,003 places in an epoch's repeatable order; the key breaks ties.  Doesn't overflow for any key."""
    return F.pmod(F.pmod(key, F.lit(1000003)) * 7919 + epoch * 104729, F.lit(1000003))


def rank_shard(rows: DataFrame, key: str, world: int, epoch: int = 0, pad: bool = True) -> DataFrame:
    """(key, ordinal, shard): rows in an epoch's order, dealt in turn.

    ``pad`` repeats the first rows until all shards are equally long, and drops
    none.
    """
    numbered = ordinal(rows.select(key), key, slot=shuffle_slot(F.col(key).cast("long"), epoch))
    if pad:
        total = rows.agg(F.count("*").alias("_t"))
        short = F.pmod(-F.col("_t"), F.lit(world))
        more = numbered.join(F.broadcast(total)).where(F.col("ordinal") < short).select(key, (F.col("ordinal") + F.col("_t")).alias("ordinal"))
        numbered = numbered.unionByName(more)
    return numbered.withColumn("shard", (F.col("ordinal") % world).cast("int"))


def batches(shards: DataFrame, world: int, size: int) -> DataFrame:
    """Shards with batch and the place in it; the last batch may be short."""
    at = F.floor(F.col("ordinal") / world)
    return shards.select("*", F.floor(at / size).cast("int").alias("batch"), (at % size).cast("int").alias("slot"))


def job_manifest(scenes: DataFrame, level: int) -> DataFrame:
    """(scene_id, step, output, command): what to run for each scene, each step only if its output is absent."""
    name = F.format_string("scene_%d", F.col("scene_id"))
    steps = [
        ("download", F.format_string("%s.tif", name), F.format_string("fetch %s %s.tif", name, name)),
        ("tile", F.format_string("%s.tiles", name), F.format_string(f"tile --zoom {level} %s.tif %s.tiles", name, name)),
        ("downsample", F.format_string("%s.pyramid", name), F.format_string("downsample %s.tiles %s.pyramid", name, name)),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(s).alias("step"), o.alias("output"), c.alias("command")) for i, (s, o, c) in enumerate(steps)])).alias("s")
    return scenes.select("scene_id", rows).select("scene_id", "s.n", "s.step", "s.output", "s.command")


def job_script(manifest: DataFrame) -> DataFrame:
    """(scene_id, script): a scene's steps as one idempotent shell text."""
    line = F.format_string("[ -f %s ] || %s", "output", "command")
    return manifest.groupBy("scene_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("l")))), lambda s: s["l"]), "\n").alias("script"))


def download_script(chunks: DataFrame, groups: int, output: str = "all.tiles") -> DataFrame:
    """(step, place, line): shell lines that download each chunk's list, merge the chunks by groups, and those into one.

    Each line does nothing where its output is there already.
    """
    line = lambda out, command: F.concat(F.lit("[ -f "), out, F.lit(" ] || "), command)
    one = chunks.select("chunk").distinct()
    name = F.format_string("chunk_%d", F.col("chunk").cast("long"))
    fetch = one.select(F.struct(F.lit(0).alias("step"), F.col("chunk").cast("int").alias("place")).alias("n"), line(F.concat(name, F.lit(".tiles")), F.concat(F.lit("fetch "), name, F.lit(".list "), name, F.lit(".tiles"))).alias("line"))
    node = F.format_string("merged_%d.tiles", F.col("node").cast("long"))
    some = merge_tree(chunks, groups)
    merge = some.select(F.struct(F.lit(1).alias("step"), F.col("node").cast("int").alias("place")).alias("n"), line(node, F.concat(F.lit("merge "), "inputs", F.lit(" "), node)).alias("line"))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.col("node").cast("long"))), lambda c: F.format_string("merged_%d.tiles", c)), " ")
    last = some.agg(names.alias("inputs")).select(F.struct(F.lit(2).alias("step"), F.lit(0).alias("place")).alias("n"), line(F.lit(output), F.concat(F.lit("merge "), "inputs", F.lit(f" {output}"))).alias("line"))
    return fetch.unionByName(merge).unionByName(last).select(F.col("n.step").alias("step"), F.col("n.place").alias("place"), "line")


def sample_metrics(metrics: DataFrame, every: int = 10) -> DataFrame:
    """The batches that are logged: every ``every``-th of an epoch."""
    return metrics.where(F.col("batch_idx") % every == 0)
