"""Masks, patches, attention biases and losses as tables.

A batch is a bounded group of samples (as in training), so pairwise losses grow
with the number of samples, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nn
from ..functions.bind import once

BATCH = 32
TEMPERATURE = 0.07
EPS = 1e-6


def noise(sample: Column, patch: Column) -> Column:
    """Repeatable stand-in for random noise: a fixed integer mix."""
    return F.pmod(sample * 7919 + patch * 104729 + 12345, F.lit(1000003))


def kept_count(patches: int, ratio: float) -> int:
    return int(patches * (1 - ratio))


def mask(samples: DataFrame, patches: int, ratio: float = 0.4) -> DataFrame:
    """(sample, patch, rank, keep): the patches of least noise are kept; rank is ids_restore."""
    rows = samples.select("sample", F.explode(F.sequence(F.lit(0), F.lit(patches - 1))).alias("patch"))
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(noise(F.col("sample"), F.col("patch")), "patch")) - 1
    return rows.select("sample", "patch", rank.alias("rank")).withColumn("keep", F.col("rank") < kept_count(patches, ratio))


def mask_arrays(masks: DataFrame) -> DataFrame:
    """(sample, ids_restore, ids_keep, mask_for_mae) as arrays."""
    rows = F.sort_array(F.collect_list(F.struct("patch", "rank", "keep")))
    by_rank = F.sort_array(F.collect_list(F.when(F.col("keep"), F.struct("rank", "patch"))))
    out = masks.groupBy("sample").agg(rows.alias("r"), by_rank.alias("k"))
    return out.select("sample", F.transform("r", lambda x: x["rank"]).alias("ids_restore"), F.transform("k", lambda x: x["patch"]).alias("ids_keep"), F.transform("r", lambda x: 1 - x["keep"].cast("int")).alias("mask_for_mae"))


def mask_maxpool(masks: DataFrame, side: int) -> DataFrame:
    """(sample, row, col, removed) on the half grid: removed if any of four is."""
    row, col = F.floor(F.col("patch") / side), F.col("patch") % side
    return masks.groupBy("sample", F.floor(row / 2).cast("int").alias("row"), F.floor(col / 2).cast("int").alias("col")).agg(F.max((~F.col("keep")).cast("int")).alias("removed"))


def mask_gather(patches: DataFrame, masks: DataFrame) -> DataFrame:
    """(sample, rank, elem, v) of the kept patches."""
    return patches.join(masks.where("keep"), ["sample", "patch"]).select("sample", "rank", "elem", "v")


def mae_restore(patches: DataFrame, masks: DataFrame, token: float = 0.0) -> DataFrame:
    """(sample, patch, elem, v): kept values in place, the mask token elsewhere."""
    return patches.join(masks, ["sample", "patch"]).select("sample", "patch", "elem", F.when(F.col("keep"), F.col("v")).otherwise(F.lit(token)).alias("v"))


def patch_normalize(patches: DataFrame) -> DataFrame:
    """Each value less its patch's mean, over the root of its sample variance."""
    stats = patches.groupBy("sample", "patch").agg(F.avg("v").alias("_m"), F.var_samp("v").alias("_s"))
    return patches.join(stats, ["sample", "patch"]).select("sample", "patch", "elem", ((F.col("v") - F.col("_m")) / F.sqrt(F.col("_s") + EPS)).alias("v"))


def mean_pool(patches: DataFrame) -> DataFrame:
    return patches.groupBy("sample", "elem").agg(F.avg("v").alias("v"))


def mae_loss(patches: DataFrame, predicted: DataFrame, masks: DataFrame, batch: int = BATCH) -> DataFrame:
    """(batch, loss): masked mean of the patches' squared errors against normalised targets."""
    errors = patch_normalize(patches).join(predicted.select("sample", "patch", "elem", F.col("v").alias("p")), ["sample", "patch", "elem"]).groupBy("sample", "patch").agg(F.avg(F.pow(F.col("p") - F.col("v"), 2)).alias("l"))
    removed = errors.join(masks.where("NOT keep").select("sample", "patch"), ["sample", "patch"])
    return removed.groupBy(F.floor(F.col("sample") / batch).alias("batch")).agg((F.sum("l") / F.count("*")).alias("loss"))


def slopes(spark: SparkSession, heads: int) -> DataFrame:
    """(head, slope); as many rows as heads."""
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(nn.slopes(heads))], "head int, slope double")


def grid_bias(spark: SparkSession, heads: int, patches: int, scale: float = 1.0) -> DataFrame:
    """(head, i, j, bias): a constant of the model, so heads * patches^2 rows whatever the data."""
    side = math.isqrt(patches)
    grid = spark.range(patches * patches).select(F.floor(F.col("id") / patches).cast("int").alias("i"), (F.col("id") % patches).cast("int").alias("j"))
    far = lambda f: F.pow(f("i") - f("j"), F.lit(2))
    distance = F.sqrt(far(lambda c: F.floor(F.col(c) / side)) + far(lambda c: F.col(c) % side))
    each = F.posexplode(F.array(*[F.lit(float(s)) for s in nn.slopes(heads)])).alias("head", "slope")
    table = grid.select("i", "j", distance.alias("d"), each)
    return table.select("head", "i", "j", (-F.col("slope") * F.lit(scale) * F.col("d") + 0.0).alias("bias"))


def bias_stride(bias: DataFrame, stride: int = 4) -> DataFrame:
    """Every ``stride``-th column, renumbered."""
    return bias.where(F.col("j") % stride == 0).select("head", "i", F.floor(F.col("j") / stride).cast("int").alias("j"), "bias")


def bias_gather(bias: DataFrame, masks: DataFrame) -> DataFrame:
    """(sample, head, i, j, bias) of each sample's kept patches, numbered by rank."""
    keep = masks.where("keep").groupBy("sample").agg(F.collect_list(F.struct("rank", "patch")).alias("k"))
    pairs = keep.select("sample", F.explode("k").alias("a"), "k").select("sample", "a", F.explode("k").alias("b"))
    model = F.broadcast(bias.select("head", F.col("i").alias("_i"), F.col("j").alias("_j"), "bias"))  # a constant of the model
    return pairs.join(model, (F.col("a.patch") == F.col("_i")) & (F.col("b.patch") == F.col("_j"))).select("sample", "head", F.col("a.rank").alias("i"), F.col("b.rank").alias("j"), "bias")


def bias_gather_rect(bias: DataFrame, low: int, stride: int = 4, flat: bool = False) -> DataFrame:
    """(head, q, k, bias) of low-resolution queries q and high-resolution keys k.

    ``bias``: the high-resolution square.  ``flat`` reads the strided tensor
    with the row-major index q * low + k, as the published weights expect.
    """
    rect = bias_stride(bias, stride)
    if flat:
        at = F.col("i") * low + F.col("j")
        q = F.explode(F.sequence(F.lit(0), F.lit(low - 1))).alias("q")
        return rect.select("head", "bias", at.alias("at")).select("*", q).select("head", "q", (F.col("at") - F.col("q") * low).cast("int").alias("k"), "bias").where((F.col("k") >= 0) & (F.col("k") < low * stride))
    return rect.select("head", F.col("j").alias("q"), F.col("i").alias("k"), "bias")


def sincos(spark: SparkSession, dim: int, side: int) -> DataFrame:
    """(position, elem, value) of the two-dimensional sine and cosine embedding."""
    quarter = dim // 4
    cell = spark.range(side * side * dim).select(F.floor(F.col("id") / dim).cast("int").alias("position"), (F.col("id") % dim).cast("int").alias("elem"))
    part = F.floor(F.col("elem") / quarter)
    at = F.when(part < 2, F.col("position") % side).otherwise(F.floor(F.col("position") / side))
    angle = at / F.pow(F.lit(10000.0), (F.col("elem") % quarter) / quarter)
    return cell.select("position", "elem", F.when(part % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column) -> Column:
    """The array over its norm; zeros stay zeros."""
    own = F.struct(a.alias("a"), F.sqrt(dot(a, a)).alias("n"))
    return once(own, lambda s: F.transform(s["a"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(F.lit(0.0))))


def logits(pairs: DataFrame, batch: int = BATCH, temperature: float = TEMPERATURE) -> DataFrame:
    """(batch, i, j, logit) within each batch of (sample, a, b)."""
    rows = pairs.select("sample", F.floor(F.col("sample") / batch).alias("batch"), l2_normalize(F.col("a")).alias("a"), l2_normalize(F.col("b")).alias("b"))
    left, right = rows.select("batch", F.col("sample").alias("i"), "a"), rows.select("batch", F.col("sample").alias("j"), "b")
    return left.join(right, "batch").select("batch", "i", "j", (dot(F.col("a"), F.col("b")) / temperature).alias("logit"))


def _entropy(table: DataFrame, own: str, name: str) -> DataFrame:
    """(batch, name): mean over the rows (own: i) or columns (own: j) of the cross entropy of the matching pair."""
    rows = table.groupBy("batch", own).agg((F.log(F.sum(F.exp("logit"))) - F.max(F.when(F.col("i") == F.col("j"), F.col("logit")))).alias("l"))
    return rows.groupBy("batch").agg(F.avg("l").alias(name))


def contrastive_loss(table: DataFrame) -> DataFrame:
    """(batch, loss): cross entropy of the matching pair, mean over rows and over columns, halved."""
    return _entropy(table, "i", "one").join(_entropy(table, "j", "two"), "batch").select("batch", ((F.col("one") + F.col("two")) / 2).alias("loss"))


def contrastive_three(pair: DataFrame, own: DataFrame) -> DataFrame:
    """(batch, loss): mean of three, both ways of the pair's logits and the third modality against itself."""
    sides = _entropy(pair, "i", "one").join(_entropy(pair, "j", "two"), "batch").join(_entropy(own, "i", "three"), "batch")
    return sides.select("batch", ((F.col("one") + F.col("two") + F.col("three")) / 3).alias("loss"))


def attention_weights(patches: DataFrame, slope: float, side: int) -> DataFrame:
    """(sample, i, j, w): softmax of scaled dot products plus the grid bias, each sample by itself."""
    tokens = patches.groupBy("sample", "patch").agg(F.transform(F.sort_array(F.collect_list(F.struct("elem", "v"))), lambda s: s["v"]).alias("t"))
    left, right = tokens.select("sample", F.col("patch").alias("i"), F.col("t").alias("q")), tokens.select("sample", F.col("patch").alias("j"), F.col("t").alias("k"))
    rows = F.floor(F.col("i") / side) - F.floor(F.col("j") / side)
    columns = F.col("i") % side - F.col("j") % side
    score = dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q")) - slope * F.sqrt(rows * rows + columns * columns)
    scored = left.join(right, "sample").select("sample", "i", "j", score.alias("s"))
    own = Window.partitionBy("sample", "i")
    e = F.exp(F.col("s") - F.max("s").over(own))
    return scored.select("sample", "i", "j", e.alias("e")).withColumn("w", F.col("e") / F.sum("e").over(own)).drop("e")


def project(images: DataFrame, height: int, width: int, channels: int, patch: int = 2, dim: int = 16, heads: int = 4, depth: int = 2, weights: dict | None = None) -> DataFrame:
    """(tile, pooled): embeddings of (tile, data) by the encoder, in Arrow batches; weights are broadcast."""
    sent = images.sparkSession.sparkContext.broadcast(weights or nn.init_vit(channels, patch, dim, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = np.stack([np.asarray(x, float) for x in b.column(1).to_pylist()])
            chw = flat.reshape(-1, height, width, channels).transpose(0, 3, 1, 2) / 255
            _, pooled = nn.project(chw, sent.value, patch, heads, depth)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(pooled.astype(np.float32)), pa.list_(pa.float32()))], ["tile", "pooled"])

    return images.select("tile", "data").mapInArrow(run, "tile long, pooled array<float>")
