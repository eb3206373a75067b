"""Line dedup: repeated line runs by distributed prefix doubling over line ids.

All documents' lines, in the order of doc_id, are one sequence of line ids.  The
suffix array's intervals of a common prefix of h lines are named by the first
position in each; doubling takes the names at s and s + h to the names for 2h.
Only positions in intervals with two or more suffixes go on, so each round reads
less, and an interval's name says at once where its run occurs first.

A run that is deleted has at least ``MIN_WORDS`` words.  Every such run is the
union of its shortest qualifying windows, those from each line forward and those
from each line back, so doubling stops when the names reach the longest of these
(at most ``MIN_WORDS`` lines); longer common prefixes lie within what is marked.
A window that isn't the first of its interval is a later copy; its lines go.
Neighbouring deleted lines form the maximal repeated runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, append_columns, positional, restored, settle, text_bytes, unused, words

MIN_WORDS = 5


def windows(count: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first line, lines) of the shortest runs of ``least`` words from each line, forward and back."""
    total = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(len(count))
    end = np.searchsorted(total, total[:-1] + least)
    forward = end <= len(count)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    back = total[1:] >= least
    pairs = np.concatenate([np.stack([at, end - at], 1)[forward], np.stack([start, at + 1 - start], 1)[back]])
    return np.unique(pairs, axis=0).tolist()


def line_arrays(docs: DataFrame, least: int) -> DataFrame:
    """Per row of (doc_id, text): tag and the 128-bit ids of the lines that have a word, and windows."""

    def work():
        from xxhash import xxh3_128_digest, xxh3_64_intdigest

        def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
            data, off = text_bytes(column)
            raw = data.tobytes()
            starts, _, first = words(data, off, SPACED)
            tags, ids, spans = [], [], []
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                body = raw[a:b]
                tags.append(xxh3_64_intdigest(body) - (1 << 63))
                lines = body.split(b"\n")
                edge = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]) + a
                count = np.diff(np.searchsorted(starts[first[i] : first[i + 1]], edge))
                some = count > 0
                ids.append(np.frombuffer(b"".join(xxh3_128_digest(x) for x, ok in zip(lines, some.tolist(), strict=True) if ok), np.int64))
                spans.append([x for pair in windows(count[some], least) for x in pair])
            return [
                pa.array(tags, pa.int64()),
                pa.array([x[::2] for x in ids], pa.list_(pa.int64())),
                pa.array([x[1::2] for x in ids], pa.list_(pa.int64())),
                pa.array(spans, pa.list_(pa.int32())),
            ]

        return step

    return append_columns(docs, "text", "tag long, high array<long>, low array<long>, spans array<int>", work).drop("text")


def _named(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """(pos, name) of the rows whose ``keys`` occur more than once; name is the least pos."""
    names = rows.groupBy(*keys).agg(F.min("pos").alias("name"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(names, keys).select("pos", "name", *more)


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tag, gone): for each document that has later copies, the numbers of
    the lines (among those with a word) to delete.  tag is a hash of the text."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    arrays = line_arrays(source, min_words).where("size(high) > 0").dropDuplicates(["doc_id", "tag"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = arrays.repartitionByRange(parts, F.col("doc_id").asc_nulls_last(), "tag").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "tag")
    # Partition numbers follow the range, so these ids rise with doc_id.
    table = settle(sorted_.withColumn("mark", F.monotonically_increasing_id()))
    sizes = table.groupBy(F.shiftright("mark", 33).alias("part")).agg(F.count("*").alias("n"), F.max(F.size("high")).alias("lines")).orderBy("part").collect()
    if not sizes:
        return table.select("doc_id", "tag", F.array().cast("array<int>").alias("gone"))
    bits = max(r["lines"] for r in sizes).bit_length()
    base, offsets = 0, []
    for r in sizes:  # a row for each partition
        offsets.append((r["part"], base))
        base += r["n"]
    place = spark.createDataFrame(offsets, "part long, base long")
    numbered = table.withColumn("part", F.shiftright("mark", 33)).join(F.broadcast(place), "part")
    numbered = numbered.withColumn("at", F.shiftleft(F.col("base") + F.col("mark").bitwiseAND((1 << 33) - 1), bits))
    lines = numbered.select("at", F.posexplode(F.arrays_zip("high", "low"))).select((F.col("at") + F.col("pos")).alias("pos"), "col.high", "col.low")
    starts = F.expr("transform(sequence(0, CAST(size(spans) DIV 2 AS INT) - 1), i -> struct(spans[i * 2] AS s, spans[i * 2 + 1] AS m))")
    spans = numbered.where("size(spans) > 0").select("at", F.explode(starts).alias("w")).select((F.col("at") + F.col("w.s")).alias("pos"), F.col("w.m").alias("m"))
    longest = numbered.agg(F.max(F.expr("array_max(filter(spans, (x, i) -> i % 2 = 1))")).alias("m")).where("m IS NOT NULL")
    most = (longest.first() or {"m": 0})["m"]
    named, h, copies = settle(_named(lines, ["high", "low"])), 1, None
    while h <= most:
        own = spans.where((F.col("m") >= h) & (F.col("m") < 2 * h))
        if h == 1:
            later = own.join(named, "pos").where("name < pos").select("pos", "m")
        else:
            ends = named.select(F.col("pos").alias("_end"), F.col("name").alias("second"))
            both = own.join(named.withColumnRenamed("name", "first"), "pos").withColumn("_end", F.col("pos") + F.col("m") - h).join(ends, "_end")
            later = _named(both, ["m", "first", "second"], "m").where("name < pos").select("pos", "m")
        copies = later if copies is None else copies.unionByName(later)
        h *= 2
        if h <= most:
            ahead = named.select((F.col("pos") - h // 2).alias("pos"), F.col("name").alias("second"))
            pairs = named.withColumnRenamed("name", "first").join(ahead, "pos")
            named = settle(_named(pairs, ["first", "second"]))
    if copies is None:
        return table.limit(0).select("doc_id", "tag", F.array().cast("array<int>").alias("gone"))
    mask = (1 << bits) - 1
    gone = copies.select(F.shiftright("pos", bits).alias("doc"), F.explode(F.sequence(F.col("pos").bitwiseAND(mask), F.col("pos").bitwiseAND(mask) + F.col("m") - 1)).alias("line")).select("doc", F.col("line").cast("int"))
    gone = gone.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    keys = numbered.select(F.shiftright("at", bits).alias("doc"), "doc_id", "tag")
    return keys.join(gone, "doc").select("doc_id", "tag", "gone")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with n_lines, n_deleted, longest_run and kept_text.

    Lines are what ``\\n`` separates; n_lines and n_deleted count those with a
    word, longest_run the most deleted lines in a row.  kept_text is the text
    without the deleted lines (blank lines stay; null stays null).  The earlier
    of two runs is the one of the lower doc_id, null last, then the one nearer
    the text's start.  Rows alike in id and text are one document and get one
    result.  Columns of ``docs`` that are called like a new one are replaced.
    """
    copies = find_copies(docs, doc_id, text, min_words)
    # `gone` by document; the tag is computed again, so that any row finds its own.
    own, other, their, gone_lines = unused(docs, "own_tag", "copy_id", "copy_tag", "gone_lines")
    tagged = append_columns(docs, text, f"`{own}` long", _tag_work)
    side = copies.select(F.col("doc_id").alias(other), F.col("tag").alias(their), F.col("gone").alias(gone_lines))
    met = tagged.join(side, F.col(f"`{doc_id}`").eqNullSafe(F.col(other)) & (F.col(own) == F.col(their)), "left").drop(other, own, their)

    def work():
        def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
            data, off = text_bytes(column)
            raw = data.tobytes()
            lists = part.column(part.schema.get_field_index(gone_lines))
            lines_of, deleted, longest, kept = [], [], [], []
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                lines = raw[a:b].split(b"\n")
                full = [k for k, x in enumerate(lines) if x and not x.isspace()]
                lines_of.append(len(full))
                if not lists[i].is_valid:
                    deleted.append(0)
                    longest.append(0)
                    kept.append(raw[a:b].decode("utf-8", "replace") if column[i].is_valid else None)
                    continue
                gone = np.array(lists[i].as_py())
                step_at = np.concatenate([[0], np.flatnonzero(np.diff(gone) != 1) + 1, [len(gone)]])
                deleted.append(len(gone))
                longest.append(int(np.diff(step_at).max()))
                out = {full[k] for k in gone.tolist()}
                kept.append(b"\n".join(x for k, x in enumerate(lines) if k not in out).decode("utf-8", "replace"))
            return [pa.array(x, pa.int64()) for x in (lines_of, deleted, longest)] + [pa.array(kept, pa.string())]

        return step

    return append_columns(met, text, "n_lines long, n_deleted long, longest_run long, kept_text string", work).drop(gone_lines)


def _tag_work():
    from xxhash import xxh3_64_intdigest

    def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
        data, off = text_bytes(column)
        raw = data.tobytes()
        return [pa.array([xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.int64())]

    return step


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the kept texts; a document whose every line was a later copy goes."""
    at = [f"c{docs.columns.index(c)}_" for c in (doc_id, text)]
    done = dedup_lines(positional(docs), *at, min_words).where("n_deleted < n_lines OR n_deleted = 0")
    return restored(done, docs, text, "kept_text")
