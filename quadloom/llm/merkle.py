"""Merkle fixity audit of WARC archives.

Records lie in segments, one after the other, at the offsets of their WARC
serialisation.  A record's leaf is the SHA-256 of its bytes; a range of
``RANGE`` bytes of offsets hashes the records that begin in it, in the order of
their offsets; every ``FAN`` neighbouring ranges hash into the range above, up
to a segment's root, and every ``FAN`` segments into the node above, up to one
root.  Two replicas are compared from the root down: only children of nodes that
differ are read.

Payloads are hashed where they are read; what is shuffled is a record's offset,
length and digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

RANGE_BITS = 16
FAN_BITS = 4
#: Records that a segment holds on average.
SEGMENT = 4096


#: Of records whose capture has no date.
NO_DATE = "1970-01-01T00:00:00Z"


def warc_bytes(uri: Column, payload: Column, date: str = NO_DATE) -> Column:
    """A WARC/1.1 resource record: header block, payload, and the closing blank lines.

    The record id is a UUID made of the first 128 bits of SHA-256 of address and payload.
    """
    body, where = F.coalesce(payload.cast("binary"), F.lit(b"")), F.coalesce(uri, F.lit(""))
    name = F.regexp_replace(F.substring(F.sha2(F.concat(F.encode(where, "UTF-8"), F.lit(b"\n"), body), 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    lines = [F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), where]
    lines += [F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(F.encode(F.concat(*lines), "UTF-8"), body, F.lit(b"\r\n\r\n"))


def segment_of(key: Column, uri: Column, n: int) -> Column:
    """The first 32 bits of SHA-256 of id and address, modulo ``n``."""
    named = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(uri.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long"), F.lit(n))


def records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", segment: int = SEGMENT, copy: Callable[[Column], Column] | None = None) -> DataFrame:
    """(record_id, segment, offset, length, digest[, copy_length, copy_digest]): the archive's layout.

    Segments are dealt by a hash of id and address; within one, records follow
    id, then digest.  Null ids, addresses and payloads are allowed; a null
    payload is an empty one.  ``copy`` maps a record's bytes to those that another
    replica holds at its place (null: nothing); they are hashed in the same pass.
    Repeated rows are records of their own, one after the other; other columns
    aren't read.
    """
    n = max(1, -(-pages.count() // segment))
    raw = warc_bytes(F.col(uri).cast("string"), F.col(payload))
    more = []
    if copy is not None:
        other = copy(raw)
        more = [F.octet_length(other).cast("long").alias("copy_length"), F.sha2(other, 256).alias("copy_digest")]
    rows = pages.select(F.col(key).alias("record_id"), segment_of(F.col(key), F.col(uri), n).alias("segment"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("digest"), *more)
    # About `segment` rows of numbers in a window, but for rows that are alike in id and address.
    before = Window.partitionBy("segment").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("record_id", "segment", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), *rows.columns[2:])


def copies(laid: DataFrame) -> DataFrame:
    """What the other replica holds, as ``records`` that lie where its manifest says."""
    return laid.where("copy_digest IS NOT NULL").select("record_id", "segment", "offset", F.col("copy_length").alias("length"), F.col("copy_digest").alias("digest"))


def tree(records: DataFrame, depth: int, tops: int) -> DataFrame:
    """(level, segment, node, hash, n_records): all nodes, leaves' ranges at level 0.

    ``depth``: levels within a segment; ``tops``: levels above segments, whose
    node is a range of segments.  Nulls in offset or digest aren't allowed.
    """
    def joined(order: str, value: Column) -> Column:
        listed = F.sort_array(F.collect_list(F.struct(order, value.alias("v"))))
        return F.sha2(F.concat_ws("|", F.transform(listed, lambda x: x["v"])), 256).alias("hash")

    leaf = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest")
    now = records.groupBy("segment", F.shiftright("offset", RANGE_BITS).alias("node")).agg(joined("offset", leaf), F.count("*").alias("n_records"))
    levels = [now.select(F.lit(0).alias("level"), "segment", "node", "hash", "n_records")]
    for level in range(1, depth + tops):
        if level < depth:
            group = [F.col("segment"), F.shiftright("node", FAN_BITS).alias("node")]
            now = now.withColumn("child", F.col("node"))
        else:
            group = [F.shiftright("segment", FAN_BITS).alias("segment"), F.lit(0).cast("long").alias("node")]
            now = now.withColumn("child", F.col("segment"))
        now = now.groupBy(*group).agg(joined("child", F.concat_ws(":", F.col("child").cast("string"), "hash")), F.sum("n_records").alias("n_records"))
        levels.append(now.select(F.lit(level).alias("level"), "segment", "node", "hash", "n_records"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(record_id, segment, offset, length, fault, range_start, range_end, range_hash, other_range_hash,
    root, other_root) of each record that differs.

    Both sides have the columns of ``records``; a replica keeps the offsets of
    the manifest it was copied by.  fault is `changed` (length or digest differ),
    `missing` (the replica has nothing at that offset) or `extra`.  range_hash is
    the node of the record's range, root that of the whole tree, null where a
    side has none.  Two empty replicas are equal; equal rows at one place count
    as one.  A column of another name isn't read.
    """
    sides = [settle(x.select("record_id", "segment", "offset", "length", "digest")) for x in (primary, replica)]
    reach = sides[0].unionByName(sides[1]).agg(F.max("offset").alias("o"), F.max("segment").alias("s")).first()
    depth, tops = 1, 0
    while (reach["o"] or 0) >> (RANGE_BITS + FAN_BITS * (depth - 1)):
        depth += 1
    while (reach["s"] or 0) >> (FAN_BITS * tops):
        tops += 1
    trees = [settle(tree(x, depth, tops)) for x in sides]
    suspect, roots = None, None
    for level in range(depth + tops - 1, -1, -1):
        a, b = (t.where(F.col("level") == level).select("segment", "node", "hash") for t in trees)
        if suspect is not None:
            if level + 1 >= depth:  # the parent is a range of segments
                up = [F.shiftright("segment", FAN_BITS).alias("_s"), F.lit(0).cast("long").alias("_n")]
            else:
                up = [F.col("segment").alias("_s"), F.shiftright("node", FAN_BITS).alias("_n")]
            parents = suspect.select(F.col("segment").alias("_s"), F.col("node").alias("_n"))
            a, b = (x.select("*", *up).join(parents, ["_s", "_n"], "left_semi").drop("_s", "_n") for x in (a, b))
        b = b.withColumnRenamed("hash", "other")
        suspect = settle(a.join(b, ["segment", "node"], "full_outer").where("NOT (hash <=> other)"))
        if roots is None:
            top = suspect.select("hash", "other").first() or (None, None)  # the one row of the highest level
            roots = [F.lit(x).cast("string").alias(c) for x, c in zip(top, ("root", "other_root"), strict=True)]
    places = suspect.select("segment", "node", F.col("hash").alias("range_hash"), F.col("other").alias("other_range_hash"))
    found = []
    for x in sides:
        ranged = x.withColumn("node", F.shiftright("offset", RANGE_BITS))
        found.append(ranged.join(places, ["segment", "node"], "left_semi"))
    a, b = found
    b = b.select("segment", "node", "offset", F.col("record_id").alias("other_id"), F.col("length").alias("other_length"), F.col("digest").alias("other"))
    met = a.join(b, ["segment", "node", "offset"], "full_outer").where("NOT (digest <=> other AND length <=> other_length)")
    fault = F.when(F.col("digest").isNull(), "extra").when(F.col("other").isNull(), "missing").otherwise("changed")
    met = met.join(places, ["segment", "node"])
    return met.select(
        F.coalesce("record_id", "other_id").alias("record_id"), "segment", "offset", F.coalesce("length", "other_length").alias("length"), fault.alias("fault"),
        F.shiftleft("node", RANGE_BITS).alias("range_start"), F.shiftleft(F.col("node") + 1, RANGE_BITS).alias("range_end"), "range_hash", "other_range_hash", *roots,
    )
