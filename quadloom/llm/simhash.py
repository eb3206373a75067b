"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 32 segments of two bits are mapped to their bit counts.  The
Manhattan distance of two such vectors is a lower bound of the Hamming distance,
so links lie among pairs within Manhattan distance ``DISTANCE``.  Those pairs
are found on a grid: the dimensions are dealt into some groups, a distance of 4
touches at most 4 of them, so each linked pair shares the cell spanned by all but
some 4 groups.  Each distinct fingerprint is put into the cells of every such
choice; within a cell the Manhattan bound is tested, then the exact distance.
More fingerprints are dealt into more groups, so that cells of fingerprints that
have nothing to do with each other stay small.

Only distinct fingerprints are joined.  A cell emits a spanning forest of its
links, not its pairs; a cell with more than ``CELL`` fingerprints is dealt in
pairs of blocks over many tasks.  Cells that would burden the task that gathers
them are counted first and go to the block pairs without being gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, append_columns, apply_groups, mix, release, settle, text_bytes, unused, words
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
GROUPS = 7
CELL = 2048
#: Bits that tell two vectors apart, of the 64: a segment has 0, 1 or 2 set, 1.5 bits.
ENTROPY = 48
#: Bytes of cells in a bucket.
BUCKET = 64 << 20
#: Cells with so many fingerprints, and with at least so large a share of all, are never gathered.
HOT = 1 << 16
HOT_SHARE = 1 / 4096
#: Fingerprints that are counted at once, and how many of them a cell needs to be counted.
COUNTED, COUNT_FROM = 100_000, 16
#: Cells of up to this many fingerprints are compared by shifts of the sorted cells.
SMALL = 12
PAIRS = np.uint64(0x5555555555555555)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with fingerprint (long, the 64 bits as two's complement) and n_words.

    A-Z are lower-cased; a text of fewer words than a shingle is one shingle; a
    text without words, or null, has fingerprint zero.
    """

    def work():
        from xxhash import xxh64_intdigest

        def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
            data, off = text_bytes(column)
            data = LOWER[data]
            starts, ends, at = words(data, off, SPACED)
            count = np.diff(at)
            # Words joined by one space: keep the first separator after each word.
            keep = SPACED[data]
            tail = ends[ends < len(data)]
            tail = tail[~keep[tail]]
            keep[tail] = True
            place = np.cumsum(keep) - 1
            body = data[keep]
            body[~SPACED[body]] = 0x20
            body = body.tobytes()
            starts, ends = place[starts], place[ends - 1] + 1
            full = np.maximum(count - shingle + 1, (count > 0).astype(np.int64))
            row = np.repeat(np.arange(len(count)), full)
            begin = np.concatenate([[0], np.cumsum(full)])
            a = at[row] + np.arange(begin[-1]) - begin[row]
            b = np.minimum(a + shingle, at[row + 1]) - 1
            hashes = np.fromiter((xxh64_intdigest(body[x:y], seed) for x, y in zip(starts[a].tolist(), ends[b].tolist(), strict=True)), np.uint64, len(a))
            prints = np.zeros(len(count), np.uint64)
            some = np.flatnonzero(full)
            if len(some):
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, begin[some], axis=0, dtype=np.int32)
                prints[some] = np.packbits(ones * 2 > full[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
            return [pa.array(prints.view(np.int64)), pa.array(count.astype(np.int64))]

        return step

    return append_columns(docs, text, "fingerprint long, n_words long", work, limit=1 << 20)


def embed(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments in unary (00, 01, 11), so that the
    Manhattan distance of two vectors is the bit count of their difference."""
    low, high = prints & PAIRS, (prints >> np.uint64(1)) & PAIRS
    return (low | high) | ((low & high) << np.uint64(1))


def cell_masks(groups: int = GROUPS, distance: int = DISTANCE) -> list[int]:
    """Masks of the embedding for each choice of ``groups - distance`` groups."""
    edges = [round(32 * g / groups) * 2 for g in range(groups + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, groups - distance)]


def groups_for(n: int, distance: int = DISTANCE, cell: int = CELL) -> int:
    """The fewest groups for which cells of ``n`` independent fingerprints hold an eighth of ``cell`` on average."""
    groups = distance + 2
    while groups < 2 * distance + 4 and n > (cell / 8) * 2 ** (ENTROPY * (groups - distance) / groups):
        groups += 1
    return groups


def near(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Manhattan bound first, exact distance on what is left."""
    ok = np.bitwise_count(embed(a) ^ embed(b)) <= distance
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= distance
    return ok


def forest(a: np.ndarray, b: np.ndarray | None = None, distance: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked in ``a`` (or among ``a`` and ``b``), at most one fewer than members."""
    members = a if b is None else np.concatenate([a, b])
    left, out = np.arange(len(members)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            ok = near(np.full(len(left), members[x]), members[left], distance)
            got = left[ok]
            if len(got):
                out.append((np.full(len(got), members[x]), members[got]))
                queue.extend(got.tolist())
                left = left[~ok]
    return out


def _cells_of(prints: np.ndarray, masks: list[int]) -> np.ndarray:
    """The cells of all fingerprints by the first choice, then by the second, and so on."""
    vectors = embed(prints)
    return np.concatenate([mix((vectors & np.uint64(m)) + mix(np.array([i], np.uint64))) for i, m in enumerate(masks)])


def _count(batches: Iterator[pa.RecordBatch], masks: list[int], counted_at_once: int) -> Iterator[pa.RecordBatch]:
    """(cell, n) of cells with at least COUNT_FROM of ``counted_at_once`` fingerprints."""
    held, n = [], 0

    def counted():
        cells, size = np.unique(_cells_of(np.concatenate(held), masks), return_counts=True)
        some = size >= COUNT_FROM
        return pa.RecordBatch.from_arrays([pa.array(cells[some].view(np.int64)), pa.array(size[some].astype(np.int64))], ["cell", "n"])

    for batch in batches:
        held.append(batch.column(0).to_numpy().view(np.uint64))
        n += len(held[-1])
        if n >= counted_at_once:
            yield counted()
            held, n = [], 0
    if n:
        yield counted()


def hot_cells(prints: DataFrame, masks: list[int], cell: int = CELL, hot: int = HOT, counted: int = COUNTED) -> tuple[np.ndarray, np.ndarray]:
    """(cells, blocks) of the cells that aren't gathered, in order.

    Each choice of groups has each fingerprint once, so at most
    len(masks) / HOT_SHARE cells have that share: a bounded number.
    """
    least = max(hot, int(prints.count() * HOT_SHARE))
    counts = prints.mapInArrow(lambda it: _count(it, masks, counted), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least).collect()
    cells = np.array([r["cell"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(cells)
    return cells[order], np.array([-(-r["n"] // cell) for r in rows], np.int64)[order]


def _find(cells: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which cells are hot, and where in ``hot`` those are."""
    if not len(hot):
        return np.zeros(len(cells), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(hot, cells), len(hot) - 1)
    found = hot[at] == cells
    return found, at[found]


def _hot_members(batches: Iterator[pa.RecordBatch], masks: list[int], hot: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        cells = _cells_of(prints, masks)
        found, at = _find(cells, hot)
        u = np.tile(prints, len(masks))[found].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(blocks[at]), pa.array(cells[found].view(np.int64))], ["u", "blocks", "cell"])


def _deal(batches: Iterator[pa.RecordBatch], buckets: int, masks: list[int], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct fingerprints to one binary row for each bucket of cells, without the hot ones."""
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        cells = _cells_of(prints, masks)
        rows = np.stack([cells, np.tile(prints, len(masks))], axis=1)
        rows = rows[~_find(cells, hot)[0]]
        cells = rows[:, 0]
        bucket = (cells % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(edge))
        blobs = [rows[edge[k] : edge[k + 1]].tobytes() for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "rows"])


def _cells(rows: Iterator[pa.RecordBatch], distance: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links within the cells of a bucket; members of crowded cells, with the number of blocks."""
    blobs = [np.frombuffer(x, np.uint64).reshape(-1, 2) for b in rows for x in b.column("rows").to_pylist()]
    table = np.concatenate(blobs)
    table = table[np.argsort(table[:, 0], kind="stable")]
    cell, prints = table[:, 0], table[:, 1]
    edge = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
    size = np.diff(edge)
    u, v, blocks, where = [], [], [], []

    def links(pairs):
        for x, y in pairs:
            u.append(x)
            v.append(y)
            blocks.append(np.zeros(len(x), np.int64))
            where.append(np.zeros(len(x), np.int64))

    small = np.repeat(size <= SMALL, size)
    for shift in range(1, min(SMALL, len(cell))):
        i = np.flatnonzero((cell[shift:] == cell[:-shift]) & small[shift:])
        if not len(i):
            break
        ok = near(prints[i], prints[i + shift], distance)
        links([(prints[i[ok]], prints[i[ok] + shift])])
    for k in np.flatnonzero(size > SMALL):
        own = prints[edge[k] : edge[k + 1]]
        if len(own) <= most:
            links(forest(own, distance=distance))
        else:
            u.append(own)
            v.append(own)
            blocks.append(np.full(len(own), -(-len(own) // most), np.int64))
            where.append(np.full(len(own), cell[edge[k]]).view(np.int64))
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v, blocks, where)], ["u", "v", "blocks", "cell"])


def _block_pair(rows: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("side").to_numpy(), b.column("u").to_numpy().view(np.uint64)) for b in rows]
    side, prints = (np.concatenate(x) for x in zip(*parts, strict=True))
    found = forest(prints[side == 0], prints[side == 1], distance)
    if found:
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE, groups: int | None = None, cell: int = CELL, hot: int = HOT, counted: int = COUNTED) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within ``distance``.

    ``prints``: one long column of distinct values.  ``groups`` None: by their number.  The links span the same
    components as all pairs within the distance; they aren't all those pairs.
    Cells of more than ``cell`` fingerprints are dealt in blocks, those of about
    ``hot`` or more (counted ``counted`` fingerprints at a time) without being
    gathered first.
    """
    spark = prints.sparkSession
    n = prints.count()
    masks = cell_masks(groups or groups_for(n, distance, cell), distance)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, -(-16 * len(masks) * n // BUCKET))
    skip, sizes = hot_cells(prints, masks, cell, hot, counted)
    dealt = prints.mapInArrow(lambda it: _deal(it, buckets, masks, skip), "bucket long, rows binary")
    found = settle(apply_groups(dealt, ["bucket"], lambda it: _cells(it, distance, cell), "u long, v long, blocks long, cell long"))
    links = found.where("blocks = 0").select("u", "v")
    # Crowded cells: each fingerprint meets every block once, in the pair's own task.
    own = F.pmod(F.xxhash64("u"), "blocks")
    crowded = found.where("blocks > 0").select("u", "blocks", "cell")
    if len(skip):
        crowded = crowded.unionByName(prints.mapInArrow(lambda it: _hot_members(it, masks, skip, sizes), "u long, blocks long, cell long"))
    crowded = crowded.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = crowded.select("cell", "u", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    more = apply_groups(dealt, ["cell", "i", "j"], lambda it: _block_pair(it, distance), "u long, v long")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_words) for each row of ``docs``.

    component_id is the least doc_id whose fingerprint can be reached over links
    of at most ``distance`` bits.  Null ids are carried and never the least one:
    a component of null ids only has component_id null.  Repeated rows give
    repeated rows; an empty table an empty one.
    """
    done, member = _grouped(docs, doc_id, text, distance)
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return done.join(member, "fingerprint").select("doc_id", hexed, F.col("first.id").alias("component_id"), "n_words")


def _grouped(docs: DataFrame, doc_id: str, text: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """(rows of id, fingerprint, hash of the text, n_words; each fingerprint with the first row of its group).

    The first row is the one of the least id, null last, then of the least
    fingerprint and hash.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    done = settle(fingerprints(source.withColumn("mark", _mark("text"))).drop("text"))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), "fingerprint", "mark")
    least = settle(done.groupBy("fingerprint").agg(F.min(first).alias("least")))
    joined = settle(components(link_fingerprints(least.select("fingerprint"), distance)))
    grouped = least.join(joined, least.fingerprint == joined.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    of_root = grouped.groupBy("root").agg(F.min("least").alias("first"))
    return done, grouped.join(of_root, "root").select("fingerprint", "first")


def _mark(text: str):
    return F.xxhash64(F.lit(5), F.coalesce(F.col(text).cast("string"), F.lit("")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each group: that of the least id (null last), then the least fingerprint.

    Rows alike in id and text are one document and stay or go together; rows
    that share an id and differ in text are documents of their own, and so are
    rows without an id.
    """
    done, member = _grouped(docs, doc_id, text, distance)
    own = (F.col("doc_id").eqNullSafe(F.col("first.id"))) & (F.col("fingerprint") == F.col("first.fingerprint")) & (F.col("mark") == F.col("first.mark"))
    gone_id, gone_mark, mark = unused(docs, "gone_id", "gone_mark", "mark")
    dropped = done.join(member, "fingerprint").where(~own).select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct()
    marked = docs.withColumn(mark, _mark(text))
    return marked.join(dropped, F.col(f"`{doc_id}`").eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_mark)), "left_anti").drop(mark)
