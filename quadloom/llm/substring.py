"""Near-duplicate passages by compact windows.

A text is the sequence of its five-word shingles.  For each of ``HASHES`` hash
functions, the node of the sequence's Cartesian tree (least hash on top) at
position c stands for all subsequences whose least hash is at c: those within
the compact window [l, r] that reaches from c to the next smaller hash on either
side.  Windows that hold a passage of ``PASSAGE`` words are those whose c is the
least of some ``PASSAGE - 4`` shingles, found by sliding minima.

A pair of texts is a candidate where windows of at least two hash functions
overlap by a passage in both texts; its passages are then compared shingle by
shingle.  Windows whose least hash no other text has are dropped first.  The rest
come back to their text, where every two that overlap by a passage make a key of
their two hashes: texts that share a key are the candidates, and a hash that many
texts have makes no pair by itself.

Words that very many texts share can be the least ones of several functions, and
hide what a few texts share around them.  So one more function, whose tokens are
runs of ``RUN`` shingles, has windows of its own: texts that agree on such a
token are a candidate by it alone, and equal passages always have one in common.

Which of a key's pairs are compared
-----------------------------------

Equal texts are one text throughout.  First each text of a key is compared with
the one of the least tag (in a task, then across tasks).  Texts that verified
passages connect, directly or over others, make one class.  Where the texts of a
key are of several classes, the shingles around the key's place meet in cells, and
all pairs of texts of different classes are compared there, but for those that
have too few in common, or that pairs of the cell have connected by then; texts
with the same shingles around the place are compared once.
So no two texts that share a key and a similar passage are left in different
classes, and a group of thousands of copies costs a few comparisons a copy.
Within a class not every pair is compared, so the passages found are those that
connect it, and those that texts share with the first one of a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, append_columns, apply_groups, blocks, lean, mix, release, runs, settle, text_bytes, words
from .components import components

SHINGLE = 5
PASSAGE = 50
SIMILAR = 0.8
HASHES = 5
#: Shingles in a token of the function of long tokens (a power of two), whose number is HASHES.
RUN = 32
#: Shingles that a window is followed to each side, 2**bits - 1: a passage of PASSAGE words reaches
#: less far from its least hash, and longer passages hold passages of that size.
REACH_BITS = 6
#: Of equal neighbouring shingles one in so many is kept: 2**REACH_BITS - THIN shingles hold a passage.
THIN = 16
#: Texts of one key in a block.
BLOCK = 512
#: Blocks of a key beyond which its texts meet by shingle, and not in pairs of blocks.
CROWDED = 32
#: Most pairs of a cell that are compared before those are left out that they connect.
WAVE = 2048
#: Ranges asked of a text at once, and pairs that a bucket compares.
ASKED, COMPARED = 2000, 20_000
#: Rows of keys in a bucket.
CROSSED = 50_000
#: Words of text for each bucket of windows (about 40 MB).
BUCKET_WORDS = 4_000_000
#: Windows, or pairs, that a task gathers before it combines and sends them.
GATHER = 1_000_000
#: Bytes of text that are hashed at once; a longer text alone.
BLOCK_BYTES = 1 << 19
#: The most texts whose keys are broadcast to choose the texts to compare; beyond, they are joined.
BROADCAST_KEYS = 1_000_000
#: Parts in which the texts of one class meet its least id.
SALTS = 256
#: Matching shingles this far apart still belong to one passage.
GAP = 20


_ODD = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, up to n - 1; kept for the next call."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            each = np.full(2 * n, base, np.uint64)
            each[0] = 1
            _POWERS[k] = np.multiply.accumulate(each)
    return [x[:n] for x in _POWERS]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a polynomial by prefix sums, then mixed."""
    power, back = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    each = data.astype(np.uint64)
    each += np.uint64(1)
    each *= power[:-1]
    np.cumsum(each, out=total[1:])
    own = total[ends]
    own -= total[starts]
    own *= back[starts]
    return mix(own)


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, count): 64-bit hashes of the shingles; rows' ranges of words.

    The hash at a word is that of the shingle that begins there, valid for all
    but a row's last ``size - 1`` words.
    """
    data = LOWER[data]
    starts, ends, first = words(data, off, SPACED)
    each = word_hashes(data, starts, ends)
    total = np.zeros(max(0, len(each) - size + 1), np.uint64)
    for j in range(size):
        total *= np.uint64(_ODD)
        total += each[j : j + len(total)]
    return mix(total), first, np.diff(first)


def run_hashes(hashes: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hashes of the runs of ``run`` shingles, by doubling."""
    step = 1
    while step < run and len(hashes) > step:
        hashes = mix(hashes[:-step] * np.uint64(3) + hashes[step:])
        step *= 2
    return hashes if step == run else hashes[:0]


def all_windows(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, least: int) -> list[tuple[np.ndarray, ...]]:
    """The compact windows of each function; the last one's tokens are runs, where a passage holds more than one."""
    out = compact_windows(hashes, first, count, least)
    if out and least > RUN:
        out += compact_windows(run_hashes(hashes), first, count, least - RUN + 1, SHINGLE + RUN - 1, 1)
    return out


def _seed(f: int) -> np.uint64:
    return mix(np.array([f + 1], np.uint64))[0]


def compact_windows(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, least: int, size: int = SHINGLE, functions: int = HASHES) -> list[tuple[np.ndarray, ...]]:
    """Per hash function (value, row, c, left, right) of the windows that hold ``least`` shingles.

    c is the shingle's number in its row; left and right the reach to its sides.
    """
    n = len(hashes)
    end = first[:-1] + count - size + 1  # of a row's shingles
    out = []
    if n < least:
        return out
    row_of = np.repeat(np.arange(len(count)), count)[:n]
    last = end[row_of]
    valid = np.arange(n - least + 1) + least <= last[: n - least + 1]
    if not valid.any():
        return out
    for f in range(functions):
        own = mix(hashes ^ _seed(f))
        key = (own & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        tables, k = [key], 0
        while 2 << k <= max(least, 1 << REACH_BITS) and len(tables[-1]) > 1 << k:
            tables.append(np.minimum(tables[-1][: -(1 << k)], tables[-1][1 << k :]))
            k += 1
        k = int(least).bit_length() - 1
        wide = np.minimum(tables[k][: n - least + 1], tables[k][least - (1 << k) : least - (1 << k) + n - least + 1])
        c = (wide[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        c = c[np.concatenate([[True], c[1:] != c[:-1]])]
        row = row_of[c]
        # Of a run of one shingle each place is a least one; the first of every THIN reaches as far.
        fresh = np.concatenate([[True], (own[c[1:]] != own[c[:-1]]) | (row[1:] != row[:-1])])
        since = c - c[np.maximum.accumulate(np.where(fresh, np.arange(len(c)), 0))]
        thin = fresh.copy()
        thin[1:] |= since[1:] // THIN != since[:-1] // THIN
        c, row = c[thin], row[thin]
        left, right = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for k in range(min(REACH_BITS, len(tables)) - 1, -1, -1):
            step, t = 1 << k, tables[k]
            at = c - left - step
            ok = at >= first[row]
            ok[ok] = t[np.minimum(at[ok], len(t) - 1)] > key[c[ok]]
            left += step * ok
            at = c + right + 1
            ok = at + step <= end[row]
            ok[ok] = t[np.minimum(at[ok], len(t) - 1)] > key[c[ok]]
            right += step * ok
        out.append((own[c], row, c - first[row], left, right))
    return out


def _pack(c: np.ndarray, left: np.ndarray, right: np.ndarray, f: int) -> np.ndarray:
    return (c.astype(np.uint64) << np.uint64(24)) | (left.astype(np.uint64) << np.uint64(16)) | (right.astype(np.uint64) << np.uint64(8)) | np.uint64(f)


def _unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first shingle, last shingle, the least one, function)."""
    c, left, right = ((p >> np.uint64(s)).astype(np.int64) & m for s, m in ((24, (1 << 40) - 1), (16, 255), (8, 255)))
    f = (p & np.uint64(255)).astype(np.int64)
    return c - left, c + right + (RUN - 1) * (f == HASHES), c, f


#: In place of a window: says that another text has the hash.
WITNESS = np.uint64(0xFFFFFFFFFFFFFFFF)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The different rows, in order of their columns."""
    rows = rows[np.argsort(rows[:, 0])]
    keep = np.ones(len(rows), bool)
    same = rows[1:, 0] == rows[:-1, 0]
    tied = np.zeros(len(rows), bool)
    tied[1:] = same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    part = rows[at]
    rows[at] = part[np.lexsort(part.T[::-1])]
    keep[1:] = ~same | (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)
    return rows[keep]


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, texts) of each row's run of equal values; rows are in order of (value, text)."""
    edge = runs(rows[:, 0])
    new = np.ones(len(rows), np.int64)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    size = np.diff(edge)
    return np.repeat(edge[:-1], size), np.repeat(np.add.reduceat(new, edge[:-1]), size) if len(rows) else new


def _first_places(rows: np.ndarray) -> np.ndarray:
    """Of rows in order, the first of each (value, text)."""
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[keep]


def _dealt(kind: int, rows: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = np.ascontiguousarray(rows[order]), bucket[order]
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edge))
    if len(used):
        blobs = [rows[edge[k] : edge[k + 1]].tobytes() for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(np.full(len(used), kind, np.int32)), pa.array(blobs, pa.binary())], ["bucket", "kind", "rows"])


def _of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(x) % np.uint64(buckets)).astype(np.int64)


def _read(batches: Iterator[pa.RecordBatch], width: int, kind: int | None = None) -> np.ndarray:
    blobs = [np.zeros((0, width), np.uint64)]
    for b in batches:
        for x, k in zip(b.column("rows").to_pylist(), b.column("kind").to_pylist(), strict=True):
            if kind is None or k == kind:
                blobs.append(np.frombuffer(x, np.uint64).reshape(-1, width))
    return np.concatenate(blobs)


def _sketch(batches: Iterator[pa.RecordBatch], least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows (value, text, place) by a bucket of their least hash (kind 0).

    Those whose hash two texts of a task have go to a bucket of their text at
    once (kind 1), and one row stays to tell other tasks of it: a hash that very
    many texts have isn't gathered anywhere.
    """
    held, n, seen = [], 0, set()

    def send():
        rows = _distinct(np.concatenate(held))
        start, texts = _runs(rows)
        shared = texts > 1
        yield from _dealt(1, rows[shared], _of(rows[shared, 1], buckets), buckets)
        tell = rows[shared & (start == np.arange(len(rows)))]
        tell[:, 2] = WITNESS
        rows = np.concatenate([rows[~shared], tell])
        yield from _dealt(0, rows, (rows[:, 0] % np.uint64(buckets)).astype(np.int64), buckets)

    for batch in batches:
        for part in blocks(batch, 1, BLOCK_BYTES):
            tag = part.column(0).to_numpy()
            new = np.array([t not in seen and not seen.add(t) for t in tag.tolist()], bool)
            part = part.filter(pa.array(new))
            tag = tag[new].view(np.uint64)
            data, off = text_bytes(part.column(1))
            hashes, first, count = shingles(data, off)
            for f, (value, row, c, left, right) in enumerate(all_windows(hashes, first, count, least)):
                held.append(np.stack([value, tag[row], _pack(c, left, right, f)], axis=1))
                n += len(value)
            if n >= GATHER:
                yield from send()
                held, n = [], 0
    if n:
        yield from send()


def _shared(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows whose least hash two texts or more have, by a bucket of the text."""
    batches = list(batches)
    known, rows = _read(batches, 3, 1), _distinct(_read(batches, 3, 0))
    start, texts = _runs(rows)
    told = np.zeros(len(rows), bool)
    told[start[rows[:, 2] == WITNESS]] = True
    rows = np.concatenate([known, rows[((texts > 1) | told[start]) & (rows[:, 2] != WITNESS)]])
    yield from _dealt(0, rows, _of(rows[:, 1], buckets), buckets)


def _range(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (lo.astype(np.uint64) << np.uint64(32)) | hi.astype(np.uint64)


def _ends(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _place(lo: np.ndarray, at: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A shingle and the range around it in one number."""
    return (at.astype(np.uint64) << np.uint64(24)) | ((at - lo).astype(np.uint64) << np.uint64(12)) | (hi - at).astype(np.uint64)


def _around(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, left, right = ((place >> np.uint64(s)).astype(np.int64) & m for s, m in ((24, (1 << 40) - 1), (12, 4095), (0, 4095)))
    return at - left, at, at + right


def _text_keys(rows: np.ndarray, least: int) -> np.ndarray:
    """(key, text, place) of every two windows of a text that overlap by a passage, and of each one
    of long tokens; the first place of a key in each text."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1]))]
    rows = rows[np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)])]
    value, text = rows[:, 0], rows[:, 1]
    lo, hi, c, f = _unpack(rows[:, 2])
    far = f == HASHES
    made = [np.stack([mix(value[far]), text[far], _place(lo[far], c[far], hi[far])], axis=1)]
    value, text, lo, hi, c, f = (x[~far] for x in (value, text, lo, hi, c, f))
    i = np.arange(len(f))
    for d in range(1, len(f)):
        i = i[i + d < len(f)]
        i = i[(text[i] == text[i + d]) & (c[i + d] - c[i] < least + THIN)]  # both least hashes lie in one passage
        if not len(i):
            break
        j = i + d
        ok = (f[i] != f[j]) & (np.minimum(hi[i], hi[j]) - np.maximum(lo[i], lo[j]) + 1 >= least)
        x, y = i[ok], j[ok]
        one, two = np.where(f[x] < f[y], x, y), np.where(f[x] < f[y], y, x)
        made.append(np.stack([mix(value[one] + mix(value[two])), text[x], _place(np.minimum(lo[x], lo[y]), c[one], np.maximum(hi[x], hi[y]))], axis=1))
    return _first_places(_distinct(np.concatenate(made)))


def _star(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows (a, b, range in a, range in b): each text of a key with the first one."""
    at = np.flatnonzero(start != np.arange(len(rows)))
    return _pairs_of(rows[start[at], 1], rows[at, 1], rows[start[at], 2], rows[at, 2])


def _pairs_of(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    (al, _, ar), (bl, _, br) = _around(at_a), _around(at_b)
    return _merged(np.stack([a, b, _range(al, ar), _range(bl, br)], axis=1))


def _keys(batches: Iterator[pa.RecordBatch], least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of the keys of a bucket of texts: pairs of each text with a key's first (kind 1), by a bucket
    of the two; that first text (kind 0), with how many there are, by a bucket of the key; and the
    others (kind 3)."""
    rows = _text_keys(_read(batches, 3), least)
    start, texts = _runs(rows)
    pairs = _star(rows, start)
    yield from _dealt(1, pairs, _of(pairs[:, 0] + mix(pairs[:, 1]), buckets), buckets)
    top = start == np.arange(len(rows))
    yield from _dealt(3, rows[~top], np.zeros((~top).sum(), np.int64), 1)
    first = np.concatenate([rows[top], texts[top, None].astype(np.uint64)], axis=1)
    yield from _dealt(0, first, (first[:, 0] % np.uint64(buckets)).astype(np.int64), buckets)


def _meet(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs (kind 1) of the first texts of the tasks that have a key; those of keys of three texts or more (kind 3)."""
    rows = _read(batches, 4)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    start = _runs(rows)[0]
    pairs = _star(rows, start)
    yield from _dealt(1, pairs, _of(pairs[:, 0] + mix(pairs[:, 1]), buckets), buckets)
    total = np.zeros(len(rows), np.int64)
    np.add.at(total, start, rows[:, 3].astype(np.int64))
    more = rows[total[start] > 2, :3]
    yield from _dealt(3, more, np.zeros(len(more), np.int64), 1)


def _merged(rows: np.ndarray) -> np.ndarray:
    """Rows (a, b, range in a, range in b) by pair; ranges of a pair that overlap in the first text,
    at about the same distance from those in the second, are one."""
    if not len(rows):
        return rows
    apart = (rows[:, 2] >> np.uint64(32)).astype(np.int64) - (rows[:, 3] >> np.uint64(32)).astype(np.int64) >> 8
    order = np.lexsort((rows[:, 2], apart, rows[:, 1], rows[:, 0]))
    rows, apart = rows[order], apart[order]
    (al, ar), (bl, br) = _ends(rows[:, 2]), _ends(rows[:, 3])
    pair = np.concatenate([[0], np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (apart[1:] != apart[:-1]))])
    base = pair * (int(ar.max()) + 2)
    top = np.maximum.accumulate(ar + base) - base
    at = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (al[1:] > top[:-1])]))
    own = _range(al[at], np.maximum.reduceat(ar, at))
    return np.stack([rows[at, 0], rows[at, 1], own, _range(np.minimum.reduceat(bl, at), np.maximum.reduceat(br, at))], axis=1)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column("rows").to_pylist():
            rows = np.frombuffer(x, np.uint64).reshape(-1, 3)
            for k in range(0, len(rows), 1 << 16):
                part = rows[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(y).view(np.int64)) for y in (part[:, 0], part[:, 1], _around(part[:, 2])[1], part[:, 2])], ["key", "tag", "at", "place"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their keys to a row for each: 32-bit hashes of the shingles of its place's range."""
    names = ["key", "place", "label", "texts", "route"]
    for batch in batches:
        for part in blocks(batch, 1, BLOCK_BYTES):
            data, off = text_bytes(part.column(1))
            hashes, first, count = shingles(data, off)
            hashes = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            tag, lists = part.column(0).to_numpy(), part.column(2)
            edge, listed = lists.offsets.to_numpy(), lists.values
            cols = {c: listed.field(c).to_numpy() for c in names}
            for r in range(part.num_rows):
                own = hashes[first[r] : first[r] + max(0, int(count[r]) - SHINGLE + 1)]
                for lo in range(int(edge[r]), int(edge[r + 1]), 4096):
                    some = slice(lo, min(lo + 4096, int(edge[r + 1])))
                    low, _, high = _around(cols["place"][some].view(np.uint64))
                    blobs = [own[x : y + 1].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                    made = [pa.array(cols[c][some]) for c in names]
                    made.append(pa.array(blobs, pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), tag[r])), *made], ["tag", *names, "near"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of the different hashes around a place."""
    names = ["key", "tag", "place", "label", "blocks"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            sets = [np.unique(np.frombuffer(x, np.int32)) for x in part.column("near").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([part.column(c).take(row) for c in names] + [pa.array(np.concatenate(sets))], [*names, "shingle"])


def _common(near: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes each row of ``left`` has in common with each of ``right``."""
    size = np.array([len(x) for x in near])
    both = np.unique((np.concatenate(near).view(np.uint32).astype(np.int64) << 31) | np.repeat(np.arange(len(near)), size))
    codes, owner = both >> 31, both & ((1 << 31) - 1)
    edge = runs(codes)
    many = np.repeat(np.diff(edge) > 1, np.diff(edge))
    codes = codes[many]
    place = np.cumsum(np.concatenate([np.zeros(min(1, len(codes)), np.int64), codes[1:] != codes[:-1]]))
    owner, total = owner[many], np.zeros((len(left), len(right)), np.float32)
    n = int(place.max()) + 1 if len(place) else 0
    for lo in range(0, n, 4096):
        own = (place >= lo) & (place < lo + 4096)
        table = np.zeros((len(near), min(4096, n - lo)), np.float32)
        table[owner[own], place[own] - lo] = 1
        total += table[left] @ table[right].T
    return total


def _fewest(near: np.ndarray, least: int) -> int:
    """The least number of different hashes in ``least`` neighbouring ones; 0 if there aren't so many."""
    if len(near) < least:
        return 0
    order = np.argsort(near, kind="stable")
    before = np.full(len(near), -1)
    same = near[order[1:]] == near[order[:-1]]
    if not same.any():
        return least
    before[order[1:][same]] = order[:-1][same]
    starts = np.arange(len(near) - least + 1)
    return int((np.lib.stride_tricks.sliding_window_view(before, least) < starts[:, None]).sum(axis=1).min())


def _drop_apart(wanted: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], plain: np.ndarray, plain_right: np.ndarray, least: int, similar: float) -> None:
    """Clears ``wanted`` where no stretch of both, from a common hash to another, is similar.

    A stretch with m hashes in common, of the lengths x and y, is similar if
    ``m * (1 + similar) / similar >= x + y``: the best one that ends at a place
    follows from the least value of the places before.  Only for ranges in which no
    hash repeats (``plain``).
    """
    codes, place = np.unique(np.concatenate(left + right), return_inverse=True)
    cuts = np.cumsum([len(x) for x in left + right])[:-1]
    coded = np.split(place, cuts)
    table = np.full((len(right), max(len(x) for x in right)), len(codes))
    for k, x in enumerate(coded[len(left) :]):
        table[k, : len(x)] = x
    at = np.full(len(codes) + 1, -1, np.int32)
    gain = np.float32((1 + similar) / similar)
    along = np.arange(table.shape[1], dtype=np.float32)
    for k in np.flatnonzero(plain & wanted.any(axis=1)).tolist():
        some = np.flatnonzero(wanted[k] & plain_right)
        if not len(some):
            continue
        at[coded[k]] = np.arange(len(coded[k]))
        where = at[table[some]]
        at[coded[k]] = -1
        met = where >= 0
        value = gain * np.cumsum(met, axis=1, dtype=np.float32) - along - where
        before = np.minimum.accumulate(np.where(met, value, np.float32(np.inf)), axis=1)
        reach = np.where(met, value, np.float32(-np.inf))[:, least - 1 :] - before[:, : before.shape[1] - least + 1]
        wanted[k, some] = (reach >= 2 - gain - 1e-3).any(axis=1)


def _connect(tag: np.ndarray, label: np.ndarray, near: list[bytes], left: np.ndarray, right: np.ndarray, least: int, similar: float) -> Iterator[tuple[int, int, list]]:
    """(row, row, passages) of similar ranges that connect the classes of a cell's rows.

    Pairs of ``left`` and ``right`` are compared unless they have too few hashes in
    common: similar passages of x and y different ones share
    ``(x + y) * similar / (1 + similar)``.  Rows of the same range are compared
    once, and what is connected already not at all.
    """
    _, root = np.unique(label, return_inverse=True)
    names: dict[bytes, int] = {}
    kind = np.array([names.setdefault(x, len(names)) for x in near])
    arrays = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in names]
    few = np.array([_fewest(x, least) for x in arrays])

    def compare(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list]]:
        pairs = [(arrays[kind[i]], arrays[kind[j]]) for i, j in rows]
        for (i, j), found in zip(rows, all_passages(pairs, least, similar) if pairs else [], strict=True):
            if found and root[i] != root[j] and tag[i] != tag[j]:
                root[root == root[j]] = root[i]
                yield i, j, found

    order = np.lexsort((root, kind))
    first = np.flatnonzero(np.concatenate([[True], (kind[order][1:] != kind[order][:-1])]))
    firsts = np.repeat(order[first], np.diff(np.append(first, len(order))))
    some = (root[firsts] != root[order]) & (few[kind[order]] > 0)
    # One of each other class with the first row of the same range.
    some[1:] &= (kind[order][1:] != kind[order][:-1]) | (root[order][1:] != root[order][:-1])
    yield from compare(list(zip(firsts[some].tolist(), order[some].tolist(), strict=True)))

    def distinct(side: np.ndarray) -> np.ndarray:
        side = side[few[kind[side]] > 0]
        return side[np.unique(np.stack([kind[side], root[side]]), axis=1, return_index=True)[1]]

    same = left is right
    left = distinct(left)
    right = left if same else distinct(right)
    if not len(left) or not len(right) or (root[left[0]] == root[np.concatenate([left, right])]).all():
        return
    total = _common([x.astype(np.uint32) for x in arrays], kind[left], kind[right])
    enough = np.ceil((few[kind[left], None] + few[None, kind[right]]) * (similar / (1 + similar)) - 1e-9)
    wanted = (total >= np.maximum(enough, 1)) & (root[left, None] != root[None, right])
    if same:
        wanted = np.triu(wanted, 1)
    _drop_apart(wanted, [arrays[k] for k in kind[left]], [arrays[k] for k in kind[right]], few[kind[left]] == least, few[kind[right]] == least, least, similar)
    i, j = np.nonzero(wanted)
    likely = np.argsort(-total[i, j], kind="stable")
    i, j = left[i[likely]], right[j[likely]]
    take = 1
    while len(i):
        # Of each two classes the likeliest pairs first, then twice as many.
        pair = np.minimum(root[i], root[j]) * len(root) + np.maximum(root[i], root[j])
        order = np.argsort(pair, kind="stable")
        edge = runs(pair[order])
        rank = np.empty(len(i), np.int64)
        rank[order] = np.arange(len(i)) - np.repeat(edge[:-1], np.diff(edge))
        now = np.flatnonzero(rank < take)[:WAVE]
        yield from compare(list(zip(i[now].tolist(), j[now].tolist(), strict=True)))
        rest = root[i] != root[j]
        rest[now] = False
        i, j, take = i[rest], j[rest], 2 * take


def _cross(batches: Iterator[pa.RecordBatch], least: int, similar: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of two blocks, or of one, of a cell the pairs of texts that connect classes, with their ranges
    (kind 1) and passages (kind 2); where no hashes are given, all pairs of texts of different
    classes (kind 1)."""
    columns = ["cell", "side", "tag", "place", "label"]
    parts, near = [], []
    for b in batches:
        parts.append(np.stack([b.column(c).to_numpy().astype(np.int64) for c in columns], axis=1))
        near += b.column("near").to_pylist()
    rows = np.concatenate(parts)
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    rows, near = rows[order], [near[k] for k in order.tolist()]
    held, n = [], 0

    def send():
        pairs = _merged(np.concatenate(held))
        yield from _dealt(1, pairs, _of(pairs[:, 0] + mix(pairs[:, 1]), buckets), buckets)

    for lo, hi in pairwise(runs(rows[:, 0]).tolist()):
        cut = lo + int(np.searchsorted(rows[lo:hi, 1], 1))
        left = np.arange(lo, cut)
        right = left if cut == hi else np.arange(cut, hi)
        if near[lo] is not None:
            seen, i, j, side = [], [], [], left - lo
            own = rows[lo:hi].view(np.uint64)
            starts = _around(own[:, 3])[0].tolist()
            for x, y, found in _connect(own[:, 2], own[:, 4], near[lo:hi], side, side if right is left else right - lo, least, similar):
                i.append(lo + x)
                j.append(lo + y)
                for p in found:
                    at = (starts[x] + p[0], starts[x] + p[1] + SHINGLE), (starts[y] + p[2], starts[y] + p[3] + SHINGLE)
                    one, two = (x, y) if own[x, 2] < own[y, 2] else (y, x)
                    seen.append([own[one, 2], own[two, 2], *at[one != x], *at[one == x], np.float64(p[4]).view(np.uint64)])
            if seen:
                yield from _dealt(2, np.array(seen, np.uint64), np.zeros(len(seen), np.int64), 1)
            i, j = np.array(i, np.int64), np.array(j, np.int64)
        else:
            i, j = np.nonzero(rows[left, None, 4] != rows[None, right, 4])
            i, j = left[i], right[j]
            if left is right:
                i, j = i[i < j], j[i < j]
        a, b = rows[i], rows[j]
        swap = (a[:, 2].copy().view(np.uint64) > b[:, 2].copy().view(np.uint64))[:, None]
        a, b = np.where(swap, b, a).view(np.uint64), np.where(swap, a, b).view(np.uint64)
        ok = a[:, 2] != b[:, 2]
        held.append(_pairs_of(a[ok, 2], b[ok, 2], a[ok, 3], b[ok, 3]))
        n += len(held[-1])
        if n >= GATHER:
            yield from send()
            held, n = [], 0
    if n:
        yield from send()


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages that cells have found."""
    rows = _read(batches, 7)
    made = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in rows[:, :6].T]
    yield pa.RecordBatch.from_arrays([*made, pa.array(np.ascontiguousarray(rows[:, 6]).view(np.float64))], ["a", "b", "a_start", "a_end", "b_start", "b_end", "similarity"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, a_from, a_to, b_from, b_to): shingle ranges to compare."""
    rows = _merged(_read(batches, 4))
    if len(rows):
        (al, ar), (bl, br) = _ends(rows[:, 2]), _ends(rows[:, 3])
        made = [rows[:, 0].copy().view(np.int64), rows[:, 1].copy().view(np.int64), al, ar, bl, br]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["a", "b", "a_from", "a_to", "b_from", "b_to"])


def _follow(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Places in ``b`` of the shingles ``i`` of ``a``, followed up (step 1) or down (-1): next to the
    place of the one before where that is this shingle, else as in ``j``."""
    out, own, other = j.tolist(), a.tolist(), b.tolist()
    order = range(len(out)) if step > 0 else range(len(out) - 1, -1, -1)
    at, last, place = i.tolist(), -9, -9
    for k in order:
        if at[k] == last + step and 0 <= place + step < len(other) and other[place + step] == own[at[k]]:
            out[k] = place + step
        last, place = at[k], out[k]
    return np.array(out)


def passages(a: np.ndarray, b: np.ndarray, least: int, similar: float = SIMILAR) -> list[tuple[int, int, int, int, float]]:
    """(a_from, a_to, b_from, b_to, similarity) of similar passages; ends are the last shingles."""
    return all_passages([(a, b)], least, similar)[0]


def all_passages(pairs: list[tuple[np.ndarray, np.ndarray]], least: int, similar: float = SIMILAR) -> list[list[tuple[int, int, int, int, float]]]:
    """``passages`` of each pair; the shingles that two have in common are found for all at once."""
    edges = [np.cumsum([0] + [len(p[k]) for p in pairs]) for k in (0, 1)]
    own = [mix(np.concatenate([p[k] for p in pairs]) + np.repeat(mix(np.arange(len(pairs)).astype(np.uint64)), np.diff(edges[k]))) for k in (0, 1)]
    place = np.argsort(own[1], kind="stable")
    values = own[1][place]
    if not len(values):
        return [[] for _ in pairs]
    at = np.minimum(np.searchsorted(values, own[0]), len(values) - 1)
    i = np.flatnonzero(values[at] == own[0])
    at = at[i]
    j = place[at]
    again = np.zeros(len(at), bool)  # has another place in the second text
    inner = at < len(values) - 1
    again[inner] = values[at[inner] + 1] == values[at[inner]]
    cut = np.searchsorted(i, edges[0])
    # Whether a text has a shingle twice, by row.
    twice = np.zeros(len(pairs), bool)
    for k in (0, 1):
        order = np.argsort(own[k], kind="stable") if k == 0 else place
        same = own[k][order][1:] == own[k][order][:-1]
        twice[np.searchsorted(edges[k], order[1:][same], "right") - 1] = True
    common = int(np.ceil(2 * least * similar / (1 + similar) - 1e-9))
    out: list[list] = []
    for r, (a, b) in enumerate(pairs):
        lo, hi = cut[r], cut[r + 1]
        if hi - lo < common:  # two similar passages have so many in common
            out.append([])
            continue
        out.append(_aligned(a, b, i[lo:hi] - edges[0][r], j[lo:hi] - edges[1][r], bool(again[lo:hi].any()), bool(twice[r]), least, similar, common))
    return out


def _stretch(i: np.ndarray, j: np.ndarray, least: int, similar: float) -> tuple[int, int, int, int, float] | None:
    """A similar stretch of the same shingles ``i`` and ``j``, wherever it begins and ends."""
    gain = (1 + similar) / similar
    value = gain * np.arange(len(i)) - i - j
    before = np.minimum.accumulate(value)
    upto = np.searchsorted(i, i - least + 1, "right") - 1
    best = np.where(upto >= 0, value - before[np.maximum(upto, 0)], -np.inf)
    for y in np.flatnonzero(best >= 2 - gain - 1e-6).tolist():
        x = int(value[: upto[y] + 1].argmin())
        span = int(i[x]), int(i[y]), int(j[x : y + 1].min()), int(j[x : y + 1].max())
        both = y - x + 1
        ratio = both / (span[1] - span[0] + span[3] - span[2] + 2 - both)
        if ratio >= similar and span[3] - span[2] + 1 >= least:
            return (*span, ratio)
    return None


def _aligned(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, again: bool, twice: bool, least: int, similar: float, common: int) -> list[tuple[int, int, int, int, float]]:
    """Similar passages of ``a`` and ``b``, whose shingles ``i`` and ``j`` are the same."""
    out, todo, missed = [], [(i, j)], []
    if again:  # shingles that repeat have no one place
        up = _follow(a, b, i, j, 1)
        todo = [(i, up), (i, _follow(a, b, i, up, -1)), (i, _follow(a, b, i, _follow(a, b, i, j, -1), 1))]
    while todo:
        i, j = todo.pop()
        if len(i) < common:
            continue
        step = np.maximum(np.diff(i), np.abs(np.diff(j)))
        wide = np.flatnonzero(step > GAP)
        if len(wide):
            todo += list(zip(np.split(i, wide + 1), np.split(j, wide + 1), strict=True))
            continue
        span = int(i[0]), int(i[-1]), int(j.min()), int(j.max())
        if min(span[1] - span[0], span[3] - span[2]) + 1 < least:
            continue
        if twice:
            x, y = set(a[span[0] : span[1] + 1].tolist()), set(b[span[2] : span[3] + 1].tolist())
            both, size = len(x & y), len(x) + len(y)
        else:
            both, size = len(i), span[1] - span[0] + span[3] - span[2] + 2
        ratio = both / (size - both)
        if ratio >= similar:
            out.append((*span, ratio))
        elif len(i) > 2 and step.max() > 1:
            missed.append((i, j))
            cut = int(step.argmax()) + 1
            todo += [(i[:cut], j[:cut]), (i[cut:], j[cut:])]
    if not out and not twice:
        out = [x for i, j in missed if (x := _stretch(i, j, least, similar))]
    return list(dict.fromkeys(out))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the ranges asked of them to a row for each: the hashes of the shingles lo..hi."""
    names = ["a", "b", "a_from", "b_from", "side", "lo"]
    for batch in batches:
        for part in blocks(batch, 0, BLOCK_BYTES):
            data, off = text_bytes(part.column(0))
            hashes, first, _ = shingles(data, off)
            lists = part.column(1)
            edge, asked = lists.offsets.to_numpy(), lists.values
            cols = {c: asked.field(c).to_numpy() for c in (*names, "hi")}
            base = np.zeros(len(asked), np.int64)
            base[edge[0] : edge[-1]] = np.repeat(first[:-1], np.diff(edge))
            for at in range(int(edge[0]), int(edge[-1]), 4096):
                own = slice(at, min(at + 4096, int(edge[-1])))
                blobs = [hashes[x:y].tobytes() for x, y in zip((base[own] + cols["lo"][own]).tolist(), (base[own] + cols["hi"][own] + 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[c][own]) for c in names] + [pa.array(blobs, pa.binary())], [*names, "slice"])


def _verify(batches: Iterator[pa.RecordBatch], least: int, similar: float) -> Iterator[pa.RecordBatch]:
    """Both slices of each pair, of a bucket, compared."""
    held: dict[tuple, bytes] = {}
    keys, pairs, size, rows = [], [], 0, []

    def compare():
        for (one, two, a, b), found in zip(keys, all_passages(pairs, least, similar), strict=True):
            rows.extend((one, two, p[0] + a, p[1] + a + SHINGLE, p[2] + b, p[3] + b + SHINGLE, p[4]) for p in found)

    for batch in batches:
        for one, two, a_from, b_from, side, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_from", "b_from", "side", "slice")), strict=True):
            pair = one, two, a_from, b_from
            other = held.pop(pair, None)
            if other is None:
                held[pair] = blob
                continue
            keys.append(pair)
            pairs.append(tuple(np.frombuffer(x, np.uint64) for x in ((other, blob) if side else (blob, other))))
            size += len(blob)
            if size >= 4 << 20:
                compare()
                keys, pairs, size = [], [], 0
    if pairs:
        compare()
    if rows:
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.float64())], ["a", "b", "a_start", "a_end", "b_start", "b_end", "similarity"])


def _word_counts():
    def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
        data, off = text_bytes(column)
        return [pa.array(np.diff(words(data, off, SPACED)[2]).astype(np.int64))]

    return step


BLOB = "bucket long, kind int, rows binary"
FOUND = "a long, b long, a_from long, a_to long, b_from long, b_to long"
VERIFIED = "a long, b long, a_start long, a_end long, b_start long, b_end long, similarity double"


def _bodies(tags: DataFrame, texts: DataFrame) -> DataFrame:
    """(tag, text) of the texts with these tags, each once."""
    one = settle(texts.select("tag", "doc_id").join(tags, "tag", "left_semi").groupBy("tag").agg(F.min("doc_id").alias("_least")))
    few = one.count() <= BROADCAST_KEYS
    return texts.join(F.broadcast(one) if few else one, "tag").where("doc_id <=> _least").select("tag", "text")


def _compare(found: DataFrame, texts: DataFrame, least: int, similar: float) -> DataFrame:
    """The similar passages in the ranges of ``found``, in words."""
    asked = found.select(F.col("a").alias("tag"), "a", "b", "a_from", "b_from", F.lit(0).alias("side"), F.col("a_from").alias("lo"), F.col("a_to").alias("hi"))
    asked = asked.unionByName(found.select(F.col("b").alias("tag"), "a", "b", "a_from", "b_from", F.lit(1).alias("side"), F.col("b_from").alias("lo"), F.col("b_to").alias("hi")))
    sizes = settle(asked.groupBy("tag").agg(F.count("*").alias("n")))
    # A text that very many are compared with is sent in parts of ASKED.
    parts = asked.join(sizes, "tag").withColumn("part", F.pmod(F.xxhash64("a", "b", "a_from"), F.ceil(F.col("n") / ASKED)))
    listed = parts.groupBy("tag", "part").agg(F.collect_list(F.struct("a", "b", "a_from", "b_from", "side", "lo", "hi")).alias("asked"))
    body = _bodies(sizes.select("tag"), texts)
    cut = body.join(listed, "tag").select("text", "asked").mapInArrow(_slices, "a long, b long, a_from long, b_from long, side int, lo long, slice binary")
    buckets = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // COMPARED))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("a", "b", "a_from", "b_from"), F.lit(buckets)))
    out = settle(apply_groups(dealt, ["bucket"], lambda it: _verify(it, least, similar), VERIFIED))
    release(found)
    return out


def _sides(links: DataFrame) -> DataFrame:
    """(tag, start, end) of the passages in either text."""
    one = links.select(F.col("a").alias("tag"), F.col("a_start").alias("start"), F.col("a_end").alias("end"))
    return one.unionByName(links.select(F.col("b").alias("tag"), F.col("b_start").alias("start"), F.col("b_end").alias("end")))


def regions(links: DataFrame) -> DataFrame:
    """(tag, start, end): the stretches of each text that lie in verified passages."""
    made = "tag long, start long, end long"
    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // CROSSED))
    dealt = _sides(links).mapInArrow(_merge_batches, made).withColumn("bucket", F.pmod(F.xxhash64("tag"), F.lit(parts)))
    return apply_groups(dealt, ["bucket"], _merge_batches, made)


def _by_text(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the class of their text; a text without links is its own."""
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "tag")
    return members.join(roots, "tag", "left").select("key", "tag", "place", F.coalesce("root", "tag").alias("label"))


def _routes(labelled: DataFrame) -> DataFrame:
    """``labelled`` of the keys of several classes with texts (how many the key has) and route.

    0: the key's texts fit one cell.  1, 2: those outside its largest class do;
    1 is a text of that class, 2 another one.  3: neither.
    """
    split = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("texts")).where("low < high")
    split = settle(split.select("key", "texts"))
    large = labelled.join(split.where(F.col("texts") > BLOCK).select("key"), "key", "left_semi").groupBy("key", "label").agg(F.count("*").alias("n"))
    top = large.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"))
    met = labelled.join(split, "key").join(top, "key", "left")
    route = F.when(F.col("texts") <= BLOCK, 0).when(F.col("texts") - F.col("top.n") > BLOCK, 3).when(F.col("label") == F.col("top.label"), 1).otherwise(2)
    return met.select("key", "tag", "place", "label", "texts", route.cast("long").alias("route"))


def _by_all(labelled: DataFrame, texts: DataFrame, least: int, similar: float, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(passages, ranges) of the pairs of texts that connect the classes of a key, all being compared
    that have enough in common around the place.

    A key of more than BLOCK texts isn't gathered.  Where at most BLOCK are
    outside its largest class, those go to each block of that class.  Else its
    blocks meet in pairs.  A key of more than CROWDED blocks meets by each shingle
    around the place that at most BLOCK of its texts have, and its pairs are ranges
    that are still to be compared: a pair with enough in common has such a shingle,
    unless what it has in common is itself in more texts.  Those that have so much
    that is common to very many are compared in pairs of blocks.
    """
    asked = settle(_routes(labelled).groupBy("tag").agg(F.collect_list(F.struct("key", "place", "label", "texts", "route")).alias("places")))
    body = _bodies(asked.select("tag"), texts)
    made = body.join(asked, "tag").select("tag", "text", "places").mapInArrow(_near, "tag long, key long, place long, label long, texts long, route long, near binary")
    rows = settle(made.withColumn("blocks", F.ceil(F.col("texts") / BLOCK)))
    zero, one, rest = F.lit(0).cast("long").alias("side"), F.lit(1).cast("long").alias("side"), ["tag", "place", "label", "near"]
    own = F.pmod(F.xxhash64("tag"), "blocks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    low, high = F.least("own", "block"), F.greatest("own", "block")
    side = ((low != high) & (F.col("own") == high)).cast("long").alias("side")
    cells = rows.where("route = 0").select(F.col("key").alias("cell"), zero, *rest)
    cells = cells.unionByName(rows.where("route = 1").select(F.xxhash64("key", own).alias("cell"), zero, *rest))
    cells = cells.unionByName(rows.where("route = 2").select("key", *rest, every).select(F.xxhash64("key", "block").alias("cell"), one, *rest))
    cells = cells.unionByName(rows.where("route = 2").select(F.xxhash64("key", F.lit(-1).cast("long")).alias("cell"), zero, *rest))
    met = rows.where((F.col("route") == 3) & (F.col("blocks") <= CROWDED)).withColumn("own", own).select("key", *rest, "own", every)
    cells = cells.unionByName(met.select(F.xxhash64("key", low, high).alias("cell"), side, *rest))
    many = rows.where((F.col("route") == 3) & (F.col("blocks") > CROWDED))
    if many.take(1):
        each = many.mapInArrow(_each_shingle, "key long, tag long, place long, label long, blocks long, shingle int")
        counts = settle(each.groupBy("key", "shingle").agg(F.count("*").alias("n")).where("n > 1"))
        none = F.lit(None).cast("binary").alias("near")
        few = each.join(counts.where(F.col("n") <= BLOCK), ["key", "shingle"])
        cells = cells.unionByName(few.select(F.xxhash64("key", "shingle").alias("cell"), zero, *rest[:3], none))
        enough = int(np.ceil(2 * least * similar / (1 + similar)))
        full = each.join(counts.where(F.col("n") > BLOCK), ["key", "shingle"]).groupBy("key", "tag", "place", "label", "blocks").agg(F.count("*").alias("m")).where(F.col("m") >= enough)
        full = full.withColumn("own", own).select("key", *rest[:3], "own", every)
        cells = cells.unionByName(full.select(F.xxhash64("key", low, high).alias("cell"), side, *rest[:3], none))
    n = rows.count()
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(max(buckets, -(-n // CROSSED)))))
    dealt = settle(apply_groups(cells, ["bucket"], lambda it: _cross(it, least, similar, buckets), BLOB), "kind")
    seen = settle(dealt.where("kind = 2").mapInArrow(_seen, VERIFIED))
    found = settle(apply_groups(dealt.where("kind = 1"), ["bucket"], _candidates, FOUND))
    release(asked, rows, dealt)
    return seen, found


def link_passages(texts: DataFrame, passage: int = PASSAGE, similar: float = SIMILAR, n_words: int = 0) -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end, similarity): similar passages of two texts, in words.

    ``texts``: (doc_id, tag, text), tag a hash of the text; equal tags are one
    text.  The links connect all texts that similar passages connect, in each
    passage; among texts that are connected there they aren't all pairs.
    ``n_words`` of all texts decides the number of buckets.
    """
    spark, least = texts.sparkSession, passage - SHINGLE + 1
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // BUCKET_WORDS))
    sent = lean(texts).select("tag", "text").mapInArrow(lambda it: _sketch(it, least, buckets), BLOB)
    shared = apply_groups(sent, ["bucket"], lambda it: _shared(it, buckets), BLOB)
    keyed = settle(apply_groups(shared, ["bucket"], lambda it: _keys(it, least, buckets), BLOB), "kind")
    met = settle(apply_groups(keyed.where("kind = 0"), ["bucket"], lambda it: _meet(it, buckets), BLOB), "kind")
    both = keyed.where("kind > 0").unionByName(met)
    found = settle(apply_groups(both.where("kind = 1"), ["bucket"], _candidates, FOUND))
    members = settle(both.where("kind = 3").mapInArrow(_members, "key long, tag long, at long, place long"))
    release(keyed, met)
    links = _compare(found, texts, least, similar)
    labelled = settle(_by_text(members, links))
    seen, found = _by_all(labelled, texts, least, similar, buckets)
    release(labelled)
    if found.take(1):
        links = settle(links.unionByName(seen).unionByName(_compare(found, texts, least, similar)))
    release(members)
    return links


def _merge(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    for tag, start, end in sorted(rows):
        if out and out[-1][0] == tag and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([tag, start, end])
    return [tuple(x) for x in out]


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, int]] = []
    for b in batches:
        held = _merge(held + list(zip(*(b.column(c).to_pylist() for c in ("tag", "start", "end")), strict=True)))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], ["tag", "start", "end"])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, n_words, n_dup_words, spans) for each row of ``docs``.

    Texts of at least ``passage`` words are linked if they share a passage of
    that length with a similarity of ``similar`` or more, or are equal.
    class_id is the least doc_id of those reachable, spans the shared passages
    as ranges of words (at their first place in the text).  Null and short texts
    stand alone and name themselves, null ids have class_id null where alone.
    Repeated rows are equal texts; an empty table gives an empty one; other
    columns aren't read.  A text's windows are computed in one block, some 200
    bytes a word.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    table = settle(append_columns(source, "text", "n_words long", _word_counts).select("doc_id", "tag", "n_words"))
    n_words = table.agg(F.sum("n_words")).first()[0] or 0
    links = link_passages(source.where(F.length("text") >= 2 * passage - 1), passage, similar, n_words)
    roots = settle(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    long_ = table.where(F.col("n_words") >= passage)
    of_tag = settle(long_.groupBy("tag").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    named = of_tag.join(roots, of_tag["tag"] == roots["node"], "left").select("tag", "least", "copies", "root")
    # Most texts are alone; the others' least id comes from two sums, as one class may hold very many.
    linked = named.where("root IS NOT NULL")
    salted = linked.groupBy("root", F.pmod("tag", F.lit(SALTS)).alias("salt")).agg(F.min("least").alias("class_id"))
    least_of = salted.groupBy("root").agg(F.min("class_id").alias("class_id"))
    classes = settle(salted.select("root", "salt").join(least_of, "root"))
    linked = linked.withColumn("salt", F.pmod("tag", F.lit(SALTS))).join(classes, ["root", "salt"]).select("tag", "copies", "class_id")
    every = linked.unionByName(named.where("root IS NULL").select("tag", "copies", F.col("least").alias("class_id")))
    spans = regions(links).groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("shared"))
    facts = every.join(spans, "tag", "left")
    enough = F.col("n_words") >= passage
    met = table.join(facts, "tag", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    copied = enough & (F.col("copies") > 1)
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return met.select(
        "doc_id",
        F.when(enough, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        "n_words",
        F.when(copied, F.col("n_words")).when(enough, F.coalesce("shared", F.lit(0))).otherwise(0).cast("long").alias("n_dup_words"),
        F.when(copied, whole).when(enough, F.coalesce("spans", nothing)).otherwise(nothing).alias("spans"),
    )
