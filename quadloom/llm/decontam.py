"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items form one automaton.  Documents stream
through it: at each word the state is the longest suffix read so far that occurs
in an item.  A match of ``window`` words or more marks its words; an item
shorter than a window is matched whole.

Items are a query set read in blocks of at most ``BLOCK_WORDS`` words; each
block is one broadcast, and one pass marks the documents with it.  Words that
no item has, and word pairs that no item has, end every match, so vectorised
lookups find the stretches in which a long match is possible, and the automaton
reads those stretches.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, append_columns, positional, restored, text_bytes, unused, word_codes, words

WINDOW = 10
#: Words of items in one automaton, hence in one broadcast.
BLOCK_WORDS = 200_000
#: Above this share of hit words a document goes as a whole.
MAX_COVERAGE = 0.5


def item_words(text: str | None) -> list[bytes]:
    data, off = text_bytes(pa.array([text], pa.string()))
    data = LOWER[data]
    raw, (starts, ends, _) = data.tobytes(), words(data, off, ALNUM)
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word codes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.items = [(name, seq) for name, seq in items if seq]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in seq] for _, seq in self.items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self._mark(coded)
        # What the vectorised search for stretches needs.
        self.pair_base = len(self.vocabulary) + 1
        pairs = {a * self.pair_base + b for seq in coded for a, b in zip(seq, seq[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        short = [seq for seq in coded if len(seq) < window]
        self.short_pairs = np.array(sorted({s[0] * self.pair_base + s[1] for s in short if len(s) > 1}), np.int64)
        self.single = np.array(sorted({s[0] for s in short if len(s) == 1}), np.int64)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _mark(self, coded: list[list[int]]) -> None:
        """Items by state: those that hold its words, and whole short items that end there."""
        holds: dict[int, list[int]] = defaultdict(list)
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        seen = [-1] * len(self.next)
        for k, seq in enumerate(coded):
            state = 0
            for w in seq:
                state = p = self.next[state][w]
                while p > 0 and seen[p] != k:
                    seen[p] = k
                    if self.length[p] >= self.window > self.length[self.link[p]]:
                        holds[p].append(k)
                    p = self.link[p]
            if len(seq) < self.window:
                ends[state].append((len(seq), k))
        self.holds, self.top, self.short = dict(holds), [0] * len(self.next), [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            # The state of the last `window` words of any match of that length that ends in s.
            self.top[s] = self.top[up] if self.length[up] >= self.window else s
            self.short[s] = (*self.short[up], *ends.get(s, ()))

    def read(self, codes: list[int], at: int, hit: np.ndarray, found: set[int]) -> None:
        """Mark the words of ``codes``, which begin at ``at``, that lie in windows; gather items."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for i, w in enumerate(codes):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(w)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= window:
                hit[at + i + 1 - window : at + i + 1] = True
                found.update(self.holds.get(self.top[state], ()))
            for n, item in self.short[state]:
                if n <= size:
                    hit[at + i + 1 - n : at + i + 1] = True
                    found.add(item)

    def stretches(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of words in which a window may lie; ``codes`` is -1 for words of no item."""
        n = len(codes)
        known = codes >= 0
        pair = np.where(known[:-1] & known[1:], codes[:-1] * self.pair_base + codes[1:], -1)
        edge = first[(first > 0) & (first < n)] - 1
        pair[edge] = -1
        joined = _among(pair, self.pairs)
        start = known.copy()
        start[1:] &= ~joined
        begin = np.flatnonzero(start)
        stop = known.copy()
        stop[:-1] &= ~joined
        end = np.flatnonzero(stop) + 1
        wanted = end - begin >= self.window
        key = np.zeros(n + 1, np.int64)
        if len(self.short_pairs):
            key[:-2] += _among(pair, self.short_pairs)
        if len(self.single):
            key[:-1] += _among(codes, self.single)
        if len(self.short_pairs) or len(self.single):
            total = np.concatenate([[0], np.cumsum(key)])
            wanted |= total[end] > total[begin]
        return begin[wanted], end[wanted]


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


_BUILT: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, items, window: int) -> SuffixAutomaton:
    """One automaton per worker and block; workers live over many tasks."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton(items, window)
    return _BUILT[key]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int = BLOCK_WORDS):
    """Blocks of [(id, words)]; rows of one id are together, so that they count as one item."""
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string")).orderBy(F.col(item_id).cast("string"))
    block, size, last = [], 0, None
    for name, body in rows.toLocalIterator():
        if size >= limit and name != last:
            yield block
            block, size = [], 0
        block.append((name or "", item_words(body)))
        size += len(block[-1][1])
        last = name
    if block:
        yield block


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids, contaminated, hit_spans, clean_text, rejected.

    hit_spans are byte ranges of the UTF-8 text; clean_text is the text without
    them (null text stays null); rejected: more than ``max_coverage`` of the
    words are hit.  Null and empty texts have no words; an empty benchmark hits
    nothing; rows that share an item_id are one item, a null item_id is ''.
    """
    spark = docs.sparkSession
    out, first, held = docs, True, unused(docs, "hit_bits", "hit_items")
    for block in item_blocks(benchmark, item_id, item_text):
        key = hashlib.sha256(repr(block).encode()).hexdigest()
        sent = spark.sparkContext.broadcast(block)
        out = _pass(out, text, sent, key, window, first, held)
        first = False
    if first:
        out = _pass(out, text, spark.sparkContext.broadcast([]), "", window, True, held)
    return _finish(out, text, max_coverage, held)


def _pass(df: DataFrame, text: str, sent, key: str, window: int, first: bool, held: list[str]) -> DataFrame:
    """Adds to the columns ``held``, a bit for each word and the items, what one block of items finds."""

    def work():
        automaton = _automaton(key, sent.value, window)
        names = [name for name, _ in automaton.items]
        value_set = pa.array(list(automaton.vocabulary), pa.binary())

        def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
            data, off = text_bytes(column)
            data = LOWER[data]
            starts, ends, at = words(data, off, ALNUM)
            hit = np.zeros(len(starts), bool)
            found: dict[int, set[int]] = {}
            if len(value_set) and len(starts):
                codes, distinct = word_codes(data, starts, ends)
                known = pc.fill_null(pc.index_in(distinct, value_set=value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                codes = known[codes]
                begin, end = automaton.stretches(codes, at)
                rows = np.searchsorted(at, begin, "right") - 1
                for a, b, row in zip(begin.tolist(), end.tolist(), rows.tolist(), strict=True):
                    automaton.read(codes[a:b].tolist(), a, hit, found.setdefault(row, set()))
            bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            items = [sorted({names[k] for k in found.get(i, ())}) for i in range(part.num_rows)]
            if not first:
                old = part.column(part.schema.get_field_index(held[0])).to_pylist()
                bits = [(np.frombuffer(x, np.uint8) | np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(bits, old, strict=True)]
                gone = part.column(part.schema.get_field_index(held[1])).to_pylist()
                items = [sorted({*x, *y}) for x, y in zip(items, gone, strict=True)]
            return [pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))]

        return step

    return append_columns(df, text, f"`{held[0]}` binary, `{held[1]}` array<string>", work)


def _finish(df: DataFrame, text: str, max_coverage: float, held: list[str]) -> DataFrame:
    made = "n_words long, n_hit long, item_ids array<string>, contaminated boolean, hit_spans array<struct<start:long,end:long>>, clean_text string, rejected boolean"

    def work():
        def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
            data, off = text_bytes(column)
            raw = data.tobytes()
            starts, ends, at = words(LOWER[data], off, ALNUM)
            bits = part.column(part.schema.get_field_index(held[0])).to_pylist()
            count, hits, spans, clean = np.diff(at), [], [], []
            for i, packed in enumerate(bits):
                lo, hi, base = off[i], off[i + 1], at[i]
                hit = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(count[i])).view(bool)
                hits.append(int(hit.sum()))
                if not hits[-1]:
                    spans.append([])
                    clean.append(None if not column[i].is_valid else raw[lo:hi].decode("utf-8", "replace"))
                    continue
                step_at = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                cuts = [(int(starts[base + a] - lo), int(ends[base + b - 1] - lo)) for a, b in zip(step_at[::2], step_at[1::2], strict=True)]
                spans.append([{"start": a, "end": b} for a, b in cuts])
                kept, last = [], 0
                for a, b in cuts:
                    kept.append(raw[lo + last : lo + a])
                    last = b
                kept.append(raw[lo + last : hi])
                clean.append(b"".join(kept).decode("utf-8", "replace"))
            hits_ = np.array(hits, np.int64)
            return [
                pa.array(count.astype(np.int64)),
                pa.array(hits_),
                part.column(part.schema.get_field_index(held[1])),
                pa.array(hits_ > 0),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(clean, pa.string()),
                pa.array(hits_ > max_coverage * count),
            ]

        return step

    return append_columns(df, text, made, work).drop(*held)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without rejected rows, texts without the hit spans."""
    marked = mark_contamination(positional(docs), benchmark, f"c{docs.columns.index(text)}_", **options).where("NOT rejected")
    return restored(marked, docs, text, "clean_text")
