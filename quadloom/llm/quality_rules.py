"""Quality rules on repetition, by a suffix array of each text's words.

The suffix array is built for all texts of a block at once by prefix doubling:
suffixes begin with (text, word) ranks, and each round sorts those still tied by
the rank of their second half; a suffix that is alone leaves.  The ranks of the
rounds give the longest common prefix of neighbours.  The longest repeat that
begins at a word is the larger of its two neighbours' prefixes; the spans of
repeats of ``n`` words or more are united into the covered words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACED, _table, append_columns, per_row, text_bytes, word_codes, words

#: Words of the windows whose repetition the base rule counts.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent
#: The method's verdict: repeats of at least so many words may cover so much, and none may be longer.
REPEAT = 15
MAX_COVERED = 0.1
MAX_LONGEST = 50
SYMBOLS = _table(lambda b: chr(b) in "#*$%&|<>")
#: Bytes that begin a code point.
POINTS = _table(lambda b: not 0x80 <= b < 0xC0)


def repeats(codes: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """For each word, the length of the longest run of words from it that also
    begins elsewhere in its text, or 0 if that is under ``least``."""
    n = len(codes)
    best = np.zeros(n, np.int32)
    if n < 2:
        return best
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][row]
    key = row * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    tied = ~(begin & np.concatenate([begin[1:], [True]]))
    active, ranks, h = order[tied], [rank], 1
    while len(active):
        rank = rank.copy()
        ahead = active + h
        inside = ahead < end[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        begin = np.concatenate([[True], key[1:] != key[:-1]])
        old = rank[active]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        place = np.arange(len(active))
        rank[active] = old + np.maximum.accumulate(np.where(begin, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        tied = ~(begin & np.concatenate([begin[1:], [True]]))
        active = active[tied]
        ranks.append(rank)
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[ranks[-1]] = np.arange(n)
    # Neighbours that share the largest power of two of words up to `least`.
    level = min(int(least).bit_length() - 1, len(ranks) - 1)
    a, b = suffixes[:-1], suffixes[1:]
    shared = ranks[level][a] == ranks[level][b]
    a, b = a[shared], b[shared]
    length = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a + length < end[a]) & (b + length < end[b])
        same = inside & (ranks[k][np.minimum(a + length, n - 1)] == ranks[k][np.minimum(b + length, n - 1)])
        length += same.astype(np.int64) << k
    enough = length >= least
    for side in (a, b):
        np.maximum.at(best, side[enough], length[enough].astype(np.int32))
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words."""
    at = np.flatnonzero(best >= least)
    edge = np.zeros(len(best) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + best[at], -1)
    return np.cumsum(edge[:-1]) > 0


def rate(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW, max_repeated: int = MAX_REPEATED, repeat: int = REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """``docs`` with counts, longest_repeat, n_covered, base_failed and kept.

    longest_repeat is in words (0 if under ``window``); n_covered counts words in
    repeats of at least ``repeat`` words.  base_failed: fewer than ``min_words``
    words, or more than ``max_repeated`` per cent of them in repeated windows.
    kept: not base_failed, at most ``max_covered`` of the words covered and no
    repeat over ``max_longest`` words.  Null and empty texts have no words and
    fail.  Repeated rows are rated alike; columns of ``docs`` that are called like
    a new one are replaced, others come along.  A long text is a block alone, some
    100 bytes a word.
    """
    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, base_failed boolean, kept boolean"

    def work():
        def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
            data, off = text_bytes(column)
            raw = data.tobytes()
            starts, ends, first = words(data, off, SPACED)
            codes, _ = word_codes(data, starts, ends)
            count = np.diff(first)
            points = np.concatenate([[0], np.cumsum(POINTS[data] & SPACED[data])])
            symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
            best = repeats(codes.astype(np.int64), first, min(window, repeat))
            repeated = per_row(covered(best, window), first)
            wide = per_row(covered(best, repeat), first)
            some = np.flatnonzero(count)
            longest = np.zeros(len(count), np.int64)
            if len(some):
                longest[some] = np.maximum.reduceat(best, first[some])
            twice = np.zeros(len(count), np.int64)
            for i in some.tolist():
                lines = [x for x in raw[off[i] : off[i + 1]].split(b"\n") if x and not x.isspace()]
                twice[i] = len(lines) - len(set(lines))
            failed = (count < min_words) | (100 * repeated > max_repeated * count)
            kept = ~failed & (wide <= max_covered * count) & (longest <= max_longest)
            numbers = (count, points[off[1:]] - points[off[:-1]], symbols[off[1:]] - symbols[off[:-1]], twice, repeated, wide, longest)
            return [pa.array(x.astype(np.int64)) for x in numbers] + [pa.array(failed), pa.array(kept)]

        return step

    return append_columns(docs, text, made, work)
