"""Linear-chain conditional random field over words with hashed features.

A word's features are its byte n-grams, its affixes and the word itself (the
lexicon), hashed into one table of weights for each label; labels are linked by
learned transitions.  Chains are lines, whole.  Marginals come from
forward-backward, run for all chains of a block at once: step t of the recursion
is one vectorised operation over the chains that have a word t.  Longer chains
are read in segments of ``SEGMENT`` words: the products of their transfer matrices
carry the messages over a chain, and then all its segments are read at once.

Weights are fitted on the driver from a bounded sample that the caller draws.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa

from .common import LETTERS, LOWER, mix, word_codes, words

SEGMENT = 32
BITS = 18


@dataclass(frozen=True)
class Features:
    """Byte lengths of the n-grams, prefixes and suffixes of ``^word$``.

    ``lexicon`` says of each index whether it is an entry; a word with an entry
    has one more feature, the last index.
    """

    grams: tuple[int, ...] = ()
    prefixes: tuple[int, ...] = ()
    suffixes: tuple[int, ...] = ()
    bits: int = BITS
    lexicon: np.ndarray | None = None

    def of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(indices, word): the feature indices of each distinct word, with the word's number."""
        n = len(distinct)
        raw = np.frombuffer(distinct.buffers()[2], np.uint8) if n and distinct.buffers()[2] is not None else np.zeros(0, np.uint8)
        off = np.frombuffer(distinct.buffers()[1], np.int32, n + 1, distinct.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
        lens = np.diff(off)
        # ^ and $ around each word.
        total = int(lens.sum()) + 2 * n
        start = off[:-1] - off[0] + 2 * np.arange(n)
        end = start + lens + 2
        body = np.full(total, 1, np.uint8)
        inner = np.ones(total, bool)
        inner[start] = False
        inner[end - 1] = False
        body[inner] = LOWER[raw[off[0] : off[-1]]]
        body[end - 1] = 2
        # Prefix sums of a polynomial hash give the hash of any byte range.
        odd = np.uint64(0x9E3779B97F4A7C15)
        power = np.ones(total + 1, np.uint64)
        power[1:] = odd
        power = np.multiply.accumulate(power)
        back = np.ones(total + 1, np.uint64)
        back[1:] = np.uint64(pow(int(odd), -1, 1 << 64))
        back = np.multiply.accumulate(back)
        prefix = np.zeros(total + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])

        def index(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
            h = mix((prefix[b] - prefix[a]) * back[a] + np.uint64(kind * 0x632BE59BD9B4E019 % (1 << 64)))
            return (h >> np.uint64(64 - self.bits)).astype(np.int64)

        word = np.arange(n)
        out, who = [index(start, end, 1)], [word]
        owner = np.repeat(word, lens + 2)
        for g in self.grams:
            a = np.flatnonzero(np.arange(total) + g <= end[owner])
            out.append(index(a, a + g, 10 + g))
            who.append(owner[a])
        for p in self.prefixes:
            k = np.flatnonzero(lens + 2 > p)
            out.append(index(start[k], start[k] + p, 40 + p))
            who.append(k)
        for s in self.suffixes:
            k = np.flatnonzero(lens + 2 > s)
            out.append(index(end[k] - s, end[k], 70 + s))
            who.append(k)
        index_, who_ = np.concatenate(out), np.concatenate(who)
        if self.lexicon is not None:
            listed = np.flatnonzero(np.bincount(who_, self.lexicon[index_], n) > 0)
            index_, who_ = np.append(index_, np.full(len(listed), (1 << self.bits) - 1)), np.append(who_, listed)
        return index_, who_


def line_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(codes, distinct, starts, ends, first, begin): letter words and the chains they form.

    begin holds the first word of each chain, with the number of words at the end.
    """
    starts, ends, first = words(data, off, LETTERS)
    codes, distinct = word_codes(data, starts, ends)
    n = len(starts)
    fresh = np.zeros(n + 1, bool)
    fresh[first[:-1]] = True
    breaks = np.flatnonzero(data == 0x0A)
    fresh[np.searchsorted(starts, breaks)] = True
    return codes, distinct, starts, ends, first, np.append(np.flatnonzero(fresh[:n]), n)


@dataclass
class Crf:
    labels: list[str]
    features: Features
    weights: np.ndarray  # 2**bits x labels
    moves: np.ndarray  # labels x labels

    def emissions(self, distinct: pa.Array) -> np.ndarray:
        index, who = self.features.of(distinct)
        out = np.empty((len(distinct), len(self.labels)), np.float32)
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(who, self.weights[:, k][index], len(distinct))
        return out

    def marginals(self, emitted: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return forward_backward(emitted, self.moves, begin)[0]


def _segments(begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the segments, with the number of words at the end, and which begin a chain."""
    parts = np.maximum(-(-np.diff(begin) // size), 1)
    edge = np.append(0, np.cumsum(parts))
    place = np.arange(edge[-1]) - np.repeat(edge[:-1], parts)
    return np.append(np.repeat(begin[:-1], parts) + size * place, begin[-1]), place == 0


def _messages(e: np.ndarray, a: np.ndarray, begin: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each segment from the words before it (up to the last of them) and from those behind it."""
    n, k = len(head), e.shape[1]
    before, behind = np.ones((n, k), e.dtype), np.ones((n, k), e.dtype)
    chain = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    place = np.arange(n) - first[chain]
    some = np.flatnonzero((np.diff(np.append(first, n)) > 1)[chain])
    if not len(some):
        return before, behind
    lens = np.diff(begin)[some]
    own = e[begin[some]]
    matrix = np.where(head[some][:, None, None], np.eye(k, dtype=e.dtype) * own[:, None, :], a * own[:, None, :])
    for t in range(1, int(lens.max())):
        on = lens > t
        step = (matrix[on] @ a) * e[begin[some[on]] + t][:, None, :]
        matrix[on] = step / step.max(axis=(1, 2), keepdims=True)
    where = np.full(n, -1)
    where[some] = np.arange(len(some))
    by_place = np.argsort(place[some], kind="stable")
    groups = [some[by_place[lo:hi]] for lo, hi in pairwise(np.searchsorted(place[some][by_place], np.arange(place[some].max() + 2)).tolist())]
    for now in groups[1:]:
        x = np.einsum("ij,ijk->ik", before[now - 1], matrix[where[now - 1]])
        before[now] = x / x.max(axis=1, keepdims=True)
    for now in reversed(groups[1:]):
        x = np.einsum("ijk,ik->ij", matrix[where[now]], behind[now])
        behind[now - 1] = x / x.max(axis=1, keepdims=True)
    return before, behind


def forward_backward(emitted: np.ndarray, moves: np.ndarray, begin: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word, and expected counts of each move over all chains."""
    e = np.exp(emitted - emitted.max(axis=1, keepdims=True)) if len(emitted) else emitted
    a = np.exp(moves.astype(np.float32))
    begin, head = _segments(begin, segment)
    before, behind = _messages(e, a, begin, head)
    lens = np.diff(begin)
    order = np.argsort(-lens, kind="stable")
    at, head, before, behind = begin[:-1][order], head[order], before[order], behind[order]
    # How many segments have a word t.
    alive = np.searchsorted(-lens[order], -np.arange(1, (lens.max() if len(lens) else 0) + 1), "right")
    alpha, beta = np.empty_like(e), np.empty_like(e)
    for t, n in enumerate(alive.tolist()):
        i = at[:n] + t
        x = np.where(head[:n, None], 1, before[:n] @ a) * e[i] if t == 0 else (alpha[i - 1] @ a) * e[i]
        alpha[i] = x / x.sum(axis=1, keepdims=True)
    counts = np.zeros_like(moves, dtype=np.float64)

    def move(j: np.ndarray) -> np.ndarray:
        """From the words ``j`` to the next ones."""
        ahead = e[j + 1] * beta[j + 1]
        x = ahead @ a.T
        scale = 1 / (alpha[j] * x).sum(axis=1, keepdims=True)
        counts[:] += a * ((alpha[j] * scale).T @ ahead)
        return x / x.sum(axis=1, keepdims=True)

    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        more = alive[t + 1] if t + 1 < len(alive) else 0
        i = at[:n] + t
        beta[i[more:]] = behind[more:n]
        if more:
            beta[i[:more]] = move(i[:more])
    if not head.all():
        move(at[~head] - 1)
    m = alpha * beta
    return m / m.sum(axis=1, keepdims=True) if len(m) else m, counts


def fit(labels: list[str], features: Features, distinct: pa.Array, codes: np.ndarray, begin: np.ndarray, gold: np.ndarray, epochs: int = 8, batches: int = 12, rate: float = 0.3, ridge: float = 1e-5, seed: int = 7) -> Crf:
    """Adagrad on the log-likelihood of ``gold`` (a label for each word)."""
    rng = np.random.default_rng(seed)
    k, size = len(labels), 1 << features.bits
    index, who = features.of(distinct)
    order = np.argsort(who, kind="stable")
    index, edge = index[order], np.searchsorted(who[order], np.arange(len(distinct) + 1))
    weights, squares = np.zeros((size, k), np.float32), np.full((size, k), 1e-6, np.float32)
    moves, moved = np.zeros((k, k)), np.full((k, k), 1e-6)
    chains = np.arange(len(begin) - 1)
    lens = np.diff(begin)
    for _ in range(epochs):
        rng.shuffle(chains)
        for part in np.array_split(chains, min(batches, max(1, len(chains)))):
            n = lens[part]
            own = np.append(0, np.cumsum(n))
            place = np.repeat(begin[part] - own[:-1], n) + np.arange(own[-1])
            if not len(place):
                continue
            used, local = np.unique(codes[place], return_inverse=True)
            count = edge[used + 1] - edge[used]
            word = np.repeat(np.arange(len(used)), count)
            feats = index[np.repeat(edge[used] - np.append(0, np.cumsum(count))[:-1], count) + np.arange(count.sum())]
            emitted = np.stack([np.bincount(word, weights[feats, c], len(used)) for c in range(k)], axis=1).astype(np.float32)
            marginal, expected = forward_backward(emitted[local], moves, own)
            error = -marginal.astype(np.float64)
            g = gold[place]
            error[np.arange(len(place)), g] += 1
            per_word = np.stack([np.bincount(local, error[:, c], len(used)) for c in range(k)], axis=1) / len(part)
            touched, inverse = np.unique(feats, return_inverse=True)
            grad = np.stack([np.bincount(inverse, per_word[word, c], len(touched)) for c in range(k)], axis=1) - ridge * weights[touched]
            squares[touched] += grad**2
            weights[touched] += rate * grad / np.sqrt(squares[touched])
            inner = np.ones(len(place), bool)
            inner[own[1:] - 1] = False
            seen = np.zeros((k, k))
            here = np.flatnonzero(inner)
            np.add.at(seen, (g[here], g[here + 1]), 1)
            step = (seen - expected) / len(part) - ridge * moves
            moved += step**2
            moves += rate * step / np.sqrt(moved)
    return Crf(labels, features, weights, moves)
