"""Toxicity by a linear-chain CRF that tags toxic words.

Labels say only which documents are toxic.  Words become labelled tokens by a
lexicon of words and affixes that occur in many toxic and hardly any other
sampled documents; the field learns to tag them from their words, affixes and
place in the lexicon, and from their neighbours.  Forward-backward marginals give the offending offsets, and a
calibrated function of them is the document's score.

Everything is fitted on the driver from a bounded sample: at most ``TOXIC`` rows
labelled 1 and ``CLEAN`` rows labelled 0, of at most ``FIT_CHARS`` characters.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, settle, text_bytes
from .crf import Crf, Features, fit, line_words

TOXIC = 1200
CLEAN = 3600
#: Of a longer text the fit has a piece of this size; every text is scored whole.
FIT_CHARS = 6000
FEATURES = Features(prefixes=(4, 5, 6, 7, 8), suffixes=(5, 6, 7))
#: A word with a marginal of at least this is part of an offending span.
SPAN = 0.5
#: How unlikely by chance a lexicon entry must be, in nats, and how many times likelier in toxic
#: documents: to be there at all, and for a word to be one.
CHANCE = 15.0
LIFT = 4
RATE = 15


@dataclass
class Tagger:
    field: Crf
    #: Weights of what ``evidence`` returns.
    calibration: np.ndarray


def labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", yes: int = TOXIC, no: int = CLEAN, chars: int = FIT_CHARS) -> tuple[list, float]:
    """At most ``yes`` rows with label 1 and ``no`` with 0, by a hash of the id: (id hash, label, text).

    Of a text of more than ``chars`` characters a piece from a place that its id decides.

    Also the logarithm of how many times likelier label 1 is among all labelled
    rows than among those drawn.  An id with both labels, or none, isn't drawn.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    known = settle(known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most").select("_id", "_label"))
    n = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    share = F.pmod(F.xxhash64(F.lit(23), F.col("_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    pick = F.lit(False)
    for value, most in ((1, yes), (0, no)):
        if n.get(value):
            pick = pick | ((F.col("_label") == value) & (share < most / n[value]))
    # About yes + no rows of two numbers, whatever the size of the corpus.
    chosen = F.broadcast(known.where(pick).limit(2 * (yes + no)))
    body = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).where("_text IS NOT NULL")
    place = (F.pmod(F.xxhash64("_id"), F.greatest(F.length("_text") - chars, F.lit(0)) + 1) + 1).cast("int")
    piece = F.substring(F.col("_text"), place, F.lit(chars))
    rows = body.join(chosen, "_id").select(F.xxhash64("_id").alias("h"), F.col("_label").alias("label"), piece.alias("text")).limit(2 * (yes + no)).collect()
    drawn = sorted(((r["h"], r["label"], r["text"]) for r in rows), key=lambda r: (r[0], r[2]))
    got = Counter(r[1] for r in drawn)
    shift = float(np.log(n[1] / n[0]) - np.log(got[1] / got[0])) if got[1] and got[0] else 0.0
    return drawn, shift


def lexicon(distinct: pa.Array, codes: np.ndarray, first: np.ndarray, toxic: np.ndarray, features: Features) -> np.ndarray:
    """Which feature indices mark toxic documents.

    A feature marks them if the share of toxic documents with it is LIFT times
    that of others, and so many would hardly have met by chance, and if the share
    of toxic documents' words with it is RATE times that of others.
    """
    index, who = features.of(distinct)
    order = np.argsort(who, kind="stable")
    index, edge = index[order], np.searchsorted(who[order], np.arange(len(distinct) + 1))
    size = 1 << features.bits
    counts, times = np.zeros((2, size), np.int64), np.zeros((2, size), np.int64)
    for i, kind in enumerate(toxic.astype(int).tolist()):
        word, often = np.unique(codes[first[i] : first[i + 1]], return_counts=True)
        if len(word):
            own = np.concatenate([index[edge[w] : edge[w + 1]] for w in word.tolist()])
            counts[kind][np.unique(own)] += 1
            np.add.at(times[kind], own, np.repeat(often, edge[word + 1] - edge[word]))
    good, bad = counts.astype(float)
    base = np.clip(toxic.mean(), 1e-9, 1 - 1e-9)
    total = np.maximum(good + bad, 1)
    q = np.clip(bad / total, 1e-9, 1 - 1e-9)
    surprise = total * (q * np.log(q / base) + (1 - q) * np.log((1 - q) / (1 - base)))
    lift = (bad / max(toxic.sum(), 1)) / ((good + 0.5) / max((~toxic).sum(), 1))
    n_words = [np.diff(first)[toxic == kind].sum() for kind in (False, True)]
    rate = (times[1] / max(n_words[1], 1)) / ((times[0] + 1) / max(n_words[0], 1))
    return (q > base) & (surprise >= CHANCE) & (lift >= LIFT) & (rate >= RATE)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Tagger | None:
    """Fits on all given rows of ``labels``; None if one class is missing or no word marks it."""
    rows, shift = labelled(docs, labels, label, doc_id, text)
    rows = list({r[2]: r for r in reversed(rows)}.values())[::-1]  # copies count once
    toxic = np.array([r[1] == 1 for r in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    data, off = text_bytes(pa.array(first_lines([r[2] for r in rows]), pa.string()))
    codes, distinct, _, _, first, begin = line_words(data, off)
    row = np.repeat(np.arange(len(rows)), np.diff(first))
    features = replace(FEATURES, lexicon=lexicon(distinct, codes, first, toxic, FEATURES))
    index, who = FEATURES.of(distinct)
    marks = np.bincount(who, features.lexicon[index], len(distinct)) > 0
    gold = (marks[codes] & toxic[row]).astype(np.int64)
    if not gold.any():
        return None
    # Chains with a marked word, and as many again or a fifth of the others.
    marked = np.add.reduceat(gold, begin[:-1]) > 0
    rest = np.flatnonzero(~marked & ~toxic[row[begin[:-1]]])
    rng = np.random.default_rng(5)
    rest = rng.permutation(rest)[: max(4 * int(marked.sum()), len(rest) // 5)]
    chosen = np.sort(np.concatenate([np.flatnonzero(marked), rest]))
    lens = np.diff(begin)[chosen]
    own = np.append(0, np.cumsum(lens))
    place = np.repeat(begin[chosen] - own[:-1], lens) + np.arange(own[-1])
    field = fit(["clean", "toxic"], features, distinct, codes[place], own, gold[place])
    data, off = text_bytes(pa.array([r[2] for r in rows], pa.string()))
    codes, distinct, _, _, first, begin = line_words(data, off)
    m = field.marginals(field.emissions(distinct)[codes], begin)[:, 1]
    weights = calibrate(evidence(m, first), toxic)
    weights[0] += shift
    return Tagger(field, weights)


def first_lines(texts: list[str]) -> list[str]:
    """The texts without lines that an earlier one has, so that near copies don't count as many documents."""
    seen: set[str] = set()
    out = []
    for t in texts:
        lines = t.split("\n")
        out.append("\n".join(x for x in lines if x not in seen))
        seen.update(lines)
    return out


def evidence(marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By document: bias, largest marginal, log of the summed marginals over SPAN / 5, and log of their share of the words."""
    size = np.diff(first)
    out = np.zeros((len(size), 4))
    out[:, 0] = 1
    some = np.flatnonzero(size)
    if len(some):
        out[some, 1] = np.maximum.reduceat(marginal, first[some])
    strong = np.where(marginal >= SPAN / 5, marginal, 0)
    total = np.concatenate([[0], np.cumsum(strong, dtype=np.float64)])
    total = total[first[1:]] - total[first[:-1]]
    out[:, 2] = np.log1p(total)
    out[:, 3] = np.where(total > 0, np.log((total + 0.3) / (size + 30)) - np.log(0.3 / 3000), 0)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
    return w


def score(docs: DataFrame, tagger: Tagger | None, text: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` with score, predicted (score >= ``least``) and toxic_spans.

    toxic_spans are byte ranges of the UTF-8 text with the mean marginal of
    their words.  Null and empty texts have the score of a text without toxic
    words; without a tagger every score is 0.  Repeated rows have one score;
    columns of ``docs`` that are called like a new one are replaced, others come
    along.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def work():
        model = sent.value

        def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
            data, off = text_bytes(column)
            n, kind = part.num_rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            if model is None:
                return [pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int32)), pa.array([[]] * n, kind)]
            codes, distinct, starts, ends, first, begin = line_words(data, off)
            m = model.field.marginals(model.field.emissions(distinct)[codes], begin)[:, 1] if len(codes) else np.zeros(0)
            value = 1 / (1 + np.exp(-np.clip(evidence(m, first) @ model.calibration, -30, 30)))
            spans: list[list[dict]] = [[] for _ in range(n)]
            hot = np.flatnonzero(m >= SPAN)
            if len(hot):
                row = np.searchsorted(first, hot, "right") - 1
                split = np.flatnonzero((np.diff(hot) != 1) | (np.diff(row) != 0)) + 1
                for group in np.split(hot, split):
                    r = int(np.searchsorted(first, group[0], "right") - 1)
                    spans[r].append({"start": int(starts[group[0]] - off[r]), "end": int(ends[group[-1]] - off[r]), "score": float(m[group].mean())})
            return [pa.array(value), pa.array((value >= least).astype(np.int32)), pa.array(spans, kind)]

        return step

    return append_columns(docs, text, "score double, predicted int, toxic_spans array<struct<start:long,end:long,score:double>>", work, limit=1 << 20)
