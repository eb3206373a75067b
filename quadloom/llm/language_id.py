"""Language identification by a linear-chain CRF over words.

Each word of a text gets a label by forward-backward, so that code-switched
texts come apart; a text's language is the one with the largest mean marginal.
The field is fitted on the driver from a bounded sample: about ``PER_LABEL``
rows of each label, ``FIT_CHARS`` characters each, joined into chains that switch
language, so that transitions are learned too.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, positional, restored, settle, text_bytes
from .crf import Crf, Features, fit, line_words

PER_LABEL = 400
FIT_CHARS = 2000
#: Every label is learned; beyond this many, fewer rows of each, in a smaller table of weights.
LABELS = 64
#: Rows of each label that are drawn, however many labels there are.
LEAST_ROWS = 20
UNKNOWN = "und"
#: A text whose best label has a lower score is rejected by the filter.
LEAST_SCORE = 0.4
#: Bytes of text in a block: a word holds about twenty features of eight bytes, for each label.
BLOCK = 1 << 19
FEATURES = Features(grams=(2, 3, 4), prefixes=(4, 5, 6), suffixes=(4, 5, 6))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def draw(docs: DataFrame, label: str, key: str, per_label: int, labels: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of ``key``; of more than ``labels``
    labels as many rows in all, and at least about LEAST_ROWS of each.

    The counts come first, from the label column alone.
    """
    counts = settle(docs.groupBy(label).agg(F.count("*").alias("_rows")))
    n = counts.count()
    if n > labels:
        per_label = max(per_label * labels // n, min(per_label, LEAST_ROWS))
    share = F.pmod(F.xxhash64(F.lit(11), F.col(key).cast("string")), F.lit(1 << 40)) / float(1 << 40)
    taken = docs.join(F.broadcast(counts), label).where(share < 1.2 * per_label / F.col("_rows"))
    return taken.drop("_rows").limit(2 * per_label * n)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_label: int = PER_LABEL, seed: int = 3) -> Crf | None:
    """The field of the non-null languages of ``docs``; None where there is nothing to learn."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    source = source.where("lang IS NOT NULL AND text IS NOT NULL")
    taken = draw(source, "lang", "doc_id", per_label, LABELS)
    # A part of the text from a place that its id decides.
    place = (F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - FIT_CHARS, F.lit(0)) + 1) + 1).cast("int")
    rows = taken.select("lang", F.substring(F.col("text"), place, F.lit(FIT_CHARS)).alias("text"), F.xxhash64("doc_id").alias("h")).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], r["text"]))
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    number = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    pieces = []
    for r in rows:
        line = r["text"].replace("\n", " ").split(" ")
        at = 0
        while at < len(line):
            n = int(rng.integers(4, 24))
            pieces.append((number[r["lang"]], " ".join(line[at : at + n])))
            at += n
    order = rng.permutation(len(pieces))
    # Lines of one to three pieces.
    texts, gold_of = [], []
    for i in order.tolist():
        if not texts or rng.random() < 0.5:
            texts.append([])
        texts[-1].append(pieces[i])
    body, marks = [], []
    for line in texts:
        for k, (label, x) in enumerate(line):
            body.append(("\n" if k == 0 else " ") + x)
            marks.append(label)
    raw = [x.encode() for x in body]
    data = np.frombuffer(b"".join(raw), np.uint8)
    edge = np.cumsum([0] + [len(x) for x in raw])
    codes, distinct, starts, _, _, begin = line_words(data, np.array([0, len(data)]))
    gold_of = np.array(marks)[np.searchsorted(edge, starts, "right") - 1]
    if not len(codes):
        return None
    # Weights and a step's words hold a number for each label: of more labels, fewer of both.
    more = -(-len(labels) // LABELS)
    features = replace(FEATURES, bits=FEATURES.bits - (more - 1).bit_length())
    return fit(labels, features, distinct, codes, begin, gold_of, batches=12 * more)


def identify(docs: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and word_langs.

    score is the mean marginal of lang_pred over the words; word_langs counts
    the words by their likeliest label.  Null texts and texts without a letter
    are `und` with score 0, and so is every text if nothing could be learned.
    Repeated rows are labelled alike; columns of ``docs`` that are called like a
    new one are replaced, others come along.  A long text is a block alone, some
    30 bytes a word and label.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        import regex

        field, letter = sent.value, regex.compile(r"\p{L}")

        def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
            data, off = text_bytes(column)
            codes, distinct, _, _, first, begin = line_words(data, off)
            n, k = part.num_rows, len(field.labels) if field else 0
            best, score = np.full(n, -1), np.zeros(n)
            counts = np.zeros((n, k), np.int64)
            if k and len(codes):
                m = field.marginals(field.emissions(distinct)[codes], begin)
                total = np.concatenate([np.zeros((1, k)), np.cumsum(m, axis=0, dtype=np.float64)])
                sums = total[first[1:]] - total[first[:-1]]
                size = np.diff(first)
                some = np.flatnonzero(size)
                best[some] = sums[some].argmax(axis=1)
                score[some] = np.clip(sums[some].max(axis=1) / size[some], 0, 1)
                top = np.concatenate([np.zeros((1, k), np.int64), np.cumsum(np.eye(k, dtype=np.int64)[m.argmax(axis=1)], axis=0)])
                counts = top[first[1:]] - top[first[:-1]]
                ascii_letter = np.concatenate([[0], np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))])
                for i in np.flatnonzero((best >= 0) & (ascii_letter[off[1:]] == ascii_letter[off[:-1]])).tolist():
                    if not letter.search(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")):
                        best[i], score[i] = -1, 0.0
            names = [*(field.labels if field else []), UNKNOWN]
            spread = [[{"lang": names[c], "n_words": int(x)} for c, x in enumerate(row) if x] for row in counts.tolist()]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64())]))
            return [pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score), pa.array(spread, kind)]

        return step

    return append_columns(docs, text, "lang_pred string, score double, word_langs array<struct<lang:string,n_words:long>>", work, limit=BLOCK // -(-max(1, len(model.labels) if model else 0) // LABELS))


def keep_known(docs: DataFrame, model: Crf | None, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows that are `und` or whose score is below ``least``."""
    scored = identify(positional(docs), model, f"c{docs.columns.index(text)}_")
    return restored(scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs)
