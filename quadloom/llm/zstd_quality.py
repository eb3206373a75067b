"""Quality by compression: dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled text.  A text is cut into
chunks of ``CHUNK`` bytes and each chunk is compressed with both, so that a
dictionary keeps its weight however long the text is.  The normalised difference
of the compressed sizes, and the size with the good dictionary normalised by the
text's length (runs of one word are small with either), become a probability by a
logistic calibration on labelled rows that the dictionaries haven't seen.

Fitted on the driver from a bounded sample: at most ``PER_CLASS`` rows of each
label and ``FIT_CHARS`` characters a row.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append_columns, text_bytes
from .toxicity import calibrate, labelled

PER_CLASS = 1200
FIT_CHARS = 6000
CHUNK = 4096
DICTIONARY = 64 << 10
LEVEL = 3
#: Bytes added to sizes before they are compared.
SHORT = 64


@dataclass
class Judge:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class Sizer:
    """Compressed sizes of a text's chunks with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zs

        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        made = []
        for d in (good, bad):
            held = zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_AUTO)
            held.precompute_compress(level=LEVEL)
            made.append(zs.ZstdCompressor(dict_data=held, level=LEVEL, **options))
        self.compressors = made

    def __call__(self, body: bytes) -> tuple[int, int]:
        chunks = [body[i : i + CHUNK] for i in range(0, len(body), CHUNK)]
        return tuple(sum(len(c.compress(x)) for x in chunks) for c in self.compressors)


def measures(sizes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bias, normalised difference, normalised size and their bends.

    SHORT bytes are added to all sizes, so that short texts, which tell little,
    come near the middle: an empty text has no difference and size 1.
    """
    good, bad = (sizes[:, k].astype(float) for k in range(2))
    diff = (bad - good) / (bad + good + 2 * SHORT)
    ratio = np.minimum((good + SHORT) / (length + SHORT), 1)
    size = np.log(np.maximum(length, 200))
    return np.stack([np.ones(len(length)), diff, ratio, diff * np.abs(diff), ratio**2, diff * size, np.minimum(ratio, 0.25)], axis=1)


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"\n".join(samples)[-size:]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Judge | None:
    """Fits on all given rows of ``labels``; None if one class is missing."""
    rows, shift = labelled(docs, labels, label, doc_id, text, PER_CLASS, PER_CLASS, FIT_CHARS)
    body = [r[2].encode() for r in rows]
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    # Rows come in the order of a hash: every second one of a class goes to its dictionary.
    turn = np.zeros(len(rows), int)
    for c in (0, 1):
        turn[y == c] = np.arange((y == c).sum()) % 2
    # Lines that several sampled rows share are copies, not a class's manner.
    shared = Counter(x for b in body for x in set(b.split(b"\n")))
    own = [b"\n".join(x for x in b.split(b"\n") if shared[x] == 1) for b in body]
    chunks = {c: [b[i : i + CHUNK] for b, k, t in zip(own, y, turn, strict=True) if k == c and t == 0 for i in range(0, len(b), CHUNK)] for c in (0, 1)}
    good, bad = dictionary(chunks[1]), dictionary(chunks[0])
    sizer = Sizer(good, bad)
    held = np.flatnonzero(turn == 1)
    if len(set(y[held].tolist())) < 2:
        held = np.arange(len(rows))
    x = measures(np.array([sizer(body[i]) for i in held]), np.array([len(body[i]) for i in held]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0, 1
    weights = calibrate((x - mean) / scale, y[held], ridge=0.3)
    weights[0] += shift
    return Judge(good, bad, mean, scale, weights)


def score(docs: DataFrame, judge: Judge | None, text: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` with score, predicted (score >= ``least``) and size_difference.

    Null and empty texts are scored like any other, as texts without bytes;
    without a judge every score is 0.5.  Repeated rows have one score; columns
    of ``docs`` that are called like a new one are replaced, others come along.
    """
    sent = docs.sparkSession.sparkContext.broadcast(judge)

    def work():
        model = sent.value
        sizer = Sizer(model.good, model.bad) if model else None

        def step(column: pa.Array, part: pa.RecordBatch) -> list[pa.Array]:
            n = part.num_rows
            if model is None:
                return [pa.array(np.full(n, 0.5)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n))]
            data, off = text_bytes(column)
            raw = data.tobytes()
            x = measures(np.array([sizer(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]).reshape(n, 2), np.diff(off))
            value = 1 / (1 + np.exp(-np.clip(((x - model.mean) / model.scale) @ model.weights, -30, 30)))
            return [pa.array(value), pa.array((value >= least).astype(np.int32)), pa.array(x[:, 1])]

        return step

    return append_columns(docs, text, "score double, predicted int, size_difference double", work)
