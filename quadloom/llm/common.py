"""Shared pieces: settled tables, column-appending Arrow maps, byte-level words.

All Python work runs in ``mapInArrow`` over blocks of bounded size, vectorised
over the raw UTF-8 bytes of a block; no operator loops over single rows of the
whole input on the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Tuple  # noqa: UP035  the form that Spark reads from hints

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step holds; a longer text is a block alone.
BLOCK_BYTES = 2 << 20

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where no folder is named and all runs on one machine (tests) a
    temporary one is set; a cluster without a shared folder is an error.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quadloom-')}")
        named = spark.sparkContext.getCheckpointDir()
    return named


def lean(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands Python 8 MB of rows at a time, where it names no other limit."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "8m")
    return df


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that read this table, not
    the work that made it.  The schema is given, so that reading starts no job.
    ``by`` names a column whose values get folders of their own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quadloom-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    _SETTLED.append(path)
    return out


#: Folders that settle has written in this process and that are still there.
_SETTLED: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _SETTLED.remove(path)


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for t in tables:
        if getattr(t, "_settled", None) in _SETTLED:
            _delete(t.sparkSession, t._settled)


def clear(spark: SparkSession) -> int:
    """Delete all settled tables, once the results that read them have been written."""
    n = len(_SETTLED)
    for path in list(_SETTLED):
        _delete(spark, path)
    return n


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns named by their place, so that none is called like what an operator adds."""
    return df.toDF(*[f"c{i}_" for i in range(len(df.columns))])


def restored(df: DataFrame, like: DataFrame, text: str | None = None, made: str | None = None) -> DataFrame:
    """The columns of ``like`` from a ``positional`` one, ``text`` being replaced by the column ``made``."""
    return df.select(*[F.col(made if made and c == text else f"c{i}_").alias(c) for i, c in enumerate(like.columns)])


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` is called so, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def blocks(batch: pa.RecordBatch, text: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose text column holds at most ``limit`` bytes, or one row."""
    n = batch.num_rows
    if not n:
        return
    _, off = text_bytes(batch.column(text))
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def append_columns(
    df: DataFrame,
    text: str,
    made: str,
    work: Callable[[], Callable[[pa.Array, pa.RecordBatch], list[pa.Array]]],
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with the columns of the DDL ``made``, computed per block of rows.

    ``work()`` is called once per task and returns the function that maps the
    texts of a block, and the block with all columns, to the arrays of the new
    columns.  An input column named like a new one, in any case, is replaced;
    that may be the text itself.
    """
    new = T._parse_datatype_string(made)
    kept = [c for c in df.columns if c.lower() not in {f.name.lower() for f in new}]
    at, columns = df.columns.index(text), [df.columns.index(c) for c in kept]
    schema = T.StructType([df.schema[i] for i in columns] + list(new))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            for part in blocks(batch, at, limit):
                arrays = step(part.column(at), part)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in columns] + arrays, names)
                del arrays, part
            pa.default_memory_pool().release_unused()

    return lean(df).mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]), off - off[0]


def _table(keep) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[[b for b in range(256) if keep(b)]] = True
    return lut


#: Bytes of `[^\x20\x09-\x0D]+` words.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words, of lower-cased text.
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Bytes of letters: ASCII letters and all that lies beyond ASCII.
LETTERS = _table(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: A-Z to a-z, the rest as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte range of each word, and each row's range of words.

    No word reaches over the end of a row.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = lut[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[(off > 0) & (off < n)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words as a binary array, exact."""
    lens = ends - starts
    offsets = np.zeros(len(lens) + 1, np.int32)
    np.cumsum(lens, out=offsets[1:])
    if not len(lens):
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    body = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
    array = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser of SplitMix64 (public domain)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges first[i]:first[i+1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def apply_groups(df: DataFrame, keys: list[str], work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on the batches of each group, read as a stream."""

    def run(key: Tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: UP006
        yield from work(rows)

    return df.groupBy(*keys).applyInArrow(run, schema)
