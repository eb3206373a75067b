"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most ``size`` tokens: full
pieces and one remainder.  Only the histogram of piece lengths, at most ``size``
numbers, reaches the driver.  There lengths are placed longest first, each in
the packs with the most room; a pack is a pattern of lengths with a count, and
placing a length moves counts from one pattern to another, so the work depends
on the number of distinct lengths, not of documents.  The patterns become a
table of slots, at most some thousand rows, and pieces find their slot by their
rank among the pieces of their length.

Ranks are taken within (length, salt) and raised by the counts of lower salts.  A
length has a salt for every ``PER_SALT`` of its pieces, dealt by a number that
each piece gets where it is cut, so that neither a length nor equal rows burden a
task, and the salts' counts, which are broadcast, stay few.

Sequences are padded to ``size``; one whose tokens are a power of two needs none.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, settle, text_bytes

SIZE = 1024
#: Pieces of one length in a salt.
PER_SALT = 500_000
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Pieces that one output batch holds.
ROWS = 8192


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The byte-level BPE of a ``tokenizers`` JSON file, as a ``tiktoken`` encoder with the strings of its added tokens.

    Ids equal those of ``tokenizers`` with add_special_tokens=False (tests hold
    the two against each other).  Needs a file whose merges are in the order of
    their ids, and whose added tokens are plain strings.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, added = whole["model"], {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
    if any(t[k] for t in whole.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that aren't plain strings")
    # The printable stand-ins of byte-level BPE: visible bytes stand for themselves.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    vocab = model["vocab"]
    ids = [vocab[m.replace(" ", "")] for m in merges]
    if ids != sorted(ids):
        raise ValueError("merges aren't in the order of ids")
    plain = {"".join(m.split(" ")) for m in merges} | set(byte)
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t in plain}
    ranks = {t: i for t, i in ranks.items() if i not in added.values()}
    return tiktoken.Encoding("quadloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(encoder, text: str, special: bool = True) -> list[int]:
    """Ids of ``text``; the strings of added tokens become those, or ordinary text if not ``special``."""
    if special and any(t in text for t in encoder.special_tokens_set):
        return encoder.encode(text, allowed_special="all")
    return encoder.encode_ordinary(text)


def cut_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None, keep_ids: bool = False, special: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, deal[, ids]): each document's tokens, cut.

    A document's tokens are its ids and then id 0; null text counts as empty.
    deal is a number that equal pieces of a task don't share.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    fixed = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, count = byte_bpe(fixed or vocabulary_path()), 0
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            raw, rows = data.tobytes(), {k: [] for k in ("row", "start", "length", "crc", "total", "deal", "ids")}

            def flush(rows=rows, batch=batch):
                ids = batch.column(0).take(pa.array(rows["row"], pa.int64()))
                made = [ids] + [pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc", "total", "deal")]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"]
                if keep_ids:
                    made.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                for v in rows.values():
                    v.clear()
                return pa.RecordBatch.from_arrays(made, names)

            for i in range(batch.num_rows):
                ids = token_ids(encoder, raw[off[i] : off[i + 1]].decode("utf-8", "replace"), special)
                ids.append(END_ID)
                tokens = np.array(ids, "<u4")
                for start in range(0, len(tokens), size):
                    piece = tokens[start : start + size]
                    rows["row"].append(i)
                    rows["start"].append(start)
                    rows["length"].append(len(piece))
                    rows["crc"].append(zlib.crc32(piece.tobytes()))
                    rows["total"].append(len(tokens))
                    rows["deal"].append(rows["crc"][-1] ^ (count * 0x9E3779B1 & 0xFFFFFFFF))
                    count += 1
                    if keep_ids:
                        rows["ids"].append(piece.astype(np.int32))
                if len(rows["row"]) >= ROWS:
                    yield flush()
            if rows["row"]:
                yield flush()

    made = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, deal long" + ", ids array<int>" * keep_ids
    return lean(source).mapInArrow(run, made)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, count) that hold each length as often as the histogram says.

    Lengths go longest first into the packs with the most room; a length that
    doesn't fit there opens new packs.  Counts move whole, so the number of
    patterns grows with the number of lengths only.
    """
    room: dict[int, list[list]] = {}
    heap: list[int] = []

    def put(pattern: tuple[int, ...], count: int) -> None:
        free = size - sum(pattern)
        if free not in room:
            room[free] = []
            heapq.heappush(heap, -free)
        room[free].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens doesn't fit {size}")
        new: list[tuple[tuple[int, ...], int]] = []
        while left:
            while heap and not room[-heap[0]]:
                del room[-heapq.heappop(heap)]
            if not heap or -heap[0] < length:
                each = size // length if length * 2 <= size else 1
                whole, rest = divmod(left, each)
                if whole:
                    new.append(((length,) * each, whole))
                if rest:
                    new.append(((length,) * rest, 1))
                left = 0
                break
            pattern, count = room[-heap[0]].pop()
            times = min((size - sum(pattern)) // length, left)
            used = min(count, left // times)
            new.append((pattern + (length,) * times, used))
            left -= used * times
            if count > used:
                room[-heap[0]].append([pattern, count - used])
        for pattern, count in new:
            put(pattern, count)
    return [(p, c) for packs in room.values() for p, c in packs]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, sequence, offset): rank r in [low, high) goes to sequence + r - low."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            low = taken.get(length, 0)
            taken[length] = low + count
            rows.append((length, low, low + count, sequence, offset))
            offset += length
        sequence += count
    return rows


def pack(pieces: DataFrame, size: int = SIZE, per_salt: int = PER_SALT) -> DataFrame:
    """``pieces`` with (sequence_id, offset).  ``pieces`` has doc_id, start, length, ids_crc32 and deal,
    which is dropped; the table is read three times and must be the same each time.

    Pieces that tie in all of these are alike, so any order of them is right.
    An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    patterns = shortest_pack_first(counts, size)
    table = spark.createDataFrame(slots(patterns), "_length long, _low long, _high long, _sequence long, offset long")
    salts = spark.createDataFrame([(k, -(-n // per_salt)) for k, n in counts.items()], "length long, _salts long")
    dealt = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("deal"), "_salts")).drop("_salts")
    # A row for each length and each PER_SALT pieces.
    counted = settle(dealt.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    below = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "_salt", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_base"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(base), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    placed = ranked.join(F.broadcast(table), fits)
    return placed.select(*[c for c in pieces.columns if c != "deal"], (F.col("_sequence") + F.col("_rank") - F.col("_low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None, keep_ids: bool = False, special: bool = True) -> DataFrame:
    """All documents as pieces in padded sequences of ``size`` tokens.

    Null and empty texts are one piece of the end id; repeated rows are packed
    as often as they occur; other columns aren't read.  A text's tokens are held
    by one task, 28 bytes a token.
    """
    return pack(settle(cut_pieces(docs, doc_id, text, size, path, keep_ids, special)), size)
