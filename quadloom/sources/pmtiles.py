"""PMTiles version 3 archives, by the public specification.

Reading: ``spark.read.format("quadloom_pmtiles").load(path)`` after
``register(spark)`` gives (tile_id, payload), one partition for the root
directory and one for each leaf.  Writing is one file, so one task writes it.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = struct.Struct("<7sB11Q6B4iB2i")
MAGIC = b"PMTiles"
#: Entries of a directory beyond which leaves are written.
LEAF = 4096


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _read_varints(raw: bytes) -> Iterator[int]:
    value = shift = 0
    for b in raw:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            yield value
            value = shift = 0


def pack_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """(tile_id, offset, length, run) in order of ids; run 0 points to a leaf."""
    out = [_varint(len(entries))]
    last = 0
    for tile, *_ in entries:
        out.append(_varint(tile - last))
        last = tile
    out += [_varint(run) for *_, run in entries] + [_varint(length) for _, _, length, _ in entries]
    end = None
    for _, offset, length, _ in entries:
        out.append(_varint(0 if offset == end else offset + 1))
        end = offset + length
    return gzip.compress(b"".join(out), mtime=0)


def unpack_directory(raw: bytes, packed: bool = True) -> list[tuple[int, int, int, int]]:
    v = list(_read_varints(gzip.decompress(raw) if packed else raw))
    n, at = v[0], 1
    ids, runs, lengths, offsets = (v[at + i * n : at + (i + 1) * n] for i in range(4))
    out, tile, end = [], 0, 0
    for d, run, length, offset in zip(ids, runs, lengths, offsets, strict=True):
        tile += d
        begin = end if offset == 0 else offset - 1
        out.append((tile, begin, length, run))
        end = begin + length
    return out


def write_file(path: str, tiles: Iterator[tuple[int, bytes]], header: dict | None = None, metadata: dict | None = None, leaf: int = LEAF) -> int:
    """One archive of tiles in ascending order of ids; gives the number written."""
    body, entries, seen, count = bytearray(), [], {}, 0
    for tile, payload in tiles:
        if entries and tile <= entries[-1][0] + max(entries[-1][3], 1) - 1:
            raise ValueError("ids must ascend")
        count += 1
        if payload in seen:
            offset, length = seen[payload]
            last = entries[-1]
            if (last[1], last[2]) == (offset, length) and tile == last[0] + last[3]:
                entries[-1] = (*last[:3], last[3] + 1)
                continue
        else:
            offset, length = len(body), len(payload)
            seen[payload] = offset, length
            body += payload
        entries.append((tile, offset, length, 1))
    leaves = b""
    root = entries
    if len(entries) > leaf:
        root = []
        for i in range(0, len(entries), leaf):
            raw = pack_directory(entries[i : i + leaf])
            root.append((entries[i][0], len(leaves), len(raw), 0))
            leaves += raw
    root_raw, meta = pack_directory(root), gzip.compress(json.dumps(metadata or {}).encode(), mtime=0)
    h = {"tile_type": 2, "min_zoom": 0, "max_zoom": 0, "min_lon_e7": 0, "min_lat_e7": 0, "max_lon_e7": 0, "max_lat_e7": 0, "center_zoom": 0, "center_lon_e7": 0, "center_lat_e7": 0} | (header or {})
    at = HEAD.size
    spans = []
    for part in (root_raw, meta, leaves, body):
        spans += [at, len(part)]
        at += len(part)
    head = HEAD.pack(MAGIC, 3, *spans, count, len(entries), len(seen), 1, 2, 1, h["tile_type"], h["min_zoom"], h["max_zoom"], h["min_lon_e7"], h["min_lat_e7"], h["max_lon_e7"], h["max_lat_e7"], h["center_zoom"], h["center_lon_e7"], h["center_lat_e7"])
    with open(path, "wb") as f:
        for part in (head, root_raw, meta, leaves, bytes(body)):
            f.write(part)
    return count


def read_header(path: str) -> dict:
    with open(path, "rb") as f:
        v = HEAD.unpack(f.read(HEAD.size))
    if v[0] != MAGIC or v[1] != 3:
        raise ValueError("not a PMTiles 3 archive")
    names = ["root_at", "root_size", "meta_at", "meta_size", "leaves_at", "leaves_size", "body_at", "body_size", "n_tiles", "n_entries", "n_contents", "clustered", "internal", "compression", "tile_type", "min_zoom", "max_zoom", "min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7", "center_zoom", "center_lon_e7", "center_lat_e7"]
    return dict(zip(names, v[2:], strict=True))


def read_metadata(path: str) -> dict:
    h = read_header(path)
    with open(path, "rb") as f:
        f.seek(h["meta_at"])
        return json.loads(gzip.decompress(f.read(h["meta_size"])))


class _Part(InputPartition):
    def __init__(self, at: int, size: int):
        self.at, self.size = at, size


class PmtilesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        h = read_header(self.path)
        with open(self.path, "rb") as f:
            f.seek(h["root_at"])
            root = unpack_directory(f.read(h["root_size"]), h["internal"] == 2)
        leaves = [_Part(h["leaves_at"] + offset, length) for _, offset, length, run in root if run == 0]
        return leaves if len(leaves) == len(root) and root else [_Part(h["root_at"], h["root_size"]), *leaves]

    def read(self, partition: _Part) -> Iterator[tuple]:
        h = read_header(self.path)
        with open(self.path, "rb") as f:
            f.seek(partition.at)
            for tile, offset, length, run in unpack_directory(f.read(partition.size), h["internal"] == 2):
                if run:
                    f.seek(h["body_at"] + offset)
                    payload = f.read(length)
                    for k in range(run):
                        yield tile + k, payload


class PmtilesSource(DataSource):
    """Files must be on a path that all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "quadloom_pmtiles"

    def schema(self) -> str:
        return "tile_id long, payload binary"

    def reader(self, schema) -> PmtilesReader:
        return PmtilesReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PmtilesSource)


def export(tiles: DataFrame, path: str, header: dict | None = None, metadata: dict | None = None) -> int:
    """(tile_id, payload) to one file; rows are streamed to the driver in order, an archive is one file."""
    rows = tiles.select("tile_id", "payload").sort("tile_id").toLocalIterator()
    return write_file(path, ((r[0], bytes(r[1])) for r in rows), header, metadata)
