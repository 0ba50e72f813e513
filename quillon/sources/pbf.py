"""Map extracts in PBF: nodes, ways and relations, read by many tasks from any part of a file."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = "kind STRING, id BIGINT, version INT, tags MAP<STRING, STRING>, x DOUBLE, y DOUBLE, refs ARRAY<BIGINT>, members ARRAY<STRUCT<kind: STRING, ref: BIGINT, role: STRING>>"
_ARROW = pa.schema(
    [
        ("kind", pa.string()), ("id", pa.int64()), ("version", pa.int32()), ("tags", pa.map_(pa.string(), pa.string())), ("x", pa.float64()), ("y", pa.float64()),
        ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))),
    ]
)
#: Fixed values of the format: how a block's header starts, and the most bytes that a header and a block may have.
STARTS = (b"\x0a\x07OSMData", b"\x0a\x09OSMHeader")
HEADER_BYTES, BLOCK_BYTES = 64 << 10, 32 << 20
MEMBERS = ("node", "way", "relation")


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message: integers as they are, all else as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 2, 5):
            n, at = _varint(data, at) if wire == 2 else (8 if wire == 1 else 4, at)
            if at + n > len(data):
                raise ValueError("a field ends after its message")
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"no wire type {wire}")
        yield key >> 3, value


def packed(data: memoryview) -> np.ndarray:
    """The unsigned integers of a packed field."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.bitwise_or.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def signed(v: np.ndarray) -> np.ndarray:
    """Zigzag integers."""
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def _zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _long(v: int) -> int:
    """A plain integer, negative ones being written as 64 bits."""
    return v - (1 << 64) if v >> 63 else v


def unpacked(blob: bytes) -> memoryview:
    """The content of a blob: plain, or compressed by zlib, lzma or zstd."""
    for number, value in fields(memoryview(blob)):
        if number == 1:
            return value
        if number == 3:
            return memoryview(zlib.decompress(value))
        if number == 4:
            return memoryview(lzma.decompress(value))
        if number == 7:
            import zstandard

            return memoryview(zstandard.ZstdDecompressor().decompress(bytes(value), max_output_size=BLOCK_BYTES))
        if number in (5, 6):
            raise ValueError(f"blobs compressed by method {number} are not read")
    return memoryview(b"")


def _dense(data: memoryview, place, text: list[str]) -> Iterator[dict]:
    """Nodes whose ids and places are told by differences, their tags as one list with a zero after each node."""
    got = {n: v for n, v in fields(data) if not isinstance(v, int)}
    none = memoryview(b"")
    ids, lat, lon = (np.cumsum(signed(packed(got.get(n, none)))) for n in (1, 8, 9))
    pairs = packed(got.get(10, none)).tolist()
    info = {n: v for n, v in fields(got[5]) if not isinstance(v, int)} if 5 in got else {}
    versions = packed(info.get(1, none)).tolist() or [0] * len(ids)
    x, y = place(lon, lat)
    at = 0
    for i, (one, version, px, py) in enumerate(zip(ids.tolist(), versions, x.tolist(), y.tolist(), strict=True)):
        tags = []
        while at < len(pairs) and pairs[at]:
            tags.append((text[pairs[at]], text[pairs[at + 1]]))
            at += 2
        at += 1
        yield {"kind": "node", "id": one, "version": version, "tags": tags, "x": px, "y": py}


def _element(number: int, data: memoryview, place, text: list[str]) -> dict:
    """A node (1), way (3) or relation (4)."""
    got = dict(fields(data))
    none = memoryview(b"")
    keys, values = (packed(got.get(n, none)).tolist() for n in (2, 3))
    info = dict(fields(got[4])) if 4 in got else {}
    out = {"version": info.get(1, 0), "tags": [(text[k], text[v]) for k, v in zip(keys, values, strict=True)]}
    if number == 1:
        x, y = place(np.array([_zigzag(got[9])]), np.array([_zigzag(got[8])]))
        return out | {"kind": "node", "id": _zigzag(got[1]), "x": float(x[0]), "y": float(y[0])}
    if number == 3:
        return out | {"kind": "way", "id": _long(got[1]), "refs": np.cumsum(signed(packed(got.get(8, none)))).tolist()}
    roles, kinds = (packed(got.get(n, none)).tolist() for n in (8, 10))
    refs = np.cumsum(signed(packed(got.get(9, none)))).tolist()
    return out | {"kind": "relation", "id": _long(got[1]), "members": [{"kind": MEMBERS[k], "ref": r, "role": text[s]} for k, r, s in zip(kinds, refs, roles, strict=True)]}


def elements_of(content: memoryview) -> Iterator[dict]:
    """The elements of a block. Places are billionths of a degree: an offset and so many steps of a width."""
    parts = list(fields(content))
    plain = {n: v for n, v in parts if isinstance(v, int)}
    text = [str(v, "utf-8", "replace") for n, table in parts if n == 1 for k, v in fields(table) if k == 1]
    width, lat0, lon0 = plain.get(17, 100), _long(plain.get(19, 0)), _long(plain.get(20, 0))
    place = lambda lon, lat: ((lon0 + width * lon) / 1e9, (lat0 + width * lat) / 1e9)
    for n, group in parts:
        if n == 2:
            for number, data in fields(group):
                if number == 2:
                    yield from _dense(data, place, text)
                elif number in (1, 3, 4):
                    yield _element(number, data, place, text)


def _header(f: pa.NativeFile, at: int, size: int) -> tuple[bool, int, int] | None:
    """(whether it holds elements, where its blob starts, where it ends) of the block at a place; None if no block starts there."""
    length = int.from_bytes(f.read_at(4, at), "big") if at + 4 < size else 0
    if not 9 <= length <= HEADER_BYTES:
        return None
    head = f.read_at(length, at + 4)
    if not head.startswith(STARTS):
        return None
    try:
        n = dict(fields(memoryview(head)))[3]
    except (KeyError, IndexError, ValueError):
        return None
    start = at + 4 + length
    return (head.startswith(STARTS[0]), start, start + n) if n <= BLOCK_BYTES and start + n <= size else None


def _first(f: pa.NativeFile, start: int, end: int, size: int, step: int = 1 << 20) -> int | None:
    """Where the first block starts within a range. What looks like a header must lead to another one, or to the end of the file."""
    for base in range(start, end, step):
        data = f.read_at(min(step + 16, size - base), base)
        found = sorted(i for s in STARTS for i in _places(data, s) if i >= 4 and base + i - 4 < end)
        for i in found:
            if _led_on(f, base + i - 4, size):
                return base + i - 4
    return None


def _led_on(f: pa.NativeFile, at: int, size: int) -> bool:
    """Whether a block starts at a place and leads to another one, or to the end of the file."""
    head = _header(f, at, size)
    return bool(head and (head[2] == size or _header(f, head[2], size)))


def _places(data: bytes, text: bytes) -> Iterator[int]:
    at = data.find(text)
    while at >= 0:
        yield at
        at = data.find(text, at + 1)


def blobs(path: str, start: int, end: int) -> Iterator[bytes]:
    """The blobs with elements whose blocks start in a range of a file."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        size = f.size()
        at = 0 if start == 0 else _first(f, start, min(end, size), size)
        while at is not None and at < size:
            head = _header(f, at, size)
            # the task of the next range finds only a block that leads on, so this one tells of any other
            if head is None or (at >= end and not _led_on(f, at, size)):
                raise ValueError(f"{path} has no whole block at byte {at if head is None else head[2]}")
            if at >= end:
                break
            if head[0]:
                yield f.read_at(head[2] - head[1], head[1])
            at = head[2]


def read_pbf(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """(kind, id, version, tags, x, y, refs, members) of the nodes, ways and relations of the .pbf files at a path.

    Spark lists the files without reading them, and deals their ranges of `split` bytes to tasks. Each finds the first block that starts in its range, then reads block after block, so a file of any length is read
    by as many tasks as it has ranges, and a task holds one block (of 32 MB at most). Tasks open files through Arrow's file systems. A file that is cut off or damaged ends the read with an error; an empty one has no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for blob in blobs(p, start, end):
                    rows = list(elements_of(unpacked(blob)))
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pbf").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    starts = files.select("path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split).cast("bigint"))).alias("start"), "length")
    # each range is a task of its own, as far as the session's partitions go
    ranges = starts.select("path", "start", F.least(F.col("start") + split, "length").alias("end")).repartition("path", "start")
    return ranges.mapInArrow(read, ELEMENTS)
