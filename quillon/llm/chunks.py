"""Repeated keys of a corpus without a row for each key.

Documents are dealt by a hash of their id and text into chunks of a few MB, whatever their source or content. A chunk sends each range of
keys one row: its distinct keys that fall into the range, sorted and compressed. The keys that meet are compared, and each chunk is answered
by one bit for each of its keys. A chunk can make the same sorted keys again, so bits are all it needs.

A chunk sends FAN rows at most. Up to FAN chunks need no more than that. Of more, FAN chunks at a time meet in a node for each range, which merges their keys and sends
them on in ranges that are finer by FAN, until what is left fits; answers come back the same way. So an exchange has FAN rows for each chunk and step, the steps grow with the
logarithm of the input, and no task holds more than about a chunk's worth of keys.

A key that occurs a million times in a chunk is sent once, and once by a node, so no task holds more of a hot key than FAN rows, and no
pairs of occurrences arise anywhere. Which bucket a key falls into is decided by a second hash, so that the bits that tell two keys apart grow with the number of buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, ship, trim
from .hashing import mix, utf8

CHUNK_BYTES = 3 << 20
#: Rows of a chunk in an exchange, and chunks that meet at a time.
FAN = 512
KEYS = "bucket bigint, chunk bigint, kind int, n int, keys binary, fine binary, more binary, docs binary, ids binary, low binary"
ANSWERS = "chunk bigint, bucket bigint, kind int, bits binary"
#: Which keys get the answer 1: those of another chunk, or those that another chunk has in a document that comes before (by its id, then by the low number given with it). FAMILY: two answers
#: for each pair of a family and a member: whether a smaller document has the member, and whether it has not though some document that is not the family's first
#: has a member of its own.
#: TIMES: how many owners all chunks together have counted for the key.
OTHER, SMALLER, FAMILY, TIMES, PASS = 0, 1, 2, 3, 9
NULL_ID = np.iinfo(np.int64).min


class Buckets:
    """n buckets, and how many of them a range holds at each step: the last one holds one, and each width is a multiple of the next."""

    def __init__(self, n: int):
        self.n, self.fan = n, FAN
        self.widths = [-(-n // FAN)]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // FAN))
        for i in range(len(self.widths) - 2, -1, -1):
            self.widths[i] = -(-self.widths[i] // self.widths[i + 1]) * self.widths[i + 1]


def pressed(a: np.ndarray) -> bytes:
    """The bytes of a, by significance and compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else a
    return np.int64(len(a)).tobytes() + pa.compress(pa.py_buffer(planes.tobytes()), "zstd", asbytes=True)


def unpressed(b: bytes, dtype) -> np.ndarray:
    n, size = int(np.frombuffer(b[:8], np.int64)[0]), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(b[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids as numbers; a null id counts as the smallest."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def chunked(docs: DataFrame, id_col: str, text_col: str, n_chunks: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, data): some documents of a chunk as a compressed Arrow stream of (doc_id, text) and the columns to keep, as k0, k1 and so on.

    Rows with the same id are dealt by their texts' lengths and ends, empty ones in turn. Only rows that have all of these in common always share a chunk.
    """
    ship(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = count()

        def flush(held):
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column(0).combine_chunks() if t.num_rows else t.column(0)
            what = _ends(t.column(1).combine_chunks())
            empty = np.flatnonzero(what == 0)
            what[empty] = np.fromiter((next(turn) for _ in empty), np.uint64, len(empty))
            where = (mix(ids_of(ids).view(np.uint64) + mix(what + np.uint64(0x51ED27))) % np.uint64(n_chunks)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            chunks, blobs = [], []
            for part in np.split(order, cuts):
                sink = pa.BufferOutputStream()
                rows = t.take(pa.array(part)).combine_chunks()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(rows)
                chunks.append(where[part[0]])
                blobs.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "data"])

        forget()
        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                held.append(b.slice(at, 2048))
                size += sum(pc.binary_length(held[-1].column(1)).fill_null(0).to_numpy(zero_copy_only=False))
                if size >= 16 << 20:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)
        held = []
        trim()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep))).mapInArrow(pack, "chunk bigint, data binary")


def _ends(texts: pa.Array) -> np.ndarray:
    """A number of each text from its length and its first and last eight bytes: 0 for an empty one."""
    data, o = utf8(texts)
    out = np.diff(o).astype(np.uint64)
    full = np.flatnonzero(out)
    for k in range(8):
        for at in (np.minimum(o[full] + k, o[full + 1] - 1), np.maximum(o[full + 1] - 1 - k, o[full])):
            out[full] = out[full] * np.uint64(0x9E3779B97F4A7C15) + data[at].astype(np.uint64) + np.uint64(1)
    out[full] |= np.uint64(1)
    return out


def rows_of(packed: pa.Table) -> pa.Table:
    """A chunk's rows sorted by id and text: blobs arrive in any order, and positions must mean the same in every pass."""
    t = pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(b)).read_all() for b in packed.column("data").to_pylist()])
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def documents(packed: pa.Table) -> tuple[pa.Array, pa.Array]:
    """The ids and texts of a chunk's rows in that order."""
    t = rows_of(packed)
    ids, text = t.column(0), t.column(1)
    return (ids.combine_chunks() if ids.num_chunks != 1 else ids.chunk(0)), (text.combine_chunks() if text.num_chunks != 1 else text.chunk(0))


class KeySet:
    """The distinct keys of a chunk in a fixed order: by bucket, then by key, then by member. owner: the smallest document index that has the key."""

    def __init__(self, keys: np.ndarray, spread: np.ndarray, buckets: Buckets, docs: np.ndarray | None = None, members: np.ndarray | None = None):
        self.width = buckets.widths[0]
        bucket = (mix(spread.copy()) % np.uint64(buckets.n)).astype(np.uint32)
        order = np.argsort(keys) if members is None else np.lexsort((members, keys))
        order = order[np.argsort(bucket[order].astype(np.uint16), kind="stable")] if buckets.n < 1 << 16 else order[np.argsort(bucket[order], kind="stable")]
        k, b = keys[order], bucket[order]
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        if members is not None:
            m = members[order]
            first[1:] |= m[1:] != m[:-1]
        self.n = int(first.sum())
        self.group = np.empty(len(k), np.int64)  # of each occurrence its distinct key
        self.group[order] = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        self.keys, self.buckets, self.times = k[at], b[at], np.diff(np.append(at, len(k)))
        self.members = None if members is None else m[at]
        if docs is not None:
            d = docs[order]
            self.owner = np.minimum.reduceat(d, at) if len(at) else d[:0]
            self.last = np.maximum.reduceat(d, at) if len(at) else d[:0]

    def rows(self, chunk: int, kind: int, ids: np.ndarray | None = None, low: int | None = None) -> list[tuple]:
        """One row for each range. ids: the sorted ids that owner points into; only the order between chunks needs them. low: what comes first among equal ids."""
        own = None if ids is None else ids[self.owner]
        return _rows(chunk, kind, self.width, self.buckets, self.keys, self.members, own, None if low is None else np.full(self.n, low), self.owners if kind == TIMES else None)

    def count_owners(self, of: np.ndarray) -> None:
        """Counts the distinct values of `of`, one for each occurrence, for each key."""
        pair = np.unique(self.group * (int(of.max(initial=0)) + 1) + of)
        self.owners = np.bincount(pair // (int(of.max(initial=0)) + 1), minlength=self.n)

    def _parts(self, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        for bucket, blob in rows:
            lo, hi = np.searchsorted(self.buckets, [bucket * self.width, (bucket + 1) * self.width])
            yield lo, hi, blob

    def totals(self, rows: list[tuple[int, bytes]]) -> np.ndarray:
        """Of each distinct key what all chunks have counted."""
        out = np.zeros(self.n, np.int64)
        for lo, hi, blob in self._parts(rows):
            out[lo:hi] = unpressed(blob, np.uint32)
        return out

    def answers(self, rows: list[tuple[int, bytes]], question: int = 0) -> np.ndarray:
        """One flag for each distinct key from (bucket, bits)."""
        out = np.zeros(self.n, bool)
        for lo, hi, blob in self._parts(rows):
            out[lo:hi] = _unpacked(blob, hi - lo, question)
        return out


def _unpacked(bits: bytes, n: int, question: int) -> np.ndarray:
    size = -(-n // 8)
    return np.unpackbits(np.frombuffer(bits, np.uint8, size, question * size), count=n).view(bool)


def _rows(unit: int, kind: int, width: int, fine: np.ndarray, keys: np.ndarray, members: np.ndarray | None, docs: np.ndarray | None, low: np.ndarray | None, times: np.ndarray | None) -> list[tuple]:
    """KEYS of keys sorted by bucket, one row for each range of `width` buckets."""
    out = []
    coarse = fine // fine.dtype.type(width)
    cuts = np.flatnonzero(np.diff(coarse)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True) if len(keys) else []:
        k = keys[lo:hi]
        more = local = ids = least = None
        if times is not None:
            more = pressed(times[lo:hi].astype(np.uint32))
        if members is not None:
            more = pressed(members[lo:hi])
        if docs is not None:
            used, at = np.unique(docs[lo:hi], return_inverse=True)
            local, ids = pressed(at.astype(np.uint32)), pressed(used)
        if low is not None:
            least = pressed(low[lo:hi].astype(np.int64))
        which = pressed(np.diff(fine[lo:hi].astype(np.uint32), prepend=np.uint32(0))) if width > 1 else None
        out.append((int(coarse[lo]), unit, kind, int(hi - lo), pressed(np.diff(k, prepend=np.uint64(0))), which, more, local, ids, least))
    return out


def key_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 6
    names = ["bucket", "chunk", "kind", "n", "keys", "fine", "more", "docs", "ids", "low"]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def passed(chunk: int, data: bytes) -> tuple:
    """A row that comes back to its chunk as it is, with the answers."""
    return (-1 - chunk, chunk, PASS, 0, data, None, None, None, None, None)


class _Met:
    """The keys of some rows of one kind and range, in the order of (bucket, key, member, document), and the distinct ones among them."""

    def __init__(self, rows: list[dict], kind: int):
        self.kind, self.ends = kind, np.cumsum([r["n"] for r in rows])
        get = lambda name, dtype: np.concatenate([unpressed(r[name], dtype) for r in rows])
        keys = np.concatenate([np.cumsum(unpressed(r["keys"], np.uint64)) for r in rows])
        self.fine = np.concatenate([np.cumsum(unpressed(r["fine"], np.uint32)).astype(np.uint32) for r in rows]) if rows[0]["fine"] is not None else np.full(len(keys), rows[0]["bucket"], np.uint32)
        self.docs = np.concatenate([unpressed(r["ids"], np.int64)[unpressed(r["docs"], np.uint32)] for r in rows]) if kind in (SMALLER, FAMILY) else None
        self.low = get("low", np.int64) if rows[0]["low"] is not None else None
        members = get("more", np.uint64) if kind == FAMILY else None
        self.times = get("more", np.uint32).astype(np.int64) if kind == TIMES else None
        by = [x for x in (self.low, self.docs, members, keys, self.fine if rows[0]["fine"] is not None else None) if x is not None]
        self.order = np.argsort(by[0], kind="stable") if len(by) == 1 else np.lexsort(by)
        self.keys, self.fine = keys[self.order], self.fine[self.order]
        self.members = None if members is None else members[self.order]
        self.family = np.ones(len(keys), bool)  # where another key begins
        self.family[1:] = (self.keys[1:] != self.keys[:-1]) | (self.fine[1:] != self.fine[:-1])
        self.first = self.family.copy()  # where another key or member begins
        if members is not None:
            self.first[1:] |= self.members[1:] != self.members[:-1]
        self.at = np.flatnonzero(self.first)
        self.run = np.cumsum(self.first) - 1
        # documents come in order, so those that differ from the first of their run come after it
        self.later = None
        if self.docs is not None:
            docs, at = self.docs[self.order], self.at
            self.docs, self.later = docs[at], docs != docs[at][self.run]
            if self.low is not None:
                low = self.low[self.order]
                self.low, self.later = low[at], self.later | (low != low[at][self.run])
            self.every = docs

    def rows(self, unit: int, width: int) -> list[tuple]:
        """The distinct keys, each with its first document or the sum of its times, for the next step."""
        times = np.add.reduceat(self.times[self.order], self.at) if self.kind == TIMES else None
        at = self.at
        return _rows(unit, self.kind, width, self.fine[at], self.keys[at], None if self.members is None else self.members[at], self.docs, self.low, times)

    def settled(self) -> list[np.ndarray]:
        """The answers for the distinct keys when all that there are have met: only those of FAMILY's second question are not no."""
        if self.kind == TIMES:
            return [np.add.reduceat(self.times[self.order], self.at)]
        if self.kind != FAMILY:
            return [np.zeros(len(self.at), bool)]
        begin = np.flatnonzero(self.family)
        size = np.diff(np.append(begin, len(self.keys)))
        # a member's first document that is not the family's first has a member of its own
        alone = self.first & (self.every > np.repeat(np.minimum.reduceat(self.every, begin), size))
        return [np.zeros(len(self.at), bool), np.repeat(np.logical_or.reduceat(alone, begin), size)[self.at]]

    def answers(self, up: list[np.ndarray]) -> list[np.ndarray]:
        """The answers for all keys in the order of the rows, from those for the distinct ones."""
        got = [x[self.run] for x in up]
        if self.kind == OTHER:
            got = [got[0] | (np.diff(np.append(self.at, len(self.keys)))[self.run] > 1)]
        elif self.kind == SMALLER:
            got = [got[0] | self.later]
        elif self.kind == FAMILY:
            has = got[0] | self.later
            got = [has, got[1] & ~has]
        out = []
        for x in got:
            y = np.empty_like(x)
            y[self.order] = x
            out.append(y)
        return out

    def distinct(self, got: list[tuple[int, bytes]], width: int) -> list[np.ndarray]:
        """What the next step has answered for the distinct keys."""
        n = len(self.at)
        out = [np.zeros(n, np.int64)] if self.kind == TIMES else [np.zeros(n, bool) for _ in range(1 + (self.kind == FAMILY))]
        fine = self.fine[self.at]
        for bucket, blob in got:
            lo, hi = np.searchsorted(fine, [bucket * width, (bucket + 1) * width])
            for i, x in enumerate(out):
                x[lo:hi] = unpressed(blob, np.uint32) if self.kind == TIMES else _unpacked(blob, hi - lo, i)
        return out


def _told(rows: list[dict], met: _Met, answers: list[np.ndarray]) -> list[tuple]:
    """ANSWERS of each row."""
    parts = [np.split(a, met.ends[:-1]) for a in answers]
    return [(r["chunk"], r["bucket"], met.kind, pressed(x[0].astype(np.uint32)) if met.kind == TIMES else b"".join(np.packbits(y).tobytes() for y in x)) for r, x in zip(rows, zip(*parts, strict=True), strict=True)]


def _answer_table(out: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.binary()])], names=["chunk", "bucket", "kind", "bits"])


def _kinds(rows: list[dict]) -> list[list[dict]]:
    return [own for kind in (OTHER, SMALLER, FAMILY, TIMES) if (own := [r for r in rows if r["kind"] == kind])]


def answered(keys: DataFrame, buckets: Buckets, step: int = 0) -> DataFrame:
    """ANSWERS for KEYS."""
    width = buckets.widths
    if step == len(width) - 1:

        def answer(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            out = [(r["chunk"], r["bucket"], PASS, r["keys"]) for r in rows if r["kind"] == PASS]
            for own in _kinds(rows):
                met = _Met(own, own[0]["kind"])
                out += _told(own, met, met.answers(met.settled()))
            return _trimmed(_answer_table(out))

        return keys.groupBy("bucket").applyInArrow(answer, ANSWERS)

    finer, split = width[step + 1], width[step] // width[step + 1]

    def merge(key, table):
        return _trimmed(key_table([x for own in _kinds(table.to_pylist()) for x in _Met(own, own[0]["kind"]).rows(key[1].as_py(), finer)]))

    def back(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, got = left.to_pylist(), right.to_pylist()
        out = [(r["chunk"], r["bucket"], PASS, r["keys"]) for r in rows if r["kind"] == PASS]
        for own in _kinds(rows):
            met = _Met(own, own[0]["kind"])
            up = met.distinct([(r["bucket"], r["bits"]) for r in got if r["kind"] == met.kind], finer)
            out += _told(own, met, met.answers(up))
        return _trimmed(_answer_table(out))

    node = [F.col("bucket"), F.floor(F.col("chunk") / buckets.fan).alias("node")]
    up = answered(keys.groupBy(*node).applyInArrow(merge, KEYS), buckets, step + 1)
    return keys.groupBy(*node).cogroup(up.groupBy(F.floor(F.col("bucket") / split).alias("bucket_"), F.col("chunk").alias("node"))).applyInArrow(back, ANSWERS)


def _trimmed(table: pa.Table) -> pa.Table:
    trim()
    return table


def emitted(packed: DataFrame, f: Callable[[int, pa.Table], list[tuple]]) -> DataFrame:
    """KEYS of each chunk."""
    return packed.groupBy("chunk").applyInArrow(lambda key, t: _trimmed(key_table(f(key[0].as_py(), t))), KEYS)


def with_answers(packed: DataFrame, answers: DataFrame, f: Callable[[int, pa.Table, dict], pa.Table], schema: str) -> DataFrame:
    """f(chunk, documents, {kind: [(bucket, bits)]}) for each chunk."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[int, list] = {}
        for r in right.to_pylist():
            got.setdefault(r["kind"], []).append((r["bucket"], r["bits"]))
        forget()
        return _trimmed(f(key[0].as_py(), left, got))

    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
