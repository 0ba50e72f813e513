"""Suffix-array dedup by distributed prefix doubling: byte strings that a document with a smaller id has too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import parts_for, text_bytes
from .hashing import BYTES, OTHER, U, prefixes8, rank_pairs, utf8

#: Bytes that are ranked at a time.
BLOCK = 1 << 20
OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, kept binary, spans array<struct<start:bigint,end:bigint>>"


def doubled(data: np.ndarray, upto: list[int]) -> list[np.ndarray]:
    """For each length in upto (ascending, 8 at least) the ranks of the prefixes of that length of all suffixes that are so long.

    The ranks of 8 bytes are the bytes. Those of h + d bytes, d up to h, come from the pair of the ranks of h bytes here and at the offset d.
    Ranks are fingerprints, which chunks make alike without asking each other.
    """
    out, h, ranks = [], 8, prefixes8(data)
    for length in upto:
        while h < length:
            d = min(h, length - h)
            n = max(0, len(data) - h - d + 1)
            ranks, h = rank_pairs(ranks[:n], ranks[d : d + n]), h + d
        out.append(ranks)
    return out


def _sliding(f, a: np.ndarray, width: int) -> np.ndarray:
    """f over each stretch of `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a, have = f(a[:-step], a[step:]), have + step
    return a


def sampled(ranks: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest rank of some `width` neighbours: equal strings sample equal offsets."""
    if len(ranks) < width:
        return np.zeros(0, np.int64)
    low = np.zeros(len(ranks) + width - 1, U)
    low[width - 1 : len(ranks)] = _sliding(np.minimum, ranks, width)
    return np.flatnonzero(_sliding(np.maximum, low, width) == ranks)


class _Bytes:
    """The bytes of a chunk's documents one after another."""

    def __init__(self, packed: pa.Table, length: int):
        self.row_ids, text = C.documents(packed)
        self.data, self.o = utf8(text)
        self.ids, self.index = np.unique(C.ids_of(self.row_ids), return_inverse=True)
        self.sizes, self.length = np.diff(self.o), length
        self.short = (length + 2) // 2  # the prefix length before the last doubling

    def blocks(self, live: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, end, row of each byte) of stretches of about BLOCK bytes of the live documents; longer documents come in pieces that overlap."""
        found, size = [], 0
        for r in np.flatnonzero(live & (self.sizes >= self.length)):
            if not found or size + self.sizes[r] > BLOCK or r != found[-1][1]:
                found.append([r, r])
                size = 0
            found[-1][1] = r + 1
            size += self.sizes[r]
        for first, after in found:
            lo, hi = int(self.o[first]), int(self.o[after])
            row = np.repeat(np.arange(first, after), self.sizes[first:after])
            for at in range(lo, hi - self.length + 1, BLOCK):
                end = min(hi, at + BLOCK + self.length - 1)
                yield at, end, row[at - lo : end - lo]

    def texts(self, buckets: C.Buckets) -> tuple[np.ndarray, C.KeySet]:
        """The whole documents as keys."""
        rows = np.flatnonzero(self.sizes >= self.length)
        a, b = BYTES.spans(self.data, self.o[rows], self.o[rows + 1]), OTHER.spans(self.data, self.o[rows], self.o[rows + 1])
        return rows, C.KeySet(a, b, buckets, self.index[rows])

    def anchors(self, live: np.ndarray, buckets: C.Buckets) -> tuple[np.ndarray, C.KeySet]:
        """Sampled positions with the ranks of their prefixes of the shorter length."""
        at, key, doc = [], [], []
        for lo, hi, row in self.blocks(live):
            (ranks,) = doubled(self.data[lo:hi], [self.short])
            inside = self.o[row[: len(ranks)] + 1] - np.arange(lo, lo + len(ranks)) >= self.short
            ranks[~inside] = U(2**64 - 1)  # a prefix that runs into the next document is none
            p = sampled(ranks, self.length - self.short + 1)
            p = p[inside[p]]
            at.append(p + lo)
            key.append(ranks[p])
            doc.append(self.index[row[p]])
        at, key, doc = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((at, np.int64), (key, U), (doc, np.int64)))
        at, once = np.unique(at, return_index=True)
        return at, C.KeySet(key[once], key[once], buckets, doc[once])

    def families(self, near: np.ndarray, live: np.ndarray, buckets: C.Buckets) -> tuple[np.ndarray, np.ndarray, C.KeySet, np.ndarray]:
        """(first, last, keys, doc): the anchors' stretches of suffixes that have the anchor as their smallest rank.

        Equal strings of the full length have it at the same place, so they are found in stretches of equal anchors. A stretch's member key stands for
        the bytes from its first start to its last end.
        """
        want = np.zeros(len(self.data) + 1, bool)
        want[near] = True
        width = self.length - self.short + 1
        lows, highs, family, member = [], [], [], []
        for lo, hi, row in self.blocks(live):
            if not want[lo:hi].any():
                continue
            ranks, full = doubled(self.data[lo:hi], [self.short, self.length])
            least = _sliding(np.minimum, ranks, width)[: len(full)]
            p = np.flatnonzero(self.o[row[: len(full)] + 1] - np.arange(lo, lo + len(full)) >= self.length)
            anchors = np.flatnonzero(want[lo : lo + len(ranks)])
            after = np.searchsorted(anchors, p)
            at = np.full(len(p), -1)
            open_ = np.arange(len(p))
            while len(open_):  # the next anchor, and the next, until one holds the smallest rank or lies beyond
                i = after[open_]
                a = np.append(anchors, len(ranks) + width)[np.minimum(i, len(anchors))]
                open_, a = open_[a < p[open_] + width], a[a < p[open_] + width]
                found = ranks[a] == least[p[open_]]
                at[open_[found]] = a[found]
                open_ = open_[~found]
                after[open_] += 1
            p, at = p[at >= 0], at[at >= 0]
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            first, last = p[begin], np.append(p[begin[1:] - 1], p[-1:]) if len(p) else p
            lows.append(first + lo)
            highs.append(last + lo)
            family.append(ranks[at[begin]] >> U(24))
            member.append(rank_pairs(full[first] + (last - first).astype(U), full[last]))
        lows, highs, family, member = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((lows, np.int64), (highs, np.int64), (family, U), (member, U)))
        doc = self.row_index(lows)
        return lows, highs, C.KeySet(family, family, buckets, doc, member), doc

    def suffixes(self, at: np.ndarray, live: np.ndarray, buckets: C.Buckets) -> tuple[C.KeySet, np.ndarray]:
        """(keys, doc) for the strings of the full length at these positions, in ascending order."""
        key, spread, seen = [], [], 0
        for lo, hi, _ in self.blocks(live):
            here = at[np.searchsorted(at, lo) : np.searchsorted(at, hi - self.length, side="right")] - lo
            if len(here):
                (ranks,) = doubled(self.data[lo:hi], [self.short])
                a, b = ranks[here], ranks[here + self.length - self.short]
                key.append(rank_pairs(a, b))
                spread.append(a * U(0x9FB21C651E98DF25) ^ (b + (a >> U(17))))
                seen += len(here)
        assert seen == len(at)
        doc = self.row_index(at)
        return C.KeySet(np.concatenate([np.zeros(0, U), *key]), np.concatenate([np.zeros(0, U), *spread]), buckets, doc), doc

    def row_index(self, at: np.ndarray) -> np.ndarray:
        """The document index of each position."""
        return np.repeat(self.index, self.sizes)[at]


def _later(keys: C.KeySet, got: list, docs: np.ndarray) -> np.ndarray:
    """Of each occurrence whether a smaller document has its key, here or in another chunk."""
    return keys.answers(got)[keys.group] | (docs > keys.owner[keys.group])


def _passed(got: dict, tag: bytes, dtype) -> np.ndarray:
    """What a chunk left for itself under a tag."""
    return C.unpressed(next(x for _, x in got[C.PASS] if x[:1] == tag)[1:], dtype)


def _state(chunk: int, **arrays: np.ndarray) -> list[tuple]:
    """What a chunk leaves for itself, under tags of one letter."""
    return [C.passed(chunk, tag.encode() + C.pressed(x)) for tag, x in arrays.items()]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the ranges, ends included."""
    n = last - first + 1
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _cut(b: _Bytes, gone: np.ndarray) -> pa.Table:
    """OUT for the bytes that are not gone."""
    per = lambda x: np.concatenate([[0], np.cumsum(x)])
    so_far = per(gone)
    removed = so_far[b.o[1:]] - so_far[b.o[:-1]]
    offsets = per(b.sizes - removed)
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b.sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(b.data[~gone].tobytes())])
    head = np.zeros(len(gone) + 1, bool)
    head[b.o] = True
    begin = np.flatnonzero(gone & (head[:-1] | ~np.concatenate([[False], gone[:-1]])))
    end = np.flatnonzero(gone & (head[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    row = np.searchsorted(b.o, begin, side="right") - 1
    pair = pa.StructArray.from_arrays([pa.array(begin - b.o[row], pa.int64()), pa.array(end - b.o[row], pa.int64())], ["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(per(np.bincount(row, minlength=len(b.sizes))), pa.int32()), pair)
    return pa.table([b.row_ids.cast(pa.int64()), pa.array(b.sizes, pa.int64()), pa.array(removed, pa.int64()), kept.cast(pa.binary()), spans], names=["doc_id", "n_bytes", "n_removed", "kept", "spans"])


def remove_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Removes every byte covered by a string of `length` bytes that also starts in a document with a smaller id.

    Texts are their UTF-8 bytes; no string crosses documents; strings are judged on the input. Per row of docs: doc_id, n_bytes,
    n_removed, kept (the bytes left; a cut may fall inside a character, so they are binary) and spans (maximal removed ranges).
    A null text is empty. A null id counts as smaller than any other. Rows with equal ids remove nothing of each other.

    Prefixes double from 8 to 16 and so on up to just over half the length, then once more to the full length; at the last two
    Spark sorts the ranks of the whole corpus by buckets. After the first of these sorts a suffix drops out if its prefix is unique, so only suffixes
    that can still have an equal take part in the next. That sort takes the suffixes whose rank is the smallest among neighbours (anchors): any string of
    the full length holds one, and equal strings hold it at the same place. Before the last sort, stretches of suffixes around an anchor that agree as a whole
    with those of a smaller document are settled at once; where some stretch of an anchor does not, each suffix of the anchor is ranked by itself. Documents
    equal to an earlier one as a whole leave at the start.
    """
    if length < 16:
        raise ValueError("strings of at least 16 bytes are needed")
    n = parts_for(text_bytes(docs, text_col), C.CHUNK_BYTES, 24)
    packed = C.chunked(docs, id_col, text_col, n)
    buckets, fewer = C.Buckets(n), C.Buckets(max(12, n // 3))

    def copies(b: _Bytes, got: dict) -> np.ndarray:
        rows, keys = b.texts(buckets)
        out = np.zeros(len(b.sizes), bool)
        out[rows] = _later(keys, got.get(C.SMALLER, []), b.index[rows])
        return out

    def first(chunk: int, t: pa.Table) -> list[tuple]:
        b = _Bytes(t, length)
        return b.texts(buckets)[1].rows(chunk, C.SMALLER, b.ids)

    def second(chunk: int, t: pa.Table, got: dict) -> pa.Table:
        b = _Bytes(t, length)
        gone = copies(b, got)
        return C.key_table([*b.anchors(~gone, fewer)[1].rows(chunk, C.OTHER), *_state(chunk, g=gone.view(np.uint8))])

    def third(chunk: int, t: pa.Table, got: dict) -> pa.Table:
        b = _Bytes(t, length)
        gone = _passed(got, b"g", np.uint8).view(bool)
        at, keys = b.anchors(~gone, fewer)
        near = at[(keys.answers(got.get(C.OTHER, [])) | (keys.owner < keys.last))[keys.group]]
        _, _, found, _ = b.families(near, ~gone, fewer)
        return C.key_table([*found.rows(chunk, C.FAMILY, b.ids), *_state(chunk, g=gone.view(np.uint8), n=near.astype(np.uint32))])

    def fourth(chunk: int, t: pa.Table, got: dict) -> pa.Table:
        b = _Bytes(t, length)
        gone = _passed(got, b"g", np.uint8).view(bool)
        lows, highs, keys, doc = b.families(_passed(got, b"n", np.uint32).astype(np.int64), ~gone, fewer)
        answers = got.get(C.FAMILY, [])
        later = doc > keys.owner[keys.group]
        hit, ask = keys.answers(answers)[keys.group] | later, keys.answers(answers, 1)[keys.group] & ~later
        at = _ranges(lows[ask], highs[ask])
        found, _ = b.suffixes(at, ~gone, buckets)
        return C.key_table([*found.rows(chunk, C.SMALLER, b.ids), *_state(chunk, g=gone.view(np.uint8), l=lows[hit].astype(np.uint32), h=highs[hit].astype(np.uint32), a=at.astype(np.uint32))])

    def last(chunk: int, t: pa.Table, got: dict) -> pa.Table:
        b = _Bytes(t, length)
        gone = _passed(got, b"g", np.uint8).view(bool)
        at = _passed(got, b"a", np.uint32).astype(np.int64)
        keys, doc = b.suffixes(at, ~gone, buckets)
        hit = at[_later(keys, got.get(C.SMALLER, []), doc)]
        edge = np.zeros(len(b.data) + 1, np.int32)
        for begin, end in ((hit, hit), (_passed(got, b"l", np.uint32).astype(np.int64), _passed(got, b"h", np.uint32).astype(np.int64))):
            np.add.at(edge, begin, 1)
            np.add.at(edge, end + length, -1)
        return _cut(b, (np.cumsum(edge)[:-1] > 0) | np.repeat(gone, b.sizes))

    one = C.answered(C.emitted(packed, first), buckets)
    two = C.answered(C.with_answers(packed, one, second, C.KEYS), fewer)
    three = C.answered(C.with_answers(packed, two, third, C.KEYS), fewer)
    four = C.answered(C.with_answers(packed, three, fourth, C.KEYS), buckets)
    return C.with_answers(packed, four, last, OUT)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_earlier(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same with every string of 50 bytes spelt out, as hexadecimal digits in pieces of 200 starts.
OP5_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, len(h) // 2 AS n, k, substring(h, k * 400 + 1, 498) AS piece FROM (SELECT doc_id, h, unnest(range(0, len(h) // 400 + 1)) AS k FROM b)),
starts AS (SELECT doc_id, k * 200 + i AS i, substring(piece, i * 2 + 1, 100) AS s FROM (SELECT doc_id, k, piece, unnest(range(0, least(200, len(piece) // 2 - 49))) AS i FROM part)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least_id FROM starts) WHERE least_id < doc_id),
run AS (SELECT doc_id, i, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) >= i - 50 THEN 0 ELSE 1 END AS new FROM hit),
span AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run) GROUP BY doc_id, g),
stay AS (SELECT b.doc_id, s.lo, s.hi, coalesce(lag(s.hi) OVER (PARTITION BY b.doc_id ORDER BY s.lo), 0) AS after, lead(s.lo) OVER (PARTITION BY b.doc_id ORDER BY s.lo) AS next_lo, b.h FROM b JOIN span s ON b.doc_id = s.doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, after * 2 + 1, (lo - after) * 2) || CASE WHEN next_lo IS NULL THEN substring(h, hi * 2 + 1) ELSE '' END, '' ORDER BY lo) AS k, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM stay GROUP BY doc_id)
SELECT b.doc_id, CAST(len(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.k, b.h))) AS kept_sha256
FROM b LEFT JOIN kept ON b.doc_id = kept.doc_id
"""
