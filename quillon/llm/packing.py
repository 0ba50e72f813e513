"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, ship, stored, trim
from .simhash_dedup import _slices
from .tokens import WordEncoder, vocabulary_path

#: Pieces that are packed together: the more, the less is lost in the bins that stay open at the end.
TOGETHER = 150_000
#: Ids of such a part where rows carry their ids: 16 MB.
TOGETHER_IDS = 4 << 20
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most `capacity` ids (the text's ids, then end_id): doc_id, piece, start, length, ids_crc32, and ids if they are kept.

    Only longer documents are cut, and only their last piece may be shorter. A null text has only end_id.
    """
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(tokenizer)
        for whole in batches:
            for b in _slices(whole):
                ids, n = encoder.encode(b.column(1), end_id)
                ids = ids.astype("<u4", copy=False)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                at = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(ids[s : s + k]) for s, k in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:  # pieces follow one another without gaps
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])
        trim()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE + (", ids array<int>" if keep_ids else ""))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length in the given order, and the number of bins.

    Each goes where the sum over all gaps of the squared number of open bins with that gap becomes smallest: into a bin with some gap, or a new one. A full bin counts no more.
    """
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            bins[i], offsets[i] = used, 0
            used += 1
            continue
        # what the sum of squares changes by if a bin of gap g, s or more, takes s: N[g] falls by one and N[g - s] grows by one
        change = 2 * (n[: capacity + 1 - s] - n[s:] + 1)
        change[0] = 1 - 2 * n[s]  # a bin that becomes full counts no more
        change[n[s:] == 0] = capacity**3
        change[-1] = 2 * n[capacity - s] + 1  # a new bin: nothing is taken away
        g = int(np.argmin(change)) + s
        if g == capacity:
            b, used = used, used + 1
        else:
            b = stacks[g].pop()
            n[g] -= 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            n[g - s] += 1
            stacks[g - s].append(b)
    return bins, offsets, used


def settled(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, given longest first: the pieces of bins that stay open are taken out and placed once more by the same rule, as long as that saves bins."""
    bins = place(lengths, capacity)[0]
    while True:
        fill = np.bincount(bins, lengths, minlength=1)
        loose = np.flatnonzero(fill[bins] < capacity)
        again, _, used = place(lengths[loose], capacity)
        if used >= len(np.unique(bins[loose])):
            break
        bins[loose] = again + len(fill)
        bins = np.unique(bins, return_inverse=True)[1]
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    offsets = np.empty(len(bins), np.int64)
    offsets[order] = ends - lengths[order] - np.repeat((ends - lengths[order])[first], np.diff(np.append(first, len(bins))))
    return bins, offsets


def packed(rows: DataFrame, capacity: int) -> DataFrame:
    """rows (with length, 1 to capacity, and doc_id, piece) with sequence_id and offset: gapless from 0 in each sequence. rows must be a stored table, whose rows keep their order.

    Rows are dealt by their places in the table into parts of about TOGETHER, and of TOGETHER_IDS ids where they carry them, so that equal or null ids are spread too, and each part is packed by itself, longest first.
    A part loses the gaps of a few bins at most, whatever the input is. Equal rows are packed as often as they are there; no rows give none.
    """
    ship(rows.sparkSession)
    names = [f.name for f in rows.schema]
    step = 500 if "ids" in names else 20_000

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        held.clear()
        order = pc.sort_indices(t.select(["length", "doc_id", "piece"]), [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = settled(t.column("length").take(order).to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 32
        # rows are put in order a stretch at a time: ids are never there twice
        for k in range(0, len(order), step):
            part = t.take(order.slice(k, step)).append_column("sequence_id", pa.array(bins[k : k + step] + base)).append_column("offset", pa.array(offsets[k : k + step]))
            yield from part.combine_chunks().to_batches()
        del t
        trim()

    n = parts_for(rows.count(), TOGETHER, 1)
    if "ids" in names:
        n = max(n, parts_for(rows.agg(F.sum("length")).first()[0] or 0, TOGETHER_IDS, 1))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint"
    return rows.repartition(n, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))).select(*names).mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence that each is in and its place there; keep_ids adds the ids of each piece.

    Null texts are empty, so a document has one piece at least, of end_id alone; null and repeated ids stay as they are, each row a document; other columns are ignored.
    A very long text is cut into as many pieces as it needs, within one batch of Arrow.
    """
    return packed(stored(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, keep_ids), "pieces"), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
