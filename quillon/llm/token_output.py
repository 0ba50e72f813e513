"""Token-id output: Parquet list columns, sorted by document, that can be read in part."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, parts_for, shared_folder, ship, text_bytes, trim, until_exit
from .simhash_dedup import _slices
from .tokens import WordEncoder, vocabulary_path

#: Bytes of text in a file.
FILE_TEXT = 24 << 20
FORMAT = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group: int = 16 << 20, page: int = 256 << 10, page_rows: int = 1000) -> None:
    """Writes the ids of every text in ascending id order (nulls first, then by text), one file for each range of ids.

    Columns: doc_id; part, the number of the file in id order; part_start, the ids before the document in its file; n_tokens; ids, a list of integers.
    encoding "dictionary" packs ids by a dictionary; "delta" writes DELTA_BINARY_PACKED pages instead. row_group and page are bytes; each page holds page_rows
    rows at most and has its bounds in the page index, so that a range of doc_id or the columns but for ids are read alone. A null text has only end_id, if that is given.
    Rows with equal or null ids are told apart by their texts' beginnings, so that many of them fill several files; other columns are ignored; no rows give an empty table.
    A very long text is one list, in a row group of its own.
    """
    spark = docs.sparkSession
    ship(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, so_far = WordEncoder.of_worker(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in _slices(whole):
                ids, n = encoder.encode(b.column(1), end_id)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(so_far + ends - n), pa.array(n), lists], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                so_far += int(ends[-1])
        trim()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(parts_for(text_bytes(docs, text_col), FILE_TEXT), F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text").mapInArrow(encode, FORMAT)
    options = {"compression": "zstd", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0"}
    rows.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The table of write_tokens(); select columns and filter doc_id to read only what they need."""
    return spark.read.schema(FORMAT).parquet(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the table of write_tokens().

    The totals of the files, one row each, give the start of each file.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            lists = b.column(4)
            o, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[s:e]) for s, e in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(crc, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    rows = tokens.mapInArrow(digest, "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary_path(), end_id=2)
    until_exit(spark, path)
    return token_index(read_tokens(spark, path))
