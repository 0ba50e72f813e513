"""Substring search by scan, or by stored trigram postings that name candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import trigrams

#: Ids of one row of postings, grams of a search text that are asked for (the rarest), and bytes of text whose postings are one file and the work of one task.
CHUNK, ASKED, TEXT = 65_536, 4, 8 << 20


def search(df: DataFrame, column: str, text: str, kind: str = "contains", ignore_case: bool = False) -> DataFrame:
    """Rows whose column contains, starts or ends with a text. Without ignore_case the predicate reaches the Parquet scan; with it, only the end in question is lowered."""
    c, t = F.col(column), text
    if ignore_case:
        t = text.lower()
        # the first or last n letters of a lowered text come from no more than n letters of the text
        c = F.lower({"contains": lambda x: x, "prefix": lambda x: F.left(x, F.lit(len(t))), "suffix": lambda x: F.right(x, F.lit(len(t)))}[kind](c))
    return df.where({"contains": c.contains, "prefix": c.startswith, "suffix": c.endswith}[kind](t))


def trigram_table(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(gram, id) for the lower-case trigrams of each row: write it clustered by gram, and a search reads a few row groups."""
    return df.select(F.col(id_col).alias("id"), F.explode(trigrams(F.lower(column))).alias("gram")).select("gram", "id")


def trigram_search(df: DataFrame, id_col: str, column: str, grams: DataFrame, text: str, kind: str = "contains", ignore_case: bool = True) -> DataFrame:
    """search() for ids that have all trigrams of the text; texts shorter than three characters are scanned."""
    wanted = sorted({text.lower()[i : i + 3] for i in range(len(text) - 2)})
    if not wanted:
        return search(df, column, text, kind, ignore_case)
    found = grams.where(F.col("gram").isin(wanted)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select(F.col("id").alias("_id"))
    return search(df.join(found, F.col(id_col) == F.col("_id"), "left_semi"), column, text, kind, ignore_case)


def _poster():
    """post(), as a function that travels to the workers whole, so that they need not have this package."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, n, ids), sorted by gram, of the texts (id, t) of a partition: ids of a gram are different and ascend."""

        def distinct(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((ids, codes))
            codes, ids = codes[order], ids[order]
            new = np.ones(len(codes), bool)
            new[1:] = (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1])
            return codes[new], ids[new]

        def pairs(ids: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """A code (three code points) and an id for each trigram of each text, in order. Letters are numbered among those of the texts, so that a gram and a text are one number to sort by; texts of too many letters for that are taken half by half."""
            n = np.array([len(t) for t in texts], np.int64)
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            there = np.flatnonzero(np.bincount(points))
            wide, bits = max(1, len(there) - 1).bit_length(), (len(texts) - 1).bit_length()
            if 3 * wide + bits > 63:
                half = [pairs(ids[i], texts[i]) for i in (slice(0, len(texts) // 2), slice(len(texts) // 2, None))]
                return distinct(*(np.concatenate(x) for x in zip(*half, strict=True)))
            number = np.zeros(int(there[-1]) + 1 if len(there) else 1, np.int64)
            number[there] = np.arange(len(there))
            letters, text = number[points], np.repeat(np.arange(len(n)), n)
            key = ((letters[:-2] << 2 * wide | letters[1:-1] << wide | letters[2:]) << bits | text[:-2])[text[:-2] == text[2:]] if len(points) > 2 else letters[:0]
            key.sort()
            key = key[np.diff(key, prepend=-1) != 0]
            gram, letter = key >> bits, (1 << wide) - 1
            code = there[gram >> 2 * wide] << 42 | there[gram >> wide & letter] << 21 | there[gram & letter]
            return distinct(code, ids[key & ((1 << bits) - 1)]) if len(set(ids.tolist())) < len(ids) else (code, ids[key & ((1 << bits) - 1)])

        found = []
        for b in batches:
            order = np.argsort(b.column("id").to_numpy(), kind="stable")
            if len(order):
                t = b.column("t").to_pylist()
                found.append(pairs(b.column("id").to_numpy()[order], [t[i] for i in order.tolist()]))
            if sum(len(c) for c, _ in found[1:]) > 1 << 22:  # rows of one id in numbers: no more is kept than its grams
                found = [distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))]
        if not found:
            return
        codes, ids = found[0] if len(found) == 1 else distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = np.append(first[1:], len(codes))
        for k in range(0, len(first), 4096):
            mine, stop = first[k : k + 4096], ends[k : k + 4096]
            c = codes[mine]
            letters = np.stack([c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF], 1).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            grams = [letters[i : i + 3] for i in range(0, len(letters), 3)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(mine, stop[-1]) - mine[0], pa.int32()), pa.array(ids[mine[0] : stop[-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(stop - mine, pa.int64()), lists], names=["gram", "n", "ids"])

    return post


_post = _poster()


class TrigramIndex:
    """Postings of lower-case trigrams below a folder: for each gram the ids of the texts that hold it, in rows of CHUNK ids at most; each file is of some texts and sorted by gram, so that a search reads the row groups of its own grams alone.

    Each batch of texts has a folder of its own, which is written once. Ids are sorted and delta-coded.
    """

    ROWS = "gram string, n bigint, ids array<bigint>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def batches(self) -> list[str]:
        """The folders of the batches that are complete."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = lambda s: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return [s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory() and done(s)] if fs.exists(p) else []

    def add(self, batch: str, df: DataFrame, id_col: str, column: str) -> None:
        """Writes the postings of a batch, unless they are there. Ids are whole numbers; NULL texts have no grams.

        The texts are dealt by their id into parts of about TEXT bytes, and CHUNK texts at most, so that a task's work does not grow with the batch; they move once, and their ids, which are more, do not.
        """
        path = f"{self.root}/{batch}"
        if any(b.rpartition("/")[2] == batch for b in self.batches()):
            return
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(column).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
        many, size = rows.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
        parts = max(1, -(-many // CHUNK), -(-(size or 0) // TEXT))
        dealt = rows.repartitionById(parts, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).select("id", F.make_valid_utf8(F.lower("t")).alias("t"))
        options = {"compression": "zstd", "parquet.block.size": 1 << 20, "parquet.page.size": 64 << 10, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
        dealt.mapInArrow(_post, self.ROWS).write.options(**options).mode("overwrite").parquet(path)

    def postings(self) -> DataFrame:
        paths = self.batches()
        return self.spark.read.schema(self.ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], self.ROWS)

    def candidates(self, text: str) -> DataFrame | None:
        """(id) of the texts that hold the rarest trigrams of a text, and a few others; None if the text has none, so that all texts are candidates.

        The counts of the grams are read first, without ids; then the ids of the rarest, which are met in rising order of their counts.
        """
        wanted = sorted({text.lower()[i : i + 3] for i in range(len(text.lower()) - 2)})
        if not wanted:
            return None
        rows = self.postings().where(F.col("gram").isin(wanted))
        many = {r.gram: r.n for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each gram of the search text
        if len(many) < len(wanted):
            return rows.select(F.explode("ids").alias("id")).where("false")
        rare = sorted(many, key=lambda g: (many[g], g))[:ASKED]
        ids = rows.where(F.col("gram").isin(rare)).select(F.explode("ids").alias("id"))
        return ids.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= len(rare)).select("id")

    def search(self, df: DataFrame, id_col: str, column: str, text: str, kind: str = "contains", ignore_case: bool = True) -> DataFrame:
        """search() over the candidates alone. The rows of df must have been added, and an id that stands in several of them is looked at in each."""
        found = self.candidates(text)
        if found is not None:
            df = df.join(found.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left_semi")
        return search(df, column, text, kind, ignore_case)
