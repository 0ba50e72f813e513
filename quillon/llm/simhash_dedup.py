"""SimHash near-dedup: fingerprints of word shingles, linked by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, forget, ship, stored, trim
from .components import components
from .hashing import utf8, words, xxh64

BITS = 64
#: Shingles whose bits are counted at a time.
STEP = 1 << 17
#: Texts that are worked on at a time.
ROWS = 1 << 10


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, row) of the shingles of each text, repeats included: n words in a row joined by one space, A-Z lowered, or the whole sequence if there are fewer words."""
    flat, doc = words(texts)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")
    data = lower[np.frombuffer(joined[0].as_py().encode(), np.uint8)]
    ends = np.cumsum(np.diff(utf8(flat)[1]) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = np.minimum(n, count)
    have = np.where(count > 0, count - size + 1, 0)
    row = np.repeat(np.arange(len(texts)), have)
    at = np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have) + first[row]
    return data, starts[at], ends[at + size[row] - 1], row


def simhashes(texts: pa.Array, shingle: int) -> np.ndarray:
    """The fingerprint of each text: a bit is set if it is set in over half of the XXH64 values (seed 42) of its shingles; without words it is 0."""
    data, starts, ends, row = shingles(texts, shingle)
    h = xxh64(data, starts, ends, 42)
    ones = np.zeros((len(texts), BITS), np.int64)
    for lo in range(0, len(h), STEP):
        bits = np.unpackbits(h[lo : lo + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        o = row[lo : lo + STEP]
        cuts = np.flatnonzero(np.diff(o, prepend=-1))
        ones[o[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    count = np.bincount(row, minlength=len(texts))
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def with_columns(docs: DataFrame, text_col: str, f: Callable[[pa.Array], list[pa.Array]], added: str, size: int = 1 << 19) -> DataFrame:
    """docs and the columns `added` (a schema) that f makes of the texts, about `size` bytes at a time. Column names must differ; the workers do without pandas, which an Arrow function of columns would load."""
    ship(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns + [x.split()[0] for x in added.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for b in _slices(whole, size, at, ROWS):
                yield pa.RecordBatch.from_arrays([*b.columns, *f(b.column(at))], names=names)
        trim()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(of, f"{schema}, {added}")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each text.

    A-Z are lowered; shingles are `shingle` words in a row joined by one space, repeats included, or the whole sequence if there are fewer words; without words, as for a null, fp is 0.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for b in _slices(whole, 1 << 19, 1, ROWS):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhashes(b.column(1), shingle))], names=["doc_id", "fp"])
        trim()

    return rows.mapInArrow(of, "doc_id bigint, fp bigint")


def _slices(batch: pa.RecordBatch, size: int = 8 << 20, column: int = 1, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of a text column and `rows` rows at most."""
    if batch.num_rows:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero((np.diff(ends // size) > 0) | (np.arange(1, len(ends)) % rows == 0)) + 1
        cuts = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(lo, hi - lo)


def blocks_for(distance: int) -> list[int]:
    """A mask of each way to leave out `distance` of the blocks. Twelve blocks at the distance 2 leave 12 bits at most,
    so that no more than 4096 different fingerprints can agree on the rest, whatever the data are."""
    n = 12
    edges = [round(i * BITS / n) for i in range(n + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [((1 << BITS) - 1) ^ sum(x) for x in combinations(masks, distance)]


def _linked(distance: int):
    """Edges of a partition whose rows (key, fp) are sorted by key: within a key the fingerprints at most `distance` bits apart, as a forest."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            yield _forest(key[:cut], fp[:cut], distance)
            key, fp = key[cut:], fp[cut:]
        yield _forest(key, fp, distance)

    return of


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; counted unsigned, as a signed number's bits are those of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(key: np.ndarray, fp: np.ndarray, distance: int) -> pa.RecordBatch:
    at = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    size = np.diff(np.append(at, len(key)))
    out = []
    few = np.repeat(size <= 8, size)
    run = np.repeat(np.arange(len(at)), size)
    for d in range(1, 8):
        i = np.flatnonzero(few[:-d] & (run[d:] == run[:-d])) if len(key) > d else np.zeros(0, np.int64)
        near = _differing(fp[i], fp[i + d]) <= distance
        out.append(np.stack([fp[i[near]], fp[i[near] + d]], axis=1))
    for lo, n in zip(at[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        f = fp[lo : lo + n]
        todo = np.ones(n, bool)
        while todo.any():  # one tree after another, each grown from its frontier
            front = [int(np.argmax(todo))]
            todo[front] = False
            while front:
                i = front.pop()
                new = np.flatnonzero(todo & (_differing(f, f[i]) <= distance))
                todo[new] = False
                out.append(np.stack([f[new], np.full(len(new), f[i])], axis=1))
                front += new.tolist()
    e = np.concatenate([np.zeros((0, 2), np.int64), *out])
    e = np.unique(np.sort(e, axis=1), axis=0) if len(e) else e
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])


def near_fingerprints(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between the different fingerprints of prints (fp) that are at most `distance` bits apart, as many as connect them all.

    A fingerprint has a row for each choice of left-out blocks; rows that agree on the others meet, and their distance is counted. What leaves a block is a forest of
    its links, never all its pairs.
    """
    ship(prints.sparkSession)
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in blocks_for(distance)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    rows = prints.select("fp").distinct().select(F.explode(keys).alias("key"), "fp")
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 12)
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_linked(distance), "a bigint, b bigint")


def fingerprint_components(prints: DataFrame, distance: int = 2) -> DataFrame:
    """prints (doc_id, fp) with component_id, the smallest doc_id that links of at most `distance` bits reach.

    Equal fingerprints are one node from the start. Null ids belong to the component of their fingerprint but don't name it, unless there is no other; rows with equal
    ids are documents of their own. No rows give none.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    named = named_nodes(nodes, near_fingerprints(prints, distance))
    return prints.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def named_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, component_id) of nodes (fp, doc): the root of the nodes that edges (a, b) connect, and the smallest doc of them."""
    roots = components(edges)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp and component_id for every row of docs; see fingerprints() and fingerprint_components().

    Null ids and repeated rows stay; a null or empty text has the fingerprint 0; a long text is hashed in whole, its bits counted in stretches; other columns are ignored.
    """
    return fingerprint_components(stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints"), distance)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows of docs but for near duplicates: of each component one row with the smallest id stays (of a component without ids, any one of its rows that fp and text put first).

    Components are of texts, not of ids: different texts with one id stay both. Columns of any names stay as they are.
    """
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(columns)])
    at = {c: f"c_{columns.index(c)}" for c in (id_col, text_col)}
    printed = with_columns(named, at[text_col], lambda x: [pa.array(simhashes(x, shingle))], "fp bigint")
    rows = bucketed(printed.select(F.col(at[id_col]).cast("bigint").alias("doc_id"), "fp", *named.columns), "fp", "rows")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    return first_of_each(rows, named_nodes(nodes, near_fingerprints(rows, distance)), columns, text_col)


def first_of_each(rows: DataFrame, groups: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The columns c_0, c_1, ... of rows (doc_id, fp, c_0, ...), a table bucketed by fp, under their names, for the first row of each root of groups (fp, root, component_id).

    Which fingerprint has a component's first row is settled without the texts, which are not shuffled.
    """
    slim = rows.select("doc_id", "fp").join(groups, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = slim.groupBy("root").agg(F.min("fp").alias("fp"), F.first("component_id").alias("component_id")).select("fp", "component_id")
    found = rows.join(first, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    by = Window.partitionBy("fp").orderBy(f"c_{columns.index(text_col)}")
    found = found.withColumn("n_", F.row_number().over(by)).where("n_ = 1")
    return found.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(columns)])


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
