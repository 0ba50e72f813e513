"""Near-duplicate documents: links of an exact Jaccard similarity of word shingles, found by SimHash blocks and by prefixes of the shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import pressed, unpressed
from .common import bucketed, discard, stored, trim
from .components import components
from .hashing import BYTES, U, mix, utf8
from .simhash_dedup import _slices, first_of_each, named_nodes, near_fingerprints, shingles, simhashes, with_columns

#: Documents of the sample that common shingles are counted in, occurrences that make one common, and how many are told to all tasks. They settle the order of shingles only: any order finds all pairs.
SAMPLE, COMMON, TOLD = 1 << 16, 4, 1 << 20
#: Ranges of hashes that the sample's shingles are counted in.
RANGES = 64
#: Documents of a key that are compared with one another at once; of more, first neighbours and the smallest only, then those that this has not connected.
FEW = 8
#: Sets of a key that one task compares with one another; more are compared block by block.
CELL = 4096
PAIRS = 1 << 18
#: Bits of a set's sign.
BITS = 1024


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted: `shingle` words in a row joined by one space, A-Z lowered, or the whole sequence if there are fewer words."""
    data, starts, ends, row = shingles(texts, shingle)
    h = BYTES.spans(data, starts, ends)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def set_names(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, size) of each row's set: equal sets have equal names, the empty one 0."""
    size = np.bincount(row, minlength=rows)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h + U(0x9E3779B97F4A7C15)))])
    end = np.cumsum(size)
    name = mix(total[end] - total[end - size] + size.astype(U) * U(0xD6E8FEB86659FD93))
    return np.where(size > 0, name, U(0)).view(np.int64), size


def signs(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """BITS bits for each row's set, each telling whether an odd number of shingles fall to it: two sets differ in at least as many shingles as their signs do in bits."""
    odd = np.bincount(row * BITS + (h % U(BITS)).astype(np.int64), minlength=rows * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, BITS), axis=1)


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first shingles hold one of every set that is similar enough: such a set shares at least percent of the larger one's size."""
    return size + (-percent * size) // 100 + 1


def named(texts: pa.Array, shingle: int) -> list[pa.Array]:
    """fp (the name of a text's shingle set), size, sign and the SimHash fingerprint of each text."""
    row, h = shingle_sets(texts, shingle)
    name, size = set_names(row, h, len(texts))
    sign = pa.array([x.tobytes() for x in signs(row, h, len(texts))], pa.binary())
    return [pa.array(name), pa.array(size.astype(np.int32)), sign, pa.array(simhashes(texts, shingle))]


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count), by hash, of shingles that several documents of a sample of texts (fp, text) hold: TOLD at most, the most frequent first."""
    n = texts.count()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held = [shingle_sets(b.column(1), shingle)[1] for b in _slices(whole, 1 << 20)]
            if held:
                h = np.sort(np.concatenate(held))
                cuts = np.searchsorted(h >> U(58), np.arange(RANGES + 1, dtype=U))
                blobs = [pressed(np.diff(h[lo:hi], prepend=U(0))) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["range", "blob"])
        trim()

    def count(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.cumsum(unpressed(b, U)) for b in table.column("blob").to_pylist()])
        h, n = np.unique(h, return_counts=True)
        return pa.table({"h": h[n >= COMMON].view(np.int64), "n": n[n >= COMMON]})

    sample = texts.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, -(-n // SAMPLE)))) == 0)
    often = sample.mapInArrow(of, "range int, blob binary").groupBy("range").applyInArrow(count, "h bigint, n bigint")
    got = often.orderBy(F.desc("n"), "h").limit(TOLD).toArrow()
    h, n = got.column("h").to_numpy().view(U), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _entries(told, shingle: int, percent: int):
    """(key, fp, size, place): the first shingles of each set, the rarest in the sample first, then by hash. Rows of one set that follow one another count once."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = told.value
        before = None
        for whole in batches:
            fp = whole.column(0).to_numpy(zero_copy_only=False)
            new = np.ones(len(fp), bool)
            new[1:] = fp[1:] != fp[:-1]
            if len(fp):
                new[0] = fp[0] != before
                before = fp[-1]
            for b in _slices(whole.filter(pa.array(new)), 1 << 20):
                row, h = shingle_sets(b.column(1), shingle)
                size = np.bincount(row, minlength=b.num_rows)
                count = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    count = np.where(common[at] == h, often[at], 0)
                order = np.lexsort((h, count, row))
                row, h = row[order], h[order]
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                first = place < prefix_length(size, percent)[row]
                fp = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(fp[row[first]]), pa.array(size[row[first]].astype(np.int32)), pa.array(place[first].astype(np.int32))], names=["key", "fp", "size", "place"])
        trim()

    return of


def _may_do(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles can be similar if the first one that they share stands at i and j: no more than the rest of either is left to share."""
    return (100 + percent) * np.minimum(n - i, m - j) >= percent * (n + m)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of a partition sorted by its first column, cut where that one changes."""
    held: list[np.ndarray] = []
    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if len(held[0]):
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held:
        yield held


def _met(percent: int):
    """Of entries sorted by (key, size, fp): pairs (null, a, b, null) of those that share a key, and the entries (key, fp, size, place) of keys with more than FEW."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, size, place in _runs(batches):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
            key, fp, size, place = key[new], fp[new], size[new].astype(np.int64), place[new].astype(np.int64)
            begin = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            n = np.diff(np.append(begin, len(key)))
            run, many = np.repeat(np.arange(len(begin)), n), np.repeat(n > FEW, n)
            x, y = [np.repeat(begin, n)], [np.arange(len(key))]  # the smallest of the key
            for d in range(1, FEW):
                if len(key) > d:
                    i = np.flatnonzero((run[d:] == run[:-d]) & (~many[:-d] | (d == 1)))
                    x.append(i)
                    y.append(i + d)
            x, y = np.concatenate(x), np.concatenate(y)
            fit = (fp[x] != fp[y]) & (100 * size[x] >= percent * size[y]) & _may_do(size[x], place[x], size[y], place[y], percent)
            pair = np.unique(np.sort(np.stack([fp[x[fit]], fp[y[fit]]], axis=1), axis=1), axis=0)
            none = pa.nulls(len(pair), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([none, pa.array(key[many])]), pa.array(np.concatenate([pair[:, 0], fp[many]])), pa.array(np.concatenate([pair[:, 1], size[many]])), pa.concat_arrays([none, pa.array(place[many])])], names=["key", "a", "b", "place"]
            )

    return of


def _apart(percent: int):
    """Of entries (cell, size, fp, place, root, block, sign), sorted: the pairs of a cell that are not connected yet and that neither places nor signs rule out. Where a cell holds two blocks, pairs across them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, size, fp, place, root, block, sign in _runs(batches):
            begin = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
            out, held = [], 0
            for lo, hi in zip(begin.tolist(), np.append(begin, len(cell))[1:].tolist(), strict=True):
                s, f, r, p, b = size[lo:hi], fp[lo:hi], root[lo:hi], place[lo:hi], block[lo:hi]
                if (r == r[0]).all():
                    continue
                bits, both = np.frombuffer(b"".join(sign[lo:hi]), U).reshape(hi - lo, -1), bool((b != b[0]).any())
                last = np.searchsorted(s, 100 * s // percent, side="right")
                for i in range(hi - lo):
                    j = i + 1 + np.flatnonzero((r[i + 1 : last[i]] != r[i]) & ((b[i + 1 : last[i]] != b[i]) | (not both)) & _may_do(s[i], p[i], s[i + 1 : last[i]], p[i + 1 : last[i]], percent))
                    differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    j = j[(100 + percent) * differ <= (100 - percent) * (s[i] + s[j])]
                    out.append(np.stack([np.minimum(f[i], f[j]), np.maximum(f[i], f[j])], axis=1))
                    held += len(j)
                    if held >= PAIRS:
                        yield _pairs(out)
                        out, held = [], 0
            yield _pairs(out)

    return of


def _pairs(out: list[np.ndarray]) -> pa.RecordBatch:
    e = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])


def _similar(pairs: DataFrame, rows: DataFrame, shingle: int, percent: int, told: list[str]) -> DataFrame:
    """The pairs (a, b) whose sets have the Jaccard similarity: those that their signs do not rule out are compared as sets. told: tables that it reads."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (utf8(b.column(i))[0].reshape(b.num_rows, BITS // 8) for i in (3, 4))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            both = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            yield b.select(["a", "b"]).filter(pa.array((100 + percent) * differ <= (100 - percent) * both))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 1 << 20):
                row, h = shingle_sets(b.column(1), shingle)
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).tolist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["fp", "held"])
        trim()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fit[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield b.select(["a", "b"]).filter(pa.array(fit))

    sign = rows.groupBy("fp").agg(F.max("size").alias("size"), F.max("sign").alias("sign"))
    one, two = (sign.select(F.col("fp").alias(k), F.col("size").alias(f"n{k}"), F.col("sign").alias(f"s{k}")) for k in "ab")
    signed = pairs.join(one, "a").join(two, "b").select("a", "b", F.col("na") + F.col("nb"), "sa", "sb")
    pairs = stored(signed.mapInArrow(possible, "a bigint, b bigint"), "possible", told)
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    held = stored(rows.select("fp", "text").join(ends, "fp", "left_semi").mapInArrow(sets, "fp bigint, held binary").groupBy("fp").agg(F.max("held").alias("held")), "sets", told)
    both = pairs.join(held.select(F.col("fp").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("fp").alias("b"), F.col("held").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(judged, "a bigint, b bigint")


def similar_pairs(rows: DataFrame, text_col: str, shingle: int, percent: int, distance: int = 2) -> DataFrame:
    """Links (a, b) between shingle sets of rows (fp, size, sign, sim, text), a table bucketed by fp: they connect the same sets as all pairs of the similarity do.

    Candidates come from two sides. Sets whose SimHash fingerprints (sim) are at most `distance` bits apart meet in pigeonhole blocks. But a similarity of 0.8 leaves ten of 64 bits
    different, more than blocks can cover, so sets also meet by their shingles: two similar sets share one among the first of each, in any one order of all shingles.
    All candidates are compared as sets. Of a key that many sets share, first neighbours and the smallest are; then pairs that this has not connected and that the places of the shingle and the
    signs of the sets do not rule out, in cells of a bounded size. What is ruled out leaves no row.
    """
    spark = rows.sparkSession
    rows = rows.select("fp", "size", "sign", "sim", F.col(text_col).alias("text"))
    prints = rows.select("fp", "sim").distinct()
    first = prints.groupBy("sim").agg(F.min("fp").alias("first"))
    equal = prints.join(first, "sim").where("fp <> first").select(F.least("fp", "first").alias("a"), F.greatest("fp", "first").alias("b"))
    near = near_fingerprints(first.select(F.col("sim").alias("fp")), distance)
    ends = [first.select(F.col("sim").alias(k), F.col("first").alias(f"f{k}")) for k in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    texts = rows.select("fp", "text")
    common, told = spark.sparkContext.broadcast(common_shingles(texts, shingle)), []
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    entries = texts.mapInArrow(_entries(common, shingle, percent), "key bigint, fp bigint, size int, place int")
    met = stored(entries.repartition(n, "key").sortWithinPartitions("key", "size", "fp").mapInArrow(_met(percent), "key bigint, a bigint, b bigint, place bigint"), "met", told)
    pairs = met.where("key IS NULL").select("a", "b").union(equal).union(near).distinct()
    links = stored(_similar(pairs, rows, shingle, percent, told), "links", told)
    roots = components(links)
    more = met.where("key IS NOT NULL").join(roots, F.col("a") == F.col("node"), "left").select("key", F.col("b").alias("size"), F.col("a").alias("fp"), "place", F.coalesce("root", "a").alias("root"))
    # keys whose sets are not all connected, and into how many blocks each is dealt
    open_ = more.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / CELL).alias("blocks")).where("low <> high").select("key", "blocks")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = more.join(open_, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "size", "fp", "place", "root", "block")
    signed = dealt.join(rows.groupBy("fp").agg(F.max("sign").alias("sign")), "fp").select("cell", "size", "fp", "place", "root", "block", "sign")
    pairs = stored(signed.repartition(n, "cell").sortWithinPartitions("cell", "size", "fp").mapInArrow(_apart(percent), "a bigint, b bigint").distinct(), "pairs", told)
    found = stored(links.union(_similar(pairs, rows, shingle, percent, told)), "links")
    discard(spark, told)
    return found


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but for near duplicates: documents are linked if their sets of shingles have a Jaccard similarity of at least `percent` / 100; of each component
    one row with the smallest id stays (of a component without ids, the one that its set and text put first). Texts without words, null ones too, are all alike.

    Components are of texts, not of ids: different texts with one id stay both. Columns of any names stay as they are; no rows give none.
    """
    columns = docs.columns
    aliased = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(columns)])
    text = f"c_{columns.index(text_col)}"
    whole = with_columns(aliased, text, lambda x: named(x, shingle), "fp bigint, size int, sign binary, sim bigint")
    rows = bucketed(whole.withColumn("doc_id", F.col(f"c_{columns.index(id_col)}").cast("bigint")), "fp", "rows")
    links = similar_pairs(rows, f"c_{columns.index(text_col)}", shingle, percent)
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    return first_of_each(rows, named_nodes(nodes, links), columns, text_col)
