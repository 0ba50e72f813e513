"""Exact top-k by inner product over an impact-ordered index, processed score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: Candidates and queries of one index block.
CANDIDATES, QUERIES = 4096, 65536
#: Bands of impact of an index, and sums that are held at a time.
BANDS, CELLS = 4, 1 << 20
#: Bits of a limb of a score that is too large for one integer.
LIMB = 62


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers as a matrix; shorter rows end in zeros."""
    lists = lists.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class ImpactIndex:
    """Postings of a block of vectors, scaled so that no component is larger than 1, in order of their impact: BANDS bands, each of the components that reach a bound, which falls by four from band to band."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        scaled = np.ldexp(vectors, -int(np.frexp(np.abs(vectors).max(initial=0))[1]))
        size, above, self.bands = np.abs(scaled), np.inf, []
        for bound in [*(4.0**-i for i in range(1, BANDS)), 0.0]:
            here = (size >= bound) & (size < above)
            if here.any() or not bound:  # a posting is its place in the band's matrix; beside it the largest size left of each dimension
                self.bands.append((np.where(here, scaled, 0.0).T.copy(), np.where(size < bound, size, 0.0).max(axis=0, initial=0)))
            above = bound

    def possible(self, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row of queries, vectors that may be among its k best: all that are, and few others).

        Score at a time, for as many queries together as CELLS sums allow: a band's postings are added to the sums of all of them by one product of matrices. A sum can still change by no more
        than the query's sizes times the largest ones left. What cannot reach the k-th best sum even so, rounding included, is out by proof; a query ends when few are left or no postings.
        """
        n, d = self.vectors.shape
        need, slack, step = min(k, n), 8 * (d + 1) ** 2 * 2.0**-52, max(1, CELLS // n)
        for start in range(0, len(queries), step):
            part = queries[start : start + step]
            part = np.ldexp(part, -np.frexp(np.abs(part).max(axis=1, initial=0))[1][:, None])
            at, sums = np.arange(start, start + len(part)), np.zeros((len(part), n))
            for i, (postings, rest) in enumerate(self.bands):
                sums += part @ postings
                last, left = i == len(self.bands) - 1, np.abs(part) @ rest + slack
                some = np.flatnonzero(last | (2 * left < np.ptp(sums, axis=1)))  # of others no vector is out
                mine = sums[some]
                fits = mine >= (np.partition(mine, n - need, axis=1)[:, n - need] - 2 * left[some])[:, None]
                ends = last | (np.count_nonzero(fits, axis=1) <= max(64, n // 64))
                yield from ((int(at[some[j]]), np.flatnonzero(fits[j])) for j in np.flatnonzero(ends))
                goes_on = np.ones(len(at), bool)
                goes_on[some[ends]] = False
                if not goes_on.all():
                    part, at, sums = part[goes_on], at[goes_on], sums[goes_on]
                if not len(at):
                    break


def _best(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int, exact: bool) -> tuple[list[int], list[int]]:
    """(places, scores) of the k largest integer inner products, ties to smaller ids; exact: no sum leaves the range where integers of 64 bits hold it."""
    if exact:
        scores = vectors.astype(np.int64) @ query.astype(np.int64)
        best = np.lexsort((ids, -scores))[:k]
        return best.tolist(), scores[best].tolist()
    q = [int(x) for x in query.tolist()]
    scores = [sum(a * int(b) for a, b in zip(q, v, strict=True)) for v in vectors.tolist()]
    best = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k]
    return best, [scores[i] for i in best]


def _limbs(score: int, n: int) -> list[int]:
    """A score as n integers that sort as it does."""
    out = []
    for _ in range(n - 1):
        out.append(score & ((1 << LIMB) - 1))
        score >>= LIMB
    return [score, *reversed(out)]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of queries (id, v) against candidates (id, v), v arrays of whole numbers.

    Score: the integer inner product, a missing component being zero; one that 64 bits don't hold is ranked all the same but told as NULL. Ties go to smaller ids. Null ids or vectors take no part.
    A query's own row, a candidate with its id and its vector, takes no part, but others with its id do; each of several rows with one id asks by itself, and so has ranks of its own.
    Fewer than k candidates: all of them; no queries or candidates: no rows.

    Equal rows are counted first. Both sides are dealt into blocks by a hash of id and vector. Each block of queries meets each block of candidates in a task of its own, which builds the
    index of its candidates and returns k rows for each query at most; the best of those are the result.
    """
    ship(candidates.sparkSession)
    count = lambda df: df.where("id is not null and v is not null").groupBy("id", "v").agg(F.count("*").alias("times"))
    queries, candidates = count(queries), count(candidates)
    sizes = [F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))]
    (n, width, most), (m, wide, far) = candidates.agg(*sizes).first(), queries.agg(*sizes).first()
    width = max(width or 0, wide or 0, 1)
    reach = width * int(most or 0) * int(far or 0)
    limbs, exact = max(1, -(-(reach.bit_length() + 1) // LIMB)), reach < 1 << LIMB
    rows, columns = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    name = F.xxhash64("id", "v")
    block = lambda count: F.pmod(F.xxhash64(name), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    left = candidates.select("id", "v", "times", name.alias("q"), F.lit(False).alias("asks"), block(rows).alias("r"), every(columns).alias("c"))
    right = queries.select("id", "v", "times", name.alias("q"), F.lit(True).alias("asks"), block(columns).alias("c"), every(rows).alias("r"))

    def search(table: pa.Table) -> pa.Table:
        ids, asks, times, names = (table.column(c).to_numpy() for c in ("id", "asks", "times", "q"))
        vectors = _matrix(table.column("v"), width)
        out = []
        if not asks.all():
            there, many, called = ids[~asks], times[~asks], names[~asks]
            index, asking = ImpactIndex(there, vectors[~asks]), np.flatnonzero(asks)
            for i, at in index.possible(vectors[asking], k + 1):  # the query's own row may be among the best
                q = int(asking[i])
                left = many[at] - ((there[at] == ids[q]) & (called[at] == names[q]))
                at, left = at[left > 0], left[left > 0]
                best, scores = _best(there[at], index.vectors[at], vectors[q], k, exact)
                out += [(int(ids[q]), int(names[q]), int(times[q]), int(there[at[i]]), int(min(left[i], k)), _limbs(x, limbs)) for i, x in zip(best, scores, strict=True)]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["query_id", "q", "asked", "vec_id", "times", "key"])

    found = left.unionByName(right).groupBy("r", "c").applyInArrow(search, "query_id bigint, q bigint, asked bigint, vec_id bigint, times bigint, key array<bigint>")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    by = Window.partitionBy("query_id", "q").orderBy(F.desc("key"), "vec_id", "copy")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("asked"))))
    return found.select("query_id", "rank", "vec_id", (F.get("key", F.lit(0)) if limbs == 1 else _narrow(limbs)).alias("score"))


def _narrow(limbs: int) -> Column:
    """The score of a key of several limbs, NULL where 64 bits don't hold it: all limbs above the last two must be no more than the sign."""
    part, full = lambda i: F.get("key", F.lit(i)), (1 << LIMB) - 1
    negative, fits, top = part(0) < 0, F.lit(True), part(limbs - 2)
    if limbs > 2:
        fits = part(0) == F.when(negative, F.lit(-1)).otherwise(F.lit(0))
        for i in range(1, limbs - 2):
            fits = fits & (part(i) == F.when(negative, F.lit(full)).otherwise(F.lit(0)))
        top = top - F.when(negative, F.lit(full + 1)).otherwise(F.lit(0))
    return F.when(fits & top.between(-2, 1), top * F.lit(full + 1) + part(limbs - 1))


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(256 x) of each component as a double that is a whole number; vectors that are null or hold null or non-finite components, 256 times taken too, are left out."""
    x = F.transform(vector_col, lambda c: _floor(c.cast("double") * 256))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("bigint").alias("id"), x.alias("v"))


def _floor(c: Column) -> Column:
    """The floor of a double as a double: those beyond 2**53 are whole already, and a bigint would not hold all of them."""
    return F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double") + 0.0).otherwise(c)


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("id % 50 = 0"), 5)


OP8_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
