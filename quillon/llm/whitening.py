"""Whitening of embeddings: Spark sums centred products of every pair of dimensions, LAPACK decomposes what they make."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, ship

#: Sums of one aggregation: wider covariances take several passes, each over a stretch of the upper triangle's rows.
SUMS = 8192


def pairs(d: int, most: int = SUMS) -> list[list[tuple[int, int]]]:
    """The upper triangle of d dimensions, diagonal included, in stretches of at most `most` pairs."""
    every = [(i, j) for i in range(d) for j in range(i, d)]
    return [every[k : k + most] for k in range(0, len(every), most)]


def covariance(rows: DataFrame, centred: list[Column], n: int, most: int = SUMS) -> np.ndarray:
    """The covariance, divisor n, of columns that are centred already: a sum for each pair of dimensions, all of them (or `most`) in one aggregation."""
    d = len(centred)
    line, out = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(centred)]), np.zeros((d, d))
    for part in pairs(d, most):
        sums = rows.sparkSession.sql(f"SELECT {', '.join(f'sum(c{i} * c{j}) AS s{k}' for k, (i, j) in enumerate(part))} FROM {{line}}", line=line).first()
        for (i, j), s in zip(part, sums, strict=True):
            out[i, j] = out[j, i] = (s or 0.0) / n
    return out


class Whitening(NamedTuple):
    """Integer vectors' count and sums by dimension, and their components by falling eigenvalue: unit vectors in columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def rank(self) -> int:
        """Components whose eigenvalue is more than the rounding of the largest."""
        return int((self.values > max(self.values.max(initial=0), 0) * len(self.values) * np.finfo(float).eps).sum())


def fit(rows: DataFrame, d: int, most: int = SUMS) -> Whitening:
    """From rows with x, an array of d whole numbers (long): exact sums first, then the products of what is left when the mean is taken away."""
    sums = rows.agg(F.count("*"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(19,0)")) for i in range(d)]).first()
    n, sums = sums[0], [int(s or 0) for s in sums[1:]]
    if not n or not d:
        return Whitening(n, sums, np.zeros(d), np.eye(d))
    # the mean is a whole number and a rest: x less the whole number is exact, and only the rest is rounded
    centred = [(F.get("x", F.lit(i)) - F.lit(s // n)).cast("double") - F.lit((s % n) / n) for i, s in enumerate(sums)]
    values, vectors = np.linalg.eigh(covariance(rows, centred, n, most))
    return Whitening(n, sums, values[::-1].copy(), vectors[:, ::-1].copy())


def projected(rows: DataFrame, model: Whitening, components: int) -> DataFrame:
    """rows (id, x) with w, the whitened vector (`components` doubles; null beyond the rank), and deviation, the exact sum of (n x - S)^2 over the dimensions (null where a long does not hold it)."""
    ship(rows.sparkSession)
    n, d, rank = model.n, len(model.sums), min(components, model.rank())
    whole, rest = np.array([s // n for s in model.sums], np.int64), np.array([s % n for s in model.sums], np.int64)
    change = model.vectors[:, :rank] / np.sqrt(model.values[:rank])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                x = part.column(1)
                x = x.flatten().to_numpy().reshape(-1, d) - whole
                w = np.full((len(x), components), np.nan)
                w[:, :rank] = (x - rest / n) @ change
                far = float(np.abs(x).max(initial=0) + 1) * n
                if far * far * d < 2.0**62:
                    deviation = ((x * n - rest) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [sum((a * n - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in x.tolist()]
                    deviation = [a if a < 1 << 63 else None for a in deviation]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * components), pa.array(w.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.int64()), lists], names=["id", "deviation", "w"])

    return rows.select("id", "x").mapInArrow(project, "id bigint, deviation bigint, w array<double>")


def identity_error(rows: DataFrame, components: int) -> float | None:
    """The largest absolute entry of the covariance of w less the identity, over the first `components`: None if there are none or no rows."""
    w = [F.get("w", F.lit(i)) for i in range(components)]
    sums = rows.agg(F.count("*"), *[F.sum(c) for c in w]).first()
    if not sums[0] or not components:
        return None
    found = covariance(rows, [c - F.lit(s / sums[0]) for c, s in zip(w, sums[1:], strict=True)], sums[0])
    return float(np.abs(found - np.eye(components)).max())


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(rows with id and x, dimensions): x = floor(64 c) + 1000000 of each component c as a double; vectors that are null or hold null or non-finite components are left out, shorter ones end in zeros."""
    fine = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.where(F.col(vector_col).isNotNull() & fine)
    d = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * 64).cast("bigint") + 1000000)
    x = F.concat(x, F.array_repeat(F.lit(1000000).cast("bigint"), F.lit(d) - F.size(vector_col)))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x")), d


def whiten(rows: DataFrame, d: int, components: int = 32, most: int = SUMS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row (id, x) and each component up to `components`, or as many as there are dimensions.

    Each row takes part, null and equal ids too. Components without variance have a null `whitened`, and a null `explained` if no dimension varies. No rows give none.
    Four passes of the vectors reach the driver as one row of sums each, of the square of the dimensions at most, whatever the rows.
    """
    kinds = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(rows, d, most)
    if not model.n or not d:
        return rows.sparkSession.createDataFrame([], kinds)
    k = min(components, d)
    out = projected(rows, model, k)
    error, trace = identity_error(out, min(k, model.rank())), float(model.values.sum())
    share = F.lit([float(max(e, 0.0) / trace) for e in model.values[:k]]) if trace > 0 else F.array_repeat(F.lit(None).cast("double"), F.lit(k))
    out = out.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("w").alias("c", "whitened"))
    return out.select("vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("c")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(*whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), 32)
