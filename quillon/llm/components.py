"""Connected components of a graph that no machine can hold: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b): root is the smallest node of its component, which has a row for itself.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest neighbour, so trees flatten in about log n rounds.
    A round groups by node with partial minima and joins them back to the edges: no neighbourhood is ever collected, and a hot node's rows can be split.
    Rounds end in checkpoint() in the shared folder. Nulls and loops are ignored; no edges give no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:  # each round leaves less to do, so it ends
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = low.select("a", F.col("m").alias("b")).union(kept).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
