"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and grouped minima over the edges, staged to the shared folder; no adjacency
list is ever gathered. Edge tables of at most ``small`` rows, a few megabytes, go through a round in one
partition without an exchange. In larger ones hubs with over a thousandth of all edges (two thousand at
most) are joined by broadcast, so a hub's edges stay where they are; all other joins are dealt by node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common

#: Edges that one partition holds: work for seconds, so that dealing them out costs more than it spares.
SMALL = 100_000


def _with_least(rows: DataFrame, edges: int, small: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (a, b) with ``m``, the least ``b`` of each ``a``; and these minima."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
    if edges <= small:  # in one partition: nothing is dealt by node
        return rows.join(least.select("a", "m"), "a"), least.select("a", "m")
    hub = F.col("c") > max(64, edges // 1000)
    hubs = F.broadcast(least.where(hub).select("a", "m"))
    rest = rows.join(hubs.select("a"), "a", "left_anti").join(least.where(~hub).select("a", "m"), "a")
    return rest.union(rows.join(hubs, "a")), least.select("a", "m")


def _large_star(edges: DataFrame, count: int, small: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    held, _ = _with_least(both, count, small)
    return held.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, count: int, small: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    held, least = _with_least(down, count, small)
    return held.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _staged(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The edges, staged, their path, and their number and two sums of hashes, gathered while they are written."""
    seen = Observation()
    marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.xxhash64("a", "b") % 1000003).alias("s")]
    rows, path = common.staged_at(edges.observe(seen, *marks), "edges")
    return rows, path, (seen.get["n"], seen.get["h"], seen.get["s"])


def connected_components(edges: DataFrame, rounds: int = 60, small: int = SMALL) -> DataFrame:
    """``edges``: two columns of one integer type. Returns ``node`` and ``root`` (the smallest node
    of its component) for every node that has an edge to another node."""
    a, b = edges.columns
    pairs, path, mark = _staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        count = mark[0] or 0
        dealt = pairs.coalesce(1) if count <= small else pairs
        starred = _small_star(_large_star(dealt, count, small), count, small).where("a <> b").distinct()
        pairs_next, new_path, new_mark = _staged(starred)
        common.remove(pairs.sparkSession, path)
        pairs, path, mark, settled = pairs_next, new_path, new_mark, new_mark == mark
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
