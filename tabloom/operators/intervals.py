"""Joins of points with intervals as equality joins on bins, instead of comparing all pairs.

Bins lie between quantiles of the points, so they hold about the same number of them; an interval is copied into the bins it
touches and every meeting is checked again exactly. A bin with far more points than the others (one frequent value) is
split: its points are dealt among parts, its intervals copied to each.

Counts and sums over the pairs need no pairs: an interval's are those of the points up to its end without those before its start
(``range_sums``), so the work grows with points and intervals, not with how often they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running_total


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, how: str = "inner", closed: bool = True, bins: int | None = None, hot: float = 3.0) -> DataFrame:
    """All pairs with ``low <= value <= high`` (``value < high`` unless ``closed``); ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``, seen from the points.

    Nulls match nothing, nor does an interval whose end lies before its start. NaN matches nothing. The columns of both sides must
    have different names."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"range_join: {how}")
    spark = points.sparkSession
    n = bins or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = F.col(f"`{value}`").cast("double")
    known = points.where(number.isNotNull() & ~F.isnan(number))
    edges = sorted(set(known.select(number.alias("v")).approxQuantile("v", [i / n for i in range(1, n)], 0.25 / n)))  # n numbers at most
    at = lambda c: F.size(F.filter(F.lit(edges), lambda e: e <= c)) if edges else F.lit(0)
    sizes = {r["bin"]: r["n"] for r in known.groupBy(at(number).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bin
    share = hot * max(1.0, sum(sizes.values()) / max(1, len(sizes)))
    parts = {b: -(-c // int(share)) for b, c in sizes.items() if c > share}
    fan: Column = F.lit(1)
    for b, k in parts.items():
        fan = F.when(F.col("__bin") == b, F.lit(int(k))).otherwise(fan)
    dealt = points.withColumn("__bin", at(number)).withColumn("__part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns if not points.schema[c].dataType.typeName() == "map"]), fan).cast("int"))
    start, end = (F.col(f"`{c}`").cast("double") for c in (low, high))
    valid = ranges.where((start <= end) & ~F.isnan(start) & ~F.isnan(end))
    copies = valid.withColumn("__bin", F.explode(F.sequence(at(start), at(end)))).withColumn("__part", F.explode(F.sequence(F.lit(0), fan - 1)))
    upper = F.col(f"`{value}`") <= F.col(f"`{high}`") if closed else F.col(f"`{value}`") < F.col(f"`{high}`")
    keys = (dealt["__bin"] == copies["__bin"]) & (dealt["__part"] == copies["__part"])
    joined = dealt.join(copies, keys & ~F.isnan(number) & (F.col(f"`{low}`") <= F.col(f"`{value}`")) & upper, how)
    columns = points.columns if how in ("left_semi", "left_anti") else [*points.columns, *ranges.columns]
    return joined.select(*[F.col(f"`{c}`") for c in columns])


def range_sums(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, by: list[str], amounts: list[str], closed: bool = True) -> DataFrame:
    """What grouping ``range_join`` by the intervals' columns ``by`` gives: ``n`` pairs and the sums of the points' ``amounts`` over them, a row
    for each group with a pair.

    Points are counted by distinct value; values and the intervals' ends go through one running total. Amounts that are not finite are
    counted apart, so that they reach only the groups that hold them."""
    at = lambda c: F.col(f"`{c}`").cast("double")
    named = {f"__g{i}": F.col(f"`{c}`") for i, c in enumerate(by)}
    parts = {"n": F.lit(1).cast("long")}
    for i, c in enumerate(amounts):
        a = at(c)
        parts |= {f"__s{i}": F.when(~F.isnan(a) & (F.abs(a) != float("inf")), a).otherwise(0.0), f"__k{i}": a.isNotNull().cast("long")}
        parts |= {f"__x{i}{m}": F.coalesce(a.eqNullSafe(F.lit(float(m))).cast("long"), F.lit(0).cast("long")) for m in ("nan", "inf", "-inf")}
    known = points.where(at(value).isNotNull() & ~F.isnan(at(value)))
    counted = known.groupBy(at(value).alias("__v")).agg(*[F.sum(p).alias(f"__p_{k}") for k, p in parts.items()])
    start, end = at(low), at(high)
    valid = ranges.where((start <= end) & ~F.isnan(start) & ~F.isnan(end))
    ends = F.explode(F.array(F.struct(start.alias("v"), F.lit(0).alias("o"), F.lit(-1).alias("w")), F.struct(end.alias("v"), F.lit(2 if closed else 0).alias("o"), F.lit(1).alias("w"))))
    borders = valid.select(*[c.alias(k) for k, c in named.items()], ends.alias("e")).select(*named, F.col("e.v").alias("__v"), F.col("e.o").alias("__o"), F.col("e.w").alias("__w"))
    borders = borders.groupBy(*named, "__v", "__o").agg(F.sum("__w").alias("__w")).where("__w <> 0")
    both = counted.withColumn("__o", F.lit(1)).unionByName(borders, allowMissingColumns=True)
    upto = running_total(both, [F.col("__v"), F.col("__o")], {k: F.coalesce(f"__p_{k}", F.lit(0)) for k in parts}).where("__w IS NOT NULL")
    found = upto.groupBy(*named).agg(*[F.sum(F.col(k) * F.col("__w")).alias(k) for k in parts]).where("n > 0")
    sums = []
    for i, c in enumerate(amounts):
        nan, up, down = (F.col(f"`__x{i}{m}`") for m in ("nan", "inf", "-inf"))
        odd = F.when((nan > 0) | ((up > 0) & (down > 0)), float("nan")).when(up > 0, float("inf")).when(down > 0, float("-inf"))
        sums.append(F.when(F.col(f"__k{i}") > 0, F.coalesce(odd, F.col(f"__s{i}"))).alias(c))
    return found.select(*[F.col(k).alias(c) for k, c in zip(named, by, strict=True)], "n", *sums)
