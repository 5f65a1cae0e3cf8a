"""Profiles: one aggregation for all numeric columns, one pass for values, then rules over the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_finite, kind_of

QUANTILES = {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}


def sample_skewness(c: Column) -> Column:
    """Bias-corrected, from the population moment that Spark has."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)))


def _melt(row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{f}`").alias(f) for f in fields]) for c in columns]
    return row.select(F.inline(F.array(*each)))


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Interpolated quantiles of finite values, by column. Values are counted once for all columns and dealt by range with
    running totals, so no task holds a column; two rows a quantile reach the driver."""
    from .ranking import running_total

    finite = lambda c: F.when(is_finite(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), finite(c).alias("v")) for i, c in enumerate(columns)]))
    counted = df.select(pairs.alias("p")).select("p.*").where("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    ordered = running_total(counted, [F.col("c"), F.col("v")], {"upto": F.col("n")})
    sizes = {r["c"]: r["n"] for r in ordered.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    before, wanted = 0, []
    for i in range(len(columns)):
        for p in probabilities if i in sizes else ():
            at = p * (sizes[i] - 1)
            wanted += [(i, p, before + int(at), at - int(at)), (i, p, before + min(int(at) + 1, sizes[i] - 1), at - int(at))]
        before += sizes.get(i, 0)
    places = sorted({w[2] for w in wanted})
    first = F.col("upto") - F.col("n")
    inside = F.filter(F.lit(places) if places else F.array().cast("array<bigint>"), lambda x: (x >= first) & (x < F.col("upto")))
    value_at = {r["at"]: r["v"] for r in ordered.select("v", F.explode(inside).alias("at")).collect()}
    found: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        mine = [w for w in wanted if w[0] == i]
        found[c] = [value_at[lo[2]] + (value_at[hi[2]] - value_at[lo[2]]) * lo[3] for lo, hi in zip(mine[::2], mine[1::2], strict=True)] or [None] * len(probabilities)
    return found


def numeric_profile(df: DataFrame, columns: list[str], exact: bool = True, exact_at: dict[str, list[float | None]] | None = None) -> DataFrame:
    """One row per column: counts, moments and quantiles (exact by range-dealt counts, or approximate in the one aggregation).
    ``exact_at`` are the quantiles, if they are known already."""
    exact_at = exact_at or (exact_quantiles(df, columns, list(QUANTILES.values())) if exact else {})
    aggs, fields = [], ["rows", "nulls", "null_pct", "zeros", "negatives", "min", "max", "mean", "std", "skew", "kurt", "cv", *QUANTILES]
    for name in columns:
        value = F.col(f"`{name}`").cast("double")
        c = F.when(is_finite(value), value)
        q = [F.lit(v).cast("double") for v in exact_at[name]] if exact else F.percentile_approx(c, list(QUANTILES.values()), 10_000)
        made = {
            "rows": F.count(F.lit(1)), "nulls": F.count_if(value.isNull()), "null_pct": F.round(100 * F.count_if(value.isNull()) / F.count(F.lit(1)), 3),
            "zeros": F.count_if(c == 0), "negatives": F.count_if(c < 0), "min": F.min(c), "max": F.max(c), "mean": F.avg(c), "std": F.stddev_samp(c),
            "skew": sample_skewness(c), "kurt": sample_kurtosis(c), "cv": F.abs(F.stddev_samp(c) / F.nullif(F.avg(c), F.lit(0.0))),
        }
        aggs += [v.alias(f"{name}__{k}") for k, v in made.items()]
        aggs += [q[i].alias(f"{name}__{k}") for i, k in enumerate(QUANTILES)]
    return _melt(df.agg(*aggs), columns, fields)


def outliers(df: DataFrame, columns: list[str], factor: float = 1.5, bounds: dict[str, list[float | None]] | None = None) -> DataFrame:
    """Tukey fences of all columns in one pass (unless their quarters are given as ``bounds``), then the rows outside in a second."""
    bounds = bounds or exact_quantiles(df, columns, [0.25, 0.75])
    aggs, fields = [], ["low", "high", "outliers", "outlier_pct"]
    for c in columns:
        q1, q3 = (v if v is not None else 0.0 for v in bounds[c])
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        out = F.count_if((F.col(f"`{c}`") < low) | (F.col(f"`{c}`") > high))
        aggs += [F.lit(float(low)).alias(f"{c}__low"), F.lit(float(high)).alias(f"{c}__high"), out.alias(f"{c}__outliers")]
        aggs += [F.round(100 * out / F.nullif(F.count(f"`{c}`"), F.lit(0)), 3).alias(f"{c}__outlier_pct")]
    return _melt(df.agg(*aggs), columns, fields)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Fixed-width bins over [p01, p99] (or [min, max]); values outside are left out, empty bins are 0."""
    c = F.col(f"`{column}`").cast("double")
    low, high, least, most = (exact_quantiles(df, [column], [0.01, 0.99, 0.0, 1.0]))[column]
    if low is None or high <= low:
        low, high = least, most
    spark = df.sparkSession
    if low is None or high <= low:
        return spark.createDataFrame([], "bin long, low double, high double, n long")
    width = (high - low) / bins
    at = F.least(F.floor((c - F.lit(low)) / F.lit(width)).cast("long"), F.lit(bins - 1).cast("long"))
    counted = df.where(c.between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(bins).withColumnRenamed("id", "bin")
    edges = [(F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high")]
    return every.join(counted, "bin", "left").select("bin", *edges, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``value``, ``n`` of all columns in one exchange; nulls are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    if approximate:
        return _melt(df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"{c}__n_distinct") for c in columns]), columns, ["n_distinct"])
    return value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    made = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}__nulls") for c in columns] + [F.count(F.lit(1)).alias(f"{c}__rows") for c in columns]
    return _melt(df.agg(*made), columns, ["rows", "nulls"])


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    total = df.where(F.col(column).isNotNull()).count()
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "value").limit(k).withColumn("pct", F.round(100 * F.col("n") / F.lit(max(1, total)), 3))


def datetime_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    made = [f(F.col(f"`{c}`").cast("timestamp_ntz")).alias(f"{c}__{n}") for c in columns for n, f in (("first", F.min), ("last", F.max))]
    return _melt(df.agg(*made), columns, ["first", "last"])


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    made = [f(F.length(f"`{c}`")).cast(t).alias(f"{c}__{n}") for c in columns for n, f, t in (("avg_length", F.avg, "double"), ("max_length", F.max, "long"))]
    return _melt(df.agg(*made), columns, ["avg_length", "max_length"])


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Groups of equal rows and the rows in them beyond the first."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("extra_rows"))


def quality_issues(df: DataFrame, exact_at: dict[str, list[float | None]] | None = None) -> tuple[list[dict], int, str]:
    """Issues by column, the score (100 less 8, 3 or 1 an issue) and its level. ``exact_at`` are the ``QUANTILES``, if they are known already."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema}
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    texts = [c for c, k in kinds.items() if k == "categorical"]
    nulls = {r["column"]: r for r in null_counts(df).collect()}
    distinct = {r["column"]: r["n_distinct"] for r in distinct_counts(df, df.columns).collect()}
    exact_at = exact_at or exact_quantiles(df, numeric, list(QUANTILES.values())) if numeric else {}
    quarters = [list(QUANTILES).index(q) for q in ("p25", "p75")]
    stats = {r["column"]: r for r in numeric_profile(df, numeric, exact_at=exact_at).collect()} if numeric else {}
    fences = {r["column"]: r for r in outliers(df, numeric, bounds={c: [q[i] for i in quarters] for c, q in exact_at.items()}).collect()} if numeric else {}
    lengths = {r["column"]: r["avg_length"] for r in text_lengths(df, texts).collect()} if texts else {}
    found: list[dict] = []
    add = lambda column, code, severity: found.append({"column": column, "code": code, "severity": severity})
    for c in df.columns:
        rows, values = nulls[c]["rows"], distinct.get(c, 0)
        null_pct = 100 * nulls[c]["nulls"] / max(1, rows)
        if values <= 1:
            add(c, "constant", "high")
        if null_pct >= 60:
            add(c, "nulls_high", "high")
        elif null_pct >= 20:
            add(c, "nulls_medium", "medium")
        if (lengths.get(c) or 0) >= 25 and 100 * values / max(1, rows) >= 50:
            add(c, "text", "low")
        elif kinds[c] == "categorical" and values > 200:
            add(c, "high_cardinality", "medium")
        if rows > 1 and values == rows:
            add(c, "identifier", "medium")
        if c in stats:
            if (fences[c]["outlier_pct"] or 0) > 10:
                add(c, "outliers", "medium")
            if abs(stats[c]["skew"] or 0) > 3:
                add(c, "skewed", "low")
    if duplicate_groups(df).first()["groups"]:
        add(None, "duplicates", "medium")
    score = max(0, 100 - sum({"high": 8, "medium": 3, "low": 1}[i["severity"]] for i in found))
    return found, score, "good" if score >= 80 else "fair" if score >= 55 else "poor"
