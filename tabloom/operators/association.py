"""Association between columns: correlations, AUC, eta squared, Cramér's V; targets and equal columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import grouped_ranks, ranks


def correlation(a: Column, b: Column) -> Column:
    """Pearson's coefficient of the rows that have both values; null where one of them does not vary (``corr`` raises there in ANSI mode)."""
    x, y = F.when(b.isNotNull(), a).cast("double"), F.when(a.isNotNull(), b).cast("double")
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs in one aggregation; each pair uses its complete rows."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*each)))


def spearman(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """Pearson over average ranks; every column is ranked over its own values. ``top`` keeps the strongest pairs only."""
    found = pearson(ranks(df, columns), columns)
    return found if top is None else found.where(~F.isnan("corr")).orderBy(F.abs("corr").desc(), "a", "b").limit(top)


def univariate_auc(df: DataFrame, column: str, positive) -> DataFrame:
    """Area under the ROC curve of one column, whichever way it points (Mann-Whitney over average ranks)."""
    by_value = grouped_ranks(df.where(positive.isNotNull()), column, {"__pos": positive.cast("long")})
    sums = by_value.agg(F.sum(F.col("__rank") * F.col("__pos")).alias("r"), F.sum("__pos").cast("double").alias("p"), F.sum(F.col("__n") - F.col("__pos")).cast("double").alias("q"))
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0.0))
    return sums.select(F.greatest(auc, 1 - auc).alias("auc"))


def eta_squared(df: DataFrame, category: str, value: str) -> DataFrame:
    """Between-group share of the variance."""
    rows = df.where(F.col(category).isNotNull() & F.col(value).isNotNull())
    groups = rows.groupBy(category).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    whole = groups.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"), F.sum("n").alias("t"))
    between = F.col("mm") - F.col("t") * F.col("g") * F.col("g")
    return whole.select((between / F.nullif(between + F.col("within"), F.lit(0.0))).alias("eta2"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Bias-corrected (Bergsma 2013), with every cell of the level grid, empty ones too."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    total = cells.agg(F.sum("o")).first()[0] or 0.0
    expected = F.col("ra") * F.col("cb") / F.lit(total)
    # sum over the grid of (o-e)^2/e: empty cells add their expected count, so those of the others are taken from the total
    full = cells.join(rows, "a").join(cols, "b").agg(F.sum((F.col("o") - expected) ** 2 / expected).alias("x"), F.sum(expected).alias("e"))
    shape = rows.agg(F.count(F.lit(1)).cast("double").alias("r")).crossJoin(cols.agg(F.count(F.lit(1)).cast("double").alias("k")))  # one row each
    phi2 = (F.col("x") + F.lit(total) - F.col("e")) / F.lit(total)
    n1 = F.lit(total - 1)
    corrected = F.greatest(F.lit(0.0), phi2 - (F.col("k") - 1) * (F.col("r") - 1) / n1)
    r2, k2 = F.col("r") - (F.col("r") - 1) ** 2 / n1, F.col("k") - (F.col("k") - 1) ** 2 / n1
    return full.crossJoin(shape).select(F.sqrt(corrected / F.nullif(F.least(k2 - 1, r2 - 1), F.lit(0.0))).alias("v"))


def target_distribution(df: DataFrame, target: str, classes: int = 30) -> DataFrame:
    counted = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 1
    return counted.withColumn("pct", F.round(100 * F.col("n") / F.lit(total), 3)).orderBy(F.col("n").desc(), "value").limit(classes)


def infer_task(df: DataFrame, target: str) -> str:
    """regression, binary or multiclass, from the target's values."""
    c = F.col(target)
    numeric = df.schema[target].dataType.typeName() not in ("string", "boolean")
    whole = F.min(c.cast("double") == F.floor(c.cast("double"))) if numeric else F.lit(None)
    r = df.where(c.isNotNull()).agg(F.count_distinct(c).alias("d"), F.count(F.lit(1)).alias("n"), whole.alias("whole")).first()
    if r["d"] <= 1:
        return "regression"
    if r["d"] == 2:
        return "binary"
    if not numeric:
        return "multiclass"
    return "multiclass" if r["whole"] and r["d"] <= 20 and r["n"] > 10 * r["d"] else "regression"


def association(df: DataFrame, column: str, target: str, positive=None) -> tuple[str, float | None]:
    """The measure that suits both columns' kinds, and its strength from 0 to 1."""
    numeric = lambda c: df.schema[c].dataType.typeName() not in ("string", "boolean")
    both = df.where(F.col(column).isNotNull() & F.col(target).isNotNull())
    if both.limit(20).count() < 20:
        return "none", None
    task = infer_task(df, target)
    if numeric(column) and task == "binary":
        if positive is None:
            top = both.groupBy(target).count().orderBy(F.col("count").desc(), target).first()[0]
            positive = F.col(target) == F.lit(top)
        auc = univariate_auc(both, column, positive).first()["auc"]
        return "auc", None if auc is None else 2 * auc - 1
    if numeric(column) and numeric(target):
        r = spearman(both, [column, target]).first()["corr"]
        return "spearman", None if r is None else abs(r)
    if numeric(column) or numeric(target):
        category, value = (target, column) if numeric(column) else (column, target)
        return "eta2", eta_squared(both, category, value).first()["eta2"]
    return "cramers_v", cramers_v(both, column, target).first()["v"]


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Pairs of columns equal in every row: candidates by a checksum of all rows, confirmed row by row."""
    marks = df.agg(*[F.sum(F.xxhash64(F.col(f"`{c}`").cast("string")).bitwiseAND(F.lit((1 << 31) - 1))).alias(c) for c in df.columns]).first()
    pairs = [(a, b) for a, b in combinations(df.columns, 2) if marks[a] == marks[b]]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "a string, b string")
    same = df.agg(*[F.min(F.col(f"`{a}`").cast("string").eqNullSafe(F.col(f"`{b}`").cast("string"))).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
    return spark.createDataFrame([p for i, p in enumerate(pairs) if same[f"s{i}"]], "a string, b string")


def frequent_levels(df: DataFrame, column: str, min_pct: float = 0.5, most: int = 30) -> DataFrame:
    """Levels above the share, at most ``most``; the largest one always."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 1
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "value"))
    best = counted.orderBy(F.col("n").desc(), "value").limit(most).withColumn("place", place)
    return best.where((100 * F.col("n") / F.lit(total) >= min_pct) | (F.col("place") == 1)).select("value", "n")
