"""Evaluation of predictions: everything goes through one row per distinct score, never a global sort of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import exact_quantiles
from .ranking import running_total, with_ntile


def score_table(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """``score``, ``n``, ``pos`` and the sums ``n_upto``, ``pos_upto`` over scores at least as high."""
    rows = df.where(F.col(score).isNotNull() & positive.isNotNull())
    counted = rows.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(positive.cast("long")).alias("pos"))
    return running_total(counted, [F.col("score").desc()], {"n_upto": F.col("n"), "pos_upto": F.col("pos")})


def ks_statistic(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Largest gap of the two cumulative distributions; tied scores count together."""
    table = score_table(df, score, positive)
    t = table.agg(F.sum("pos").alias("p"), F.sum("n").alias("n")).first()
    p, q = float(t["p"] or 0), float((t["n"] or 0) - (t["p"] or 0))
    gap = F.abs(F.col("pos_upto") / F.lit(max(p, 1.0)) - (F.col("n_upto") - F.col("pos_upto")) / F.lit(max(q, 1.0)))
    return table.agg(F.max(gap).alias("ks"))


def deciles(df: DataFrame, score: str, positive: Column, key: str, tiles: int = 10) -> DataFrame:
    """Rows, positives, rate, lift and cumulative capture by decile of falling score."""
    tiled = with_ntile(df.select(score, key, positive.cast("long").alias("__pos")), [F.col(score).desc(), F.col(key)], tiles)
    table = tiled.groupBy("decil").agg(F.count(F.lit(1)).alias("n"), F.sum("__pos").alias("pos"), F.avg(score).alias("mean_score"))
    every = Window.partitionBy()  # over ten rows
    upto = Window.orderBy("decil").rowsBetween(Window.unboundedPreceding, 0)
    total, rows = F.sum("pos").over(every), F.sum("n").over(every)
    return table.select("decil", "n", "pos", "mean_score", (F.col("pos") / F.col("n")).alias("rate"), (F.col("pos") / F.col("n") / (total / rows)).alias("lift"), (F.sum("pos").over(upto) / total).alias("capture"))


def lift_at(df: DataFrame, score: str, positive: Column, key: str, share: float = 0.1) -> DataFrame:
    """Lift of the best ``share`` of the rows (one at least)."""
    rows = df.select(score, key, positive.cast("long").alias("pos"))
    n = max(1, int(rows.count() * share))
    numbered = running_total(rows, [F.col(score).desc(), F.col(key)], {"row": F.lit(1).cast("long")})
    return numbered.agg((F.avg(F.when(F.col("row") <= n, F.col("pos"))) / F.nullif(F.avg("pos"), F.lit(0.0))).alias("lift"))


def calibration_bins(df: DataFrame, score: str, positive: Column, bins: int = 10) -> DataFrame:
    """Bins between the distinct quantiles of the score: rows, mean score, observed rate."""
    edges = exact_quantiles(df.select(F.col(score).cast("double").alias("s")), ["s"], [i / bins for i in range(bins + 1)])["s"]
    inner = sorted({e for e in edges if e is not None})[1:-1]
    at = sum((F.when(F.col(score) > e, 1).otherwise(0) for e in inner), F.lit(0))
    return df.groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(positive.cast("double")).alias("rate"))


def expected_calibration_error(df: DataFrame, score: str, positive: Column, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, score, positive, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def binary_metrics(df: DataFrame, score: str, positive: Column, threshold: float | None = None) -> DataFrame:
    """AUC, average precision, Brier score, log loss, and the figures at ``threshold`` (default: the quantile
    at which the predicted share of positives is the true one)."""
    rows = df.select(F.col(score).cast("double").alias("s"), positive.cast("long").alias("y"))
    if threshold is None:
        base = rows.agg(F.avg("y")).first()[0] or 0.0
        threshold = exact_quantiles(rows, ["s"], [1 - base])["s"][0]
    t, y, s = F.lit(float(threshold or 0.5)), F.col("y"), F.col("s")
    clipped = F.least(F.greatest(s, F.lit(1e-15)), F.lit(1 - 1e-15))
    hit = s >= t
    c = rows.agg(
        F.avg((s - y) ** 2).alias("brier"), F.avg(-(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))).alias("logloss"),
        F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn"),
    )
    table = score_table(rows, "s", y == 1)
    p, n = F.sum("pos"), F.sum("n") - F.sum("pos")
    before_n, before_p = F.col("n_upto") - F.col("n"), F.col("pos_upto") - F.col("pos")
    area = F.sum((F.col("n") - F.col("pos")) * (before_p + F.col("pos") / 2)) / F.nullif(p * n, F.lit(0))
    precision = F.sum(F.col("pos") * F.col("pos_upto") / F.col("n_upto")) / F.nullif(p, F.lit(0))
    del before_n
    curves = table.agg(area.alias("auc"), precision.alias("pr_auc"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    figures = [ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]
    return curves.crossJoin(c).select("auc", "pr_auc", "brier", "logloss", *figures)  # one row each


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def multiclass_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    cells = confusion(df, truth, guess)
    sides = cells.select(F.col("truth").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.union(cells.select("guess", F.lit(0).cast("long"), "n", F.lit(0).cast("long")))
    per = sides.groupBy("c").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("hit").alias("hit")).where("t > 0")
    precision, recall = F.coalesce(F.try_divide("hit", "g"), F.lit(0.0)), F.col("hit") / F.col("t")
    f1 = 2 * F.col("hit") / (F.col("t") + F.col("g"))
    return per.agg((F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("f1_macro"), F.avg(precision).alias("precision_macro"), F.avg(recall).alias("recall_macro"))


def multiclass_probability_metrics(df: DataFrame, truth: str, classes: list[str], probabilities: str) -> DataFrame:
    """``logloss`` and macro one-vs-rest ``auc`` of ``probabilities``, an array in the order of ``classes``.

    Shares are normalised by row and kept 1e-15 from 0 and 1; rows whose truth is null or no class are left out. A class without rows or
    without others has no area and takes no part in the mean. All classes go through one table of distinct (class, score)."""
    place = F.array_position(F.lit(list(classes)), F.col(truth).cast("string"))
    rows = df.select(place.cast("int").alias("t"), F.col(probabilities).alias("p")).where("t > 0 AND p IS NOT NULL")
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    shares = rows.withColumn("p", F.transform("p", lambda x: x / F.nullif(total, F.lit(0.0))))
    own = F.least(F.greatest(F.element_at("p", F.col("t")), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = shares.agg(F.avg(-F.ln(own)).alias("logloss"))
    cells = shares.select("t", F.posexplode("p").alias("c", "s")).select((F.col("c") + 1).alias("c"), "s", (F.col("t") == F.col("c") + 1).cast("long").alias("y"))
    counted = cells.groupBy("c", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    table = running_total(counted, [F.col("c"), F.col("s").desc()], {"pos_upto": F.col("pos")})
    sizes = {r["c"]: r["p"] for r in counted.groupBy("c").agg(F.sum("pos").alias("p")).collect()}  # a row a class
    before = F.element_at(F.lit([sum(sizes.get(j, 0) for j in range(1, i)) for i in range(1, len(classes) + 1)] or [0]), F.col("c"))
    above = F.col("pos_upto") - before - F.col("pos")
    area = F.sum((F.col("n") - F.col("pos")) * (above + F.col("pos") / 2)) / F.nullif(F.sum("pos") * (F.sum("n") - F.sum("pos")), F.lit(0))
    return loss.crossJoin(table.groupBy("c").agg(area.alias("area")).agg(F.avg("area").alias("auc")))  # one row each


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    e = p - y
    nz = lambda c: F.nullif(c, F.lit(0.0))
    return df.where(y.isNotNull() & p.isNotNull()).agg(
        (1 - F.sum(e * e) / nz(F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.abs(y) > 1e-9, F.abs(e) / F.abs(F.nullif(y, F.lit(0.0))))).alias("mape"), (F.sum(F.abs(e)) / nz(F.sum(F.abs(y)))).alias("wmape"),
        F.avg(2 * F.abs(e) / nz(F.abs(y) + F.abs(p))).alias("smape"), (F.sum(e) / nz(F.sum(F.abs(y)))).alias("bias"),
    )


#: The metrics by name: which direction is better, how they are shown, what they say.
CATALOGUE: dict[str, tuple[str, str, str]] = {
    "auc": ("higher", "0.000", "chance that a positive row is ranked above a negative one"),
    "pr_auc": ("higher", "0.000", "average precision over all thresholds"),
    "accuracy": ("higher", "0.0%", "share of right predictions"),
    "balanced_accuracy": ("higher", "0.0%", "mean recall of the classes"),
    "precision": ("higher", "0.0%", "share of predicted positives that are right"),
    "recall": ("higher", "0.0%", "share of positives that are found"),
    "f1": ("higher", "0.000", "harmonic mean of precision and recall"),
    "f1_macro": ("higher", "0.000", "mean F1 of the classes"),
    "brier": ("lower", "0.0000", "mean squared error of probabilities"),
    "logloss": ("lower", "0.0000", "mean negative log likelihood"),
    "ece": ("lower", "0.0%", "mean gap between predicted and observed shares"),
    "r2": ("higher", "0.000", "share of variance explained"),
    "rmse": ("lower", "0.00", "root of the mean squared error"),
    "mae": ("lower", "0.00", "mean absolute error"),
    "mape": ("lower", "0.0%", "mean relative error"),
    "wmape": ("lower", "0.0%", "absolute error over absolute total"),
    "smape": ("lower", "0.0%", "error relative to the mean of truth and prediction"),
    "bias": ("zero", "0.0%", "signed error over absolute total"),
}
#: The metric that models of a task are compared by.
PRIMARY = {"binary": "auc", "multiclass": "f1_macro", "regression": "wmape"}


def better(metric: str, a: float | None, b: float | None) -> bool:
    """Is ``a`` strictly better than ``b``? A missing value is worse than any."""
    if a is None or b is None:
        return a is not None
    direction = CATALOGUE[metric][0]
    return a > b if direction == "higher" else abs(a) < abs(b) if direction == "zero" else a < b
