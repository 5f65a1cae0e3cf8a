"""Dashboards: a spec derived from a profile, filters, KPIs, series, bars, histograms, period comparisons."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import profile as P

#: Name parts of money, shares, counts, and of what is averaged rather than summed.
MONEY = r"(?i)monto|importe|total|price|amount|revenue|cost|saldo|balance|acctbal|colocacion|cobrad"
PERCENT = r"(?i)porcentaje|pct|percent|rate|ratio|tasa|discount|tax"
COUNT = r"(?i)cantidad|count|qty|quantity|cuotas|socios|num"
AVERAGED = r"(?i)edad|age|dias|days|score|prob|promedio|avg|mean|size"
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclass
class Spec:
    time: str | None
    metrics: dict[str, str] = field(default_factory=dict)  # column: aggregate
    dimensions: list[str] = field(default_factory=list)
    table: list[str] = field(default_factory=list)


def label(name: str) -> str:
    """CamelCase and snake_case as words."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name.replace("_", " "))
    return re.sub(r"\s+", " ", spaced).strip().capitalize()


def detect_spec(df: DataFrame) -> Spec:
    kinds = {f.name: V.kind_of(f.dataType) for f in df.schema}
    rows = df.count()
    distinct = {r["column"]: r["n_distinct"] for r in P.distinct_counts(df, df.columns).collect()}
    times = sorted((c for c, k in kinds.items() if k == "datetime"), key=lambda c: (-distinct.get(c, 0), c))
    numeric = [c for c, k in kinds.items() if k == "numeric" and not re.search(r"(?i)key$|(^|_)id$|Id$|linenumber", c) and distinct.get(c, 0) > 1]
    stats = {r["column"]: r for r in P.numeric_profile(df, numeric, exact=False).collect()} if numeric else {}

    def merit(c: str) -> float:
        base = 3.0 if re.search(MONEY, c) else 2.0 if re.search(PERCENT, c) else 1.2 if re.search(COUNT, c) else 0.5
        return base + min(stats[c]["cv"] or 0.0, 1.0)

    best = sorted(numeric, key=lambda c: (-merit(c), c))[:6]
    averaged = lambda c: bool(re.search(PERCENT, c) and not re.search(MONEY, c) or re.search(AVERAGED, c))
    dims = [c for c, k in kinds.items() if k in ("categorical", "boolean") and 2 <= distinct.get(c, 0) <= min(40, max(2, rows / 5))]
    return Spec(times[0] if times else None, {c: "avg" if averaged(c) else "sum" for c in best}, sorted(dims, key=lambda c: (distinct[c], c))[:4], df.columns[:24])


def apply_filters(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """``{column: [values]}`` or ``{column: {"from": ..., "to": ...}}`` (both days inclusive); unknown columns and empty values are ignored."""
    for name, wanted in filters.items():
        if name not in df.columns or not wanted:
            continue
        c = F.col(f"`{name}`")
        if isinstance(wanted, dict):
            if wanted.get("from"):
                df = df.where(c >= F.lit(wanted["from"]).cast("timestamp_ntz"))
            if wanted.get("to"):
                df = df.where(c < F.lit(wanted["to"]).cast("timestamp_ntz") + F.expr("interval 1 day"))
        else:
            df = df.where(c.isin(*wanted))
    return df


def kpis(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """All KPIs in one aggregation: ``rows`` and one column per metric."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[AGGREGATES[a](F.col(f"`{c}`")).alias(f"{a}_{c}") for c, a in metrics.items()])


def series(df: DataFrame, time: str | Column, metric: str, aggregate: str = "sum", grain: str = "month") -> DataFrame:
    at = F.col(time) if isinstance(time, str) else time
    return df.where(at.isNotNull()).groupBy(V.truncated(grain, at).alias("period")).agg(AGGREGATES[aggregate](metric).alias("value"))


def bars(df: DataFrame, dimension: str, metric: str | None = None, aggregate: str = "sum", most: int = 14) -> DataFrame:
    value = F.count(F.lit(1)) if metric is None else AGGREGATES[aggregate](metric)
    grouped = df.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("level")).agg(value.alias("value"))
    return grouped.orderBy(F.col("value").desc(), "level").limit(most)


def compare(df: DataFrame, time: str, metric: str, aggregate: str = "sum", points: bool = False) -> DataFrame:
    """By month: value, month-over-month, year-over-year, and year-to-date with its change. Looked up by calendar, not by
    position; changes are in percent, or in ``points``; null where the base is missing or zero."""
    m = series(df, time, metric, aggregate).select(F.col("period"), F.col("value"))
    back = lambda months, name: m.select(F.add_months("period", months).cast("timestamp_ntz").alias("period"), F.col("value").alias(name))
    both = m.join(back(1, "prior"), "period", "left").join(back(12, "year_ago"), "period", "left")
    days = m.select(F.year("period").alias("y"), F.month("period").alias("mo"), "value")
    sums = days.alias("a").join(days.alias("b"), (F.col("a.y") == F.col("b.y")) & (F.col("b.mo") <= F.col("a.mo")))
    ytd = sums.groupBy(F.make_date("a.y", "a.mo", F.lit(1)).cast("timestamp_ntz").alias("period")).agg((F.avg if aggregate == "avg" else F.sum)("b.value").alias("ytd"))
    last = ytd.select(F.add_months("period", 12).cast("timestamp_ntz").alias("period"), F.col("ytd").alias("ytd_ago"))
    full = both.join(ytd, "period").join(last, "period", "left")
    change = lambda now, base: (F.col(now) - F.col(base)) if points else 100 * (F.col(now) - F.col(base)) / F.abs(F.nullif(F.col(base), F.lit(0.0)))
    return full.select("period", "value", change("value", "prior").alias("mom"), change("value", "year_ago").alias("yoy"), "ytd", change("ytd", "ytd_ago").alias("ytd_yoy"))


def facets(df: DataFrame, dimensions: list[str], most: int = 40) -> DataFrame:
    """The most frequent levels of each dimension, up to ``most``."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    return P.value_counts(df, dimensions).withColumn("place", place).where(F.col("place") <= most).select("column", "value", "n")


def run(df: DataFrame, filters: dict | None = None, spec: Spec | None = None) -> dict[str, DataFrame]:
    """All parts of the dashboard over the filtered rows."""
    spec = spec or detect_spec(df)
    rows = apply_filters(df, filters or {})
    out = {"kpis": kpis(rows, spec.metrics), "table": rows.select(*[F.col(f"`{c}`") for c in spec.table])}
    for c, a in list(spec.metrics.items())[:2]:
        if spec.time:
            out[f"series_{c}"], out[f"compare_{c}"] = series(rows, spec.time, c, a), compare(rows, spec.time, c, a, points=a == "avg")
        out |= {f"bars_{d}_{c}": bars(rows, d, c, a) for d in spec.dimensions[:2]}
    for c in list(spec.metrics)[:1]:
        out[f"histogram_{c}"] = P.histogram(rows, c)
    return out
