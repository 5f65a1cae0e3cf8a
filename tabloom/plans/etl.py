"""Cleaning plans: a list of steps, proposed from a profile, reviewed by the user, compiled into one query.

Compiling folds the enabled steps over a map of column expressions and emits a single
``select [distinct] ... where``; later steps wrap earlier expressions, as their order says."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import association as A
from ..operators import profile as P
from ..session import settled


@dataclass
class Step:
    op: str
    column: str | None = None
    params: dict = field(default_factory=dict)
    reason: str = ""
    severity: str = "info"
    enabled: bool = True


@dataclass(frozen=True)
class Options:
    """Thresholds of the proposal."""

    null_pct: float = 80.0
    rare_pct: float = 0.5
    max_categories: int = 30
    numeric_share: float = 0.95
    datetime_share: float = 0.90
    trim_share: float = 0.01
    clip_outliers: bool = False
    impute: bool = True
    expand_dates: bool = True


#: Name parts of identifiers and of dates.
ID_NAMES = r"(?i)(^|_|\b)(id|key|codigo|code|cod|uuid|dni|cuit|nro|num)(_|\b|$)|(key|Id|ID)$"
DATE_NAMES = r"(?i)fecha|date|period|month|mes|dia|day|_at$|time"


def compile_plan(df: DataFrame, steps: list[Step]) -> DataFrame:
    exprs: dict[str, Column] = {c: F.col(f"`{c}`") for c in df.columns}
    extras: dict[str, Column] = {}
    dropped: set[str] = set()
    wheres: list[Column] = []
    distinct = False
    for step in steps:
        if not step.enabled or step.column is not None and step.column not in exprs:
            continue
        c, p = step.column, step.params
        match step.op:
            case "drop_column":
                dropped.add(c)
            case "cast_numeric":
                exprs[c] = V.cast_numeric(exprs[c], p.get("decimal") == ",")
            case "parse_datetime":
                exprs[c] = V.parse_datetime(exprs[c], p.get("strict", False))
            case "trim_text":
                exprs[c] = V.trim_text(exprs[c], p.get("lower", False))
            case "expand_datetime":
                extras |= V.date_parts(exprs[c], c, p.get("hour", False), p.get("quarter", False))
                dropped.add(c)
            case "missing_indicator":
                extras[f"{c}__faltante"] = exprs[c].isNull().cast("int")
            case "impute_numeric":
                exprs[c] = F.coalesce(exprs[c], F.lit(p["value"]))
            case "impute_categorical":
                exprs[c] = F.coalesce(V.trim_text(exprs[c].cast("string")), F.lit(p.get("value", V.MISSING)))
            case "clip_outliers":
                exprs[c] = V.clip(exprs[c], p["low"], p["high"])
            case "log_transform":
                exprs[c] = V.log_companion(exprs[c])
            case "group_rare":
                exprs[c] = V.group_rare(exprs[c], p["keep"])
            case "filter_null_target":
                wheres.append(exprs[c].isNotNull())
            case "filter_rows":
                wheres.append(_condition(p["condition"]))
            case "drop_duplicates":
                distinct = True
            case "text_column":
                pass
            case _:
                raise ValueError(f"unknown step {step.op}")
    source = df
    for where in wheres:
        source = source.where(where)
    out = source.select(*[e.alias(c) for c, e in exprs.items() if c not in dropped], *[e.alias(c) for c, e in extras.items()])
    return out.distinct() if distinct else out


def _condition(text: str) -> Column:
    """A user's condition: one expression without statements or subqueries."""
    lowered = text.lower()
    if ";" in text or "--" in text or "/*" in text or any(f"{w} " in lowered.replace("(", " ") for w in ("select", "insert", "drop", "delete")):
        raise ValueError("a condition may not hold statements, comments or subqueries")
    from .ask import allowed_functions, called_functions

    spark = SparkSession.active()
    allowed_functions(spark, called_functions(spark._jsparkSession.sessionState().sqlParser().parseExpression(text)))
    return F.expr(text)


def decimal_votes(df: DataFrame, column: str) -> DataFrame:
    """Votes for a decimal comma and a decimal dot among the values of a text column, in one aggregate."""
    c = F.regexp_replace(F.trim(F.col(column).cast("string")), r"[$€£¥%\s]", "")
    dots, commas = c.contains("."), c.contains(",")
    comma_last = F.length(c) - F.instr(F.reverse(c), ",") > F.length(c) - F.instr(F.reverse(c), ".")
    single = lambda mark: c.rlike(rf"^-?\d+\{mark}\d+$") & ~c.rlike(rf"^-?[1-9]\d{{0,2}}\{mark}\d{{3}}$")
    vote = lambda both, one: F.sum(F.when(dots & commas & both, 2).when(one, 1).otherwise(0)).cast("long")
    return df.where(c.isNotNull()).agg(
        vote(comma_last, commas & ~dots & (single(","))).alias("comma"),
        vote(~comma_last, dots & ~commas & single(".")).alias("dot"),
        F.count_if(c.rlike(r"^-?[1-9]\d{0,2}(\.\d{3})+$")).alias("dot_thousands"), F.count_if(c.rlike(r"^-?[1-9]\d{0,2}(,\d{3})+$")).alias("comma_thousands"),
        F.avg(V.cast_numeric(c, True).isNotNull().cast("double")).alias("comma_parses"), F.avg(V.cast_numeric(c, False).isNotNull().cast("double")).alias("dot_parses"),
    )


def decimal_is_comma(df: DataFrame, column: str) -> bool:
    r = decimal_votes(df, column).first()
    comma, dot = (r["comma"] or 0) + (r["dot_thousands"] or 0 if not r["dot"] else 0), (r["dot"] or 0) + (r["comma_thousands"] or 0 if not r["comma"] else 0)
    return comma > dot if comma != dot else (r["comma_parses"] or 0) > (r["dot_parses"] or 0)


def detect(df: DataFrame, options: Options | None = None) -> list[Step]:
    """Casts and text hygiene of all text columns, measured over all rows in one aggregate."""
    o = options or Options()
    texts = [f.name for f in df.schema if V.kind_of(f.dataType) == "categorical"]
    if not texts:
        return []
    aggs = []
    for c in texts:
        v = F.col(f"`{c}`").cast("string")
        share = lambda e, v=v: F.avg(F.when(v.isNotNull(), e.cast("double")))
        parts = {
            "num": F.greatest(share(V.cast_numeric(v).isNotNull()), share(V.cast_numeric(v, True).isNotNull())),
            "date": share(V.parse_datetime(v).isNotNull()), "trim": share(v != F.trim(v)),
        }
        aggs += [e.alias(f"{c}__{k}") for k, e in parts.items()]
    r = df.agg(*aggs).first()
    # distinct values with and without case, all columns in one exchange
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.trim(F.col(f"`{c}`").cast("string")).alias("v")) for c in texts]))
    values = df.select(each.alias("p")).select("p.*").where("v IS NOT NULL").distinct()
    mixed = values.groupBy("c", F.lower("v").alias("f")).agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.max(F.col("n") > 1).alias("mixed"))
    mixed_case = {row["c"] for row in mixed.collect() if row["mixed"]}
    steps = []
    for c in texts:
        is_id = bool(re.search(ID_NAMES, c))
        if (r[f"{c}__date"] or 0) >= o.datetime_share and not is_id:
            steps.append(Step("parse_datetime", c, {}, "text that reads as dates"))
        elif (r[f"{c}__num"] or 0) >= o.numeric_share:
            steps.append(Step("cast_numeric", c, {"decimal": "," if decimal_is_comma(df, c) else "."}, "text that reads as numbers"))
        elif (r[f"{c}__trim"] or 0) > o.trim_share or c in mixed_case:
            steps.append(Step("trim_text", c, {"lower": c in mixed_case}, "stray spaces or mixed case"))
    return steps


def is_magnitude(df: DataFrame, column: str) -> bool:
    """A column of unique values that is a measure, not a key: it has decimals or is sparse in its range."""
    if re.search(ID_NAMES, column):
        return False
    c = F.col(f"`{column}`").cast("double")
    r = df.agg(F.max(c != F.floor(c)).alias("decimals"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).first()
    return bool(r["decimals"]) or r["lo"] is not None and r["n"] / (r["hi"] - r["lo"] + 1) < 0.001


def propose(df: DataFrame, target: str | None = None, options: Options | None = None) -> list[Step]:
    """The proposed steps, in the order in which they must run."""
    o = options or Options()
    df = settled(df)  # a dozen passes follow, here and below
    casts = detect(df, o)
    typed = settled(compile_plan(df, casts))
    kinds = {f.name: V.kind_of(f.dataType) for f in typed.schema}
    rows = typed.count()
    nulls = {r["column"]: 100 * r["nulls"] / max(1, rows) for r in P.null_counts(typed).collect()}
    distinct = {r["column"]: r["n_distinct"] for r in P.distinct_counts(typed, typed.columns).collect()}
    texts = [c for c, k in kinds.items() if k == "categorical"]
    lengths = {r["column"]: r["avg_length"] or 0 for r in P.text_lengths(typed, texts).collect()} if texts else {}
    free = {c for c in texts if lengths[c] >= 25 and 100 * distinct.get(c, 0) >= 50 * rows}
    drops: list[Step] = []
    gone: set[str] = set()

    def drop(c: str, reason: str) -> None:
        if c != target and c not in gone:
            gone.add(c)
            drops.append(Step("drop_column", c, {}, reason, "warning"))

    for c, kind in kinds.items():
        if distinct.get(c, 0) <= 1:
            drop(c, "constant")
        elif nulls[c] >= o.null_pct:
            drop(c, "almost empty")
        elif rows > 1 and distinct[c] == rows and kind != "datetime" and c not in free and not (kind == "numeric" and is_magnitude(typed, c)):
            drop(c, "identifier")
    for r in A.duplicate_columns(typed).collect():
        drop(r["b"], f"equal to {r['a']}")
    steps = drops + [s for s in casts if s.column not in gone]
    stay = [c for c in typed.columns if c not in gone]
    if o.expand_dates:
        steps += [Step("expand_datetime", c, {"quarter": True}, "parts of the date") for c in stay if kinds[c] == "datetime" and c != target]
    bounds = [c for c in stay if kinds[c] == "numeric" and c != target]
    figures = {r["column"]: r for r in P.numeric_profile(typed, bounds).collect()} if bounds else {}
    if o.impute:
        holes = [c for c in stay if nulls[c] > 0 and c != target]
        numeric = [c for c in holes if kinds[c] == "numeric"]
        medians = {c: figures[c]["median"] for c in numeric if c in figures}
        for c in holes:
            if c in medians:
                steps += [Step("missing_indicator", c, {}, "which were missing")] if nulls[c] >= 5 else []
                steps.append(Step("impute_numeric", c, {"value": medians[c]}, "median"))
            elif kinds[c] == "categorical" and c not in free:
                steps.append(Step("impute_categorical", c, {}, "missing as a level"))
    steps += [Step("text_column", c, {}, "free text") for c in stay if c in free]
    for c in stay:
        if kinds[c] == "categorical" and c not in free and c != target and distinct[c] > o.max_categories:
            steps.append(Step("group_rare", c, {"keep": [r["value"] for r in A.frequent_levels(typed, c, o.rare_pct, o.max_categories).collect()]}, "rare levels"))
    for r in figures.values():
        if r["p99"] is not None and r["p99"] > r["p01"]:
            steps.append(Step("clip_outliers", r["column"], {"low": r["p01"], "high": r["p99"]}, "extremes", enabled=o.clip_outliers))
    steps.append(Step("drop_duplicates", None, {}, "equal rows"))
    if target:
        steps.append(Step("filter_null_target", target, {}, "rows without a target"))
        steps += [Step("drop_column", f["column"], {}, f"leaks the target ({f['measure']} {f['strength']:.3f})", "critical") for f in audit_leakage(typed.drop(*gone), target) if f["level"] == "block"]
    return steps


def audit_leakage(df: DataFrame, target: str) -> list[dict]:
    """Columns suspiciously close to the target: ``block`` from 0.98 (0.85 if the name echoes it), ``warn`` from 0.90."""
    found = []
    for c in df.columns:
        if c == target or V.kind_of(df.schema[c].dataType) == "datetime":
            continue
        measure, strength = A.association(df, c, target)
        if strength is None:
            continue
        echo = target.lower() in c.lower() or c.lower() in target.lower()
        level = None
        if strength >= 0.98 and (measure != "eta2" or echo) or echo and strength >= 0.85:
            level = "block"
        elif strength >= 0.90:
            level = "warn"
        if level:
            found.append({"column": c, "measure": measure, "strength": float(strength), "level": level})
    return sorted(found, key=lambda f: (-f["strength"], f["column"]))
