"""Guarded SQL and questions in words.

The guard parses with Catalyst: one query, no command, and no relation but the frames bound to it."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import board


class NotReadOnly(ValueError):
    """The text is not a single read-only query over the bound frames."""


#: Built-in functions that call any Java method, read files or stop a job.
FORBIDDEN = frozenset("reflect java_method try_reflect raise_error input_file_name input_file_block_start input_file_block_length read_files session_user current_user user".split())


def called_functions(tree) -> set[str]:
    """Names of all functions that a parsed plan or expression of Catalyst calls, subqueries included."""
    names: set[str] = set()
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = node.nameParts() if kind == "UnresolvedFunction" else node.name()
            names.add(".".join(str(parts.apply(i)) for i in range(parts.size())).lower())
        below = [node.children()]
        if hasattr(node, "expressions") and "logical" in node.getClass().getName():
            below += [node.expressions(), node.innerChildren()]
        if "SubqueryExpression" in kind or kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            waiting.append(node.plan())
        for seq in below:
            waiting += [seq.apply(i) for i in range(seq.size())]
    return names


def allowed_functions(spark: SparkSession, names: set[str]) -> None:
    """Refuse functions that are not built in, or that reach beyond the query's rows."""
    wrong = sorted(n for n in names if n.rpartition(".")[2] in FORBIDDEN or "." in n or not spark._jsparkSession.sessionState().functionRegistry().functionExists(_function_id(spark, n)))
    if wrong:
        raise NotReadOnly(f"functions that are not allowed: {wrong}")


def _function_id(spark: SparkSession, name: str):
    return spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)


def guard(spark: SparkSession, sql: str, frames: tuple[str, ...] = ("t",)) -> str:
    """The query's text, if it is one SELECT or WITH over ``frames`` alone."""
    bare = re.sub(r"/\*.*?\*/", " ", re.sub(r"--[^\n]*", " ", sql), flags=re.S).strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", bare) or ";" in re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"", "", bare):
        raise NotReadOnly("one SELECT or WITH query is allowed")
    parsed = re.sub(r"\{(\w+)\}", r"\1", bare)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(parsed)
    except Exception as e:
        raise NotReadOnly(f"not a query: {str(e)[:200]}") from e
    allowed_functions(spark, called_functions(plan))
    tree = plan.treeString()
    if re.search(r"(?m)^\W*'?(Insert|Delete|Update|Merge|Create|Drop|Alter|Set|Load|Cache|Truncate|Replace|Command)\w*", tree):
        raise NotReadOnly("only reading is allowed")
    named = {m.lower() for m in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", tree)}
    local = {m.lower() for m in re.findall(r"(?i)(?:\bwith\b(?:\s+recursive)?|,)\s*(\w+)(?:\s*\([^)]*\))?\s+as\s*\(", parsed)}
    if named - {f.lower() for f in frames} - local or "UnresolvedTableValuedFunction" in tree:
        raise NotReadOnly(f"unknown relations: {sorted(named - set(frames) - local)}")
    return bare


def run_sql(spark: SparkSession, sql: str, params: dict | None = None, limit: int | None = 500, **frames: DataFrame) -> DataFrame:
    """Run guarded SQL; frames are named as ``{t}``, values as ``:name``. ``limit`` caps what is shown."""
    out = spark.sql(guard(spark, sql, tuple(frames)), args=params, **frames)
    return out if limit is None else out.limit(limit)


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


#: Words of intents, in Spanish, English and Portuguese.
INTENTS = (
    ("avg", r"promedio|media\b|average|mean\b|medio"), ("max", r"maxim|mayor valor|highest|largest|\bmax\b|maior"), ("min", r"minim|menor valor|lowest|smallest|\bmin\b|menor\b"),
    ("distinct", r"distint|unique|unicos|unicas|different"), ("share", r"porcentaje|participacion|share|percent|participacao|porcentagem"),
    ("count", r"cuant|quantos|quantas|cantidad de|how many|count|numero de"), ("sum", r"suma|total|sum\b|acumulad|soma"),
)


def answer(df: DataFrame, question: str, spec: board.Spec | None = None, limit: int = 200) -> DataFrame | None:
    """Questions of the forms "<aggregate> <metric> [by <dimension>] [in <year>]" and "top <n> by <metric>"; None if it is no such question."""
    spec, q = spec or board.detect_spec(df), fold(question)
    named = lambda names: next((c for c in sorted(names, key=len, reverse=True) if fold(c) in q or fold(board.label(c)) in q), None)
    metric = named([c for c in df.columns if c in spec.metrics]) or next(iter(spec.metrics), None)
    dimension = named(spec.dimensions) if re.search(r"\b(por|by|per|segun|cada|each)\b", q) else None
    year = re.search(r"\b(20\d\d|19\d\d)\b", q)
    if year and spec.time:
        df = df.where(F.year(spec.time) == int(year[1]))
    top = re.search(r"\btop\s+(\d+)", q)
    if top and metric and not dimension:
        return df.orderBy(F.col(metric).desc_nulls_last(), *[F.col(c) for c in df.columns if c != metric]).limit(int(top[1]))
    intent = next((name for name, words in INTENTS if re.search(words, q)), None)
    trend = re.search(r"evolucion|evolution|tendencia|trend|por mes|by month|monthly|mensual", q)
    if trend and spec.time and metric:
        return board.series(df, spec.time, metric, grain="month")
    if intent is None or intent != "count" and metric is None:
        return None
    if intent == "share" and dimension is not None:
        grouped = df.groupBy(dimension).agg(F.sum(metric).alias("__part"))
        whole = grouped.agg(F.sum("__part")).first()[0] or 1
        return grouped.select(dimension, F.round(100 * F.col("__part") / F.lit(whole), 3).alias("valor")).orderBy(F.col("valor").desc(), dimension).limit(limit)
    if intent == "share":
        return None
    value = F.count(F.lit(1)) if intent == "count" else F.count_distinct(metric) if intent == "distinct" else board.AGGREGATES[intent](metric)
    if dimension is None:
        return df.agg(value.alias("valor"))
    grouped = df.groupBy(dimension).agg(value.alias("valor")).orderBy(F.col("valor").desc(), dimension)
    return grouped.limit(int(top[1]) if top else limit)


#: Words that mean the same in the supported languages.
SYNONYMS = (
    ("pago", "paid", "payment", "paga", "pagamento"), ("baja", "churn", "abandono", "cancelamento"), ("fraude", "fraud"), ("venta", "sale", "sales", "venda"),
    ("precio", "price", "preco"), ("monto", "amount", "importe", "valor"), ("riesgo", "risk", "risco"), ("calidad", "quality", "qualidade"), ("estado", "status"),
    ("cliente", "customer", "client"), ("deuda", "debt", "divida"), ("mora", "default", "atraso", "overdue"), ("ingreso", "income", "renda"), ("fecha", "date", "data"),
)
#: Words of goals that name no column, in three languages.
STOP = frozenset("quiero predecir saber que cual como para los las una del con por want predict know what which how the for and with will if quero prever qual como para dos das uma com".split())


def suggest_target(df: DataFrame, goal: str, null_pct: dict[str, float] | None = None) -> tuple[str, float] | None:
    """The column a goal in words most likely means, and the confidence."""
    words = [w for w in re.findall(r"\w+", fold(goal)) if len(w) > 2 and w not in STOP]
    groups = [set(g) for g in SYNONYMS if not set(g).isdisjoint(words)]
    best: tuple[float, str] | None = None
    for name in df.columns:
        parts = re.findall(r"\w+", fold(board.label(name)))
        score = 0.0
        for w in words:
            score += max((1.0 if p == w else 0.7 if min(len(p), len(w)) >= 4 and p[: min(len(p), len(w), 5)] == w[: min(len(p), len(w), 5)] else 0.4 if any({w} & g and any(x == p or len(x) > 4 and x in p for x in g) for g in groups) else 0.0 for p in parts), default=0.0)
        score -= 1.0 if re.search(r"(^|_)id$|key$", name.lower()) else 0.0
        score -= 0.5 if (null_pct or {}).get(name, 0) > 60 else 0.0
        if score > 0.35 and (best is None or score > best[0]):
            best = (score, name)
    return None if best is None else (best[1], min(0.45 + 0.18 * best[0], 0.92))


def narrate(value: float) -> str:
    """A number with thousands dots and a decimal comma."""
    return f"{value:,.2f}".translate(str.maketrans(",.", ".,"))


def narrate_rows(rows: list, metric: str, dimension: str | None = None) -> str:
    """A short sentence about an answer's rows: one value, or the leading groups."""
    if not rows:
        return "No rows match."
    if dimension is None:
        return f"{board.label(metric)}: {narrate(float(rows[0]['valor'] or 0))}."
    lead = ", ".join(f"{r[dimension]} ({narrate(float(r['valor'] or 0))})" for r in rows[:3])
    return f"{board.label(metric)} by {board.label(dimension).lower()}: {lead}{'; and others' if len(rows) > 3 else ''}."
