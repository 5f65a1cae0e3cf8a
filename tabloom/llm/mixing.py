"""Mixing sources to target weights by iterative proportional fitting.

Token counts are gathered by (source, language, topic). The cell weights are raked: scaled to the
target of one marginal after the other until all hold within ``tolerance``. No cell can give more
tokens than it has, so the raking itself holds a cell at probability one and raises the others instead.
Each document is then kept with its cell's calibrated probability, decided by a hash of its id, so the
choice is the same on every run and executor.

A value whose tokens are fewer than its target asks for is taken whole and the rest of the target goes
to the other values; that, and marginals that do not hold within ``tolerance`` after ``rounds``, are
warned of, and only then ``weight`` differs from one: it carries the sample back to the targets.

Targets are shares by value for each dimension; without targets a dimension's own token shares are
tempered (share ** ``temper``), which lifts small sources and languages.

The raking is windows over the cell table, a few rounds to a job; texts are searched once,
and the documents are staged with their cell when they themselves are asked for. The cells are broadcast to the documents only below ``broadcast_cells`` rows.

Defined cases: a null source, language or topic is a value of its own ('(none)'); null and empty texts
have no tokens and go with the probability of their cell (zero when the cell has no tokens); repeated
rows are drawn alike, as are all rows without an id; a target for a value without tokens is left out and the others rescaled; extra
columns are ignored by ``sample``; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

NONE = "(none)"
BROADCAST_CELLS = 100_000


def token_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")


def topic_of(text: str) -> Column:
    """A coarse topic by markers in the text; pass ``topic_col`` where the table has a better one."""
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    legal = low.contains("license") | low.contains("licence") | low.contains("copyright") | low.contains("all rights reserved")
    separators = F.regexp_count(body, F.lit(r"[|#$%&*]"))
    return (
        F.when(legal, "legal")
        .when(body.rlike(r"[\w.+-]@[\w-]+\.\w|\(\d{3}\) \d{3}|\d{3}[-.]\d{3}"), "contact")
        .when(25 * separators > F.length(body), "listing")
        .when(F.length(body) < 600, "note")
        .otherwise("prose")
    )


def _cell_columns(source_col: str, lang_col: str, topic: Column) -> list[Column]:
    named = lambda c, n: F.coalesce(c.cast("string"), F.lit(NONE)).alias(n)
    return [named(F.col(source_col), "source"), named(F.col(lang_col), "lang"), named(topic, "topic")]


DIMENSIONS = ("source", "lang", "topic")


def _targets(cells: DataFrame, dimension: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """``dimension`` and its target ``share`` (sums to one over the values that have tokens)."""
    own = cells.where("tokens > 0").groupBy(dimension).agg(F.sum("tokens").alias("t"))
    if given is None:
        raw = own.select(dimension, F.pow(F.col("t").cast("double"), F.lit(temper)).alias("s"))
    else:
        wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{dimension} string, s double")
        raw = own.join(wanted, dimension).select(dimension, "s")
    return raw.select(dimension, (F.col("s") / F.sum("s").over(Window.partitionBy(F.lit(0)))).alias("share"))


def _with_targets(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Cells that have tokens with a column ``want_<dimension>`` of target shares, in one partition: the table has a row for each
    combination of values, not for documents, and one partition lets every window over it do without an exchange."""
    for dimension, target in targets.items():
        cells = cells.join(target.select(dimension, F.col("share").alias(f"want_{dimension}")), dimension, "left")
    return cells.where("tokens > 0").fillna(0.0, [f"want_{d}" for d in targets]).coalesce(1)


def _reachable(cells: DataFrame, dimension: str, budget: float) -> DataFrame:
    """``cells`` with no value's target above what its tokens give of ``budget``, the excess shared out among the others in
    proportion (``asked_<dimension>`` keeps the target). The values that come out full are those of the least tokens for their target."""
    want, of_value = F.col(f"want_{dimension}"), Window.partitionBy(dimension)
    rows = cells.withColumn("__most", F.sum("tokens").over(of_value) / F.lit(budget)).withColumn("__first", F.row_number().over(of_value.orderBy(*cells.columns)) == 1)
    rows = rows.withColumn("__ratio", F.when(want > 0, F.col("__most") / want).otherwise(F.lit(float("inf"))))
    fills = Window.orderBy("__ratio", dimension).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    one = lambda c: F.when(F.col("__first"), c).otherwise(0.0)
    rows = rows.withColumn("__full", F.sum(one(F.col("__most"))).over(fills)).withColumn("__open", F.lit(1.0) - F.sum(one(want)).over(fills))
    before_full, before_open = F.col("__full") - F.col("__most"), F.col("__open") + want
    # a value is full if the scale of all that fill after the fuller ones before it would exceed its own
    is_full = (want > 0) & (F.lit(1.0) - before_full >= F.col("__ratio") * before_open)
    rows = rows.withColumn("__is_full", is_full)
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("__sum_full", F.sum(one(F.when(F.col("__is_full"), F.col("__most")).otherwise(0.0))).over(everything))
    rows = rows.withColumn("__sum_open", F.sum(one(F.when(F.col("__is_full"), 0.0).otherwise(want))).over(everything))
    scale = F.when(F.col("__sum_open") > 0, (F.lit(1.0) - F.col("__sum_full")) / F.col("__sum_open")).otherwise(1.0)
    held = F.when(F.col("__is_full"), F.col("__most")).otherwise(want * F.greatest(F.lit(1.0), scale))
    return rows.withColumn(f"asked_{dimension}", want).withColumn(f"want_{dimension}", held).drop(*[c for c in rows.columns if c.startswith("__")])


#: Rounds of the raking that one job makes.
UNROLLED = 4


def rake(cells: DataFrame, dimensions: tuple[str, ...], rounds: int = 30, tolerance: float = 1e-4, budget: float | None = None) -> tuple[DataFrame, int, float]:
    """Cells (with ``want_<dimension>``, from ``_with_targets``) with raked ``share``, the rounds taken and the largest marginal error left.

    With a ``budget`` of tokens no cell's share exceeds its tokens: for every value the factor is the one
    that its cells below that bound need. The bound does not change ``__free``, the share before it, so a
    cell can come down from its bound again. A round is one window for each dimension over the one partition."""
    spark = cells.sparkSession
    most = F.lit(float("inf")) if budget is None else F.col("tokens") / F.lit(float(budget))
    free, full = F.col("__free") < most, F.col("__free") >= most
    start = cells.withColumn("__free", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0)))).withColumn("__off", F.lit(1.0))
    raked, path = common.staged_at(start, "cells")
    error, done = 0.0, 0
    while done < rounds:
        step = raked.coalesce(1)
        for _ in range(min(UNROLLED, rounds - done)):
            for dimension in dimensions:
                of_value, want = Window.partitionBy(dimension), F.col(f"want_{dimension}")
                step = step.withColumns({
                    "__have": F.sum("__free").over(of_value), "__open": F.sum(F.when(free, F.col("__free")).otherwise(0.0)).over(of_value),
                    "__held": F.sum(F.when(full, most).otherwise(0.0)).over(of_value),
                })
                left = want - F.col("__held")
                factor = (
                    F.when((left > 0) & (F.col("__open") > 0), left / F.col("__open"))
                    .when((left < -1e-12) | (F.col("__open") > 0), want / F.greatest("__have", F.lit(1e-300)))  # bounded cells alone exceed the target
                    .otherwise(1.0)  # every cell is taken whole
                )
                step = step.withColumn("__free", F.col("__free") * factor).drop("__have", "__open", "__held")
            done += 1
        offs = [F.abs(F.sum(F.least("__free", most)).over(Window.partitionBy(d)) - F.col(f"want_{d}")) for d in dimensions]
        step, new_path = common.staged_at(step.withColumn("__off", F.greatest(*offs) if len(offs) > 1 else offs[0]), "cells")
        common.remove(spark, path)
        raked, path = step, new_path
        error = raked.agg(F.max("__off")).first()[0] or 0.0
        if error <= tolerance:
            break
    return raked.withColumn("share", F.least("__free", most)).drop("__free", "__off"), done, error


def calibrated(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float, fraction: float, rounds: int, tolerance: float) -> DataFrame:
    """Cells with ``probability`` (so that a ``fraction`` of all tokens is expected) and ``weight``."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    names = [*DIMENSIONS, "tokens", "share", "probability", "weight"]
    if not total or fraction <= 0:
        none = F.lit(0.0)
        return cells.select(*DIMENSIONS, "tokens", none.alias("share"), none.alias("probability"), none.alias("weight"))
    wanted = _with_targets(cells, {d: _targets(cells, d, (targets or {}).get(d), temper) for d in DIMENSIONS})
    for dimension in DIMENSIONS:
        wanted = _reachable(wanted, dimension, fraction * total)
    raked, done, error = rake(wanted, DIMENSIONS, rounds, tolerance, fraction * total)
    budget = F.lit(fraction * total)
    # rounded: the last digits depend on the order of addition, and the same rows must be drawn on every run
    probability = F.round(F.least(F.lit(1.0), budget * F.col("share") / F.greatest(F.col("tokens"), F.lit(1))), 12)
    with_p = common.staged(raked.withColumn("probability", probability).withColumn("weight", F.when(F.col("probability") > 0, 1.0).otherwise(0.0)), "calibrated")
    cut = [F.col(f"asked_{d}") > F.col(f"want_{d}") * (1 + 1e-9) for d in DIMENSIONS]
    short: list[str] = []
    for dimension, is_cut in zip(DIMENSIONS, cut, strict=True):  # the ten values cut most
        rows = with_p.where(is_cut).groupBy(dimension).agg(F.first(f"asked_{dimension}").alias("asked"), F.first(f"want_{dimension}").alias("left"))
        short += [f"{dimension} {v!r}: {left:.4%} of {asked:.4%}" for v, asked, left in rows.orderBy(F.col("left") - F.col("asked"), dimension).limit(10).collect()]
    if short:
        warnings.warn(f"mixing: too few tokens for the target; taken whole: {'; '.join(short)}", stacklevel=2)
    if error > tolerance:
        warnings.warn(f"mixing: marginals are off by up to {error:.2e} after {done} rounds (tolerance {tolerance:.0e})", stacklevel=2)
    if not short and error <= tolerance:
        return with_p.select(*names)
    # what the sample lacks of the targets asked for, as weights
    drawn = with_p.withColumn("__expected", F.col("probability") * F.col("tokens")).where("__expected > 0")
    drawn = drawn.select(*DIMENSIONS, F.col("__expected").alias("tokens"), *[F.col(f"asked_{d}").alias(f"want_{d}") for d in DIMENSIONS]).coalesce(1)
    back, _, _ = rake(drawn, DIMENSIONS, rounds, tolerance)
    weights = back.select(*DIMENSIONS, F.round(budget * F.col("share") / F.col("tokens"), 9).alias("__weight"))
    weighed = with_p.join(F.broadcast(weights), list(DIMENSIONS), "left").withColumn("weight", F.coalesce("__weight", F.lit(0.0)))
    return common.staged(weighed.select(*names), "calibrated")


def sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None,
    targets: dict[str, dict[str, float]] | None = None, temper: float = 0.7, fraction: float = 0.5, seed: int = 17, rounds: int = 30, tolerance: float = 1e-4,
    keep_columns: bool = False, broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """The sampled documents: id, source, lang, topic, n_tokens, probability, weight; or their own columns."""
    topic = F.col(topic_col) if topic_col else topic_of(text_col)
    cell = F.struct(*_cell_columns(source_col, lang_col, topic))
    carried = [F.col(f"`{c}`") for c in docs.columns] if keep_columns else [F.col(id_col).alias("__id")]
    slim = common.staged(docs.select(*carried, cell.alias("__cell"), token_count(text_col).alias("__tokens")), "counted")  # texts are searched once
    counted = slim.select("__cell.*", "__tokens").groupBy(*DIMENSIONS)
    cells = common.staged(counted.agg(F.sum("__tokens").alias("tokens")), "cells")
    fitted = calibrated(cells, targets, temper, fraction, rounds, tolerance).select(
        F.struct(*DIMENSIONS).alias("__cell"), F.col("probability").alias("__p"), F.col("weight").alias("__w")
    )
    if fitted.count() <= broadcast_cells:
        fitted = F.broadcast(fitted)
    if keep_columns:
        drawn = slim.join(fitted, "__cell").where(_draw(id_col, seed) < F.col("__p"))
        return drawn.select(*[F.col(f"`{c}`") for c in docs.columns])
    drawn = slim.join(fitted, "__cell").where(_draw("__id", seed) < F.col("__p"))
    return drawn.select(
        F.col("__id").alias(id_col), F.col("__cell.source").alias("source"), F.col("__cell.lang").alias("lang"), F.col("__cell.topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"), F.col("__p").alias("probability"), F.col("__w").alias("weight"),
    )


def _draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
