"""Ordering without a single-task window: running totals, ranks, deciles, as-of joins.

A global window puts all rows in one task. Here rows are dealt by range, totalled by partition, and each
partition continues from the totals before it (one number a partition goes to the driver)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled


def running_total(df: DataFrame, order: list[Column], amounts: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """``df`` with, for each amount, its sum over all rows before this one and this one (ties: by ``order``)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = df.withColumns({f"__a_{k}": v for k, v in amounts.items()})
    dealt = named.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    dealt = settled(dealt)  # both passes must see one dealing
    totals = dealt.groupBy("__part").agg(*[F.sum(f"__a_{k}").alias(k) for k in amounts]).collect()
    before: dict[int, dict] = {}
    seen = dict.fromkeys(amounts, 0)
    for row in sorted(totals, key=lambda r: r["__part"]):
        before[row["__part"]] = dict(seen)
        seen = {k: seen[k] + (row[k] or 0) for k in amounts}
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt
    for k in amounts:
        start = F.element_at(F.create_map(*[x for p, b in before.items() for x in (F.lit(p), F.lit(b[k]))]), F.col("__part")) if before else F.lit(0)
        out = out.withColumn(k, F.sum(f"__a_{k}").over(inside) + start)
    return out.drop("__part", *[f"__a_{k}" for k in amounts])


def row_numbers(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    return running_total(df, order, {name: F.lit(1).cast("long")})


def grouped_ranks(df: DataFrame, col: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per non-null value: ``__value``, ``__n`` rows, average ``__rank``, and the ``extra`` sums."""
    sums = [F.sum(v).alias(k) for k, v in (extra or {}).items()]
    counted = df.where(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`").alias("__value")).agg(F.count(F.lit(1)).alias("__n"), *sums)
    return running_total(counted, [F.col("__value")], {"__upto": F.col("__n")}).withColumn("__rank", F.col("__upto") - (F.col("__n") - 1) / 2).drop("__upto")


def ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``'s columns as doubles replaced by their average ranks (null for null), one row a row, whatever their number in two exchanges of
    (row, column, value) and one of the distinct values. The ranks of values with more than a thousandth of the cells (fewer than a
    thousand) go to every task, so that the cells of a frequent value need not meet in one."""
    numbered = settled(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).withColumn("__row", F.monotonically_increasing_id()))
    cells = numbered.select("__row", F.posexplode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("__column", "__value")).where("__value IS NOT NULL")
    counted = cells.groupBy("__column", "__value").agg(F.count(F.lit(1)).alias("__n"))
    upto = settled(running_total(counted, [F.col("__column"), F.col("__value")], {"__upto": F.col("__n")}))
    sizes = {r["__column"]: r["n"] for r in upto.groupBy("__column").agg(F.sum("__n").alias("n")).collect()}  # a row a column
    before = [sum(sizes.get(j, 0) for j in range(i)) for i in range(len(columns))]
    start = F.element_at(F.lit(before), F.col("__column") + 1)
    table = upto.select("__column", "__value", (F.col("__upto") - start - (F.col("__n") - 1) / 2).alias("__rank"))
    often = upto.where(F.col("__n") * 1000 > sum(sizes.values())).select("__column", "__value")
    frequent = F.broadcast(table.join(F.broadcast(often), ["__column", "__value"]).withColumnRenamed("__rank", "__known"))
    marked = cells.join(frequent, ["__column", "__value"], "left")
    ranked = marked.where("__known IS NULL").join(table, ["__column", "__value"]).select("__row", "__column", "__rank").union(marked.where("__known IS NOT NULL").select("__row", "__column", "__known"))
    wide = ranked.groupBy("__row").agg(*[F.max(F.when(F.col("__column") == i, F.col("__rank"))).alias(f"r{i}") for i in range(len(columns))])
    return wide.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(columns)])


def with_ntile(df: DataFrame, order: list[Column], tiles: int = 10, name: str = "decil") -> DataFrame:
    """As NTILE: the first ``rows % tiles`` tiles have one row more."""
    total = df.count()
    size, more = divmod(total, tiles)
    at = F.col("__row") - 1
    big = more * (size + 1)
    tile = F.when(at < big, F.floor(at / (size + 1))).otherwise(more + F.floor((at - big) / max(1, size))) + 1
    return row_numbers(df, order, "__row").withColumn(name, tile.cast("long")).drop("__row")


def top_n(df: DataFrame, by: str, n: int, ties: list[str]) -> DataFrame:
    """The ``n`` largest rows; ties go by ``ties``, so the result is one."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 7) -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by a hash of their key: the same rows on every run and for every layout."""
    return df.orderBy(_drawn(key, seed), *key).limit(n)


def sample_fraction(df: DataFrame, fraction: float, key: list[str], seed: int = 7) -> DataFrame:
    """Each row with the given probability, by a hash of its key; no exchange."""
    return df.where(_drawn(key, seed) < F.lit(f"{int(fraction * (1 << 32)):08x}")) if fraction < 1 else df


def _drawn(key: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def text_samples(df: DataFrame, columns: list[str], k: int = 8, width: int = 45, most: int = 260) -> DataFrame:
    """By text column its ``k`` most frequent values, cut to ``width`` and joined by a bar, ``most`` characters at most."""
    from .profile import value_counts

    counted = value_counts(df, columns)
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    best = counted.withColumn("place", place).where(F.col("place") <= k)  # the limit is applied before rows move
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.substring("value", 1, width).alias("v")))), lambda s: s["v"]), "|")
    return best.groupBy("column").agg(F.substring(joined, 1, most).alias("samples"))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, allow_equal: bool = True, task_rows: int = 2_000_000) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` (same ``key``, time not after ``at``). Null keys and times match nothing.

    Where no key has more than ``task_rows`` rows, a key is one window. Otherwise rows are dealt by (key, time) range, so
    the rows of a hot key lie in many tasks; each part starts with the last value of its first key from the parts before it (one value a
    part goes to the driver). The result is the same."""
    rows = left.withColumn("__side", F.lit(1 if allow_equal else 0)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    events = right.select(key, at, value).where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__side", F.lit(0 if allow_equal else 1))
    both = rows.unionByName(events, allowMissingColumns=True)
    mine = F.col("__side") == (1 if allow_equal else 0)
    largest = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= task_rows:
        inside = both.withColumn("__spread", F.when(F.col(key).isNull(), F.xxhash64(at)))  # rows without a key need not meet
        seen = Window.partitionBy(key, "__spread").orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
        return inside.withColumn(value, F.last(value, ignorenulls=True).over(seen)).where(mine).drop("__side", "__spread")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(both.repartitionByRange(n, F.col(key), F.col(at), F.col("__side")).withColumn("__part", F.spark_partition_id()))
    order = F.struct(F.col(key), F.col(at), F.col("__side"))
    known = F.when(F.col(value).isNotNull(), order)
    ends = dealt.groupBy("__part").agg(F.max_by(F.col(key), order).alias("last_key"), F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), known).alias("last")).collect()
    carried, before = None, {}
    for row in sorted(ends, key=lambda r: r["__part"]):
        before[row["__part"]] = carried
        carried = row["last"] if row["last"] is not None and row["last"]["k"] == row["last_key"] else carried if carried is not None and carried["k"] == row["last_key"] else None
    starts = [(p, c["k"], c["v"]) for p, c in before.items() if c is not None]
    schema = T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__key", both.schema[key].dataType), T.StructField("__start", both.schema[value].dataType)])
    start = F.broadcast(left.sparkSession.createDataFrame(starts, schema))  # a row a part at most
    seen = Window.partitionBy("__part", key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn(value, F.last(value, ignorenulls=True).over(seen)).where(mine)
    joined = out.join(start, (out["__part"] == start["__part"]) & (out[key] == start["__key"]), "left")
    return joined.withColumn(value, F.coalesce(out[value], "__start")).select(*[c for c in out.columns if c not in ("__side", "__part")])
