"""Registered queries of sources, sinks, detection and the rest of the SQL surface, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .operators import association as A
from .operators import profile as P
from .operators import ranking as R
from .plans import ask, board, etl
from .plans.etl import Step
from .queries import query, rounded, table
from .session import new_folder
from .sources import read, write

_ORDERS = "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderpriority) AS priorities FROM orders"


def _totals(df: DataFrame) -> DataFrame:
    return rounded(df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum(F.col("o_totalprice").cast("double")).alias("total"), F.count_distinct("o_orderpriority").alias("priorities")), 2)


# --- sources and sinks: written, read back, compared with the table


@query(_ORDERS)
def source_csv_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    write.write_csv(table(spark, sf_dir, "orders"), folder)
    back = read.read_delimited(spark, folder)  # separator and decimal mark are found
    comma = "," if etl.decimal_is_comma(back, "o_totalprice") else "."
    return _totals(etl.compile_plan(back, [Step("cast_numeric", "o_totalprice", {"decimal": comma})]))


@query(_ORDERS)
def source_parquet_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "dataset")
    write.write_dataset(table(spark, sf_dir, "orders"), folder)
    return _totals(read.read_parquet(spark, folder))


@query(_ORDERS)
def source_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "json")
    table(spark, sf_dir, "orders").write.json(folder)
    return _totals(read.read_json(spark, folder))


@query("SELECT count(*) AS n, count(DISTINCT n_name) AS names, sum(n_regionkey)::DOUBLE AS regions, count(*) AS by_name, 5 AS second FROM nation")
def source_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'book')}.xlsx"
    write.write_workbook({"nations": table(spark, sf_dir, "nation"), "regions": table(spark, sf_dir, "region")}, path)
    back, second = read.read_workbook(spark, path, "nations"), read.read_workbook(spark, path, 2)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_name").alias("names"), F.sum(F.col("n_regionkey").cast("double")).alias("regions"), F.count("n_name").alias("by_name"), F.lit(second.count()).alias("second"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_nationkey < 10 GROUP BY 1")
def source_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = write.write_derby({"CUSTOMER": table(spark, sf_dir, "customer")}, new_folder(spark, "db"))
    sql = 'SELECT "c_mktsegment" AS "segment", "c_acctbal" AS "bal", "c_nationkey" AS "nation" FROM CUSTOMER WHERE "c_nationkey" < 10'
    got = read.read_jdbc(spark, url, sql, ("nation", 0, 10, 4), driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    return rounded(got.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("bal").alias("balance")), 2)


@query("SELECT o_orderkey, o_orderstatus, NULL::VARCHAR AS extra FROM orders UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return read.union_blocks([orders.select("o_orderkey", "o_orderstatus"), orders.select(F.col("o_orderpriority").alias("extra"), "o_orderkey")])


@query("SELECT l_orderkey AS k, l_quantity AS v FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice FROM orders")
def union_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"))
    return read.union_blocks([first, table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")], by_name=False)


@query("SELECT row_number() OVER () - 1 AS position, column_name AS name FROM (DESCRIBE orders)")
def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.describe(table(spark, sf_dir, "orders")).select("position", "name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.load_sample(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], 500, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE substr(md5('3:' || l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR), 1, 32) < '40000000'")
def sample_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_fraction(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 0.25, ["l_orderkey", "l_linenumber"], seed=3)


@query("""WITH v AS (SELECT 'o_orderpriority' AS c, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS place FROM v) SELECT c AS "column", substr(string_agg(substr(v, 1, 45), '|' ORDER BY place), 1, 260) AS samples FROM p WHERE place <= 8 GROUP BY 1""")
def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.text_samples(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


# --- detection


@query("SELECT 'orders' AS name, true AS close UNION ALL SELECT 'customers', true UNION ALL SELECT 'priorities', true")
def distinct_approx_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts lie within three standard errors (15 %) of the exact ones."""
    orders, columns = table(spark, sf_dir, "orders"), {"o_orderkey": "orders", "o_custkey": "customers", "o_orderpriority": "priorities"}
    exact, near = P.distinct_counts(orders, list(columns)), P.distinct_counts(orders, list(columns), approximate=True).withColumnRenamed("n_distinct", "approx")
    named = F.element_at(F.create_map(*[F.lit(x) for kv in columns.items() for x in kv]), F.col("column"))
    return exact.join(near, "column").select(named.alias("name"), (F.abs(F.col("approx") - F.col("n_distinct")) <= 0.15 * F.col("n_distinct")).alias("close"))


@query("""WITH t AS (SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) AS d, count(*) AS n, 0.0 AS whole, false AS num FROM orders UNION ALL
    SELECT 'o_totalprice', count(DISTINCT o_totalprice), count(*), min((o_totalprice = floor(o_totalprice))::INTEGER), true FROM orders UNION ALL
    SELECT 'o_orderdate', count(DISTINCT year(o_orderdate)), count(*), 1, true FROM orders UNION ALL SELECT 'flag', 2, count(*), 1, true FROM orders)
    SELECT c AS "column", CASE WHEN d <= 1 THEN 'regression' WHEN d = 2 THEN 'binary' WHEN NOT num THEN 'multiclass' WHEN whole = 1 AND d <= 20 AND n > 10 * d THEN 'multiclass' ELSE 'regression' END AS task FROM t""")
def infer_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("o_orderdate"), (F.col("o_totalprice") > 100000).cast("int").alias("flag"))
    return spark.createDataFrame([(c, A.infer_task(orders, c)) for c in orders.columns], "column string, task string")


@query("""SELECT m AS item, CASE WHEN m = 'time' THEN 'o_orderdate' WHEN m = 'dimension' THEN 'o_orderstatus' ELSE 'o_totalprice sum' END AS chosen FROM (VALUES ('time'), ('dimension'), ('metric')) v(m) WHERE (SELECT count(*) FROM orders) > 0""")
def board_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = board.detect_spec(table(spark, sf_dir, "orders"))
    metric, how = next(iter(spec.metrics.items()))
    return spark.createDataFrame([("time", spec.time), ("dimension", spec.dimensions[0]), ("metric", f"{metric} {how}")], "item string, chosen string")


@query("SELECT replace(replace(replace(format('{:,.2f}', sum(o_totalprice)), ',', '#'), '.', ','), '#', '.') AS said FROM orders")
def narrated_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = ask.answer(table(spark, sf_dir, "orders"), "suma de o_totalprice").first()
    return spark.createDataFrame([(ask.narrate(row["valor"]),)], "said string")


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS valor FROM orders GROUP BY 1")
def ask_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = board.Spec("o_orderdate", {"o_custkey": "sum"}, ["o_orderpriority"])
    return ask.answer(table(spark, sf_dir, "orders"), "how many different o_custkey by o_orderpriority", spec)


@query("SELECT o_orderstatus, round(100 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 3) AS valor FROM orders GROUP BY 1")
def ask_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ask.answer(table(spark, sf_dir, "orders"), "porcentagem de o_totalprice por o_orderstatus"), 3)


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def ask_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ask.answer(table(spark, sf_dir, "orders"), "evolucion de o_totalprice"), 2)


# --- guarded SQL


@query("SELECT count(*) AS n FROM (SELECT 1 FROM lineitem LIMIT 500)")
def sql_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.run_sql(spark, "SELECT * FROM {t}", t=table(spark, sf_dir, "lineitem")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 50000 AND o_orderpriority = '1-URGENT' GROUP BY 1")
def sql_bound_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT o_orderstatus, count(*) AS n FROM {t} WHERE o_totalprice > :least AND o_orderpriority = :priority GROUP BY 1"
    return ask.run_sql(spark, sql, {"least": 50000, "priority": "1-URGENT"}, None, t=table(spark, sf_dir, "orders"))


# --- the rest of the SQL surface


def _sql(text: str, name: str, *tables: str) -> None:
    bound = {t: f"{{{t}}}" for t in tables}
    spark_text = text
    for t in tables:
        spark_text = spark_text.replace(f"@{t}", bound[t])
    duck_text = text
    for t in tables:
        duck_text = duck_text.replace(f"@{t}", t)
    query(duck_text, name)(lambda spark, sf_dir: ask.run_sql(spark, spark_text, None, None, **{t: table(spark, sf_dir, t) for t in tables}))


_sql("SELECT o_orderkey, o_custkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM @orders", "win_nth_value", "orders")
_sql("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter FROM @customer", "win_ntile", "customer")
_sql("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM @customer", "win_range_frame", "customer")
_sql("SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS cd FROM @customer", "win_percent_rank", "customer")
_sql("SELECT c_nationkey FROM @customer INTERSECT ALL SELECT s_nationkey FROM @supplier", "set_intersect_all", "customer", "supplier")
_sql("SELECT c_nationkey FROM @customer EXCEPT ALL SELECT s_nationkey FROM @supplier", "set_except_all", "customer", "supplier")
_sql("SELECT n.n_name, x.best FROM @nation n, LATERAL (SELECT max(c.c_acctbal) AS best FROM @customer c WHERE c.c_nationkey = n.n_nationkey) x", "join_lateral", "nation", "customer")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY 1")
def nested_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("a"))
    return grouped.select("n_regionkey", F.array_join("a", ",").alias("names"), F.size("a").cast("long").alias("n"), F.get("a", F.lit(0)).alias("first_name"))


@query("SELECT n_regionkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def nested_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", F.struct("n_name")))).alias("m"))
    return packed.select("n_regionkey", F.explode(F.map_filter("m", lambda k, _: k % 2 == 0)).alias("k", "v")).select("n_regionkey", "v.n_name")


@query("SELECT l.n_nationkey AS k, l.n_name AS left_name, r.n_name AS right_name FROM (SELECT *, row_number() OVER (ORDER BY n_name) AS rn FROM nation) l JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation) r USING (rn)")
def join_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    left = R.row_numbers(nations, [F.col("n_name")], "rn").select("rn", F.col("n_nationkey").alias("k"), F.col("n_name").alias("left_name"))
    return left.join(R.row_numbers(nations, [F.col("n_nationkey")], "rn").select("rn", F.col("n_name").alias("right_name")), "rn").drop("rn")


@query("SELECT count(*) AS data_rows, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'")
def board_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "board")
    spec = board.Spec("o_orderdate", {"o_totalprice": "sum"}, ["o_orderpriority"], ["o_orderkey"])
    write.write_board(table(spark, sf_dir, "orders"), spec, folder, {"o_orderstatus": ["F"]})
    data = read.read_delimited(spark, f"{folder}/data", read.Form("utf-8", ";", ","))
    return data.agg(F.count(F.lit(1)).alias("data_rows"), F.round(F.sum(V.cast_numeric(F.col("o_totalprice"), True)), 2).alias("total"))


@query("SELECT count(*) AS columns_listed, 0 AS left_over FROM (DESCRIBE orders)")
def report_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "report")
    write.write_report(table(spark, sf_dir, "orders"), folder)
    listed = read.read_delimited(spark, f"{folder}/variables", read.Form("utf-8", ";", ",")).count()
    kept = new_folder(spark, "dataset")
    write.write_dataset(table(spark, sf_dir, "region"), kept)
    write.delete_dataset(spark, kept)
    path = spark._jvm.org.apache.hadoop.fs.Path(kept)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.createDataFrame([(listed, int(there))], "columns_listed long, left_over int")
