"""Registered queries of detection, guards, exports and reports, each over a table and with a DuckDB equivalent that depends on it."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .operators import evaluation as E
from .operators import learning as L
from .operators import splits
from .operators import states as S
from .operators.neighbours import Neighbours
from .plans import ask, board, etl
from .queries import _HOLES, _holes, _money, query, rounded, table
from .session import new_folder
from .sources import read, write

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@query("""SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 > 1) AS kept, count(DISTINCT CASE WHEN o_orderkey % 5 > 1 THEN o_orderpriority END) AS levels, round(sum(o_totalprice), 2) AS total FROM orders""")
def types_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens for missing become null in text columns; other types are as they were."""
    token = F.when(F.col("o_orderkey") % 5 == 0, " N/A ").when(F.col("o_orderkey") % 5 == 1, "-").otherwise(F.col("o_orderpriority"))
    rows = V.normalise_types(table(spark, sf_dir, "orders").select("o_totalprice", token.alias("priority")))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.count("priority").alias("kept"), F.count_distinct("priority").alias("levels"), F.sum("o_totalprice").alias("total")), 2)


@query("""SELECT 'CUSTOMER' AS name, least(7, count(*)) AS previewed, count(*) AS n, 'NULL' AS said FROM customer UNION ALL SELECT 'NATION', least(7, count(*)), count(*), 'NULL' FROM nation""")
def jdbc_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server's tables by its own catalogue, a connection test, and a preview whose limit the server applies."""
    url = write.write_derby({name.upper(): table(spark, sf_dir, name) for name in ("customer", "nation")}, new_folder(spark, "db"))
    said = str(read.jdbc_works(spark, url, driver=DERBY)).replace("None", "NULL")
    out = []
    for row in read.jdbc_tables(spark, url, driver=DERBY).where("name IN ('CUSTOMER', 'NATION')").collect():
        sql = f"SELECT * FROM {row['name']}"
        out.append((row["name"], read.read_jdbc(spark, url, sql, limit=7, driver=DERBY).count(), read.read_jdbc(spark, url, sql, driver=DERBY).count(), said))
    return spark.createDataFrame(out, "name string, previewed long, n long, said string")


@query("SELECT count(*) AS data_rows, round(sum(o_totalprice), 2) AS total, count(*) AS kpi_rows FROM orders WHERE o_orderstatus = 'F'")
def board_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dashboard as one workbook, read back: the filtered table and the KPI sheet."""
    path = f"{new_folder(spark, 'board')}.xlsx"
    spec = board.Spec("o_orderdate", {"o_totalprice": "sum"}, ["o_orderpriority"], ["o_orderkey"])
    write.write_board(table(spark, sf_dir, "orders"), spec, path, {"o_orderstatus": ["F"]}, workbook=True)
    data, kpi = read.read_workbook(spark, path, "data", continued=True), read.read_workbook(spark, path, "kpis")
    return data.agg(F.count(F.lit(1)).alias("data_rows"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total")).withColumn("kpi_rows", F.lit(int(float(kpi.first()["rows"]))))


@query("SELECT upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS label, count(*) AS n FROM part GROUP BY 1")
def value_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def labelled(names: pd.Series) -> pd.Series:
        return names.map(board.label)

    return table(spark, sf_dir, "part").groupBy(labelled("p_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS sum_o_totalprice, 'o_orderdate' AS time FROM orders WHERE o_orderstatus = 'F'")
def board_rederived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a spec from outside a dashboard is derived from the table again; filters on unknown columns are ignored."""
    orders = table(spark, sf_dir, "orders")
    parts = board.run(orders, {"o_orderstatus": ["F"], "no_such_column": ["x"]})
    found = parts["kpis"].select("rows", F.round("sum_o_totalprice", 2).alias("sum_o_totalprice"))
    return found.withColumn("time", F.lit(board.detect_spec(orders).time))


@query(f"""{_HOLES}, m AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, 100.0 * count(*) FILTER (precio IS NULL) / count(*) AS holes, 100.0 * count(*) FILTER (prioridad IS NULL) / count(*) AS gaps,
        avg((o_orderkey % 7 <> 0)::INTEGER) AS tagged, avg((o_orderkey % 50 <> 0)::INTEGER) AS dated FROM h)
    SELECT 'drop_column' AS op, 'constante' AS "column", true AS enabled UNION ALL SELECT 'drop_column', 'o_orderkey', true FROM m WHERE n = keys
    UNION ALL SELECT CASE WHEN tagged >= 0.95 THEN 'cast_numeric' ELSE 'group_rare' END, 'monto', true FROM m
    UNION ALL SELECT 'cast_numeric', 'importe', true UNION ALL SELECT 'parse_datetime', 'fecha', true FROM m WHERE dated >= 0.9 UNION ALL SELECT 'expand_datetime', 'fecha', true FROM m WHERE dated >= 0.9
    UNION ALL SELECT 'trim_text', 'estado', true FROM (SELECT count(*) > 0 AS mixed FROM orders WHERE o_orderkey % 3 = 0) WHERE mixed
    UNION ALL SELECT 'missing_indicator', 'precio', true FROM m WHERE holes >= 5 UNION ALL SELECT 'impute_numeric', 'precio', true FROM m WHERE holes > 0 UNION ALL SELECT 'impute_categorical', 'prioridad', true FROM m WHERE gaps > 0
    UNION ALL SELECT 'clip_outliers', c, false FROM m, (VALUES ('importe'), ('precio')) v(c) UNION ALL SELECT 'drop_duplicates', NULL, true""")
def etl_proposed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that a messy table gets, against the rules that its measures trigger."""
    orders = table(spark, sf_dir, "orders")
    amount = F.translate(F.format_number(F.col("o_totalprice") * 3, 2), ",.", ".,").alias("importe")
    day = F.when(F.col("o_orderkey") % 50 == 0, "sin fecha").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("fecha")
    state = F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("estado")
    messy = _money(spark, sf_dir, True).join(_holes(spark, sf_dir), "o_orderkey").join(orders.select("o_orderkey", amount, day, state), "o_orderkey").withColumn("constante", F.lit("X"))
    return spark.createDataFrame([(s.op, s.column, s.enabled) for s in etl.propose(messy)], "op string, column string, enabled boolean")


@query("SELECT n_name AS raw, n_name AS name FROM nation UNION ALL SELECT n_name || ' again', n_name || '_1' FROM nation UNION ALL SELECT 'blank', 'col_' || (2 * count(*))::VARCHAR FROM nation")
def column_names_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of a table's values, with stray spaces, repeats and a blank."""
    names = [r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]  # 25 names
    cleaned = V.clean_columns([*[f"  {n.replace(' ', '   ')} " for n in names], *names, " "])
    raw = [*names, *[f"{n} again" for n in names], "blank"]
    return spark.createDataFrame(list(zip(raw, cleaned, strict=True)), "raw string, name string")


@query("SELECT count(*) AS accepted, count(*) AS refused, count(*) AS counted FROM nation")
def guarded_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every nation a query that reads, with a statement in its text, and one that writes: the guards of both engines, and the rows that come out."""
    nations = table(spark, sf_dir, "nation")
    accepted, refused, counted = 0, 0, 0
    for (name,) in nations.select("n_name").collect():  # 25 names
        text = f"{name}; DROP TABLE nation".replace("'", "''")
        sql = f"SELECT count(*) AS n FROM {{t}} WHERE concat(n_name, '; DROP TABLE nation') = '{text}'"
        read.read_only(sql.replace("{t}", "t"))
        accepted += 1
        counted += ask.run_sql(spark, sql, None, None, t=nations).first()["n"]
        try:
            ask.guard(spark, f"DELETE FROM t WHERE n_name = '{text}'", ("t",))
        except ValueError:
            refused += 1
    return spark.createDataFrame([(accepted, refused, counted)], "accepted long, refused long, counted long")


@query("""WITH s AS (SELECT ((l_quantity * 7 + l_linenumber) % 100) / 100 AS p, (l_returnflag = 'R')::INTEGER AS y FROM lineitem)
    SELECT 'brier' AS metric, round(avg((p - y) ** 2), 8) AS value, 'lower' AS better FROM s UNION ALL SELECT 'logloss', round(avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))), 8), 'lower' FROM s
    UNION ALL SELECT 'accuracy', round(avg(((p >= 0.5)::INTEGER = y)::INTEGER), 8), 'higher' FROM s UNION ALL SELECT 'recall', round(avg((p >= 0.5)::INTEGER) FILTER (y = 1), 8), 'higher' FROM s
    UNION ALL SELECT 'precision', round(avg(y) FILTER (p >= 0.5), 8), 'higher' FROM s
    UNION ALL SELECT 'f1', round(2.0 * count(*) FILTER (p >= 0.5 AND y = 1) / (count(*) FILTER (p >= 0.5) + count(*) FILTER (y = 1)), 8), 'higher' FROM s
    UNION ALL SELECT 'balanced_accuracy', round((avg((p >= 0.5)::INTEGER) FILTER (y = 1) + avg((p < 0.5)::INTEGER) FILTER (y = 0)) / 2, 8), 'higher' FROM s""")
def metrics_by_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's binary metrics measured on a table, with the direction that is better."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(((F.col("l_quantity") * 7 + F.col("l_linenumber")) % 100 / 100).alias("p"), (F.col("l_returnflag") == "R").alias("y"))
    measured = E.binary_metrics(rows, "p", F.col("y"), 0.5).first().asDict()
    names = ("brier", "logloss", "accuracy", "recall", "precision", "f1", "balanced_accuracy")
    return rounded(spark.createDataFrame([(m, float(measured[m]), E.CATALOGUE[m][0]) for m in names], "metric string, value double, better string"), 8)


@query("""SELECT chosen, n FROM (VALUES ('o_totalprice'), ('o_orderstatus'), ('(none)')) v(chosen), (SELECT count(*) AS n FROM orders)""")
def targets_of_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals in words and the columns they mean; a column that is mostly empty yields to a fuller one."""
    orders = table(spark, sf_dir, "orders").withColumn("total_note", F.when(F.col("o_orderkey") % 100 == 0, "x"))
    r = orders.agg(F.count(F.lit(1)).alias("n"), *[(100 * F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(c) for c in orders.columns]).first()
    holes = {c: r[c] for c in orders.columns}
    goals = ("how to predict the total price", "predecir el estado", "xyzzy")
    return spark.createDataFrame([((ask.suggest_target(orders, g, holes) or ("(none)",))[0], r["n"]) for g in goals], "chosen string, n long")


@query("""SELECT true AS quantity_kept, true AS something_dropped, count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey""")
def pruned_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that carry nothing are pruned if the selection window loses nothing by it."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("spent"))
    noise = [(F.pmod(F.xxhash64("o_orderkey", F.lit(i)), F.lit(1000)) / 1000).alias(f"noise_{i}") for i in range(8)]
    rows = splits.hashed(table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "quantity", *noise, "spent"), "o_orderkey").drop("o_orderkey")
    family = tuple(f for f in L.FAMILIES if f.name == "tree_regression")
    model = L.train(rows, "spent", "regression", families=family, ensemble=1, log_target=False, prune=True)
    used = set(model.features.numeric)
    return model.score(rows).agg(F.lit("quantity" in used).alias("quantity_kept"), F.lit(len(used) < 9).alias("something_dropped"), F.count("prediccion").alias("n"))


@query("""SELECT 'quantity carries the prediction; raises' AS said, count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey""")
def explained_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native importance, permuted importance and Shapley direction in one sentence a column."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("spent"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "quantity", "o_orderpriority", "spent")
    rows = splits.hashed(rows, "o_orderkey")
    family = tuple(f for f in L.FAMILIES if f.name == "tree_regression")
    model = L.train(rows.drop("o_orderkey"), "spent", "regression", families=family, ensemble=1, log_target=False)
    held = rows.where("split = 'holdout'").withColumn("label", F.col("spent"))
    permuted = {r["column"]: r["drop"] for r in L.permutation_importance(model, held, ["quantity", "o_orderpriority"], "o_orderkey").collect()}
    effects = {r["column"]: r["direction"] for r in model.shap(rows).collect() if r["direction"]}
    return rows.agg(F.lit(L.explained(model, permuted, effects)[0]).alias("said"), F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS data_rows, round(sum(o_totalprice), 2) AS total, 8 AS sheets, 2 AS models, true AS measured, 7 AS plan_rows, max(length(o_orderpriority)) AS longest FROM orders WHERE o_orderkey % 2 = 0""")
def report_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a table, its cleaning plan and a trained model as one workbook, read back."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    rows = splits.hashed(orders.select("o_orderkey", "o_orderpriority", F.pmod("o_custkey", F.lit(10)).cast("double").alias("x"), (F.pmod("o_custkey", F.lit(10)) * 3 + F.pmod("o_orderkey", F.lit(3))).cast("double").alias("y")), "o_orderkey")
    model = L.train(rows.drop("o_orderkey"), "y", "regression", families=tuple(f for f in L.FAMILIES if f.name in ("tree_regression", "generalized_linear")), ensemble=1, log_target=False)
    steps = [etl.Step("trim_text", c) for c in orders.columns][:7] * (7 // min(7, len(orders.columns)))
    path = f"{new_folder(spark, 'report')}.xlsx"
    sheets = write.report_workbook(orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), path, model, (steps * 7)[:7])
    sheet = lambda name: read.read_workbook(spark, path, name)
    held = {r["metric"]: float(r["value"]) for r in sheet("holdout").collect()}
    found = read.read_workbook(spark, path, "data", continued=True).agg(F.count(F.lit(1)).alias("data_rows"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"), F.max(F.length("o_orderpriority")).cast("long").alias("longest"))
    return found.withColumns({"sheets": F.lit(len(sheets)), "models": F.lit(sheet("models").count()), "measured": F.lit(abs(held["r2"] - model.holdout["r2"]) < 1e-9 and held["r2"] > 0.5), "plan_rows": F.lit(sheet("plan").count())})


@query("""WITH t AS (SELECT count(*) AS n, count(DISTINCT l_extendedprice) AS d, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_extendedprice), 4) AS m FROM lineitem), f AS (SELECT l_returnflag AS flag, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, flag LIMIT 1)
    SELECT n AS rows, lo AS least, hi AS greatest, m AS mean, flag AS top_flag, c AS top_count, true AS distinct_close, true AS ranks_close, 3 AS parts FROM t, f""")
def profile_by_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved states of three parts, the last one added later and one replaced, merged: exact figures, and sketches within their error."""
    lines, path = table(spark, sf_dir, "lineitem"), new_folder(spark, "states")
    columns = ["l_extendedprice", "l_returnflag"]
    S.add_part(lines.where("l_orderkey % 3 = 1"), path, "0", columns)
    for i in range(3):
        S.add_part(lines.where(f"l_orderkey % 3 = {i}"), path, str(i), columns)
    found = {r["column"]: r for r in S.figures(S.merged(S.parts(spark, path))).collect()}
    price, flag = found["l_extendedprice"], found["l_returnflag"]["top"][0]
    exact = lines.agg(F.count_distinct("l_extendedprice").alias("d"), *[F.avg((F.col("l_extendedprice") <= q).cast("double")).alias(f"r{i}") for i, q in enumerate(price["quantiles"])]).first()
    close = all(abs(exact[f"r{i}"] - p) < 0.0165 for i, p in enumerate((0.01, 0.25, 0.5, 0.75, 0.99)))
    row = (price["rows"], price["least"], price["greatest"], round(price["mean"], 4), flag["item"], flag["count"], abs(price["n_distinct"] / exact["d"] - 1) < 0.06, close, S.parts(spark, path).select("part").distinct().count())
    return spark.createDataFrame([row], "rows long, least double, greatest double, mean double, top_flag string, top_count long, distinct_close boolean, ranks_close boolean, parts long")


@query("""WITH d AS (SELECT s_suppkey, abs(s_acctbal - c_acctbal) AS away, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal)) AS place FROM supplier, customer)
    SELECT s_suppkey, round(sum(away), 4) AS away, count(*) AS n FROM d WHERE place <= 3 GROUP BY 1""")
def nearest_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every supplier the three customers with the nearest balance, by the neighbour index with all cells probed."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("label"), array_to_vector(F.array("c_acctbal")).alias("scaled"))
    model = Neighbours(k=3, cells=16, probes=16, task="regression").fit(known)
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("row"), F.array("s_acctbal").alias("x"))
    found = model.nearest(asked).groupBy(F.col("row").alias("s_suppkey")).agg(F.sum("away").alias("away"), F.count(F.lit(1)).alias("n"))
    return rounded(found, 4)


@query("SELECT count(*) AS n, count(DISTINCT n_name) AS names, sum(n_regionkey)::BIGINT AS regions FROM nation")
def source_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON documents, an array over several lines a region, each in a file of its own."""
    folder = new_folder(spark, "json")
    nations = table(spark, sf_dir, "nation")
    for (region,) in table(spark, sf_dir, "region").select("r_regionkey").collect():  # five regions
        rows = nations.where(F.col("n_regionkey") == region).select(F.to_json(F.struct("*")).alias("j"))
        rows.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("value")).coalesce(1).write.mode("append").text(folder)
    return read.read_json(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_name").alias("names"), F.sum("n_regionkey").alias("regions"))
