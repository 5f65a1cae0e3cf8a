"""Tabular operators on hand-made frames: nulls, empty input, quirks; and all SQL-expressible queries against DuckDB."""

import glob
import math
import os
import subprocess

import duckdb
import pandas as pd
import pyspark
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tabloom.functions import values as V
from tabloom.operators import association, evaluation, intervals, profile, ranking, splits
from tabloom.plans import ask, board, etl
from tabloom.plans.etl import Step
from tabloom.queries import ORACLES, QUERIES
from tabloom.sources import read, write

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(frame):
    one = lambda v: "null" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) or type(v).__name__ in ("int64", "int32", "float64", "Decimal") else str(v)
    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry(spark, duck):
    months = duck.execute("SELECT count(DISTINCT date_trunc('month', l_shipdate)) FROM lineitem").fetchone()[0]
    assert __spark_entry__.entry(spark).count() == months
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_clean_columns():
    assert V.clean_columns([" a  b ", "", "a b", None]) == ["a b", "col_1", "a b_1", "col_3"]


def test_cast_and_dates(spark):
    df = spark.createDataFrame([("$ 1.234,56", "31/12/2023", "2023-01"), ("12%", "2023-12-31", "202302"), ("x", "y", "03/2023"), (None, None, None)], "n string, d string, p string")
    got = df.select(V.cast_numeric(F.col("n"), True).alias("n"), F.date_format(V.parse_datetime(F.col("d")), "yyyy-MM-dd").alias("d"), V.parse_datetime(F.col("d"), strict=True).isNotNull().alias("iso"), F.date_format(V.period_month(F.col("p")), "yyyy-MM-dd").alias("p")).collect()
    assert [tuple(r) for r in got] == [(1234.56, "2023-12-31", False, "2023-01-01"), (12.0, "2023-12-31", True, "2023-02-01"), (None, None, False, "2023-03-01"), (None, None, False, None)]


def test_plan_order_and_quirks(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (99.0, "rare")], "x double, c string")
    steps = [Step("missing_indicator", "x"), Step("clip_outliers", "x", {"low": 2.0, "high": 50.0}), Step("group_rare", "c", {"keep": ["a"]}), Step("drop_column", "x", enabled=False), Step("drop_column", "ghost")]
    out = etl.compile_plan(df, steps)
    assert out.columns == ["x", "c", "x__faltante"]
    assert sorted(map(tuple, out.collect())) == [(2.0, "(otros)", 1), (2.0, "a", 0), (50.0, "(otros)", 0)]
    assert "Python" not in out._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        etl.compile_plan(df, [Step("filter_rows", None, {"condition": "x > 1; drop table t"})])


def test_propose_and_leakage(spark):
    n = 300
    rows = [(i, f"$ {i % 97}.{i % 900 + 100:03d},50", "X", "norte" if i % 3 else "sur", i % 2, i % 2, float(i * 7 % 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, monto string, constante string, region string, objetivo int, copia_del_objetivo int, ruido double")
    steps = {(s.op, s.column) for s in etl.propose(df, "objetivo")}
    assert {("drop_column", "constante"), ("drop_column", "id"), ("cast_numeric", "monto"), ("filter_null_target", "objetivo")} <= steps
    assert ("drop_column", "copia_del_objetivo") in steps and ("drop_column", "ruido") not in steps
    assert etl.decimal_is_comma(df, "monto")


def test_profile_of_empty_and_null(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "x double")
    r = profile.numeric_profile(df, ["x"]).first()
    assert (r["rows"], r["nulls"], r["mean"], r["median"]) == (4, 1, 2.0, 2.0)
    assert profile.histogram(df.limit(0), "x").count() == 0
    assert profile.quality_issues(df)[1] <= 100


def test_auc_ks_by_brute_force(spark):
    data = [(i, (i * 37 % 50) / 50, (i * 13) % 7 < 3) for i in range(400)]
    df = spark.createDataFrame(data, "k int, p double, y boolean")
    pos, neg = [p for _, p, y in data if y], [p for _, p, y in data if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(evaluation.binary_metrics(df, "p", F.col("y"), 0.5).first()["auc"], auc, abs_tol=1e-9)
    assert math.isclose(association.univariate_auc(df, "p", F.col("y")).first()["auc"], max(auc, 1 - auc), abs_tol=1e-9)


def test_running_total_over_partitions(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, 1) for i in range(1000)], "a int, b int")
    got = ranking.row_numbers(df, [F.col("a")], "n").collect()
    assert all(r["n"] == r["a"] + 1 for r in got)


def test_splits_are_disjoint_and_stable(spark):
    df = spark.range(1000).withColumn("c", F.col("id") % 3)
    parts = splits.stratified(df, "c", "id")
    assert parts.count() == 1000 and {r["split"] for r in parts.select("split").distinct().collect()} == set(splits.WINDOWS)
    hashed = {r["id"]: r["split"] for r in splits.hashed(df, "id").collect()}
    assert all(hashed[r["id"]] == r["split"] for r in splits.hashed(df.where("id < 100"), "id").collect())


def test_guard(spark):
    frame = spark.range(3).toDF("x")
    for sql in ("DROP TABLE t", "SELECT 1; DELETE FROM t", "INSERT INTO t SELECT 1", "SELECT * FROM parquet.`/etc`", "SELECT * FROM other", "WITH a AS (SELECT 1) DELETE FROM a", "SET x = 1"):
        with pytest.raises(ask.NotReadOnly):
            ask.guard(spark, sql)
    assert ask.run_sql(spark, "SELECT count(*) AS n FROM {t} WHERE x > :low -- note", {"low": 0}, t=frame).first()["n"] == 2
    assert ask.run_sql(spark, "WITH a AS (SELECT x FROM {t}) SELECT ';' AS s, x FROM a", t=frame).count() == 3


def test_suggest_target_and_labels(spark):
    df = spark.createDataFrame([(1, 2, 3)], "cliente_id int, Pago30d int, saldo int")
    assert ask.suggest_target(df, "predecir el pago")[0] == "Pago30d"
    assert board.label("TotalCobrado_mes") == "Total cobrado mes" and ask.narrate(1234567.891) == "1.234.567,89"


def test_sniff_and_roundtrip(spark, tmp_path):
    assert read.sniff(b"a;b\n1,5;x\n2,5;y\n") == read.Form("utf-8", ";", ",")
    assert read.sniff("a,b\n1.5,ñ\n".encode("latin-1")).encoding == "latin-1"
    assert read.choose_separator("just one column\nand text\n") == "\x01"
    df = spark.createDataFrame([(1.5, "a"), (None, "NA")], "x double, s string")
    write.write_csv(df, f"{tmp_path}/out")
    back = read.read_delimited(spark, f"{tmp_path}/out", read.Form("utf-8", ";", ","))
    assert sorted((r["x"] or "", r["s"] or "") for r in back.collect()) == [("", ""), ("1,5", "a")]


def test_plans_stay_in_the_jvm_and_prune(spark):
    plan = QUERIES["series_month"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan and "Python" not in plan


def test_guard_refuses_calls_into_the_machine(spark):
    t = spark.range(3).withColumn("s", F.lit("x"))
    for sql in ("SELECT reflect('java.lang.System', 'exit') FROM {t}", "SELECT `java_method`('a', 'b') FROM {t}", "SELECT * FROM {t} WHERE id IN (SELECT try_reflect('a', 'b'))", "WITH c AS (SELECT reflect('a', 'b')) SELECT * FROM c", "SELECT input_file_name() FROM {t}"):
        with pytest.raises(ask.NotReadOnly):
            ask.run_sql(spark, sql, t=t)
    assert ask.run_sql(spark, "SELECT upper(s) AS u, row_number() OVER (ORDER BY id) AS r FROM {t} WHERE id > 0", t=t).count() == 2
    with pytest.raises(ValueError):
        etl._condition("reflect('a', 'b') = 'x'")


def test_asof_join_over_parts_and_keys(spark):
    left = spark.createDataFrame([(k, t) for k in range(3) for t in range(0, 100, 7)], "k int, t int").repartition(3)
    right = spark.createDataFrame([(0, 5, "a"), (0, 50, "b"), (2, 1, "c"), (2, 60, None)], "k int, t int, v string")
    events = {0: [(5, "a"), (50, "b")], 1: [], 2: [(1, "c")]}
    got = {(r.k, r.t): r.v for r in ranking.asof_join(left, right, "k", "t", "v").collect()}
    assert got == {(k, t): next((v for at, v in reversed(events[k]) if at <= t), None) for k in range(3) for t in range(0, 100, 7)}


def test_workbook_dates_and_names(spark, tmp_path):
    path = f"file://{tmp_path}/book.xlsx"
    write.write_workbook({"one": spark.createDataFrame([(1.5, "a<b", None)], "n double, t string, z string"), "two": spark.range(2)}, path)
    assert [tuple(r) for r in read.read_workbook(spark, path, "one").collect()] == [("1.5", "a<b", None)]
    assert read.read_workbook(spark, path, 2).count() == 2
    assert read._iso("45292") == "2024-01-01" and read._iso("45292.5") == "2024-01-01 12:00:00"


def test_exact_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert profile.exact_quantiles(empty, ["x", "y"], [0.0, 0.5]) == {"x": [None, None], "y": [1.0, 1.0]}


# --- joins on intervals, ranks, as-of joins with null keys


def test_range_join_against_all_pairs(spark):
    import random

    from tabloom.operators.intervals import range_join

    rng = random.Random(3)
    points = [(i, rng.choice([5.0, 5.0, 5.0, rng.uniform(-10, 40), None, float("nan")])) for i in range(400)]
    ranges = [(i, a := rng.choice([5.0, rng.uniform(-12, 40), None]), None if a is None else a + rng.choice([0.0, 0.5, 3.0, 60.0, -1.0])) for i in range(60)]
    p = spark.createDataFrame(points, "pid long, v double").repartition(3)
    r = spark.createDataFrame(ranges, "rid long, lo double, hi double")
    for closed in (True, False):
        want = {(i, j) for i, v in points for j, a, b in ranges if None not in (v, a, b) and v == v and a <= v and (v <= b if closed else v < b)}
        joined = range_join(p, r, "v", "lo", "hi", closed=closed, bins=16)
        got = [(x.pid, x.rid) for x in joined.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()
        assert {x.pid for x in range_join(p, r, "v", "lo", "hi", "left_semi", closed, 16).collect()} == {i for i, _ in want}
        assert {x.pid for x in range_join(p, r, "v", "lo", "hi", "left_anti", closed, 16).collect()} == {i for i, _ in points} - {i for i, _ in want}
        left = [(x.pid, x.rid) for x in range_join(p, r, "v", "lo", "hi", "left", closed, 16).collect()]
        assert sorted(left, key=str) == sorted([*want, *[(i, None) for i, _ in points if i not in {k for k, _ in want}]], key=str)
    assert range_join(p.limit(0), r, "v", "lo", "hi").count() == 0 and range_join(p, r.limit(0), "v", "lo", "hi").count() == 0


def test_spearman_of_many_columns_and_awkward_names(spark):
    import numpy as np
    import pandas as pd

    from tabloom.operators import association as A

    rng = np.random.default_rng(2)
    data = pd.DataFrame({c: rng.integers(0, 9, 200).astype(float) for c in ("n", "rank", "upto", "pos", "a b")})
    data.loc[::7, "rank"] = np.nan
    df = spark.createDataFrame(data).select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) for c in data.columns]).repartition(3)
    ranked = data.rank()
    found = A.spearman(df, list(data.columns))
    for r in found.collect():
        assert abs(r["corr"] - ranked[[r["a"], r["b"]]].dropna().corr().iloc[0, 1]) < 1e-9
    assert A.spearman(df, list(data.columns), top=3).count() == 3
    assert 0.4 < A.univariate_auc(df, "n", F.col("pos") > 4).first()["auc"] < 0.7


def test_asof_join_with_null_keys_and_hot_keys(spark):
    from tabloom.operators.ranking import asof_join

    left = [(i, None if i % 5 == 0 else "hot" if i % 3 else "b", None if i % 11 == 0 else i) for i in range(120)]
    right = [(None if j % 4 == 0 else "hot" if j % 3 else "b", None if j % 13 == 0 else j, float(j)) for j in range(0, 120, 3)]
    want = {i: None if k is None or t is None else max((v for rk, rt, v in right if rk == k and rt is not None and rt <= t), default=None) for i, k, t in left}
    lf, rf = spark.createDataFrame(left, "id long, k string, t long").repartition(4), spark.createDataFrame(right, "k string, t long, v double").repartition(4)
    for rows in (10, 10**6):
        assert {r.id: r.v for r in asof_join(lf, rf, "k", "t", "v", task_rows=rows).collect()} == want
    strict = {i: None if k is None or t is None else max((v for rk, rt, v in right if rk == k and rt is not None and rt < t), default=None) for i, k, t in left}
    for rows in (10, 10**6):
        assert {r.id: r.v for r in asof_join(lf, rf, "k", "t", "v", allow_equal=False, task_rows=rows).collect()} == strict


def test_column_names_stay_apart():
    assert V.clean_columns(["a", "a", "a_1", "a", "", ""]) == ["a", "a_1", "a_1_1", "a_2", "col_4", "col_5"]
    assert len(set(V.clean_columns(["x"] * 20_000))) == 20_000


# --- guards and names


_REFUSED = (
    "DELETE FROM {t}", "SELECT 1; DROP TABLE x", "SELECT reflect('java.lang.System', 'exit') FROM {t}", "SELECT * FROM other", "WITH a AS (SELECT java_method('a', 'b') AS x FROM {t}) SELECT * FROM a",
    "SELECT * FROM parquet.`/etc`", "SET spark.x = 1", "SELECT * FROM read_files('/etc')", "SELECT input_file_name() FROM {t}",
)
_READ_ONLY_REFUSED = ("WITH d AS (DELETE FROM t RETURNING *) SELECT * FROM d", "SELECT * INTO x FROM t", "UPDATE t SET a = 1", "SELECT 1; SELECT 2", "SELECT 1 /* a */ ; drop table t", "EXEC p")


def test_guards_refuse_what_writes_or_reaches_out(spark):
    for sql in _REFUSED:
        with pytest.raises(ValueError):
            ask.guard(spark, sql, ("t",))
    for sql in _READ_ONLY_REFUSED:
        with pytest.raises(ValueError):
            read.read_only(sql)
    for sql in ("SELECT 'a;b' AS x", 'select "update" from t', "WITH a AS (SELECT 1 AS deleted_at) SELECT * FROM a"):
        assert read.read_only(sql) == sql


def test_names_and_goals(spark):
    assert V.clean_columns([" a  b ", "", "a b", "Monto\nTotal"]) == ["a b", "col_1", "a b_1", "Monto Total"]
    orders = spark.createDataFrame([], "o_orderkey long, o_orderstatus string, o_totalprice double, paid_flag boolean")
    goals = {"quero prever o pagamento": "paid_flag", "predecir el estado": "o_orderstatus", "saber si habra pago": "paid_flag", "how to predict the total price": "o_totalprice"}
    assert {g: ask.suggest_target(orders, g)[0] for g in goals} == goals
    assert {m: evaluation.CATALOGUE[m][0] for m in evaluation.PRIMARY.values()} == {"auc": "higher", "f1_macro": "higher", "wmape": "lower"}


def test_workbook_of_awkward_cells_over_several_sheets(spark, tmp_path, monkeypatch):
    import datetime

    monkeypatch.setattr(write, "SHEET_ROWS", 7)
    monkeypatch.setattr(write, "PART_ROWS", 3)
    rows = [(i, None if i % 3 else "a\nb <&> \x01 é", float("nan") if i == 2 else i / 4, datetime.datetime(2024, 1, 2, 3, 4, i), i % 2 == 0) for i in range(16)]
    df = spark.createDataFrame(rows, "i long, s string, d double, t timestamp_ntz, b boolean").repartition(2).sortWithinPartitions("i")
    df = df.orderBy("i")
    write.write_workbook({"data": df, "none": df.limit(0)}, str(tmp_path / "w.xlsx"))
    got = [read.read_workbook(spark, str(tmp_path / "w.xlsx"), name) for name in ("data", "data_2", "data_3")]
    assert [g.count() for g in got] == [7, 7, 2] and read.read_workbook(spark, str(tmp_path / "w.xlsx"), "none").count() == 0
    cells = [tuple(r) for g in got for r in g.orderBy(F.col("i").cast("int")).collect()]
    assert [c[0] for c in cells] == [str(i) for i in range(16)]
    assert {c[1] for c in cells} == {None, "a\nb <&>  é"} and cells[2][2] is None and cells[3][2] == "0.75" and cells[5][3] == "2024-01-02 03:04:05" and cells[4][4] == "True"


def test_correlation_with_a_constant_column(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 7.0, None if i % 2 else 1.0 * i) for i in range(10)], "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): r["corr"] for r in association.pearson(df, df.columns).collect()}
    assert abs(got["a", "b"] - 1) < 1e-12 and abs(got["a", "d"] - 1) < 1e-12 and got["a", "c"] is None and got["c", "d"] is None
    assert abs(association.spearman(df, ["a", "b", "c"], top=1).first()["corr"] - 1) < 1e-12


def test_derby_archive_is_read_by_other_processes(spark, tmp_path):
    odd = [(1, 'a "quoted", cell', 1.5, True), (2, "two\nlines", None, False), (3, "", -2e10, None), (4, None, 0.1, True), (5, " ñ ", 3.0, True)]
    df = spark.createDataFrame(odd, "k long, t string, x double, b boolean")
    url = write.write_derby({"ODD": df.repartition(3)}, str(tmp_path / "db"))
    got = read.read_jdbc(spark, url, 'SELECT * FROM "ODD"', driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert sorted(tuple(r) for r in got.collect()) == odd and got.dtypes == df.dtypes
    script = tmp_path / "q.sql"
    script.write_text(f"CONNECT '{url}';\nSELECT count(*) + 900 FROM ODD;\nEXIT;\n")
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars", "*")
    said = subprocess.run(["java", "-cp", jars, f"-Dderby.stream.error.file={tmp_path}/log", "org.apache.derby.tools.ij", str(script)], capture_output=True, text=True, timeout=120).stdout
    assert "905" in said


def test_workbook_read_back_over_several_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(write, "SHEET_ROWS", 7)
    monkeypatch.setattr(read, "BATCH_ROWS", 3)
    write.write_workbook({"data": spark.range(16).repartition(3), "data 2": spark.range(3), "one": spark.range(5)}, str(tmp_path / "w.xlsx"))
    whole = lambda name: sorted(int(r[0]) for r in read.read_workbook(spark, str(tmp_path / "w.xlsx"), name, continued=True).collect())
    assert whole("data") == list(range(16)) and whole("one") == list(range(5))


@pytest.mark.parametrize("closed", [True, False])
def test_sums_over_intervals_are_those_of_the_join(spark, closed):
    points = spark.range(300).select(F.when(F.col("id") % 50 > 0, F.col("id") % 37).cast("double").alias("v"), F.when(F.col("id") == 5, float("inf")).when(F.col("id") == 60, float("nan")).when(F.col("id") % 11 > 0, F.col("id") / 4).alias("a"))
    ranges = spark.createDataFrame([("x", 1.0, 4.0), ("x", 3.0, 9.0), ("x", 9.0, 1.0), (None, 20.0, 22.0), (None, 20.0, 22.0), ("y", 5.0, 5.0), ("z", 90.0, 99.0), ("y", None, 3.0), ("w", 30.0, float("inf"))], "g string, lo double, hi double")
    want = intervals.range_join(points, ranges, "v", "lo", "hi", closed=closed).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"))
    got = intervals.range_sums(points, ranges, "v", "lo", "hi", ["g"], ["a"], closed)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_interval_sums_make_no_pairs(spark):
    plan = QUERIES["join_intervals"](spark, __spark_entry__.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_ranks_with_frequent_values(spark):
    rows = pd.DataFrame({"a": [1.0] * 900 + [None] * 50 + [float(i) for i in range(1050)], "b": [float(i % 3) for i in range(2000)], "c": [float(i) for i in range(2000)]})
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "a double, b double, c double").repartition(3)
    got = ranking.ranks(df, ["a", "b", "c"])
    want = rows.rank()
    key = lambda r: tuple(-1.0 if pd.isna(x) else x for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.itertuples(index=False)))
    joins = [n for n in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in n]
    assert any("broadcast" in n.lower() for n in joins)


def test_proposals_profile_numbers_once(spark, monkeypatch):
    calls, made = [], profile.numeric_profile
    monkeypatch.setattr(profile, "numeric_profile", lambda *a: calls.append(1) or made(*a))
    df = spark.range(200).select(F.when(F.col("id") % 4 > 0, F.col("id") * 1.5).alias("x"), (F.col("id") % 7).alias("y"))
    assert {"impute_numeric", "missing_indicator"} <= {s.op for s in etl.propose(df)} and len(calls) == 1


def test_tasks_do_not_hold_a_mounted_workbook(spark, tmp_path, monkeypatch):
    """Only the paths of mounted workbooks go to the tasks, and no tree of a sheet is kept; the content of other files goes to them whole."""
    from xml.etree import ElementTree

    monkeypatch.setattr(write, "SHEET_ROWS", 900)
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    write.write_workbook({"data": spark.range(2000).select("id", F.lit("<x> & é").alias("t")), "one": spark.range(5)}, str(folder / "w.xlsx"))
    rows = read.read_workbook(spark, str(folder / "w.xlsx"), "data", continued=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "path#" in plan and "content#" not in plan
    assert sorted((int(r["id"]), r["t"]) for r in rows.collect()) == [(i, "<x> & é") for i in range(2000)]
    by_glob = read.read_workbook(spark, f"file://{folder}/*.xlsx", 1)
    assert by_glob.count() == 900
    content = (folder / "w.xlsx").read_bytes()
    import io
    import zipfile

    monkeypatch.setattr(ElementTree, "iterparse", None)
    cells = read._cells(zipfile.ZipFile(io.BytesIO(content)), "data_3")
    assert len(list(cells)) == 201


def test_cells_of_foreign_sheets():
    """Cells with places, shared, rich and inline texts, dates, repeated values, prefixes and blank rows."""
    import io
    import zipfile

    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="/xl/worksheets/x.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/x.xml", f'''<x:worksheet xmlns:x="{ns}"><x:sheetData><x:row r="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c><x:c r="C1" t="s"><x:v>1</x:v></x:c></x:row>
            <x:row r="2"/><x:row r="3"><x:c r="A3"/><x:c r="B3"><x:v></x:v></x:c></x:row><x:row r="4"><x:c r="B4" s="1"><x:v>45293</x:v></x:c><x:c r="AB4" t="inlineStr"><x:is><x:r><x:t>a &amp;</x:t></x:r><x:r><x:t> b</x:t></x:r></x:is></x:c></x:row>
            <x:row r="5"><x:c><x:f>1+1</x:f><x:v>2</x:v></x:c><x:c s="1"><x:v>45293.5</x:v></x:c><x:c t="b"><x:v>1</x:v></x:c></x:row></x:sheetData></x:worksheet>''')  # fmt: skip
    got = list(read._cells(zipfile.ZipFile(held), 1))
    assert got == [["plain", None, "rich"], [None, "2024-01-02", *[None] * 25, "a & b"], ["2", "2024-01-02 12:00:00", "1"]]
