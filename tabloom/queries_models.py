"""Registered queries of features and models. Fitted numbers differ from engine to engine, so the SQL states what must hold of them."""

from __future__ import annotations

from pyspark.ml import regression as R
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation as E
from .operators import learning as L
from .operators import splits, trees
from .operators import text_features as TF
from .queries import _PRED, _predictions, query, rounded, table
from .session import new_folder


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with targets that their columns explain: a spending class, and a price that grows with the lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("spent"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    chosen = orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "n_lines", "quantity", "spent")
    return splits.hashed(chosen, "o_orderkey")


def _some(*names: str) -> tuple[L.Family, ...]:
    return tuple(f for f in L.FAMILIES if f.name in names)


#: Least squares of spending on quantity in the train window, in SQL.
_LEAST_SQUARES = """WITH l AS (SELECT l_orderkey AS k, sum(l_quantity) AS x, sum(l_extendedprice) AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
    f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l WHERE k % 10 < 6), h AS (SELECT y, f.a + f.b * x AS p FROM l, f WHERE k % 10 >= 8)"""


def _by_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    window = F.when(F.col("o_orderkey") % 10 < 6, "train").when(F.col("o_orderkey") % 10 < 8, "selection").otherwise("holdout")
    return rows.select("quantity", "spent", window.alias("split"))


@query(_LEAST_SQUARES + " SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sum(abs(p - y)) / sum(abs(y)), 6) AS wmape, round(sum(p - y) / sum(abs(y)), 6) AS bias FROM h")
def train_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training on one column without a penalty is least squares: the holdout's figures are those of the normal equations."""
    plain = L.Family("least_squares", R.LinearRegression, ({"regParam": 0.0},), True, ("regression",))
    model = L.train(_by_quantity(spark, sf_dir), "spent", "regression", families=(plain,), ensemble=1, log_target=False)
    return spark.createDataFrame([tuple(round(float(model.holdout[k]), 6) for k in ("r2", "wmape", "bias"))], "r2 double, wmape double, bias double")


@query(_LEAST_SQUARES + " SELECT round(a + b * 100, 2) AS at_100, round(a + b * 7.5, 2) AS at_7_5, 'own' AS model FROM f")
def single_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family of one's own, registered for later searches, and predictions for records given as dictionaries."""
    L.register(L.Family("own", R.LinearRegression, ({"regParam": 0.0},), True, ("regression",)))
    try:
        model = L.train(_by_quantity(spark, sf_dir), "spent", "regression", families=(), ensemble=1, log_target=False)
    finally:
        L.unregister("own")
    first, second = model.score_records(spark, [{"quantity": 100}, {"quantity": "7.5"}])
    return spark.createDataFrame([(round(first["prediccion"], 2), round(second["prediccion"], 2), model.champion)], "at_100 double, at_7_5 double, model string")


@query("""WITH c AS (SELECT coalesce(p_type, '(nulo)') AS v, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), p AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS code FROM c ORDER BY code LIMIT 200)
    SELECT p.code::BIGINT AS code, count(*) AS n FROM (SELECT CASE WHEN p_size = 7 THEN 'never seen' ELSE coalesce(p_type, '(nulo)') END AS v FROM part) l LEFT JOIN p USING (v) GROUP BY 1""")
def ordinal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a category for trees, fitted on some rows: levels by frequency, null where a level was not seen."""
    parts = table(spark, sf_dir, "part")
    features = L.fit_features(parts.where("p_partkey % 2 = 0").select("p_type"))
    given = parts.select(F.when(F.col("p_size") == 7, "never seen").otherwise(F.col("p_type")).alias("p_type"))
    return given.select(features.code("p_type").cast("long").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, true AS adds_up, 'quantity' AS leading, 'raises' AS direction FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey")
def shap_of_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of every row add up to its prediction minus the mean; the column behind the target leads."""
    rows = _orders(spark, sf_dir).drop("n_lines")
    model = L.train(rows.drop("o_orderkey"), "spent", "regression", families=_some("boosting_regression"), ensemble=1, log_target=False)
    forest = trees.exported(model.models[model.champion], spark)
    given = model.features.transform(rows).select(trees.explanations(forest).alias("phi"), trees.predictions(forest)[0].alias("p"))
    total = F.aggregate("phi", F.lit(float(forest.expected()[0])), lambda a, b: a + b)
    first = model.shap(rows).orderBy(F.col("mean_abs").desc()).first()
    off = F.max(F.abs(total - F.col("p")) / (1 + F.abs(F.col("p"))))
    return given.agg(F.count(F.lit(1)).alias("n"), (off < 1e-6).alias("adds_up")).withColumns({"leading": F.lit(first["column"]), "direction": F.lit(first["direction"])})


@query("""WITH w AS (SELECT lower(strip_accents(text)) AS t FROM documents WHERE text IS NOT NULL), d AS (SELECT row_number() OVER () AS id, regexp_extract_all(t, '\\b\\w\\w+\\b') AS w FROM w WHERE regexp_full_match(t, '[\\x00-\\x7F]*')),
    t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d), c AS (SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM t GROUP BY 1 HAVING df >= 2)
    SELECT term, round(ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1, 8) AS idf FROM c ORDER BY n DESC, term LIMIT 400""")
def text_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms and weights that text components start from, of the documents that are ASCII once accents are gone."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").where(TF.is_plain(F.col("text")))
    words, idf = TF.vocabulary(docs, "text", 400)
    return spark.createDataFrame([(w, round(x, 8)) for w, x in zip(words, idf, strict=True)], "term string, idf double")


@query(f"""{_PRED}, m AS (SELECT y::INTEGER AS y, p FROM s), g AS (SELECT p, count(*) AS n, sum(y) AS a FROM m GROUP BY 1), c AS (SELECT *, sum(a) OVER (ORDER BY p DESC) - a AS above FROM g),
    auc AS (SELECT sum((n - a) * (above + a / 2)) / (sum(a) * (sum(n) - sum(a))) AS auc FROM c), bias AS (SELECT (sum(p) - sum(y)) / sum(y) AS bias FROM m)
    SELECT CASE WHEN auc >= 0.99 THEN 'suspiciously good: look for leakage' WHEN auc >= 0.85 THEN 'strong' WHEN auc >= 0.70 THEN 'useful' ELSE 'weak' END AS auc_said, abs(bias) > 0.05 AS biased, false AS overfitted FROM auc, bias""")
def model_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    auc = E.binary_metrics(rows, "p", F.col("y"), 0.5).first()["auc"]
    r = rows.agg(F.sum("p").alias("p"), F.sum(F.col("y").cast("int")).alias("y")).first()
    said = L.verdict(auc, gap=0.01, bias=(r["p"] - r["y"]) / r["y"])
    return spark.createDataFrame([(said[0], any(s.startswith("biased") for s in said), any(s.startswith("overfitted") for s in said))], "auc_said string, biased boolean, overfitted boolean")


@query("""WITH s AS (SELECT l_returnflag AS t, (l_quantity + 1) / 60 AS a, (l_linenumber + l_discount) / 8 AS b, 0.5 AS c FROM lineitem), n AS (SELECT t, a / (a + b + c) AS a, b / (a + b + c) AS n, c / (a + b + c) AS r FROM s),
    l AS (SELECT avg(-ln(CASE t WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END)) AS logloss FROM n), m AS (SELECT 'A' AS k, a AS p, t = 'A' AS y FROM n UNION ALL SELECT 'N', n, t = 'N' FROM n UNION ALL SELECT 'R', r, t = 'R' FROM n),
    g AS (SELECT k, p, count(*) AS n, count(*) FILTER (y) AS a FROM m GROUP BY 1, 2), c AS (SELECT *, sum(a) OVER (PARTITION BY k ORDER BY p DESC) - a AS above FROM g), u AS (SELECT k, sum((n - a) * (above + a / 2)) / (sum(a) * (sum(n) - sum(a))) AS auc FROM c GROUP BY k)
    SELECT round((SELECT logloss FROM l), 8) AS logloss, round(avg(auc), 8) AS auc FROM u""")
def multiclass_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss and one-vs-rest area of shares that do not add up to one by row."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.array((F.col("l_quantity") + 1) / 60, (F.col("l_linenumber") + F.col("l_discount")) / 8, F.lit(0.5)).alias("p"))
    return rounded(E.multiclass_probability_metrics(rows, "l_returnflag", ["A", "N", "R"], "p"), 8)


@query("""SELECT model, n, positives, true AS good FROM (VALUES ('logistic'), ('decision_tree'), ('gradient_boosting'), ('adaboost'), ('linear_svm')) v(model),
    (SELECT count(*) AS n, count(*) FILTER (l_quantity * 1000 + l_extendedprice > 62000) AS positives FROM lineitem)""")
def train_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families on a target that two columns explain together: each ranks the selection window better than the best column alone would have to."""
    lines = table(spark, sf_dir, "lineitem").withColumn("target", F.when(F.col("l_quantity") * 1000 + F.col("l_extendedprice") > 62000, "yes").otherwise("no"))
    rows = splits.hashed(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "target"), "k").drop("k")
    model = L.train(rows, "target", "binary", families=_some("logistic", "decision_tree", "gradient_boosting", "adaboost", "linear_svm"))
    board = spark.createDataFrame([(r["model"], float(r["auc"]) > 0.93) for r in model.leaderboard if r["model"] not in ("ensemble", "logistic_1")], "model string, good boolean")
    return board.crossJoin(rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == "yes").alias("positives")))  # one row


@query("SELECT 'multiclass' AS task, 3 AS classes, true AS better_than_chance")
def train_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("size", F.when(F.col("quantity") < 60, "small").when(F.col("quantity") < 130, "middle").otherwise("large")).drop("o_orderkey", "quantity")
    model = L.train(rows, "size", "multiclass", families=_some("logistic", "decision_tree"))
    return spark.createDataFrame([("multiclass", len(model.classes), bool(model.holdout["f1_macro"] > 0.5))], "task string, classes int, better_than_chance boolean")


@query("SELECT count(*) AS n, true AS same, true AS deleted FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey")
def model_saved_and_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    model = L.train(rows.drop("o_orderkey"), "spent", "regression", families=_some("linear"), ensemble=1)
    root = new_folder(spark, "models")
    model.save(f"{root}/spending", spark)
    (path, _), = L.list_cards(root, spark)
    again = L.load(path, spark)
    both = model.score(rows).select("o_orderkey", "prediccion").join(again.score(rows).select("o_orderkey", F.col("prediccion").alias("other")), "o_orderkey")
    row = both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("prediccion") - F.col("other"))).alias("off")).first()
    L.delete(path, spark)
    return spark.createDataFrame([(row["n"], row["off"] < 1e-6, not L.list_cards(root, spark))], "n long, same boolean, deleted boolean")


@query("SELECT 'quantity' AS leading, 'quantity' AS permuted")
def explained_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column behind the target leads both the models' own importances and the permuted ones."""
    rows = _orders(spark, sf_dir).drop("n_lines", "o_orderstatus")
    model = L.train(rows.drop("o_orderkey"), "spent", "regression", families=_some("tree_regression"), ensemble=1, log_target=False)
    held = rows.where("split = 'holdout'").withColumn("label", F.col("spent"))
    permuted = L.permutation_importance(model, held, ["quantity", "o_orderpriority"], "o_orderkey").orderBy(F.col("drop").desc()).first()["column"]
    return spark.createDataFrame([(next(iter(model.importance())), permuted)], "leading string, permuted string")


@query("SELECT true AS learned, count(*) AS n FROM documents WHERE text IS NOT NULL")
def train_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language from the text alone, by TF-IDF on components: AUC over 0.9 on the holdout, and every row scored."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", (F.col("lang") == "en").cast("int").alias("english"))
    rows = splits.hashed(rows, "doc_id").drop("doc_id")
    model = L.train(rows, "english", "binary", text=["text"], families=_some("logistic"))
    return model.score(rows).agg(F.lit(bool(model.holdout["auc"] > 0.9)).alias("learned"), F.count("prob").alias("n"))


@query("""WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS place FROM c)
    SELECT count(*) FILTER (o.o_orderpriority = (SELECT v FROM p WHERE place = 1)) AS first_level, count(*) FILTER (o.o_orderpriority = (SELECT v FROM p WHERE place = 2)) AS second_level, count(*) AS n FROM orders o""")
def one_hot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority")
    made = L.fit_features(orders, levels=2).prepared(orders)
    return made.agg(F.sum("`o_orderpriority=0`").cast("long").alias("first_level"), F.sum("`o_orderpriority=1`").cast("long").alias("second_level"), F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(ln(1 + greatest(x * x * x * x, 0))), 4) AS total, 'x' AS base FROM (SELECT l_quantity AS x FROM lineitem)")
def log_companion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.pow("l_quantity", F.lit(4)).alias("x"))
    features = L.Features(["x"], ["x"], {}, [])
    return features.prepared(rows).agg(F.round(F.sum("x__log"), 4).alias("total"), F.lit(L.base_of("x__log")).alias("base"))


@query("SELECT round(least(5, greatest(0.2, avg(exp(ln(1 + o_totalprice) - ln(1 + o_totalprice) * 0.99)))), 6) AS factor FROM orders")
def smearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_totalprice", (F.log1p("o_totalprice") * 0.99).alias("guess"))
    return spark.createDataFrame([(round(L.smearing_factor(rows, "o_totalprice", "guess"), 6),)], "factor double")
