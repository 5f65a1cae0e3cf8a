"""Model search under the three-window protocol, on MLlib.

Encoders and models are fitted on the train window only, compared on the selection window, and measured
once on the holdout. Families without an equivalent here are named in ``UNAVAILABLE``."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import feature as X
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..session import new_folder, removed, settled
from . import evaluation as E
from . import search as S
from . import trees
from .boosting import AdaBoost, SoftmaxBoosting, StagewiseModel
from .neighbours import Neighbours, NeighboursModel
from .ranking import row_numbers
from .text_features import TextModel, fit_text

#: Tokens that mean the positive class.
POSITIVE = ("1", "1.0", "true", "si", "sí", "y", "yes")
#: Families that have no equivalent here.
UNAVAILABLE = ("extra_trees", "mlp_regression", "hist_gradient_boosting", "lightgbm", "xgboost", "catboost")
#: Fixed value: the level of a null.
NO_VALUE = "(nulo)"
#: Levels of a category that get a column of their own for linear models; the others share none.
LEVELS = 25
#: Levels of a category that get a code of their own for trees; the others share the code after the last.
CODES = 200
#: Bins of trees: more than a category has codes.
BINS = 256
#: From so many rows on, alike rows are kept once with their number, if that leaves at most this share of them.
MANY, ALIKE = 1_000_000, 0.5
#: Rows that one row stands for at most: more are dealt over several, and so over tasks.
STACK = 256


@dataclass(frozen=True)
class Family:
    name: str
    make: Callable[..., object]
    grid: tuple[dict, ...] = ({},)
    scaled: bool = False
    tasks: tuple[str, ...] = ("binary",)
    max_rows: int | None = None  # beyond it the family is not tried
    space: dict = field(default_factory=dict)  # what a search may vary, from the first of ``grid``
    weighted: bool = False  # a row of weight n counts as n rows of its kind: no draws of rows, no least number of rows


_CLASSES = ("binary", "multiclass")
_LINEAR = {"regParam": S.Real(1e-4, 1.0, True), "elasticNetParam": S.Real(0.0, 1.0)}
_TREE = {"maxDepth": S.Whole(2, 10), "minInstancesPerNode": S.Whole(1, 100, True)}
_FOREST = {"maxDepth": S.Whole(3, 10), "numTrees": S.Whole(10, 60), "featureSubsetStrategy": S.Choice(("auto", "all", "onethird", "sqrt"))}
_BOOST = {"maxDepth": S.Whole(2, 6), "maxIter": S.Whole(8, 40), "stepSize": S.Real(0.03, 0.4, True)}
_STAGES = {"maxDepth": S.Whole(1, 5), "rounds": S.Whole(4, 30), "rate": S.Real(0.1, 1.0, True)}

FAMILIES = (
    Family("logistic", C.LogisticRegression, ({"regParam": 0.01}, {"regParam": 0.1}), True, _CLASSES, space={"regParam": S.Real(1e-5, 1.0, True)}, weighted=True),
    Family("elastic_net", C.LogisticRegression, ({"regParam": 0.01, "elasticNetParam": 0.5},), True, _CLASSES, space=_LINEAR, weighted=True),
    Family("decision_tree", C.DecisionTreeClassifier, ({"maxDepth": 5, "seed": 7, "maxBins": BINS},), False, _CLASSES, space=_TREE, weighted=True),
    Family("random_forest", C.RandomForestClassifier, ({"numTrees": 20, "seed": 7, "maxBins": BINS},), False, _CLASSES, space=_FOREST),
    Family("gradient_boosting", C.GBTClassifier, ({"maxIter": 15, "seed": 7, "maxBins": BINS},), False, space=_BOOST, weighted=True),
    Family("softmax_boosting", SoftmaxBoosting, ({"rounds": 8},), False, ("multiclass",), space=_STAGES),
    Family("adaboost", AdaBoost, ({"rounds": 8, "maxDepth": 2},), False, _CLASSES, space=_STAGES, weighted=True),
    Family("linear_svm", C.LinearSVC, ({"maxIter": 30},), True, space={"regParam": S.Real(1e-5, 1.0, True)}, weighted=True),
    Family("naive_bayes", C.NaiveBayes, ({"modelType": "gaussian"},), True, _CLASSES, weighted=True),
    Family("mlp", C.MultilayerPerceptronClassifier, ({"maxIter": 60, "seed": 7},), True, _CLASSES, 2_000_000),
    Family("factorization", C.FMClassifier, ({"maxIter": 30, "seed": 7, "stepSize": 0.05},), True, space={"stepSize": S.Real(0.01, 0.3, True), "factorSize": S.Whole(2, 16)}),
    Family("neighbours", Neighbours, ({"k": 15},), True, _CLASSES, 5_000_000, {"k": S.Whole(3, 60, True)}),
    Family("neighbours_regression", Neighbours, ({"k": 15, "task": "regression"},), True, ("regression",), 5_000_000, {"k": S.Whole(3, 60, True)}),
    Family("linear", R.LinearRegression, ({"regParam": 0.01}, {"regParam": 0.1, "elasticNetParam": 0.5}), True, ("regression",), space=_LINEAR, weighted=True),
    Family("tree_regression", R.DecisionTreeRegressor, ({"maxDepth": 5, "seed": 7, "maxBins": BINS},), False, ("regression",), space=_TREE, weighted=True),
    Family("generalized_linear", R.GeneralizedLinearRegression, ({"family": "gaussian", "regParam": 0.01},), True, ("regression",), space={"regParam": S.Real(1e-5, 1.0, True)}, weighted=True),
    Family("forest_regression", R.RandomForestRegressor, ({"numTrees": 20, "seed": 7, "maxBins": BINS},), False, ("regression",), space=_FOREST),
    Family("boosting_regression", R.GBTRegressor, ({"maxIter": 15, "seed": 7, "maxBins": BINS},), False, ("regression",), space=_BOOST, weighted=True),
)


#: Models of the library's own families.
OWN = (StagewiseModel, NeighboursModel)
_REGISTERED: list[Family] = []


def register(family: Family) -> None:
    """Add a family of one's own; it takes part in every later search for its tasks."""
    _REGISTERED.append(family)


def unregister(name: str) -> None:
    _REGISTERED[:] = [f for f in _REGISTERED if f.name != name]


def families_for(task: str, rows: int, families: tuple[Family, ...] = FAMILIES) -> list[Family]:
    return [f for f in (*families, *_REGISTERED) if task in f.tasks and (f.max_rows is None or rows <= f.max_rows)]


def encode_target(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str]]:
    """``df`` with ``label`` in place of the target, and the names of the classes (none for regression).

    Binary: 1 for the canonical positive token, else for the rarer of two values; more values are an error.
    Multiclass: the place among the values by frequency, the most frequent first."""
    known = df.where(F.col(target).isNotNull())
    if task == "regression":
        return known.withColumn("label", F.col(target).cast("double")).where("label IS NOT NULL").drop(*([target] if target != "label" else [])), []
    text = F.col(target).cast("string")
    text = F.lower(text) if task == "binary" else text
    most = 3 if task == "binary" else 201
    values = [r["v"] for r in known.groupBy(text.alias("v")).count().orderBy("count" if task == "binary" else F.col("count").desc(), "v").limit(most).collect()]
    if len(values) >= most:
        raise ValueError(f"{target} has {len(values)} values or more: not a {task} target")
    if task == "binary":
        positive = next((v for v in values if v in POSITIVE), values[0] if values else "")
        values = [*[v for v in values if v != positive], positive]
        values = values if len(values) == 2 else [f"not {positive}", positive]
        label = (text == F.lit(positive)).cast("double")
    else:
        label = F.array_position(F.lit(values), text).cast("double") - 1
    return known.withColumn("label", label).drop(*([target] if target != "label" else [])), values


def log_companions(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns for which log1p is a feature too: over 30 finite values, none negative, skewness over 2."""
    if not columns:
        return []
    value = lambda c: F.col(f"`{c}`").cast("double")
    r = df.agg(*[x for c in columns for x in (F.count(value(c)).alias(f"{c}__c"), F.min(value(c)).alias(f"{c}__lo"), F.max(value(c)).alias(f"{c}__hi"), F.skewness(value(c)).alias(f"{c}__s"))]).first()
    return [c for c in columns if r[f"{c}__c"] > 30 and r[f"{c}__lo"] >= 0 and r[f"{c}__hi"] > 0 and (r[f"{c}__s"] or 0) > 2]


def frequent_levels(df: DataFrame, columns: list[str], levels: int = LEVELS) -> dict[str, list[str]]:
    """By column its most frequent values, all columns in one exchange; a null is the level ``(nulo)``."""
    if not columns:
        return {}
    from .profile import value_counts

    filled = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NO_VALUE)).alias(c) for c in columns])
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in value_counts(filled, columns).withColumn("place", place).where(F.col("place") <= levels).orderBy("column", "place").collect():
        found[r["column"]].append(r["value"])
    return found


@dataclass
class Features:
    """What the train window says about the columns: fixed expressions and one fitted pipeline give two vectors.

    ``features`` is for trees: numbers, log companions, a nominal code a category (its ``CODES`` most frequent levels, one more for
    levels not seen), text components. ``scaled`` is for linear models: the same numbers and components and a mark for each of the most frequent
    levels, standardised. ``names`` and ``tree_names`` are those of the vectors' places; ``base_of`` gives the column behind a place."""

    numeric: list[str]
    logs: list[str]
    levels: dict[str, list[str]]
    text: list[str]
    names: list[str] = field(default_factory=list)
    pipeline: PipelineModel | None = None
    tree_names: list[str] = field(default_factory=list)
    codes: dict[str, list[str]] = field(default_factory=dict)
    texts: dict[str, TextModel] = field(default_factory=dict)
    times: list[str] = field(default_factory=list)  # those of ``numeric`` that are seconds since 1970

    def prepared(self, df: DataFrame) -> DataFrame:
        named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NO_VALUE))
        number = lambda c: F.unix_timestamp(F.col(f"`{c}`").cast("timestamp")).cast("double") if c in self.times else F.col(f"`{c}`").cast("double")
        made = [F.log1p(F.greatest(F.col(f"`{c}`").cast("double"), F.lit(0.0))).alias(f"{c}__log") for c in self.logs]
        made += [(named(c) == F.lit(v)).cast("double").alias(f"{c}={i}") for c, vs in self.levels.items() for i, v in enumerate(vs)]
        made += [named(c).alias(f"{c}__level") for c in self.codes]
        made += [array_to_vector(m.projected(F.col(f"`{c}`").cast("string"))).alias(f"{c}__p") for c, m in self.texts.items()]
        return df.select("*", *[F.when(V.is_finite(number(c)), number(c)).alias(f"{c}__n") for c in self.numeric], *made)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(self.prepared(df))

    def code(self, column: str) -> Column:
        """The column's code for trees; null where the level was not among the coded ones."""
        place = F.array_position(F.lit(self.codes[column]), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(NO_VALUE)))
        return F.when(place > 0, place - 1)


def base_of(name: str) -> str:
    """The column behind a feature: ``x__log``, ``x=value`` and ``x__txt3`` are all ``x``."""
    for mark in ("__log", "__txt", "__n"):
        at = name.rfind(mark)
        if at > 0 and (mark == "__txt" or name.endswith(mark)):
            return name[:at]
    return name.partition("=")[0]


def fit_features(df: DataFrame, text: list[str] = (), levels: int = LEVELS, vocabulary: int = 400, components: int = 24) -> Features:
    """Fit on the train window: medians and scales, levels and codes of categories, log companions, texts as TF-IDF projected by a truncated SVD."""
    kinds = {f.name: V.kind_of(f.dataType) for f in df.schema if f.name not in ("label", "split", *text)}
    times = [c for c, k in kinds.items() if k == "datetime"]
    numeric = [c for c, k in kinds.items() if k in ("numeric", "boolean", "datetime")]
    categories = [c for c, k in kinds.items() if k == "categorical"]
    codes = frequent_levels(df, categories, CODES)
    texts = {c: m for c in text if (m := fit_text(df, c, vocabulary, components)) is not None}
    out = Features(numeric, log_companions(df, [c for c in numeric if kinds[c] == "numeric"]), {c: vs[:levels] for c, vs in codes.items()}, list(text), codes=codes, texts=texts, times=times)
    numbers = [f"{c}__n" for c in numeric] + [f"{c}__log" for c in out.logs]
    marks = [f"{c}={i}" for c, vs in out.levels.items() for i in range(len(vs))]
    projected = [f"{c}__p" for c in texts]
    stages: list = []
    if numbers:
        stages += [X.Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}__i" for c in numbers])]
    coded = [c for c in codes if codes[c]]
    stages += [X.StringIndexerModel.from_labels(codes[c], f"{c}__level", f"{c}__code", "keep") for c in coded]
    stages += [X.VectorSizeHint(inputCol=f"{c}__p", size=m.dimensions, handleInvalid="optimistic") for c, m in texts.items()]
    filled = [f"{c}__i" for c in numbers]
    stages += [
        X.VectorAssembler(inputCols=[*filled, *[f"{c}__code" for c in coded], *projected], outputCol="features", handleInvalid="keep"),
        X.VectorAssembler(inputCols=[*filled, *marks, *projected], outputCol="__linear", handleInvalid="keep"), X.StandardScaler(inputCol="__linear", outputCol="scaled", withMean=True),
    ]
    out.pipeline = Pipeline(stages=stages).fit(out.prepared(df))
    plain, parts = [c.removesuffix("__n") for c in numbers], [f"{c}__txt{i}" for c, m in texts.items() for i in range(m.dimensions)]
    out.tree_names = [*plain, *coded, *parts]
    out.names = [*plain, *[f"{c}={v}" for c, vs in out.levels.items() for v in vs], *parts]
    return out


@dataclass
class Trained:
    task: str
    classes: list[str]
    features: Features
    models: dict[str, object]
    champion: str
    members: list[str]
    leaderboard: list[dict] = field(default_factory=list)
    holdout: dict = field(default_factory=dict)
    calibrator: object | None = None
    smearing: float | None = None  # set where the model predicts log1p of the target
    threshold: float = 0.5

    def _raw(self, df: DataFrame) -> DataFrame:
        out = df if {"features", "scaled", "__half"} <= set(df.columns) else self.features.transform(df)
        for i, m in enumerate(self.members):
            scored = self.models[m].transform(out)
            given = vector_to_array("probability") if self.task != "regression" and "probability" in scored.columns else None
            if self.task != "regression" and given is None:  # a margin: its logistic
                margin = vector_to_array("rawPrediction")[1]
                given = F.array(1 / (1 + F.exp(margin)), 1 / (1 + F.exp(-margin)))
            out = scored.withColumn(f"__m{i}", F.col("prediction") if given is None else given).drop("probability", "rawPrediction", "prediction")
        return out

    def score(self, df: DataFrame, shares: bool = False) -> DataFrame:
        """``df`` with ``prob`` (binary), ``prediccion`` and, for classes, ``confianza``: the mean of the champion's members. With ``shares``
        several classes also get ``probs``, an array in the order of ``classes``."""
        out, n = self._raw(df), len(self.members)
        parts = [F.col(f"__m{i}") for i in range(n)]
        if self.task == "regression":
            mean = sum(parts[1:], parts[0]) / n
            guess = mean
            if self.smearing is not None:
                guess = F.greatest(F.exp(F.least(mean, F.lit(700.0))) * F.lit(self.smearing) - 1, F.lit(0.0))
            return out.withColumn("prediccion", guess).select(*df.columns, "prediccion")
        mean = F.array(*[sum((p[k] for p in parts[1:]), parts[0][k]) / n for k in range(len(self.classes))])
        out = out.withColumn("__mean", mean)
        if self.task == "multiclass":
            best = F.array_position("__mean", F.array_max("__mean")).cast("int")
            return out.withColumns({"prediccion": F.element_at(F.lit(self.classes), best), "confianza": F.array_max("__mean")}).select(*df.columns, "prediccion", "confianza", *[F.col("__mean").alias("probs")] * shares)
        out = out.withColumn("prob", F.col("__mean")[1])
        if self.calibrator is not None:
            out = self.calibrator.transform(out.withColumn("__x", F.col("prob"))).withColumn("prob", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)))
        return out.select(*df.columns, "prob", (F.col("prob") >= F.lit(self.threshold)).alias("prediccion"), F.abs(F.col("prob") - F.lit(self.threshold)).alias("confianza"))

    def score_records(self, spark: SparkSession, records: list[dict]) -> list[dict]:
        """Predictions for a few rows given as dictionaries; columns that are missing are null."""
        names = [*self.features.numeric, *self.features.levels, *self.features.text]
        numbers = [n for n in self.features.numeric if n not in self.features.times]
        schema = T.StructType([T.StructField(n, T.DoubleType() if n in numbers else T.StringType()) for n in names])
        rows = [tuple(None if r.get(n) is None else float(r[n]) if n in numbers else str(r[n]) for n in names) for r in records]
        return [r.asDict() for r in self.score(spark.createDataFrame(rows, schema).coalesce(1)).collect()]

    def importance(self) -> dict[str, float]:
        """Share of each column in the members' own importances (splits of trees, sizes of coefficients)."""
        total: dict[str, float] = {}
        for m in self.members:
            model = self.models[m]
            names = self.features.names if model.getFeaturesCol() == "scaled" else self.features.tree_names
            if isinstance(model, StagewiseModel):
                sizes = model.sizes
            elif hasattr(model, "featureImportances"):
                sizes = model.featureImportances.toArray()
            elif hasattr(model, "coefficientMatrix"):
                sizes = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
            elif hasattr(model, "coefficients"):
                sizes = np.abs(model.coefficients.toArray())
            else:
                continue
            for name, size in zip(names, sizes / (sizes.sum() or 1.0), strict=False):
                total[base_of(name)] = total.get(base_of(name), 0.0) + float(size) / len(self.members)
        return dict(sorted(total.items(), key=lambda kv: (-kv[1], kv[0])))

    def shap(self, df: DataFrame) -> DataFrame | None:
        """``column, mean_abs, direction`` by exact path-dependent Shapley values of the champion's first tree model over all rows of
        ``df``; None if no member is made of trees. Binary and multiclass values are of the last class (boosting: of the margin)."""
        for m in self.members:
            model = self.models[m]
            forest = model.forest if isinstance(model, StagewiseModel) else None if isinstance(model, OWN) else trees.exported(model, df.sparkSession)
            if forest is not None:
                output = forest.trees[0].value.shape[1] - 1
                return trees.shap_summary(self.features.transform(df), forest, self.features.tree_names, base_of, self.features.codes, output=output)
        return None

    def save(self, path: str, spark: SparkSession) -> None:
        """A folder with the fitted pipeline, the champion's members and a card."""
        self.features.pipeline.write().overwrite().save(f"{path}/features")
        for m in self.members:
            if isinstance(self.models[m], OWN):
                self.models[m].save_to(f"{path}/models/{m}", spark)
            else:
                self.models[m].write().overwrite().save(f"{path}/models/{m}")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")
        f = self.features
        card = {
            "task": self.task, "classes": self.classes, "champion": self.champion, "members": self.members, "leaderboard": self.leaderboard, "holdout": self.holdout, "smearing": self.smearing, "threshold": self.threshold,
            "features": {"numeric": f.numeric, "logs": f.logs, "levels": f.levels, "text": f.text, "names": f.names, "tree_names": f.tree_names, "codes": f.codes, "times": f.times},
            "texts": {c: m.__dict__ for c, m in f.texts.items()}, "kinds": {m: type(self.models[m]).__module__ + "." + type(self.models[m]).__name__ for m in self.members},
            "calibrated": self.calibrator is not None,
        }
        spark.createDataFrame([(json.dumps(card),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/card")


def read_card(path: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(f"{path}/card").first()[0])


def load(path: str, spark: SparkSession) -> Trained:
    """The model that ``save`` left at ``path``, ready to score."""
    card = read_card(path, spark)
    texts = {c: TextModel(**m) for c, m in card["texts"].items()}
    features = Features(pipeline=PipelineModel.load(f"{path}/features"), texts=texts, **card["features"])
    models = {}
    for m, kind in card["kinds"].items():
        module, _, name = kind.rpartition(".")
        if own := next((k for k in OWN if k.__name__ == name), None):
            models[m] = own.load_from(f"{path}/models/{m}", spark)
            continue
        models[m] = getattr(importlib.import_module(module), name).load(f"{path}/models/{m}")
    calibrator = R.IsotonicRegressionModel.load(f"{path}/calibrator") if card["calibrated"] else None
    return Trained(card["task"], card["classes"], features, models, card["champion"], card["members"], card["leaderboard"], card["holdout"], calibrator, card["smearing"], card["threshold"])


def list_cards(root: str, spark: SparkSession) -> list[tuple[str, dict]]:
    """The models below a folder, with their cards."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/card")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    paths = sorted(str(f.getPath().getParent().toString()) for f in found)
    return [(p, read_card(p, spark)) for p in paths]


def delete(path: str, spark: SparkSession) -> None:
    """Remove a saved model; a folder without a card is refused."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/card")):
        raise ValueError(f"{path} is not a saved model")
    fs.delete(where, True)


def measured(scored: DataFrame, task: str, classes: list[str], threshold: float | None = 0.5) -> dict:
    """The task's metrics of scored rows that have ``label`` (and, if they are stacked, ``__n``). Where they take several passes the rows are scored once."""
    if task != "regression":
        scored = settled(scored.select(*[c for c in ("label", "prob", "prediccion", "probs", "__n") if c in scored.columns]))
    scored = unstacked(scored)
    if task == "binary":
        return E.binary_metrics(scored, "prob", F.col("label") == 1, threshold).first().asDict()
    if task == "multiclass":
        named = scored.withColumn("__truth", F.element_at(F.lit(classes), F.col("label").cast("int") + 1))
        found = E.multiclass_metrics(named, "__truth", "prediccion").first().asDict()
        return found | E.multiclass_probability_metrics(named, "__truth", classes, "probs").first().asDict() if "probs" in scored.columns else found
    return E.regression_metrics(scored, "label", "prediccion").first().asDict()


def stacked(rows: DataFrame) -> DataFrame | None:
    """``rows`` with alike ones kept once and their number in ``__n``, up to ``STACK``; None where there are not ``MANY`` rows or too few are alike."""
    if any(T.MapType.typeName() in f.dataType.simpleString() or f.dataType.typeName() == "variant" for f in rows.schema):
        return None
    columns = [F.col(f"`{c}`") for c in rows.columns]
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*columns)).alias("kinds")).first()
    if r["n"] < MANY or r["kinds"] > ALIKE * r["n"]:
        return None
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__all"))
    dealt = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("__all") - 1) / STACK))).alias("__i"))
    made = dealt.withColumn("__n", F.least(F.lit(STACK), F.col("__all") - F.col("__i") * STACK).cast("int")).drop("__all", "__i")
    return made.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, r["kinds"] // 500_000))


def unstacked(df: DataFrame) -> DataFrame:
    """Every row as often as its ``__n`` says."""
    return df.withColumn("__i", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).drop("__i", "__n") if "__n" in df.columns else df


def wants_log(df: DataFrame) -> bool:
    """Is a regression target better predicted by its logarithm: 50 rows or more, none negative, skewness over 1.5."""
    r = df.agg(F.count("label").alias("n"), F.min("label").alias("lo"), F.skewness("label").alias("s")).first()
    return r["n"] >= 50 and r["lo"] >= 0 and (r["s"] or 0) > 1.5


def detached(model, spark: SparkSession):
    """A fitted model without its training summary. The summary of a two-class fit holds the session, and a session that has run jobs
    with tags cannot be serialised with the model's functions."""
    if isinstance(model, OWN) or not getattr(model, "hasSummary", False):
        return model
    path = new_folder(spark, "fitted")
    model.write().save(path)
    again = type(model).load(path)
    removed(spark, path)
    return again


def train(
    df: DataFrame, target: str, task: str, text: list[str] = (), families: tuple[Family, ...] = FAMILIES, ensemble: int = 3, log_target: bool | None = None, prune: bool = False,
    trials: int = 0, seed: int = 7, shares: tuple[float, ...] = (1.0,),
) -> Trained:
    """``df`` has ``split``. Every family is fitted on the train window and compared on the selection window by the task's primary
    metric; the mean of the best ``ensemble`` competes too; the champion is measured once on the holdout.

    With ``trials``, a family with a ``space`` is searched (``search``): its first parameters, then as many suggestions as make
    ``trials``, halved over growing ``shares`` of the train window. Alike rows of a large table are encoded, fitted as weights and scored
    once; they count as many times as they occur."""
    rows, classes = encode_target(df, target, task)
    named = [F.col(f"`{c}`") for c in rows.columns if c != "label"]
    alike = None
    if not text:  # texts are read again rather than copied
        rows = settled(rows) if task == "regression" else rows  # classes were counted in a pass of their own
        alike = stacked(rows)
        rows = rows if alike is None and task == "regression" else settled(rows if alike is None else alike)
    train_rows = unstacked(rows.where("split = 'train'"))
    features = fit_features(train_rows, text)
    in_log = task == "regression" and (wants_log(train_rows) if log_target is None else log_target)
    metric = E.PRIMARY[task]
    half = F.pmod(F.xxhash64(*named), F.lit(2))
    number = [] if alike is None else ["__n"]
    ready = settled(features.transform(rows.withColumn("__half", half)).withColumn("__y", F.log1p("label") if in_log else F.col("label")).select("label", "__y", "__half", "split", "features", "scaled", *number))
    stacks = ready.where("split = 'train'")
    fit_rows = unstacked(stacks)
    size = fit_rows.count()
    selection = ready.where("split = 'selection'")  # encoded already: scoring them makes no features again
    models: dict[str, object] = {}
    board: list[dict] = []

    def candidate(name: str, members: list[str]) -> Trained:
        out = Trained(task, classes, features, models, name, members)
        if in_log:
            guess = out._raw(stacks).withColumn("__g", sum((F.col(f"__m{i}") for i in range(1, len(members))), F.col("__m0")) / len(members))
            out.smearing = smearing_factor(unstacked(guess.select("label", "__g", *number)), "label", "__g")
        return out

    higher = E.CATALOGUE[metric][0] == "higher"

    def tried(family: Family, name: str, params: dict, share: float = 1.0) -> float | None:
        more = {"layers": [len(features.names), 16, len(classes)]} if family.make is C.MultilayerPerceptronClassifier else {}
        given = fit_rows if share >= 1 else fit_rows.sample(False, share, seed)
        if alike is not None and family.weighted and not trials:  # a search varies the least number of rows, and draws rows
            given, more = stacks, {"weightCol": "__n"}
        made = family.make(featuresCol="scaled" if family.scaled else "features", labelCol="__y", **params, **more)
        models[name] = detached(made.fit(given), df.sparkSession)
        return measured(candidate(name, [name]).score(selection), task, classes)[metric]

    for family in families_for(task, size, families):
        if trials and family.space:
            params, table = S.search(lambda p, share, f=family: tried(f, f.name, p, share), family.space, family.grid[0], higher, trials, seed, shares)
            board.append({"model": family.name, metric: tried(family, family.name, params), "params": params, "trials": len(table)})
            continue
        for i, params in enumerate(family.grid):
            name = family.name if not i else f"{family.name}_{i}"
            board.append({"model": name, metric: tried(family, name, params)})
    sign = -1 if higher else 1
    board.sort(key=lambda r: (r[metric] is None, sign * (r[metric] or 0), r["model"]))
    best = [r["model"] for r in board[:ensemble]]
    champion = candidate(board[0]["model"], best[:1])
    if len(best) > 1:
        mean = candidate("ensemble", best)
        board.append({"model": "ensemble", metric: measured(mean.score(selection), task, classes)[metric]})
        if E.better(metric, board[-1][metric], board[0][metric]):
            champion = mean
    champion.leaderboard = board
    if task == "binary":
        champion.calibrator = _calibrated(champion, selection)
    champion.holdout = measured(champion.score(ready.where("split = 'holdout'"), shares=True), task, classes, None)
    if prune:
        return _pruned(champion, df, target, text, families, ensemble, log_target, trials=trials, seed=seed, shares=shares)
    return champion


def _pruned(model: Trained, df: DataFrame, target: str, text: list[str], families: tuple[Family, ...], ensemble: int, log_target: bool | None, share: float = 0.995, least: int = 5, loss: float = 0.002, **searched) -> Trained:
    """The model without the columns behind the last 0.5 % of importance, if it loses no more than ``loss`` on the selection window."""
    ranked, kept, total = model.importance(), [], 0.0
    for column, size in ranked.items():
        if total < share or len(kept) < least:
            kept.append(column)
        total += size
    dropped = [c for c in ranked if c not in kept]
    if not dropped:
        return model
    smaller = train(df.drop(*dropped), target, model.task, [t for t in text if t in kept], families, ensemble, log_target, **searched)
    metric = E.PRIMARY[model.task]
    best = lambda m: next(r[metric] for r in m.leaderboard if r["model"] == m.champion)
    worse = best(model) - best(smaller) if E.CATALOGUE[metric][0] == "higher" else best(smaller) - best(model)
    return smaller if worse <= loss else model


def train_binary(df: DataFrame, target: str, text: list[str] = (), families: tuple[Family, ...] = FAMILIES, ensemble: int = 3) -> Trained:
    return train(df, target, "binary", text, families, ensemble)


def _calibrated(model: Trained, selection: DataFrame):
    """Isotonic calibration, fitted on one ``__half`` of the selection window and kept only if it lowers the error on the other."""
    number = [c for c in selection.columns if c == "__n"]
    scored = settled(model.score(selection).select("label", F.col("prob").alias("__x"), "__half", *number))
    iso = R.IsotonicRegression(featuresCol="__x", labelCol="label", **({"weightCol": "__n"} if number else {})).fit(scored.where("__half = 0"))
    other = unstacked(scored.where("__half = 1"))
    error = lambda d, c: E.expected_calibration_error(d, c, F.col("label") == 1).first()["ece"]
    after, before = error(iso.transform(other), "prediction"), error(other, "__x")
    return iso if after is not None and before is not None and after < before else None


def permutation_importance(model: Trained, df: DataFrame, columns: list[str], key: str, repeats: int = 1) -> DataFrame:
    """How much worse the task's primary metric is when one column's values are dealt to other rows (by hash order of ``key``).

    The rows are numbered once in one order and once a repeat in another; a column is exchanged by joining the two numbers."""
    metric = E.PRIMARY[model.task]
    sign = 1 if E.CATALOGUE[metric][0] == "higher" else -1
    base = measured(model.score(df), model.task, model.classes)[metric]
    left = row_numbers(df, [F.xxhash64(F.col(key), F.lit(0)), F.col(key)], "__row")
    drops = dict.fromkeys(columns, 0.0)
    for repeat in range(1, repeats + 1):
        right = row_numbers(df.select(key, *columns), [F.xxhash64(F.col(key), F.lit(repeat)), F.col(key)], "__row")
        both = settled(left.join(right.select("__row", *[F.col(f"`{c}`").alias(f"__other_{c}") for c in columns]), "__row"))
        for c in columns:
            shuffled = both.select(*[F.col(f"`__other_{c}`").alias(c) if n == c else F.col(f"`{n}`") for n in df.columns])
            drops[c] += sign * (base - measured(model.score(shuffled), model.task, model.classes)[metric]) / repeats
    return df.sparkSession.createDataFrame([(c, float(d)) for c, d in drops.items()], "column string, drop double")


def conditional_effects(model: Trained, df: DataFrame, column: str, levels: int = 10) -> DataFrame:
    """Mean prediction by level of a category or tenth of a number: the direction in which a column moves the prediction."""
    value = "prob" if model.task == "binary" else "prediccion"
    scored = model.score(df)
    if V.kind_of(df.schema[column].dataType) == "numeric":
        from .profile import exact_quantiles

        edges = sorted({q for q in exact_quantiles(df, [column], [i / levels for i in range(1, levels)])[column] if q is not None})
        level = F.size(F.filter(F.lit(edges), lambda e: e <= F.col(f"`{column}`"))).cast("string") if edges else F.lit("0")
    else:
        named = frequent_levels(df, [column], levels)[column]
        level = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(NO_VALUE))
        level = F.when(level.isin(named), level).otherwise("(otros)")
    return scored.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def smearing_factor(df: DataFrame, truth: str, log_guess: str) -> float:
    """Duan's factor for predictions of log1p(truth), within [0.2, 5]."""
    f = df.agg(F.avg(F.exp(F.log1p(truth) - F.col(log_guess)))).first()[0]
    return min(5.0, max(0.2, f if f is not None else 1.0))


def verdict(auc: float | None = None, ece: float | None = None, gap: float | None = None, bias: float | None = None) -> list[str]:
    """Remarks on a model, by fixed thresholds."""
    said = [] if auc is None else ["suspiciously good: look for leakage" if auc >= 0.99 else "strong" if auc >= 0.85 else "useful" if auc >= 0.70 else "weak"]
    said += ["poorly calibrated"] if (ece or 0) > 0.05 else []
    said += ["biased: totals are off"] if abs(bias or 0) > 0.05 else []
    return said + (["overfitted: selection and holdout differ"] if abs(gap or 0) > 0.05 else [])


def judged(model: Trained) -> list[str]:
    """``verdict`` on a trained model: its holdout figures and the gap between selection and holdout."""
    metric = E.PRIMARY[model.task]
    chosen = next((r[metric] for r in model.leaderboard if r["model"] == model.champion), None)
    held = model.holdout.get(metric)
    return verdict(model.holdout.get("auc"), model.holdout.get("ece"), None if chosen is None or held is None else chosen - held, model.holdout.get("bias"))


def explained(model: Trained, permuted: dict[str, float], effects: dict[str, str] | None = None, top: int = 5) -> list[str]:
    """One sentence a column, by the mean of its places in the models' own importances and in the permuted ones."""
    own = list(model.importance())
    by_drop = sorted(permuted, key=lambda c: (-permuted[c], c))
    place = lambda names, c: names.index(c) if c in names else len(names)
    ranked = sorted(set(own) | set(permuted), key=lambda c: (place(own, c) + place(by_drop, c), c))
    said = []
    for c in ranked[:top]:
        drop = permuted.get(c)
        weight = "carries the prediction" if (drop or 0) > 0.05 else "contributes" if (drop or 0) > 0.005 else "matters little"
        said.append(f"{c} {weight}" + (f"; {effects[c]}" if effects and c in effects else ""))
    return said
