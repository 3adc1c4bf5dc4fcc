"""TRAIN, REGISTER, PREDICT and PMML: linear models and boosted trees fitted by Spark ML and published as SQL functions, which Catalyst inlines and compiles."""

from __future__ import annotations

import json
import uuid
import xml.etree.ElementTree as ET

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.store import AnalysisError
from quern.plans.statements import DeployModel, Predict, RegisterModel, TrainModel

LABEL = "label"
#: Different rows of a task that trains.
_ROWS_A_TASK = 20_000
_FEATURES = (T.IntegerType, T.DoubleType, T.FloatType, T.ByteType, T.BooleanType, T.ShortType, T.LongType)


def _logistic(n: int):
    # sum of losses + half the squared weights, divided by the rows
    return LogisticRegression(family="multinomial", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=100, labelCol=LABEL)


ALGORITHMS = {
    "LogisticRegression": _logistic,
    "LinearSVC": lambda n: LinearSVC(regParam=1 / n, standardization=False, maxIter=100, labelCol=LABEL),
    "GBTClassifier": lambda n: GBTClassifier(maxIter=20, maxDepth=4, seed=1, labelCol=LABEL),
}


def _tree(node) -> list | float:
    """A tree of Spark ML as nested [feature, threshold, left, right], its leaves as numbers."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return [int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())]


def train(spark: SparkSession, s: TrainModel) -> DataFrame:
    """Fits on a query's rows (each once) and saves model and description below the path; the result is empty.

    Where rows repeat (at least twice on average), the fit sees each different row with the number of its copies as weight: the
    losses have the same sum, and the passes over the rows, dozens for linear models and a hundred for trees, become one.
    """
    if s.algorithm not in ALGORITHMS:
        raise AnalysisError(f"{s.algorithm} isn't an algorithm; there are {', '.join(ALGORITHMS)}")
    df = spark.sql(f"SELECT * FROM {s.relation}")
    names = [c for c in df.columns if c != LABEL]
    if LABEL not in df.columns or not names:
        raise AnalysisError(f"training rows need a column {LABEL} and features")
    for f in df.schema:
        if f.name != LABEL and not isinstance(f.dataType, _FEATURES):
            raise AnalysisError(f"{f.name}: {f.dataType.simpleString()} can't be a feature")
    numbers = df.select(*(F.col(c).cast("double").alias(c) for c in [*names, LABEL]))
    n, nulls, different = numbers.agg(F.count("*"), F.sum(F.when(sum((F.col(c).isNull().cast("int") for c in [*names, LABEL]), F.lit(0)) > 0, 1).otherwise(0)), F.approx_count_distinct(F.xxhash64(*numbers.columns))).first()
    if not n or nulls:
        raise AnalysisError(f"{nulls or 0} of {n} training rows have nulls" if n else "there are no training rows")
    learner, rows = ALGORITHMS[s.algorithm](n), numbers
    if 2 * different <= n:
        weight = max(numbers.columns, key=len) + "_rows"  # no feature's name
        learner.setWeightCol(weight)
        rows = numbers.groupBy(*numbers.columns).agg(F.count("*").cast("double").alias(weight)).repartition(-(-different // _ROWS_A_TASK)).persist()
    model = learner.fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    if rows is not numbers:
        rows.unpersist()
    model.write().overwrite().save(f"{s.path}/model")
    meta = {"algorithm": s.algorithm, "features": [[c, df.schema[c].dataType.simpleString()] for c in names], "rows": n}
    if s.algorithm == "GBTClassifier":
        meta |= {"trees": [_tree(t._java_obj.rootNode()) for t in model.trees], "weights": list(model.treeWeights)}
    elif s.algorithm == "LinearSVC":
        meta |= {"coefficients": [[0.0] * len(names), model.coefficients.toArray().tolist()], "intercepts": [0.0, model.intercept]}
    else:
        meta |= {"coefficients": model.coefficientMatrix.toArray().tolist(), "intercepts": model.interceptVector.toArray().tolist()}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{s.path}/meta")
    return spark.createDataFrame([], df.schema)


def described(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def _value(k: int) -> str:
    return f"coalesce(CAST(f.f{k} AS DOUBLE), 0D)"


def _linear_class(coefficients: list[list[float]], intercepts: list[float]) -> str:
    """The class of the best linear score, the lowest of equal ones."""
    scores = [" + ".join([f"{b!r}D", *(f"{w!r}D * {_value(k)}" for k, w in enumerate(row))]) for row, b in zip(coefficients, intercepts, strict=True)]
    best = lambda rest: rest[0] if len(rest) == 1 else f"greatest({', '.join(rest)})"
    return "CASE " + "".join(f"WHEN {scores[k]} >= {best(scores[k + 1 :])} THEN {k} " for k in range(len(scores) - 1)) + f"ELSE {len(scores) - 1} END"


def _boosted_class(trees: list, weights: list[float]) -> str:
    def sql(node) -> str:
        return f"{node!r}D" if isinstance(node, float) else f"if({_value(node[0])} <= {node[1]!r}D, {sql(node[2])}, {sql(node[3])})"

    return "if(" + " + ".join(f"{w!r}D * {sql(t)}" for t, w in zip(trees, weights, strict=True)) + " > 0D, 1, 0)"


def function_sql(name: str, meta: dict) -> str:
    """A SQL function over a struct of a described model's features; a null feature counts as 0."""
    fields = ", ".join(f"f{k}: {t}" for k, (_, t) in enumerate(meta["features"]))
    body = _boosted_class(meta["trees"], meta["weights"]) if "trees" in meta else _linear_class(meta["coefficients"], meta["intercepts"])
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(f STRUCT<{fields}>) RETURNS INT RETURN {body}"


def register(spark: SparkSession, s: RegisterModel) -> DataFrame:
    if s.algorithm not in ALGORITHMS:
        raise AnalysisError(f"{s.algorithm} isn't an algorithm; there are {', '.join(ALGORITHMS)}")
    spark.sql(function_sql(s.function, described(spark, s.path)))
    return spark.createDataFrame([], "function string")


def predict(spark: SparkSession, s: Predict) -> DataFrame:
    """A relation's rows with the class that a saved model gives them; its columns that the model names are the features."""
    meta, name = described(spark, s.path), "quern_predict_" + uuid.uuid4().hex[:8]
    if s.algorithm != meta["algorithm"]:
        raise AnalysisError(f"{s.path} holds a {meta['algorithm']}, not a {s.algorithm}")
    spark.sql(function_sql(name, meta))
    features = ", ".join(f"`{c}`" for c, _ in meta["features"])
    return spark.sql(f"SELECT *, {name}(struct({features})) AS {s.column} FROM {s.relation}")


def deploy(spark: SparkSession, s: DeployModel, registry: str = "quern_models") -> DataFrame:
    """Adds a row to the model registry, a table of what is deployed where."""
    row = spark.createDataFrame([(s.name, s.path, s.gateway, json.dumps(s.options))], "name string, path string, gateway string, options string")
    row.write.mode("append").saveAsTable(registry)
    return spark.table(registry)


def pmml_class(xml: str) -> tuple[Column, Column]:
    """(class, decision) of a chain of a linear regression and a softmax over it; null where an input is."""
    models = [m for m in ET.fromstring(xml).iter() if m.tag.rpartition("}")[2] == "RegressionModel"]
    child = lambda node, name: [c for c in node.iter() if c.tag.rpartition("}")[2] == name]
    linear = lambda table, cols: sum((F.lit(float(p.get("coefficient"))) * cols(p.get("name")) for p in child(table, "NumericPredictor")), F.lit(float(table.get("intercept", 0))))
    decision = linear(child(models[0], "RegressionTable")[0], lambda c: F.col(c).cast("double"))
    tables = child(models[1], "RegressionTable")
    scores = F.array(*(linear(t, lambda _: decision) for t in tables))
    classes = F.array(*(F.lit(int(t.get("targetCategory"))) for t in tables))
    return F.when(decision.isNotNull(), F.element_at(classes, F.array_position(scores, F.array_max(scores)).cast("int"))), decision
