"""TRAIN on rows that repeat."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from quern.engine import Engine
from quern.functions import models


@pytest.fixture
def repeated(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(20)), float(rng.randrange(5)), rng.random()) for _ in range(4_000)]
    rows = [(a, b, int(a - 3 * b + 8 * noise > 6)) for a, b, noise in rows]
    spark.createDataFrame(rows, "a double, b double, label int").createOrReplaceTempView("repeated")
    return rows


@pytest.mark.parametrize("algorithm", sorted(models.ALGORITHMS))
def test_fit_sees_each_different_row_once(spark, tmp_path, monkeypatch, repeated, algorithm):
    seen, plain = [], models.ALGORITHMS[algorithm]

    def spied(n):
        learner = plain(n)
        fit = learner.fit
        monkeypatch.setattr(learner, "fit", lambda df: seen.append((n, df.count())) or fit(df), raising=False)
        return learner

    monkeypatch.setitem(models.ALGORITHMS, algorithm, spied)
    Engine(spark).sql(f"TRAIN MODEL {algorithm} FROM repeated INTO '{tmp_path}/m'")
    assert seen == [(len(repeated), len(set(repeated)))]


def test_trees_are_those_of_all_rows(spark, tmp_path, repeated):
    Engine(spark).sql(f"TRAIN MODEL GBTClassifier FROM repeated INTO '{tmp_path}/m'")
    meta = models.described(spark, f"{tmp_path}/m")
    every = models.ALGORITHMS["GBTClassifier"](1).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.table("repeated")))
    assert meta["rows"] == len(repeated) and meta["weights"] == list(every.treeWeights)

    def value(node, row):
        return node if isinstance(node, float) else value(node[2] if row[node[0]] <= node[1] else node[3], row)

    trees = [models._tree(t._java_obj.rootNode()) for t in every.trees]
    for row in {r[:2] for r in repeated}:
        assert [value(t, row) for t in meta["trees"]] == pytest.approx([value(t, row) for t in trees], abs=1e-6)


def test_linear_optimum_counts_copies(spark, tmp_path, repeated):
    Engine(spark).sql(f"TRAIN MODEL LogisticRegression FROM repeated INTO '{tmp_path}/m'")
    meta = models.described(spark, f"{tmp_path}/m")
    x, y = np.array([r[:2] for r in repeated]), np.array([r[2] for r in repeated])
    w, c = np.array(meta["coefficients"]), np.array(meta["intercepts"])
    p = np.exp(x @ w.T + c)
    p /= p.sum(1, keepdims=True)
    assert np.abs((p - np.eye(2)[y]).T @ x + w).max() / len(x) < 1e-4


_TWO, _ALL = [(1.0, 1)] * 4 + [(2.0, 0)] * 4, [(0.5 * k, k % 2) for k in range(40)]


@pytest.mark.parametrize("algorithm, rows", [("GBTClassifier", [(1.0, 1)] * 4), ("GBTClassifier", _TWO), ("GBTClassifier", _ALL), ("LogisticRegression", _TWO), ("LogisticRegression", _ALL)])
def test_few_or_no_repeats(spark, tmp_path, algorithm, rows):
    spark.createDataFrame(rows, "a_rows double, label int").createOrReplaceTempView("few")
    e = Engine(spark)
    e.sql(f"TRAIN MODEL {algorithm} FROM few INTO '{tmp_path}/m'")
    assert models.described(spark, f"{tmp_path}/m")["rows"] == len(rows)
    e.sql(f"REGISTER MODEL {algorithm} FROM '{tmp_path}/m' AS of_few")
    got = [r[0] for r in spark.sql("SELECT of_few(struct(a_rows)) FROM few").collect()]
    assert len(rows) == 40 or got == [y for _, y in rows]
