"""Boosting equals a plain numpy version; predictors of exported models equal the models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees
from tidemark.operators.trees import Boosting, Model, Tree

NAMES = ("a", "b", "c")
RULES = Boosting(rounds=6, rate=0.3, depth=3, least=9, l2=2.0, bins=8)


def data(n, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c = rng.gauss(0, 1), float(rng.randint(0, 3)), rng.uniform(-2, 2)
        out.append((a, b, c, (a > 0.2) * 1.5 - (b == 2) * 1.0 + c * c / 4 + rng.gauss(0, 0.3), rng.choice([0.5, 1.0, 2.0])))
    return out


def plain(x, y, w, edges, rules, classifier):
    """Levels of splits on binned values, one after the other."""
    bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
    mean = (w * y).sum() / w.sum()
    f = np.full(len(y), math.log(mean / (1 - mean)) if classifier else mean)
    for _ in range(rules.rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = ((p - y) * w, p * (1 - p) * w) if classifier else ((f - y) * w, w)
        step = np.zeros(len(y))
        groups = [np.arange(len(y))]
        for _ in range(rules.depth):
            deeper = []
            for rows in groups:
                best = (0.0, None)
                score = lambda k: g[k].sum() ** 2 / (h[k].sum() + rules.l2)  # noqa: B023, E731
                for i in range(x.shape[1]):
                    for b in range(rules.bins):
                        left = bins[rows, i] <= b
                        k, m = rows[left], rows[~left]
                        if min(len(k), len(m)) < rules.least or min(h[k].sum(), h[m].sum()) < rules.least_hessian:
                            continue
                        gain = round(score(k) + score(m) - score(rows), 9)
                        if gain > best[0]:
                            best = (gain, (k, m))
                if best[1]:
                    for k in best[1]:
                        step[k] = -rules.rate * g[k].sum() / (h[k].sum() + rules.l2)
                    deeper += best[1]
            groups = deeper
        f = f + step
    return 1 / (1 + np.exp(-f)) if classifier else f


@pytest.mark.parametrize("classifier", [False, True])
@pytest.mark.parametrize("weighted", [False, True])
def test_boosting_equals_numpy(spark, monkeypatch, classifier, weighted):
    monkeypatch.setattr(trees, "WRITTEN", 4)
    rows = data(240)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(900, None, 1.0, 1.0, 1.0, 1.0), (901, 1.0, 1.0, float("nan"), 1.0, 1.0), (902, 1.0, 1.0, 1.0, None, 1.0)], "id int, a double, b double, c double, y double, w double").repartition(3)
    model = trees.boost(df, NAMES, "y", classifier, "w" if weighted else None, RULES)
    x = np.array([r[:3] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    edges = []
    for i in range(3):
        v = np.sort(z[:, i])
        at = [v[max(0, math.ceil(k / RULES.bins * len(v)) - 1)] for k in range(1, RULES.bins)]
        edges.append(sorted({q for q in at if q < v[-1]}))
    y, w = np.array([r[3] for r in rows]), np.array([r[4] if weighted else 1.0 for r in rows])
    want = plain(z, (y > 0).astype(float) if classifier else y, w, edges, RULES, classifier)
    got = {r.id: r.p for r in df.select("id", trees.predicted(model).alias("p")).collect()}
    assert np.allclose([got[i] for i in range(240)], want, rtol=0, atol=1e-9)
    assert got[900] is None and got[901] is None and got[902] is not None
    assert len(model.trees) == 6 and max(t.depth() for t in model.trees) == 3
    again = Model.from_json(model.to_json())
    assert again == model


def test_nothing_to_split_and_nothing_to_learn(spark):
    df = spark.createDataFrame([(float(i), 1.0, 2.0, 3.0) for i in range(30)], "a double, b double, c double, y double")
    model = trees.boost(df, NAMES, "y", rules=RULES)
    assert model.trees == [] and df.select(trees.predicted(model).alias("p")).distinct().collect()[0].p == 3.0
    with pytest.raises(ValueError):
        trees.boost(df.limit(0), NAMES, "y")
    one = trees.boost(df, NAMES, "y", classifier=True, rules=RULES)
    assert one.trees == [] and df.select(trees.predicted(one).alias("p")).first().p == pytest.approx(1.0)


def test_sums_do_not_hang_on_partitions(spark):
    df = spark.createDataFrame(data(300, 5), "a double, b double, c double, y double, w double")
    one, many = (trees.boost(df.repartition(n), NAMES, "y", rules=RULES) for n in (1, 7))
    assert [(t.feature, t.left, t.right) for t in one.trees] == [(t.feature, t.left, t.right) for t in many.trees]
    assert np.allclose([v for t in one.trees for v in t.value], [v for t in many.trees for v in t.value])


def test_exported_forest_equals_the_model(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame(data(400, 7), "a double, b double, c double, y double, w double").withColumn("label", (F.col("y") > 0.5).cast("double"))
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(df)
    fitted = RandomForestClassifier(numTrees=12, maxDepth=4, minInstancesPerNode=10, seed=3).fit(vectors)
    model = trees.forest_model(spark, fitted, NAMES)
    assert len(model.trees) == 12
    both = fitted.transform(vectors).select(vector_to_array("probability")[1].alias("p"), trees.predicted(model).alias("q")).collect()
    assert all(r.p == pytest.approx(r.q, abs=1e-12) for r in both)


def test_predictors_stay_in_column_expressions(spark):
    model = Model("forest", NAMES, [Tree([0, -1, -1], [0.1, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.0, 1.0, 2.0])], single=True)
    df = spark.createDataFrame([(0.1, 0.0, 0.0), (0.1000000001, 0.0, 0.0), (0.2, 0.0, 0.0), (None, 0.0, 0.0)], "a double, b double, c double")
    out = df.select(trees.predicted(model).alias("p"))
    assert [r.p for r in out.collect()] == [2.0, 2.0, 2.0, None]  # as a 32-bit number 0.1 is above 0.1
    assert "Python" not in out._jdf.queryExecution().toString()


LEAF = {"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "value": [1.0]}


@pytest.mark.parametrize(
    "harm",
    [
        {"kind": "other"}, {"names": ()}, {"names": ("a", "a")}, {"trees": []}, {"scale": (0.0,)}, {"center": (1.0, 2.0)}, {"baseline": float("inf")},
        {"trees": [LEAF | {"value": [float("nan")]}]}, {"trees": [LEAF | {"value": []}]}, {"trees": [LEAF | {"left": [0], "right": [0], "feature": [0]}]}, {"trees": [LEAF | {"left": [1]}]},
        {"trees": [{"feature": [3, -1, -1], "threshold": [0.0] * 3, "left": [1, -1, -1], "right": [2, -1, -1], "value": [0.0] * 3}]},
    ],
)
def test_unsound_models_are_refused(harm):
    with pytest.raises(ValueError):
        Model(**{"kind": "forest", "names": ("a",), "trees": [LEAF]} | harm)


def test_linear_scores(spark):
    df = spark.createDataFrame([(1.0, 4.0), (None, 1.0)], "a double, b double")
    args = {"a": 2.0, "b": -1.0}, 0.5, {"a": 0.0, "b": 2.0}, {"a": 1.0, "b": 4.0}
    assert [r.s for r in df.select(trees.linear(*args).alias("s")).collect()] == [2.0, None]
    assert df.select(trees.linear(*args, logistic=True).alias("s")).first().s == pytest.approx(1 / (1 + math.exp(-2)))
    with pytest.raises(ValueError):
        trees.linear({"a": 1.0}, 0.0, {"a": 0.0}, {"a": 0.0})
