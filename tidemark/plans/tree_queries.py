"""Queries of tree models and of predictors of exported models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded
from tidemark.operators import features, trees
from tidemark.operators.trees import Model, Tree
from tidemark.plans import sql
from tidemark.plans.price_queries import FEATURES
from tidemark.sources.bars import item_bars
from tidemark.sources.shared import fresh_folder


def _rows(spark, sf_dir):
    return features.assemble(item_bars(spark, sf_dir))


def ml_15_boosted(spark, sf_dir):
    """160 rounds on the training rows, and what the model says of all rows. Features, a row a bar, are written down once: learning reads them several times."""
    path = fresh_folder(spark, "features")
    _rows(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    label = F.when(F.col("period") == "train", F.col("target"))
    model = trees.boost(rows.withColumn("label", label), features.NAMES, "label", classifier=True)
    return rounded(rows.select("symbol", "ts", "period", "target", trees.predicted(model).alias("probability")))


def _model(kind, nodes, **more):
    """Trees as declared: (feature, threshold, left, right, value) a node."""
    return Model(kind, features.NAMES, [Tree(*map(list, zip(*t, strict=True))) for t in nodes], **more)


_LEAF = (-1, 0.0, -1, -1)
#: Declared models, which the queries score.
BOOSTED = _model("boosted", [
    [(2, 0.0, 1, 2, 0.0), (3, 0.5, 3, 4, 0.0), (*_LEAF, 0.2), (*_LEAF, -0.15), (0, -0.25, 5, 6, 0.0), (*_LEAF, 0.05), (*_LEAF, -0.3)],
    [(4, 0.75, 1, 2, 0.0), (*_LEAF, -0.1), (6, 0.0, 3, 4, 0.0), (*_LEAF, 0.125), (*_LEAF, 0.4)], [(*_LEAF, 0.01)],
], baseline=-0.05, classifier=True, center=(0.0, 0.0, 0.01, 0.2, 0.0, 1.0, 0.0), scale=(0.3, 0.3, 0.3, 0.1, 0.25, 0.5, 0.2))
FOREST = _model("forest", [
    [(1, 0.1, 1, 2, 0.0), (5, 0.9, 3, 4, 0.0), (*_LEAF, 0.62), (*_LEAF, 0.41), (*_LEAF, 0.55)], [(0, 0.05, 1, 2, 0.0), (*_LEAF, 0.48), (*_LEAF, 0.53)], [(6, -0.1, 1, 2, 0.0), (*_LEAF, 0.3), (4, 0.2, 3, 4, 0.0), (*_LEAF, 0.7), (*_LEAF, 0.65)],
], single=True)
WEIGHTS = dict(zip(features.NAMES, (0.4, -0.3, 0.2, 0.1, -0.25, 0.05, 0.6), strict=True))
CENTER = dict(zip(features.NAMES, (0.01, 0.02, 0.05, 0.3, 0.0, 1.0, 0.0), strict=True))
SCALE = dict(zip(features.NAMES, (0.4, 0.4, 0.4, 0.1, 0.2, 0.5, 0.3), strict=True))


def ml_16_portable_boosted(spark, sf_dir):
    return rounded(_rows(spark, sf_dir).select("symbol", "ts", trees.predicted(BOOSTED).alias("probability")))


def ml_17_portable_forest(spark, sf_dir):
    return rounded(_rows(spark, sf_dir).select("symbol", "ts", trees.predicted(FOREST).alias("probability")))


def ml_18_linear(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return rounded(r.select("symbol", "ts", trees.linear(WEIGHTS, 0.1, CENTER, SCALE).alias("score"), trees.linear(WEIGHTS, 0.1, CENTER, SCALE, True).alias("probability")))


def _walk(model: Model, tree: Tree, node: int = 0) -> str:
    """A tree as nested cases."""
    if tree.left[node] < 0:
        return f"{tree.value[node]!r}::DOUBLE"
    name = model.names[tree.feature[node]]
    x = f"({name} - {model.center[tree.feature[node]]!r}) / {model.scale[tree.feature[node]]!r}" if model.center else name
    x = f"CAST({x} AS FLOAT)::DOUBLE" if model.single else x
    return f"CASE WHEN {x} <= {tree.threshold[node]!r}::DOUBLE THEN {_walk(model, tree, tree.left[node])} ELSE {_walk(model, tree, tree.right[node])} END"


_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in features.NAMES)
_SUM = f"({BOOSTED.baseline!r} + {' + '.join(_walk(BOOSTED, t) for t in BOOSTED.trees)})"
_MEAN = f"(({' + '.join(_walk(FOREST, t) for t in FOREST.trees)}) / {len(FOREST.trees)})"
_Z = " + ".join(f"{WEIGHTS[c]!r} * (({c} - {CENTER[c]!r}) / {SCALE[c]!r})" for c in features.NAMES)
ML_16_SQL = f"WITH {FEATURES} SELECT symbol, ts, {sql.settled(f'CASE WHEN {_KNOWN} THEN 1 / (1 + exp(-{_SUM})) END', 'probability')} FROM f"
ML_17_SQL = f"WITH {FEATURES} SELECT symbol, ts, {sql.settled(f'CASE WHEN {_KNOWN} THEN {_MEAN} END', 'probability')} FROM f"
ML_18_SQL = f"WITH {FEATURES} SELECT symbol, ts, {sql.settled(f'0.1 + {_Z}', 'score')}, {sql.settled(f'1 / (1 + exp(-(0.1 + {_Z})))', 'probability')} FROM f"

QUERIES = {f.__name__: f for f in (ml_15_boosted, ml_16_portable_boosted, ml_17_portable_forest, ml_18_linear)}
SQL = {"ml_16_portable_boosted": ML_16_SQL, "ml_17_portable_forest": ML_17_SQL, "ml_18_linear": ML_18_SQL}
