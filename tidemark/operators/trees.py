"""Tree models: boosting by histograms that Spark adds up, and predictors of exported models as plain column expressions.

A model is data: trees as arrays of nodes (feature, threshold, left, right, value; left -1 at a leaf), with the centre and scale of its features. It is scored by
walking literal arrays, without a Python worker, and can be written as JSON.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import fresh_folder

TREE = "struct<feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,value:array<double>>"
#: Rounds after which the running prediction is written down, so that a round walks few trees.
WRITTEN = 20


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for column, x in zip((self.feature, self.threshold, self.left, self.right, self.value), (-1, 0.0, -1, -1, value), strict=True):
            column.append(x)
        return len(self.left) - 1

    def split(self, node: int, feature: int, threshold: float, left: float, right: float) -> tuple[int, int]:
        """Turn a leaf into a split; its new leaves."""
        a, b = self.leaf(left), self.leaf(right)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, a, b
        return a, b

    def check(self, features: int) -> None:
        """Children come after their parents, so that every walk ends; features exist; numbers are finite."""
        n = len(self.left)
        if not n or any(len(x) != n for x in (self.feature, self.threshold, self.right, self.value)):
            raise ValueError("arrays of a tree differ in length")
        for i, (a, b, f, t, v) in enumerate(zip(self.left, self.right, self.feature, self.threshold, self.value, strict=True)):
            if not (math.isfinite(t) and math.isfinite(v)):
                raise ValueError("a node is not finite")
            if (a == -1) != (b == -1):
                raise ValueError("a node has one child")
            if a != -1 and not (i < a < n and i < b < n and 0 <= f < features):
                raise ValueError("cyclic or invalid node")

    def depth(self) -> int:
        level = [0] * len(self.left)
        for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            for k in (a, b):
                if k >= 0:
                    level[k] = level[i] + 1
        return max(level)


@dataclass
class Model:
    """kind: boosted (baseline plus the sum of trees, through the logistic function where classifier) or forest (mean of trees)."""

    kind: str
    names: tuple[str, ...]
    trees: list[Tree]
    baseline: float = 0.0
    classifier: bool = False
    center: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    #: whether features are compared as 32-bit numbers
    single: bool = False

    def __post_init__(self) -> None:
        self.trees = [t if isinstance(t, Tree) else Tree(**t) for t in self.trees]
        if self.kind not in ("boosted", "forest") or not self.names or len(set(self.names)) != len(self.names) or (self.kind == "forest" and not self.trees):
            raise ValueError("unknown kind, no features, repeated features or no trees")
        for x in (self.center, self.scale):
            if x and len(x) != len(self.names):
                raise ValueError("centre and scale have other features")
        if any(not math.isfinite(x) for x in (*self.center, *self.scale, self.baseline)) or any(x <= 0 for x in self.scale):
            raise ValueError("non-finite model or a scale that is not positive")
        for t in self.trees:
            t.check(len(self.names))

    def to_json(self) -> str:
        return json.dumps(asdict(self), allow_nan=False)

    @staticmethod
    def from_json(text: str) -> Model:
        said = json.loads(text)
        return Model(**said | {k: tuple(said[k]) for k in ("names", "center", "scale")})


def scaled(model: Model) -> Column:
    """The model's features as an array, centred and scaled. A null among them makes the array null."""
    x = [F.col(c).cast("double") for c in model.names]
    if model.center:
        x = [(c - F.lit(a)) / F.lit(b) for c, a, b in zip(x, model.center, model.scale, strict=True)]
    known = F.lit(True)
    for c in x:
        known = known & c.isNotNull() & ~F.isnan(c)
    return F.when(known, F.array(*[c.cast("float").cast("double") if model.single else c for c in x]))


def predicted(model: Model) -> Column:
    """The model's prediction, null where a feature is undefined. Trees are literals; each walk takes as many steps as the deepest tree."""
    trees = F.from_json(F.lit(json.dumps([asdict(t) for t in model.trees])), f"array<{TREE}>")
    steps = max((t.depth() for t in model.trees), default=0)

    def value(x: Column, tree: Column) -> Column:
        at = lambda name, node: F.get(tree[name], node)
        down = lambda node, _: F.when(at("left", node) < 0, node).when(F.get(x, at("feature", node)) <= at("threshold", node), at("left", node)).otherwise(at("right", node))
        return at("value", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), down) if steps else F.lit(0))

    x = scaled(model)
    total = F.aggregate(trees, F.lit(model.baseline if model.kind == "boosted" else 0.0), lambda acc, tree: acc + value(x, tree))
    if model.kind == "forest":
        total = total / len(model.trees)
    elif model.classifier:
        total = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), total))))
    return F.when(x.isNotNull(), total)


def linear(weights: dict[str, float], intercept: float, center: dict[str, float], scale: dict[str, float], logistic: bool = False) -> Column:
    """The score of a linear model on centred and scaled features, through the logistic function if asked for; null where a feature is undefined."""
    if any(s <= 0 for s in scale.values()) or weights.keys() != center.keys() or weights.keys() != scale.keys():
        raise ValueError("features of centre or scale differ, or a scale is not positive")
    z = F.array(*[(F.col(c).cast("double") - center[c]) / scale[c] for c in weights])
    total = F.aggregate(F.zip_with(z, F.array(*[F.lit(float(w)) for w in weights.values()]), lambda a, b: a * b), F.lit(float(intercept)), lambda acc, x: acc + x)
    return 1 / (1 + F.exp(-total)) if logistic else total


def walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of x."""
    node = np.zeros(len(x), np.int64)
    left, right, feature, threshold = (np.asarray(c) for c in (tree.left, tree.right, tree.feature, tree.threshold))
    for _ in range(tree.depth()):
        inner = np.flatnonzero(left[node] >= 0)
        at = node[inner]
        node[inner] = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])
    return node


# Boosting


@dataclass(frozen=True)
class Boosting:
    rounds: int = 160
    rate: float = 0.05
    depth: int = 3
    least: int = 100
    l2: float = 10.0
    bins: int = 64
    least_hessian: float = 1e-3


def _edges(rows: DataFrame, width: int, rules: Boosting) -> list[list[float]]:
    """Of each feature the thresholds between bins: values at equal shares of the rows, each once, without the largest."""
    shares = [k / rules.bins for k in range(1, rules.bins)]
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"q{i}") for i in range(width)], *[F.max(F.col("x")[i]).alias(f"m{i}") for i in range(width)]).first()
    return [[v for v in sorted(set(found[f"q{i}"])) if v < found[f"m{i}"]] for i in range(width)]


def best_splits(sums: np.ndarray, rules: Boosting) -> list[tuple[int, int, float, float] | None]:
    """For each node of sums (node, feature, bin, 3: gradient, hessian, rows) the best feature and last bin of its left side, and the values of both leaves; None where
    nothing gains. Ties go to the first feature and the lowest bin."""
    out: list = []
    for node in sums:
        total = node[0].sum(axis=0)
        left = np.cumsum(node, axis=1)
        right = total - left
        gain = left[..., 0] ** 2 / (left[..., 1] + rules.l2) + right[..., 0] ** 2 / (right[..., 1] + rules.l2) - total[0] ** 2 / (total[1] + rules.l2)
        fits = (np.minimum(left[..., 2], right[..., 2]) >= rules.least) & (np.minimum(left[..., 1], right[..., 1]) >= rules.least_hessian)
        gain = np.where(fits, np.round(gain, 9), -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        value = lambda s: float(-rules.rate * s[0] / (s[1] + rules.l2))
        out.append((int(f), int(b), value(left[f, b]), value(right[f, b])) if gain[f, b] > 0 else None)
    return out


def boost(rows: DataFrame, names: tuple[str, ...], target: str, classifier: bool = False, weight: str | None = None, rules: Boosting = Boosting()) -> Model:
    """A boosted model of the rows whose target and features are known (for a classifier: target above 0 against the rest).

    Each level of a tree is one job: tasks add up gradients, hessians and rows by (node, feature, bin) for their rows, Spark adds up the tasks' sums, and as many numbers as
    nodes times features times bins come to the driver, which picks the splits. Rows, as bins, stay in a table in the shared folder with the prediction up to the last
    WRITTEN rounds; lost executors recompute from there.
    """
    spark = rows.sparkSession
    known = F.col(target).isNotNull()
    for c in names:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    used = rows.where(known)
    moments = used.agg(F.count("*").alias("n"), *[f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("a", F.avg), ("d", F.stddev_pop))]).first()
    if not moments["n"]:
        raise ValueError("no rows to learn from")
    center = tuple(moments[f"a_{i}"] for i in range(len(names)))
    scale = tuple(d if (d := moments[f"d_{i}"]) > 1e-8 else 1.0 for i in range(len(names)))
    x = F.array(*[(F.col(c).cast("double") - F.lit(a)) / F.lit(b) for c, a, b in zip(names, center, scale, strict=True)])
    y = (F.col(target) > 0).cast("double") if classifier else F.col(target).cast("double")
    table = used.select(x.alias("x"), y.alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    edges = _edges(table, len(names), rules)
    mean = table.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m")).first()["m"]
    baseline = math.log(mean / (1 - mean)) if classifier and 0 < mean < 1 else (float(mean) if not classifier else math.copysign(700.0, mean - 0.5))
    features, bins = len(names), rules.bins
    model = Model("boosted", tuple(names), [], baseline, classifier, center, scale)

    def place(batches):
        for batch in batches:
            m = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            placed = np.stack([np.searchsorted(np.asarray(e), m[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.int16)
            offsets = pa.array(np.arange(len(m) + 1) * features, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(placed.ravel())), batch.column("y"), batch.column("w"), pa.array(np.full(len(m), baseline))], ["bins", "y", "w", "f"])

    schema = "bins array<smallint>, y double, w double, f double"

    def written(df: DataFrame) -> DataFrame:
        path = fresh_folder(spark, "boosting")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        m = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
        return m, *[batch.column(c).to_numpy(zero_copy_only=False) for c in "ywf"]

    def moved(trees: list[Tree]):
        def run(batches):
            for batch in batches:
                m, _, _, f = unpack(batch)
                f = f.copy()
                for t in trees:
                    f += np.asarray(t.value)[walk(t, m)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(f)], ["bins", "y", "w", "f"])

        return run

    def summed(trees: list[Tree], tree: Tree, nodes: list[int]):
        """Sums by (node, feature, bin) of a task, as a row for each node and feature that has rows."""

        def run(batches):
            sums = np.zeros((len(nodes), features, bins, 3))
            number = np.full(len(tree.left), -1)
            number[nodes] = np.arange(len(nodes))
            for batch in batches:
                m, y, w, f = unpack(batch)
                f = f.copy()
                for t in trees:
                    f += np.asarray(t.value)[walk(t, m)]
                if classifier:
                    p = 1 / (1 + np.exp(-np.clip(f, -700, 700)))
                    g, h = (p - y) * w, p * (1 - p) * w
                else:
                    g, h = (f - y) * w, w
                at = number[walk(tree, m)]
                mine = at >= 0
                for i in range(features):
                    key = at[mine] * bins + m[mine, i]
                    for k, v in enumerate((g[mine], h[mine], None)):
                        sums[:, i, :, k] += np.bincount(key, weights=v, minlength=len(nodes) * bins).reshape(len(nodes), bins)
            rows = [(n, i) for n in range(len(nodes)) for i in range(features) if sums[n, i, :, 2].any()]
            columns = [pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1)]
            columns += [pa.array([sums[n, i, :, k].tolist() for n, i in rows], pa.list_(pa.float64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "feature", "g", "h", "n"])

        return run

    held, since = written(table.mapInArrow(place, schema)), []
    for _ in range(rules.rounds):
        tree = Tree()
        tree.leaf(0.0)
        open_nodes = [0]
        for _level in range(rules.depth):
            found = held.mapInArrow(summed(list(since), tree, open_nodes), "node int, feature int, g array<double>, h array<double>, n array<double>")
            cells = found.select("node", "feature", F.posexplode(F.arrays_zip("g", "h", "n")).alias("bin", "s")).groupBy("node", "feature", "bin").agg(*[F.sum(f"s.{k}").alias(k) for k in "ghn"])
            sums = np.zeros((len(open_nodes), features, bins, 3))
            for r in cells.where("n > 0").collect():
                sums[r["node"], r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
            nodes = []
            for node, split in zip(open_nodes, best_splits(sums, rules), strict=True):
                if split:
                    nodes += tree.split(node, split[0], float(split[1]), split[2], split[3])
            open_nodes = nodes
            if not open_nodes:
                break
        if len(tree.left) == 1:
            break  # nothing gains any more
        since.append(tree)
        # thresholds of bins become thresholds of the scaled features
        real = Tree(list(tree.feature), [edges[f][int(t)] if a >= 0 else 0.0 for f, t, a in zip(tree.feature, tree.threshold, tree.left, strict=True)], list(tree.left), list(tree.right), [v if a < 0 else 0.0 for v, a in zip(tree.value, tree.left, strict=True)])
        model.trees.append(real)
        if len(since) == WRITTEN:
            held, since = written(held.mapInArrow(moved(since), schema)), []
    return model


def forest_model(spark: SparkSession, fitted, names: tuple[str, ...]) -> Model:
    """A fitted random forest classifier of Spark as a Model: the share of the second class. Read from its public saved form."""
    path = fresh_folder(spark, "forest")
    fitted.write().save(path)
    by_tree: dict[int, dict[int, dict]] = {}
    saved = spark.read.parquet(f"{path}/data")
    flat = saved.select("treeID", "nodeData.*") if "nodeData" in saved.columns else saved
    for r in flat.collect():
        by_tree.setdefault(r["treeID"], {})[r["id"]] = r
    trees = []
    for _, nodes in sorted(by_tree.items()):
        order, waiting = [], [0]
        while waiting:  # parents first
            i = waiting.pop(0)
            order.append(i)
            if nodes[i]["leftChild"] >= 0:
                waiting += [nodes[i]["leftChild"], nodes[i]["rightChild"]]
        at = {i: k for k, i in enumerate(order)}
        t = Tree()
        for i in order:
            r = nodes[i]
            inner = r["leftChild"] >= 0
            stats = r["impurityStats"]
            t.feature.append(r["split"]["featureIndex"] if inner else -1)
            t.threshold.append(float(r["split"]["leftCategoriesOrThreshold"][0]) if inner else 0.0)
            t.left.append(at[r["leftChild"]] if inner else -1)
            t.right.append(at[r["rightChild"]] if inner else -1)
            t.value.append(0.0 if inner else float(stats[1] / sum(stats)))
        trees.append(t)
    return Model("forest", tuple(names), trees)
