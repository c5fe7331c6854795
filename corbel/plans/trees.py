"""Tree ensembles: a Spark classifier to train them, and flat node rows to score them without it."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from math import exp, inf, log, nextafter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.errors import SpecError
from corbel.functions.expressions import lookup, number
from corbel.operators.binning import MOST_CATEGORIES
from corbel.operators.scaling import LogitScale
from corbel.operators.stage import Estimator, Model, require
from corbel.workspace import Workspace

#: Ensembles of up to so many nodes are one Catalyst expression; larger ones are scored by Spark's own tree model.
EXPRESSION_NODES = 20_000
#: Fixed value of the dump format: what is no farther from zero counts as zero.
ZERO = float(np.float32(1e-35))


@dataclass(frozen=True)
class Node:
    """A split or a leaf.  Children are places in the tree.

    ``mode`` is le or lt (of the threshold), or in: whole parts that are among ``members`` go left.  A missing value goes left if
    ``missing_left``; by ``missing`` that is what is null or NaN (nan), zeros as well (zero), or nothing, null being 0 (none).
    """

    leaf: float | None = None
    feature: int = -1
    threshold: float = 0.0
    mode: str = "le"
    left: int = -1
    right: int = -1
    missing_left: bool = False
    missing: str = "nan"
    members: tuple[float, ...] = ()
    gain: float = 0.0  # of the split, where the trainer tells
    cover: float = 0.0  # the weight of the rows that reach the node


@dataclass(frozen=True)
class TreeModel(Model):
    """margin = base + sum of leaves; the score is its probability, or its place on a scale."""

    kind = "trees"
    features: list[str] = field(default_factory=list)
    trees: list[list[Node]] = field(default_factory=list)
    base: float = 0.0
    scale: LogitScale | None = None
    output: str = "risk_score"
    single: bool = False  # inputs and thresholds are rounded to single precision
    categories: dict[str, dict[str, float]] = field(default_factory=dict)  # codes of the values of string features

    # --- in Catalyst -------------------------------------------------------------------------------------------

    def _inputs(self) -> list[Column]:
        cols = [coded(f, self.categories.get(f)) for f in self.features]
        return [c.cast("float").cast("double") for c in cols] if self.single else cols

    def _tree(self, tree: list[Node], inputs: list[Column], k: int = 0) -> Column:
        node = tree[k]
        if node.leaf is not None:
            return F.lit(float(node.leaf))
        x = inputs[node.feature]
        if node.missing == "none":
            x = F.coalesce(x, F.lit(0.0))
        elif node.missing == "zero":
            x = F.when(F.abs(x) > ZERO, x)
        goes = x < node.threshold if node.mode == "lt" else x <= node.threshold if node.mode == "le" else _whole(x).isin([float(v) for v in node.members])
        goes = F.coalesce(goes, F.lit(node.missing_left))
        return F.when(goes, self._tree(tree, inputs, node.left)).otherwise(self._tree(tree, inputs, node.right))

    def margin(self) -> Column:
        """Base and leaves in one expression, summed in pairs: generated code stays flat however many trees there are."""
        inputs = self._inputs()
        parts = [F.lit(self.base), *[self._tree(t, inputs) for t in self.trees]]
        while len(parts) > 1:
            parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
        return parts[0]

    def _with_margin(self, df: DataFrame) -> DataFrame:
        if sum(map(len, self.trees)) <= EXPRESSION_NODES:
            return df.withColumn("__margin", self.margin())
        forest, fills = spark_forest(df.sparkSession, self.trees)
        inputs = self._inputs()
        cells = F.array(*[_filled(inputs[f], kind, value) for f, kind, value in fills])
        out = forest.setFeaturesCol("__cells").setPredictionCol("__margin").transform(df.withColumn("__cells", array_to_vector(cells))).drop("__cells")
        return out.withColumn("__margin", F.col("__margin") + self.base)

    def score(self, margin: Column | None = None) -> Column:
        m = self.margin() if margin is None else margin
        # on a logit scale the margin is the log-odds: no detour over the probability
        return self.scale.of_margin(m) if self.scale else F.lit(1.0) / (F.lit(1.0) + F.exp(-m))

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, self.features)
        return self._with_margin(df).withColumn(self.output, self.score(F.col("__margin"))).drop("__margin")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``, whatever the scale of the score."""
        require(df, self.features)
        return self._with_margin(df).withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__margin")))).drop("__margin")

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``df`` with ``probability`` and ``prediction``: 1 where it is at least ``threshold``."""
        return self.predict_proba(df).withColumn("prediction", (F.col("probability") >= threshold).cast("int"))

    # --- for one row -------------------------------------------------------------------------------------------

    def apply_row(self, row: dict) -> dict:
        values = []
        for f in self.features:
            try:
                v = float(self.categories[f][str(row.get(f))] if f in self.categories else row.get(f))  # type: ignore[arg-type]
            except (KeyError, TypeError, ValueError):
                v = float("nan")
            values.append(float(np.float32(v)) if self.single else v)
        total = 0.0
        for tree in self.trees:
            node = tree[0]
            while node.leaf is None:
                node = tree[node.left if goes_left(node, values[node.feature]) else node.right]
            total += node.leaf
        m = self.base + total
        return row | {self.output: self.scale.offset + self.scale.slope * m if self.scale else 1 / (1 + exp(-m)) if m > -700 else 0.0}

    def to_dict(self) -> dict:
        return {"kind": self.kind, "features": self.features, "trees": [[asdict(n) for n in t] for t in self.trees], "base": self.base, "scale": self.scale and self.scale.to_dict(), "output": self.output, "single": self.single, "categories": self.categories}

    @classmethod
    def from_dict(cls, spec: dict) -> TreeModel:
        scale = spec["scale"] and LogitScale(**{k: v for k, v in spec["scale"].items() if k != "kind"})
        return cls(list(spec["features"]), [[Node(**n | {"members": tuple(n.get("members", ()))}) for n in t] for t in spec["trees"]], spec["base"], scale, spec["output"], spec["single"], dict(spec.get("categories") or {}))


def coded(name: str, codes: dict[str, float] | None) -> Column:
    """A feature as a number; of a string feature the code of its value, NULL for unknown ones."""
    return lookup(F.col(f"`{name}`").cast("string"), codes) if codes is not None else number(F.col(f"`{name}`"))


def goes_left(node: Node, x: float) -> bool:
    """Where one value goes; NaN is missing."""
    if node.missing == "none" and x != x:
        x = 0.0
    if x != x or (node.missing == "zero" and abs(x) <= ZERO):
        return node.missing_left
    return x < node.threshold if node.mode == "lt" else x <= node.threshold if node.mode == "le" else abs(x) < 2**63 and float(int(x)) in node.members


def leaf_values(tree: Sequence[Node], x: np.ndarray) -> np.ndarray:
    """The leaf of every row of ``x``; node by node, each with the rows that reach it."""
    out, todo = np.zeros(len(x)), [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        node = tree[k]
        if node.leaf is not None:
            out[rows] = node.leaf
            continue
        v = x[rows, node.feature]
        v = np.where(np.isnan(v), 0.0, v) if node.missing == "none" else v
        gone = np.isnan(v) | ((np.abs(v) <= ZERO) if node.missing == "zero" else False)
        goes = v < node.threshold if node.mode == "lt" else v <= node.threshold if node.mode == "le" else np.isin(np.trunc(v), node.members)
        goes = np.where(gone, node.missing_left, goes)
        todo += [(node.left, rows[goes]), (node.right, rows[~goes])]
    return out


def _whole(x: Column) -> Column:
    """The whole part of a double, without a detour over longs, which may not hold it."""
    return x - x % 1.0


def _filled(x: Column, kind: str, value: float) -> Column:
    """An input with what is missing replaced; whole categories for membership."""
    if kind.startswith("in"):
        whole = _whole(x)
        x = F.when((whole >= 0) & (whole < value), whole).otherwise(F.when(x.isNotNull(), F.lit(value + 1)))
        value = {"in": value + 1, "in left": value, "in zero": 0.0}[kind]
    elif kind == "zero":
        x = F.when(F.abs(x) > ZERO, x)
    return F.coalesce(x, F.lit(float(value)))


def spark_forest(spark: SparkSession, trees: Sequence[Sequence[Node]]) -> tuple[GBTRegressionModel, list[tuple[int, str, float]]]:
    """Spark's own model of the trees, and its inputs: (feature, kind, filling) by place.  It scores in the JVM at any size.

    Spark's splits have no missing values, so each way to treat them is an input of its own: what is missing is filled with an
    infinity on the side where it belongs.  x < t is x <= the next double below t.  Nodes go as a table in the form in which
    Spark keeps models.
    """
    inputs: dict[tuple[int, str, float], int] = {}
    most = 1.0 + max((m for t in trees for n in t for m in n.members), default=0.0)  # no category is above
    rows = []
    for number_, tree in enumerate(trees):
        places, todo = {}, [0]
        while todo:  # numbered so that parents stand before their children
            k = todo.pop()
            places[k] = len(places)
            if tree[k].leaf is None:
                todo += [tree[k].right, tree[k].left]
        for k, place in places.items():
            n = tree[k]
            if n.leaf is not None:
                rows.append((number_, (place, float(n.leaf), 0.0, [0.0, 0.0, 0.0], 0, -1.0, -1, -1, (-1, [], -1))))
                continue
            if n.mode == "in":
                kind = "in zero" if n.missing == "none" else "in left" if n.missing_left else "in"
                if n.missing == "zero":
                    raise SpecError("zeros cannot be missing in a split by members")
                at, arity = inputs.setdefault((n.feature, kind, most), len(inputs)), int(most) + 2
                # the set is always kept as it is, never as its complement: an arity of twice its size
                members = sorted({*n.members, *([most] if kind == "in left" else [])})
                split = (at, members, max(arity, 2 * len(members) + 2))
            else:
                fill = 0.0 if n.missing == "none" else -inf if n.missing_left else inf
                at = inputs.setdefault((n.feature, "zero" if n.missing == "zero" else "value", fill), len(inputs))
                split = (at, [float(n.threshold if n.mode == "le" else nextafter(n.threshold, -inf))], -1)
            rows.append((number_, (place, 0.0, 0.0, [0.0, 0.0, 0.0], 0, 0.0, places[n.left], places[n.right], split)))
    ws = Workspace(spark, "forest")
    try:
        split_ = "struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
        node = f"struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: long, gain: double, leftChild: int, rightChild: int, split: {split_}>"
        about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "paramMap": {"impurity": "variance"}, "defaultParamMap": {}}
        one = json.dumps(about | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "uid": "tree"})
        whole = json.dumps(about | {"class": "org.apache.spark.ml.regression.GBTRegressionModel", "uid": "forest", "numFeatures": max(1, len(inputs)), "numTrees": len(trees)})
        spark.createDataFrame(rows, f"treeID int, nodeData {node}").coalesce(1).write.parquet(ws.path("model/data"))
        spark.createDataFrame([(k, one, 1.0) for k in range(len(trees))], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(ws.path("model/treesMetadata"))
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(ws.path("model/metadata"))
        return GBTRegressionModel.load(ws.path("model")), list(inputs)
    finally:
        ws.close()


def from_debug_string(text: str) -> list[Node]:
    """A tree as Spark prints it, as nodes."""
    lines = [x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
    nodes: list[Node] = []
    at = iter(lines)

    def read() -> int:
        k, line = len(nodes), next(at)
        nodes.append(Node())
        if line.startswith("Predict"):
            nodes[k] = Node(leaf=float(line.split(":")[1]))
            return k
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        if not m:
            raise ValueError(f"not a numeric split: {line}")
        left = read()
        next(at)
        right = read()
        nodes[k] = Node(None, int(m[1]), float(m[2]), "le", left, right)
        return k

    read()
    return nodes


def _statistics(node: object) -> list[tuple[float, float]]:
    """Gain and weight of each node of a Spark tree, in the order in which it prints them."""
    split = node.getClass().getSimpleName() == "InternalNode"  # type: ignore[attr-defined]
    own = (float(node.gain()) if split else 0.0, float(node.impurityStats().count()))  # type: ignore[attr-defined]
    return [own, *(_statistics(node.leftChild()) + _statistics(node.rightChild()) if split else [])]  # type: ignore[attr-defined]


def _codes(df: DataFrame, name: str) -> dict[str, float]:
    """Values of a string feature in alphabetical order."""
    rows = df.select(F.col(f"`{name}`").alias("v")).filter("v is not null").distinct().limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"{name} has more than {MOST_CATEGORIES} categories: group them first")
    return {v: float(k) for k, v in enumerate(sorted(r.v for r in rows))}


@dataclass(frozen=True)
class BoostedClassifier(Estimator):
    """Spark's gradient-boosted trees, kept as ``TreeModel``; missing values are filled with ``fill`` as in training.

    String features are coded by the alphabetical order of their values; values not seen in training are missing.  With ``validation``
    the number of trees is the one whose loss on it is least.
    """

    trees: int = 20
    depth: int = 4
    rate: float = 0.1
    subsample: float = 0.8
    columns: str = "0.8"
    min_rows: int = 1
    seed: int = 42
    weight: str | None = None
    scale: LogitScale | None = None
    fill: float = -1e9
    output: str = "risk_score"

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> TreeModel:
        if not features:
            raise ValueError("no features are left to train on")
        categories = {f: _codes(df, f) for f in features if isinstance(df.schema[f].dataType, T.StringType)}
        cells = [F.coalesce(coded(f, categories.get(f)), F.lit(self.fill)).alias(f"x{i}") for i, f in enumerate(features)]
        rows = df.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("y"), *cells, *([F.col(self.weight).alias("w")] if self.weight else []))
        rows = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="x").transform(rows)
        gbt = GBTClassifier(labelCol="y", featuresCol="x", maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, subsamplingRate=self.subsample, featureSubsetStrategy=self.columns, minInstancesPerNode=self.min_rows, seed=self.seed, **({"weightCol": "w"} if self.weight else {}))
        fitted = gbt.fit(rows)
        trees = []
        for tree, weight in zip(fitted.trees, fitted.treeWeights, strict=True):
            nodes = zip(from_debug_string(tree.toDebugString), _statistics(tree._call_java("rootNode")), strict=True)
            # Spark's margin is half the log-odds; a value filled in training goes where ``fill`` would
            trees.append([Node(2 * weight * n.leaf, cover=c) if n.leaf is not None else replace(n, missing_left=self.fill <= n.threshold, gain=g * weight, cover=c) for n, (g, c) in nodes])
        model = TreeModel(list(features), trees, 0.0, self.scale, self.output, categories=categories)
        return truncated(model, prefix_losses(model, validation, label)) if validation is not None else model


def prefix_losses(model: TreeModel, df: DataFrame, label: str) -> list[float]:
    """The mean logistic loss of the first 0, 1, ... all trees of ``model``, from one scan: workers add up each number's loss."""
    arrays, inputs = model.trees, [c.alias(f"x{i}") for i, c in enumerate(model._inputs())]
    base, d = model.base, len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(arrays) + 1), 0
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(d)], axis=1)
                y, m = batch.column("y").to_numpy(), np.full(batch.num_rows, base)
                n += len(y)
                for k in range(len(arrays) + 1):
                    m += leaf_values(arrays[k - 1], x) if k else 0.0
                    total[k] += (np.logaddexp(0, m) - y * m).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], names=["k", "loss", "n"])

    y = F.col(f"`{label}`").cast("double")
    rows = df.filter(y.isin(0.0, 1.0)).select(y.alias("y"), *inputs)
    got = rows.mapInArrow(run, "k int, loss double, n long").groupBy("k").agg(F.try_divide(F.sum("loss"), F.sum("n")).alias("loss")).collect()
    return [r.loss for r in sorted(got, key=lambda r: r.k)]


def truncated(model: TreeModel, losses: list[float]) -> TreeModel:
    """``model`` with the number of trees, at least one, whose loss is least; the fewest of equal ones."""
    return replace(model, trees=model.trees[: 1 + int(np.argmin(losses[1:]))]) if losses[1:] and losses[1] is not None else model


IMPORTANCES = ("weight", "gain", "cover", "total_gain", "total_cover", "share")


def importance(model: TreeModel, kind: str = "gain") -> dict[str, float]:
    """By feature, 0 for unused ones: number of splits (weight), mean or total gain or cover of them, or their share."""
    if kind not in IMPORTANCES:
        raise ValueError(f"kind must be one of {IMPORTANCES}")
    splits: list[list[Node]] = [[] for _ in model.features]
    for node in (n for t in model.trees for n in t if n.leaf is None):
        splits[node.feature].append(node)
    every = sum(map(len, splits))

    def value(nodes: list[Node]) -> float:
        if kind in ("weight", "share"):
            return len(nodes) / (every if kind == "share" and every else 1)
        total = sum(n.gain if kind.endswith("gain") else n.cover for n in nodes)
        return total if kind.startswith("total") or not nodes else total / len(nodes)

    return {f: float(value(n)) for f, n in zip(model.features, splits, strict=True)}


def _dumped(trees: Sequence[dict], read: Callable[[dict], tuple[Node, tuple[dict, dict] | None]]) -> list[list[Node]]:
    """Flat trees from nested ones; ``read`` gives a node and its children, the one that the condition leads to first."""
    out = []
    for tree in trees:
        nodes: list[Node] = []

        def put(x: dict, nodes: list[Node] = nodes) -> int:
            k = len(nodes)
            node, children = read(x)
            nodes.append(node)
            if children:
                left, right = put(children[0]), put(children[1])
                nodes[k] = replace(node, left=left, right=right)
            return k

        put(tree)
        out.append(nodes)
    return out


def single(x: float) -> float:
    """Rounded to single precision."""
    return float(np.float32(x))


def from_xgboost_dump(dump: str | Sequence[str | dict], features: Sequence[str], base_score: float = 0.5, **options: object) -> TreeModel:
    """A model from XGBoost's JSON dump (a list of trees, each parsed or not).

    A split leads to ``yes`` for values below its threshold, or among its list of categories; to the child that ``missing`` names
    without a value.  Inputs, thresholds and leaves are of single precision.  Statistics, where dumped, give gain and cover.
    """
    place = {f: i for i, f in enumerate(features)} | {f"f{i}": i for i in range(len(features)) if f"f{i}" not in features}
    trees = [json.loads(t) if isinstance(t, str) else t for t in (json.loads(dump) if isinstance(dump, str) else dump)]

    def read(x: dict) -> tuple[Node, tuple[dict, dict] | None]:
        if "leaf" in x:
            return Node(leaf=single(x["leaf"]), cover=float(x.get("cover", 0.0))), None
        if x["split"] not in place:
            raise SpecError(f"unknown feature {x['split']!r}")
        children = {c["nodeid"]: c for c in x["children"]}
        cut = x["split_condition"]
        how = {"mode": "in", "members": tuple(float(c) for c in cut)} if isinstance(cut, list) else {"mode": "lt", "threshold": single(cut)}
        without = x.get("missing")  # a dump that names no child: as the condition that holds
        node = Node(feature=place[x["split"]], missing_left=without is None or without == x["yes"], gain=float(x.get("gain", 0.0)), cover=float(x.get("cover", 0.0)), **how)
        return node, (children[x["yes"]], children[x["no"]])

    return TreeModel(list(features), _dumped(trees, read), single(logit(base_score)), single=True, **options)  # type: ignore[arg-type]


#: What LightGBM's dumps call the three ways to treat missing values.
MISSING = {"NaN": "nan", "Zero": "zero", "None": "none"}


def from_lightgbm_dump(dump: str | dict, features: Sequence[str] | None = None, categorical: Sequence[str] = (), **options: object) -> TreeModel:
    """A model from LightGBM's dumped JSON; all in double precision, as that library predicts.

    Numeric splits send values up to the threshold left; those by category send the members of ``a||b||c`` left, all others and missing
    ones right.  Each split says what is missing (``MISSING``; without a word NaN): for None null counts as 0, and ``default_left`` tells
    nothing.  ``categorical`` names the features of strings, in the order in which the dump lists their values.
    """
    spec = json.loads(dump) if isinstance(dump, str) else dump
    names = list(features or spec["feature_names"])
    known = spec.get("pandas_categorical") or []
    if len(categorical) > len(known):
        raise SpecError(f"the dump lists the values of {len(known)} features, not of {len(categorical)}")
    codes = {f: {str(v): float(k) for k, v in enumerate(values)} for f, values in zip(categorical, known, strict=False)}

    def column(of: str | int) -> int:
        if isinstance(of, str) and of not in names:
            raise SpecError(f"unknown feature {of!r}")
        return names.index(of) if isinstance(of, str) else of

    def read(x: dict) -> tuple[Node, tuple[dict, dict] | None]:
        if "leaf_value" in x:
            return Node(leaf=float(x["leaf_value"]), cover=float(x.get("leaf_count", 0.0))), None
        node = Node(feature=column(x["split_feature"]), gain=float(x.get("split_gain", 0.0)), cover=float(x.get("internal_count", 0.0)))
        try:
            if x.get("decision_type") == "==":
                node = replace(node, mode="in", members=tuple(float(c) for c in str(x["threshold"]).split("||")))
            elif x.get("decision_type") in (None, "<="):
                node = replace(node, threshold=float(x["threshold"]), missing=MISSING[x.get("missing_type", "NaN")], missing_left=x.get("default_left") is True)
            else:
                raise SpecError(f"unknown decision {x['decision_type']!r}")
            return node, (x["left_child"], x["right_child"])
        except (KeyError, ValueError) as e:
            raise SpecError(f"not a split: {e}") from e

    return TreeModel(names, _dumped([t["tree_structure"] for t in spec["tree_info"]], read), 0.0, **{"categories": codes, **options})  # type: ignore[arg-type]


def logit(p: float) -> float:
    return log(p / (1 - p))


def literal_trees(model: Sequence[dict], features: Sequence[str], **options: object) -> TreeModel:
    """A model from nested dicts {feature, threshold, left, right[, mode, missing_left]} with numbers as leaves."""
    trees = []
    for tree in model:
        nodes: list[Node] = []

        def put(x: object, nodes: list[Node] = nodes) -> int:
            k = len(nodes)
            nodes.append(Node())
            if not isinstance(x, dict):
                nodes[k] = Node(leaf=float(x))  # type: ignore[arg-type]
            else:
                left, right = put(x["left"], nodes), put(x["right"], nodes)
                nodes[k] = Node(None, list(features).index(x["feature"]), float(x["threshold"]), x.get("mode", "le"), left, right, x.get("missing_left", False))
            return k

        put(tree)
        trees.append(nodes)
    return TreeModel(list(features), trees, **options)  # type: ignore[arg-type]
