"""Tree ensembles: dumps read right at edges and for missing values, forests of any size in the JVM, growth by leaves."""

import json
import random

import numpy as np
import pytest

from corbel.errors import SpecError
from corbel.plans import growth, trees
from corbel.plans.experiment import ParzenSearch, RandomSearch
from corbel.plans.growth import Growth, LeafwiseClassifier
from corbel.plans.pipeline import Pipeline, PipelineModel
from corbel.plans.trees import BoostedClassifier, Node, TreeModel, from_lightgbm_dump, from_xgboost_dump, importance, prefix_losses


def probability(m):
    return 1 / (1 + np.exp(-m))


def split(feature, threshold, left, right, **rest):
    leaf = lambda x: x if isinstance(x, dict) else {"leaf_value": x}
    return {"split_feature": feature, "threshold": threshold, "decision_type": "<=", "left_child": leaf(left), "right_child": leaf(right)} | rest


def lightgbm(*trees_, names=("a", "b"), **rest):
    return {"feature_names": list(names), "tree_info": [{"tree_structure": t} for t in trees_]} | rest


def scores(spark, model, rows, schema):
    """By the expression, by Spark's tree model, and by row; all agree."""
    df = spark.createDataFrame(rows, schema).coalesce(1)
    out = [[r.risk_score for r in model.transform(df).collect()]]
    was, trees.EXPRESSION_NODES = trees.EXPRESSION_NODES, 0
    try:
        scored = model.transform(df)
        assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
        out.append([r.risk_score for r in scored.collect()])
    finally:
        trees.EXPRESSION_NODES = was
    out.append([model.apply_row(r.asDict())["risk_score"] for r in df.collect()])
    assert out[0] == pytest.approx(out[1], abs=1e-12) and out[0] == pytest.approx(out[2], abs=1e-12)
    return out[0]


@pytest.mark.parametrize(
    ("kind", "left", "want"),
    [
        # of null, NaN, 0, a tiny value, 1 and -1, those up to 0.5 go left (-)
        ("NaN", True, "----+-"),
        ("NaN", False, "++--+-"),
        ("Zero", True, "----+-"),
        ("Zero", False, "+++++-"),
        ("None", True, "----+-"),
        ("None", False, "----+-"),
    ],
)
def test_lightgbm_missing_kinds(spark, kind, left, want):
    m = from_lightgbm_dump(lightgbm(split("a", 0.5, -1.0, 1.0, missing_type=kind, default_left=left)))
    got = scores(spark, m, [(None, 0.0), (float("nan"), 0.0), (0.0, 0.0), (1e-36, 0.0), (1.0, 0.0), (-1.0, 0.0)], "a double, b double")
    assert "".join("-" if x < 0.5 else "+" for x in got) == want


def test_lightgbm_thresholds_are_double(spark):
    t = 0.1 + 1e-12  # single precision would not tell the three values apart
    m = from_lightgbm_dump(json.dumps(lightgbm(split(0, t, -1.0, 1.0))))
    assert scores(spark, m, [(t, 0.0), (t - 1e-13, 0.0), (t + 1e-13, 0.0)], "a double, b double") == pytest.approx([probability(-1), probability(-1), probability(1)])


def test_lightgbm_categories(spark):
    tree = split("a", "0||2||40", -1.0, 1.0, decision_type="==", default_left=True, missing_type="NaN")
    m = from_lightgbm_dump(lightgbm(tree))
    got = scores(spark, m, [(x, 0.0) for x in (0.0, 1.0, 2.0, 2.9, 40.0, 41.0, -3.0, 1e30, None)], "a double, b double")
    assert "".join("-" if x < 0.5 else "+" for x in got) == "-+---++++"
    m = from_lightgbm_dump(lightgbm(split("s", "0||2", -1.0, 1.0, decision_type="=="), names=("s", "b"), pandas_categorical=[["x", "y", "z"]]), categorical=["s"])
    got = scores(spark, m, [("x", 0.0), ("y", 0.0), ("z", 0.0), ("new", 0.0), (None, 0.0)], "s string, b double")
    assert "".join("-" if x < 0.5 else "+" for x in got) == "-+-++"
    assert PipelineModel.from_json(PipelineModel((m,), ("s", "b")).to_json()).steps[0] == m


def test_xgboost_categories_and_single_precision(spark):
    tree = {"nodeid": 0, "split": "a", "split_condition": [1, 3], "yes": 2, "no": 1, "missing": 1, "children": [{"nodeid": 1, "leaf": 1.0}, {"nodeid": 2, "leaf": -1.0}]}
    got = scores(spark, from_xgboost_dump([tree], ["a", "b"]), [(x, 0.0) for x in (1.0, 2.0, 3.0, None)], "a double, b double")
    assert "".join("-" if x < 0.5 else "+" for x in got) == "-+-+"
    tree = {"nodeid": 0, "split": "a", "split_condition": 0.1, "yes": 1, "no": 2, "missing": 1, "children": [{"nodeid": 1, "leaf": -1.0}, {"nodeid": 2, "leaf": 1.0}]}
    got = scores(spark, from_xgboost_dump([tree], ["a", "b"]), [(0.1, 0.0), (0.1 - 1e-8, 0.0), (None, 0.0)], "a double, b double")  # 0.1 rounds to the threshold
    assert "".join("-" if x < 0.5 else "+" for x in got) == "+--"


def test_broken_dumps():
    for bad in (split("c", 1.0, 0, 0), split("a", 1.0, 0, 0, decision_type="<"), split("a", 1.0, 0, 0, missing_type="Other"), split("a", "x", 0, 0), split("a", "1||y", 0, 0, decision_type="==")):
        with pytest.raises(SpecError):
            from_lightgbm_dump(lightgbm(bad))
    with pytest.raises(SpecError):
        from_lightgbm_dump(lightgbm(split("a", "0", 0, 0, decision_type="==")), categorical=["a"])


def grown(rng, depth, features):
    """A random tree of all kinds of splits; children stand anywhere in it."""
    nodes = []

    def put(d):
        k = len(nodes)
        nodes.append(None)
        if not d:
            nodes[k] = Node(leaf=rng.uniform(-0.1, 0.1))
            return k
        right, left = put(d - 1), put(d - 1)
        if rng.random() < 0.2:
            nodes[k] = Node(None, rng.randrange(features), 0.0, "in", left, right, rng.random() < 0.5, members=tuple(float(x) for x in rng.sample(range(8), 3)))
        else:
            nodes[k] = Node(None, rng.randrange(features), rng.choice([0.0, 1.0, 2.5, rng.uniform(-3, 9)]), rng.choice(["le", "lt"]), left, right, rng.random() < 0.5, rng.choice(["nan", "zero", "none"]))
        return k

    put(depth)
    return nodes


def test_a_thousand_trees_in_the_jvm(spark):
    rng = random.Random(5)
    m = TreeModel(["a", "b", "c"], [grown(rng, 6, 3) for _ in range(1000)], 0.25)
    assert sum(map(len, m.trees)) > trees.EXPRESSION_NODES
    rows = [tuple(rng.choice([None, float("nan"), 0.0, 1.0, 2.5, 3.7, -2.0, rng.uniform(-3, 9)]) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double").coalesce(2)
    out = m.transform(df)
    assert out.columns == ["a", "b", "c", "risk_score"] and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.risk_score for r in out.collect()] == pytest.approx([m.apply_row(r.asDict())["risk_score"] for r in df.collect()], abs=1e-12)


# --- growth by leaves --------------------------------------------------------------------------------------------

PLAIN = dict(trees=1, rate=1.0, start=0.5, subsample=1.0, columns=1.0, l1=0.0, l2=0.0, min_rows=1, min_weight=0.0)


def shape(model, k=0, at=0):
    n = model.trees[k][at]
    return round(n.leaf, 6) if n.leaf is not None else (model.features[n.feature], n.members or n.threshold, n.missing_left, shape(model, k, n.left), shape(model, k, n.right))


def test_a_tree_by_hand(spark):
    """At a score of 0.5 each row has g = 0.5 - y and h = 0.25."""
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "x double, y int")
    grow = lambda **o: LeafwiseClassifier(**PLAIN | o).fit(df, "y", ["x"])
    m = grow()
    assert shape(m) == ("x", 2.0, False, -2.0, 2.0)  # G = 1 and H = 0.5 on the left
    assert m.trees[0][0].gain == pytest.approx(4.0) and m.trees[0][0].cover == 4
    assert shape(grow(l2=1.0)) == ("x", 2.0, False, -0.666667, 0.666667)
    assert shape(grow(l1=0.5, rate=0.1)) == ("x", 2.0, False, -0.1, 0.1)
    assert shape(grow(pos_weight=3.0)) == ("x", 2.0, False, -2.0, 2.0)  # g and h of bad rows threefold
    assert not grow(min_rows=3).trees and not grow(min_weight=0.6).trees and not grow(min_gain=4.0).trees
    assert grow(start=None).base == 0.0 and grow(start=None, pos_weight=3.0).base == pytest.approx(np.log(3))


def test_leaves_are_split_by_their_gain(spark):
    """Both sides of the first split can be split; the second leaf that may still come goes where the gain is greater."""
    rows = [(0.0, 0.0, 0)] * 30 + [(0.0, 1.0, 0)] * 9 + [(0.0, 1.0, 1)] * 1 + [(1.0, 0.0, 1)] * 20 + [(1.0, 1.0, 1)] * 10 + [(1.0, 1.0, 0)] * 10
    df = spark.createDataFrame(rows, "a double, b double, y int")
    grow = lambda **o: LeafwiseClassifier(**PLAIN | o).fit(df, "y", ["a", "b"])
    assert shape(grow(leaves=2)) == ("a", 0.0, False, -1.9, 1.0)
    assert shape(grow(leaves=3)) == ("a", 0.0, False, -1.9, ("b", 0.0, False, 2.0, 0.0))
    both = ("a", 0.0, False, ("b", 0.0, False, -2.0, -1.6), ("b", 0.0, False, 2.0, 0.0))
    assert shape(grow(leaves=4)) == shape(grow(leaves=None)) == both
    assert shape(grow(leaves=None, depth=1)) == shape(grow(leaves=2))


def test_missing_values_and_categories(spark):
    df = spark.createDataFrame([(None, "u", 1), (1.0, "v", 0), (2.0, "w", 1), (None, "u", 1), (1.0, "v", 0), (2.0, None, 1)], "x double, s string, y int")
    assert shape(LeafwiseClassifier(**PLAIN).fit(df, "y", ["x"])) == ("x", 1.0, False, -2.0, 2.0)  # missing to the bad side
    m = LeafwiseClassifier(**PLAIN).fit(df, "y", ["s"])
    node = m.trees[0][0]
    assert node.mode == "in" and m.categories == {"s": {"u": 0.0, "v": 1.0, "w": 2.0}} and len(m.trees[0]) == 3
    got = scores(spark, m, [("u", 0), ("v", 0), ("w", 0), (None, 0), ("new", 0)], "s string, y int")
    assert [x > 0.5 for x in got] == [True, False, True, True, True]
    assert PipelineModel.from_json(PipelineModel((m,), ("s",)).to_json()).steps[0] == m


def brute_tree(x, y, leaves, rule):
    """Growth by leaves over all cuts at values, row by row: {leaf rows: value}."""
    g, h = 0.5 - y, np.full(len(y), 0.25)
    term = lambda r: max(abs(g[r].sum()) - rule.l1, 0) ** 2 / (h[r].sum() + rule.l2)

    def best(rows):
        found = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(a), len(b)) >= rule.min_rows and min(h[a].sum(), h[b].sum()) >= rule.min_weight:
                    gain = term(a) + term(b) - term(rows)
                    if gain > rule.min_gain + 1e-12 and (found is None or gain > found[0] * (1 + 1e-12)):
                        found = (gain, a, b)
        return found

    open_ = [(np.arange(len(y)), best(np.arange(len(y))))]
    while len(open_) < leaves and any(s for _, s in open_):
        k = max((i for i in range(len(open_)) if open_[i][1]), key=lambda i: open_[i][1][0])
        _, (_, a, b) = open_.pop(k)
        open_ += [(a, best(a)), (b, best(b))]
    return {tuple(r): -np.sign(g[r].sum()) * max(abs(g[r].sum()) - rule.l1, 0) / (h[r].sum() + rule.l2) for r, _ in open_}


@pytest.mark.parametrize(("leaves", "l1", "l2", "min_rows", "min_weight"), [(6, 0.0, 1.0, 1, 0.0), (12, 0.3, 0.5, 4, 2.0)])
def test_growth_against_brute_force(spark, leaves, l1, l2, min_rows, min_weight):
    rng = np.random.default_rng(leaves)
    x = rng.integers(0, [40, 5, 200], (300, 3)).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(2 - x[:, 0] / 12 + (x[:, 1] == 2) - x[:, 2] / 150))).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(3)
    m = LeafwiseClassifier(**PLAIN | dict(leaves=leaves, l1=l1, l2=l2, min_rows=min_rows, min_weight=min_weight)).fit(df, "y", ["a", "b", "c"])
    want = brute_tree(x, y, leaves, Growth(l1, l2, min_rows, min_weight, 0.0))
    assert sum(n.leaf is not None for n in m.trees[0]) == len(want) > 3
    value = np.empty(300)
    for rows, v in want.items():
        value[list(rows)] = v
    got = [m.apply_row(dict(zip("abc", r, strict=True)))["risk_score"] for r in x]
    assert got == pytest.approx(list(probability(value)), abs=1e-7)


def test_early_stopping_keeps_the_best_prefix(spark, monkeypatch):
    monkeypatch.setattr(growth, "WRITE_EVERY", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < probability(1.5 * x[:, 0])).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, y int").repartition(2)
    train, held = df.filter("i < 300"), df.filter("i >= 300")
    options = dict(trees=14, leaves=8, rate=0.5, min_rows=2, subsample=0.7)
    every = LeafwiseClassifier(**options, patience=None).fit(train, "y", ["a", "b"])
    losses = prefix_losses(every, held, "y")
    best = int(np.argmin(losses[1:])) + 1
    assert len(losses) == 15 and 1 <= best < 14 and losses[0] == pytest.approx(np.logaddexp(0, every.base) - every.base * y[300:].mean())
    stopped = LeafwiseClassifier(**options, patience=4).fit(train, "y", ["a", "b"], validation=held)
    assert stopped.trees == every.trees[:best]
    spark_trees = BoostedClassifier(trees=10, depth=4, rate=0.5).fit(train, "y", ["a", "b"], validation=held)
    assert 1 <= len(spark_trees.trees) < 10
    assert sum(importance(stopped, "weight").values()) == sum(n.leaf is None for t in stopped.trees for n in t)


def test_growth_needs_both_labels(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, None), (4.0, -1)], "x double, y int")
    with pytest.raises(ValueError, match="both labels"):
        LeafwiseClassifier().fit(df, "y", ["x"])


# --- search --------------------------------------------------------------------------------------------------------


def searched(search, seed, trials=40):
    """The best value found on a surface with one peak at rate 0.02, depth 7 and share 0.3."""
    rng, history = random.Random(seed), []
    for _ in range(trials):
        x = search.suggest(None, rng, history)
        assert 0.001 <= x["rate"] <= 1.0 and x["depth"] in range(1, 13) and 0.0 <= x["share"] <= 1.0
        history.append((x, -((np.log10(x["rate"] / 0.02)) ** 2) - ((x["depth"] - 7) / 6) ** 2 - (x["share"] - 0.3) ** 2))
    return max(v for _, v in history)


def test_parzen_search_beats_random_search():
    space = {"rate": (0.001, 1.0), "depth": (1, 12), "share": (0.0, 1.0)}
    parzen = [searched(ParzenSearch(space), s) for s in range(20)]
    plain = [searched(RandomSearch(space), s) for s in range(20)]
    assert np.mean(parzen) > np.mean(plain) / 2 and np.median(parzen) > np.median(plain)  # both are below 0
    assert sum(a > b for a, b in zip(parzen, plain, strict=True)) >= 15
    assert parzen[:3] == [searched(ParzenSearch(space), s) for s in range(3)]


def test_parzen_search_tunes_a_pipeline(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(i, float(a), float(b), int(a + b + e > 0)) for i, ((a, b), e) in enumerate(zip(x, rng.normal(size=300), strict=True))], "row int, a double, b double, y int").repartition(2).cache()
    search = ParzenSearch({"leaves": (2, 6), "rate": (0.01, 0.9)}, trials=4, startup=2)
    model, chosen, value = search.fit(Pipeline([LeafwiseClassifier(trees=2, min_rows=5)]), df, "y", ["a", "b"], "row")
    assert 2 <= chosen["leaves"] <= 6 and 0.5 < value <= 1 and len(model.steps[-1].trees) == 2


def test_growth_passes_over_blocks(spark, monkeypatch):
    """Binned rows are kept as blocks of many rows, and a tree's passes do not go through earlier trees."""
    seen = []
    tree = LeafwiseClassifier._tree
    monkeypatch.setattr(LeafwiseClassifier, "_tree", lambda self, rows, *rest: (seen.append([(r.codes, r.margin) for r in rows.collect()]), tree(self, rows, *rest))[1])
    df = spark.range(4000, numPartitions=2).selectExpr("id % 50 cast", "id").selectExpr("cast(cast as double) AS x", "cast(id % 3 = 0 and cast < 30 as int) AS y")
    m = LeafwiseClassifier(trees=2, leaves=4, rate=0.5, subsample=1.0, columns=1.0).fit(df, "y", ["x"])
    assert [sum(len(c) for c, _ in blocks) for blocks in seen] == [4000, 4000] and all(len(blocks) == 2 for blocks in seen)
    first, second = ([np.frombuffer(b, np.float64) for _, b in blocks] for blocks in seen)
    assert len(m.trees) == 2 and {float(x) for b in first for x in b} == {m.base} and len({float(x) for b in second for x in b}) > 1
