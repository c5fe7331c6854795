"""Cleaning, binning, selection, metrics, pipelines, specifications, experiments, reports, sources and streams."""

import json
import zipfile
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from corbel.errors import ScoringError, SpecError, UnsupportedStepError
from corbel.operators import metrics, ranks, stats
from corbel.operators.binning import ChiMergeBinner, bin_value, chi2, chi2_quantile, merge
from corbel.operators.cleaning import FeatureCleaner
from corbel.operators.encoding import BinnerWoeEncoder
from corbel.operators.filters import TimeWindow, hash_sample, without_gray
from corbel.operators.scaling import LogitScale, pdo_scale
from corbel.operators.selection import CorrelationSelector, IVSelector, PSISelector, greedy_drops
from corbel.operators.stage import Model
from corbel.plans.experiment import ExperimentRunner, RandomSearch, default_pipeline, feature_grid, make_grid
from corbel.plans.pipeline import FeatureDerivation, Pipeline, PipelineModel, add_risk_score, assert_consistent, register
from corbel.plans.report import ModelReport, ReportContext
from corbel.plans.trees import BoostedClassifier, from_lightgbm_dump, from_xgboost_dump, importance, literal_trees
from corbel.sources.loans import DICTIONARY, LEAKING, SELECTED, load, select_features, synthetic
from corbel.sources.workbook import FormatConfig, Workbook, column_name
from corbel.streaming.scoring import binned_counts, start_scoring


@pytest.fixture(scope="module")
def data(spark):
    return synthetic(spark, 1500).cache()


FEATURES = ["amount", "age", "income", "freq", "noise1"]


@pytest.fixture(scope="module")
def model(data):
    steps = [FeatureDerivation((("share", "amount / income"),)), FeatureCleaner(), BinnerWoeEncoder(max_bins=5), IVSelector(0.0, 5.0), CorrelationSelector(0.95), BoostedClassifier(trees=4, depth=3, scale=pdo_scale())]
    return Pipeline(steps).fit(data, "y", FEATURES)


def test_cleaner(spark):
    rows = [(float(i), None if i % 2 else 1.0, -999.0 if i < 5 else float(i), "a" if i % 3 else "b", None) for i in range(30)]
    df = spark.createDataFrame(rows, "x double, flat double, mark double, s string, gone double")
    m = FeatureCleaner(outliers="percentile", percentiles=(0.1, 0.9)).fit(df, "x", ["x", "flat", "mark", "s", "gone"])
    assert m.dropped == {"flat": "distinct", "gone": "missing"} and m.impute["s"] == "a" and m.impute["mark"] == median(range(5, 30))
    out = m.transform(df).collect()
    assert out[0].mark == median(range(5, 30)) and out[0].x == pytest.approx(2.9) and "gone" not in out[0]
    assert [m.apply_row(r.asDict()) for r in df.collect()] == [r.asDict() for r in out]
    assert FeatureCleaner(missing="drop_row").fit(df, "x", ["mark"]).transform(df).count() == 25
    assert FeatureCleaner(missing="constant", outliers="iqr", action="set_null").fit(df, "x", ["mark"]).impute == {"mark": 0.0}
    with pytest.raises(ValueError, match="unknown"):
        FeatureCleaner(missing="guess").fit(df, "x", ["mark"])


def test_chi_merge():
    assert chi2_quantile(0.9) == pytest.approx(2.7055, abs=1e-3)
    assert chi2([1, 10, 20], [2, 10, 20]) == 0 and chi2([1, 0, 0], [2, 0, 0]) == 0
    bins = [[float(i), p, 100] for i, p in enumerate([10, 11, 50, 52, 90, 91])]
    assert [b[0] for b in merge(bins, 10, 2, chi2_quantile(0.9), 0.05)] == [1.0, 3.0, 5.0]
    assert len(merge(bins, 2, 2, 0, 0)) == 2 and len(merge(bins, 10, 1, 1e9, 0)) == 1
    assert len(merge([[0.0, 1, 2], [1.0, 50, 98], [2.0, 0, 100]], 5, 2, 0, 0.05)) == 2


def test_binner(spark):
    rows = [(-999.0 if i < 60 else float(i % 40), ("p", "q", "r")[i % 3], int(i % 40 > 19 or i % 3 == 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "x double, c string, y int")
    m = ChiMergeBinner(max_bins=4, special_values=[-999.0, 12345.0]).fit(df, "y", ["x", "c"])
    edges = m.edges["x"]
    assert edges[0] is None and edges[-1] is None and edges[1] == -499.5 and all(a < b for a, b in zip(edges[1:-1], edges[2:-1]))
    assert m.categories["c"]["r"] == 2 and m.row_bin("c", "unknown") is None
    got = m.transform(df).collect()
    assert [(r.x, r.c) for r in got] == [(m.row_bin("x", x), m.row_bin("c", c)) for x, c, _ in rows]
    assert bin_value(None, edges) is None and bin_value(-999.0, edges) == 0
    with pytest.raises(ValueError, match="no such columns"):
        m.transform(df.drop("x"))


def test_woe_is_by_hand(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0, 1), (1.0, 1), (None, 0)], "b double, y int")
    got = {r.value: r for r in stats.woe_table(df, ["b"], "y").collect()}
    k, eps = 2, 0.001
    want = np.log(((1 + eps) / (2 + eps * k)) / ((1 + eps) / (2 + eps * k)))
    assert got[0.0].woe == pytest.approx(want) and got[1.0].woe == pytest.approx(np.log(((1 + eps) / (2 + eps * k)) / ((0 + eps) / (2 + eps * k))))


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.0


def test_metrics(spark):
    rng = np.random.default_rng(0)
    s = np.round(rng.random(400), 2)
    y = (rng.random(400) < s).astype(int)
    rows = [("a", int(a), float(b)) for a, b in zip(y, s)] + [("one", 1, 0.5), ("one", 1, 0.7), ("flat", 0, 0.5), ("flat", 1, 0.5), ("gap", 1, None)]
    df = spark.createDataFrame(rows, "k string, y int, s double")
    auc = {r.k: r.auc for r in metrics.auc(df, "y", "s", ["k"]).collect()}
    assert auc["a"] == pytest.approx(brute_auc(y, s)) and auc["one"] == 0 and auc["flat"] == 0.5
    ks = {r.k: r.ks for r in metrics.ks(df, "y", "s", ["k"]).collect()}
    at = np.clip(np.searchsorted(np.linspace(0, 1, 101), s, side="right") - 1, 0, 99)
    assert ks["a"] == pytest.approx(max(abs((at[y == 1] <= b).mean() - (at[y == 0] <= b).mean()) for b in range(100)), abs=1e-9) and ks["flat"] == 0 and ks["one"] == 0
    lift = metrics.lift_at(df.filter("k = 'a'"), "y", "s", (10,)).first().lift_10
    assert lift == pytest.approx(y[s >= np.percentile(s, 90)].mean() / y.mean())
    table = metrics.lift_table(df.filter("k = 'a'"), "y", "s").orderBy("bin").collect()
    assert sum(r.total for r in table) == 400 and table[-1].cum_lift == pytest.approx(1) and table[-1].ks == pytest.approx(0, abs=1e-12)
    assert metrics.lift_table(df.filter("k = 'flat'"), "y", "s").count() == 0
    wide = metrics.ks(df.withColumn("s", F.col("s") * 7 - 3).filter("k = 'a'"), "y", "s").first().ks
    assert wide > 0.1
    assert metrics.metric_table(df, "y", "s", ["k"]).filter("k = 'a'").count() == 3


def test_swap_counts(spark):
    rows = [(i % 2, float(i), float((i * 7) % 20)) for i in range(20)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    for r in metrics.swap_table(df, "y", "a", "b").collect():
        ca, cb = (np.percentile([x[k] for x in rows], r.pct) for k in (1, 2))
        assert r.new_reject == sum(x[1] <= ca for x in rows) and r.swap_in == sum(x[2] <= cb and x[1] > ca for x in rows) and r.net == r.swap_in - r.swap_out


def test_selectors(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=300)
    df = spark.createDataFrame([(float(x), float(x + 0.01 * e), float(c), int(x > 0)) for x, e, c in zip(a, rng.normal(size=300), rng.normal(size=300))], "a double, b double, c double, y int")
    kept = CorrelationSelector(0.9, {"a": 0.1, "b": 0.2}).fit(df, "y", ["a", "b", "c"])
    assert kept.kept == ["b", "c"] and CorrelationSelector(0.9, strategy="drop_both").fit(df, "y", ["a", "b", "c"]).kept == ["c"]
    assert greedy_drops([("a", "b", 0.99), ("b", "c", 0.95)], {}) == {"b": "a"}
    assert IVSelector(0.0, 0.5).fit(df.withColumn("leak", F.col("y").cast("double")), "y", ["leak"]).dropped == {"leak": "iv_high"}
    moved = df.withColumn("a", F.col("a") + 5)
    assert PSISelector().fit(df, "y", ["a", "c"], validation=moved).dropped == {"a": "psi"}
    assert PSISelector().fit(df, "y", ["a"]).kept == ["a"]
    assert {r.feature: r.psi for r in stats.psi(df, df, ["a"]).collect()}["a"] == pytest.approx(0, abs=1e-12)


def test_scales(spark):
    p = pdo_scale(600, 1 / 51, 50)
    assert p(1 / 51) == pytest.approx(600) and p(1 / 101) == pytest.approx(650) and LogitScale()(0.5) == 600
    assert LogitScale(higher_is_safer=False)(0.9) > 600 and np.isfinite(p(0.0)) and np.isfinite(p(1.0))
    with pytest.raises(ScoringError):
        p(1.5)
    df = spark.createDataFrame([(0.2,), (None,)], "p double")
    got = [r.s for r in df.select(p.of_probability(F.col("p")).alias("s")).collect()]
    assert got[0] == pytest.approx(p(0.2)) and got[1] is None
    with pytest.raises(Exception, match="not a probability"):
        spark.createDataFrame([(2.0,)], "p double").select(p.of_probability(F.col("p"))).collect()


def test_trees(spark):
    spec = [{"feature": "x", "threshold": 1.0, "left": -1.0, "right": 1.0, "missing_left": True}]
    df = spark.createDataFrame([(1.0,), (1.5,), (None,), (float("nan"),)], "x double")
    for m in (literal_trees(spec, ["x"]), literal_trees(spec * 60, ["x"])):
        got = [r.risk_score for r in m.transform(df).collect()]
        want = [m.apply_row(r.asDict())["risk_score"] for r in df.collect()]
        assert got == pytest.approx(want) and got[0] == got[2] == got[3] < got[1]


def test_pipeline(spark, data, model):
    assert assert_consistent(model, data, 60) < 1e-9
    scored = model.score(data)
    assert scored.columns == [*data.columns, "risk_score"] and scored.drop("risk_score").exceptAll(data).count() == 0
    text = model.to_json()
    again = add_risk_score(data, text)
    assert scored.exceptAll(again).count() == 0 and PipelineModel.from_json(text).to_json() == text
    auc = metrics.auc(scored.withColumn("risk", -F.col("risk_score")), "y", "risk").first().auc
    assert auc > 0.6
    assert [k for _, k, _ in model.describe()] == ["derive", "clean", "woe", "select", "select", "trees"]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan  # scoring is one projection


def test_specifications(data, model):
    spec = json.loads(model.to_json())
    with pytest.raises(SpecError, match="needs reader"):
        PipelineModel.from_dict(spec | {"least_reader": [9, 0, 0]})
    with pytest.raises(SpecError, match="unknown"):
        PipelineModel.from_dict(spec | {"steps": [{"kind": "magic"}]})
    with pytest.raises(SpecError):
        PipelineModel.from_json("{}")
    with pytest.raises(UnsupportedStepError):
        PipelineModel((FeatureCleaner(missing="drop_row").fit(data, "y", ["age"]), model.steps[-1])).score(data)

    class Double(Model):
        kind = "double"

        def transform(self, df):
            return df.withColumn("age", F.col("age") * 2)

        def apply_row(self, row):
            return row | {"age": row["age"] * 2}

        def to_dict(self):
            return {"kind": self.kind}

        @classmethod
        def from_dict(cls, spec):
            return cls()

    register(Double)
    own = PipelineModel((Double(), *model.steps), model.features)
    assert type(PipelineModel.from_json(own.to_json()).steps[0]) is Double


def test_experiments(spark, data):
    small = dict(trees=2, depth=2)
    df = data.withColumn("z", 1 - F.col("y")).withColumn("w", F.lit(1.0))
    pipe = lambda w=None: Pipeline([FeatureCleaner(), BinnerWoeEncoder(max_bins=4), BoostedClassifier(weight=w, **small)])
    grid = make_grid(["y"], weights=(None,), features=tuple(FEATURES), pipeline=pipe()) + make_grid(["missing"], features=tuple(FEATURES), pipeline=pipe()) + feature_grid("y", {"few": ["noise1"]}, pipeline=pipe())
    assert [c.name for c in grid] == ["exp_000_y", "exp_000_missing", "feat_000_few"]
    run = ExperimentRunner(grid, eval_labels=["z"]).fit(df, df)
    assert [r["status"] for r in run.rows] == ["ok", "failed", "ok"] and run.best()[0] == "exp_000_y"
    assert run.best()[1] == pytest.approx(run.rows[0]["oot_auc"]) and run.rows[0]["z_auc"] == pytest.approx(1 - run.rows[0]["auc"])
    assert run.results(spark).count() == 3 and "## Best" in run.to_markdown(spark) and run.best_model().steps
    model, chosen, value = RandomSearch({"depth": (1, 3), "rate": (0.001, 0.5)}, trials=2).fit(pipe(), data, "y", FEATURES, "amount")
    assert 1 <= chosen["depth"] <= 3 and 0 < value <= 1 and default_pipeline().steps


def test_report(spark, data, model, tmp_path):
    i = F.monotonically_increasing_id()
    df = data.withColumn("tag", F.when(i % 5 == 4, "gray").when(i % 5 == 3, "oot").when(i % 5 == 2, "test").otherwise("train")).withColumn("old", F.rand(3) * 700).withColumn("y2", F.col("y")).withColumn("t", F.lit("2024-01-15 10:00:00").cast("timestamp"))
    df = df.withColumn("y", F.when(F.col("tag") == "gray", -1).otherwise(F.col("y"))).cache()
    ctx = ReportContext(df, "y", "tag", model=model, features=FEATURES, baseline="old", time="t", extra_labels=["y2"], gray_tag="gray")
    report = ModelReport().fit(ctx)
    assert len(report.sections) == 22 and all(s.table.columns for x in report.sections.values() for s in x)
    stats_ = {r.tag: r for r in report.get("sample_selection")[1].table.collect()}
    assert stats_["total"].total_with_gray == 1500 and stats_["gray"].gray == stats_["gray"].total_with_gray
    assert {r.dataset for r in report.get("score_lift_gray")[0].table.collect()} == {"train", "test", "oot", "gray"}
    report.to_xlsx(str(tmp_path / "r.xlsx"))
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        assert sum(n.startswith("xl/worksheets") for n in z.namelist()) == 8 and z.testzip() is None
    bare = ModelReport(document=[("x", ["model_comparison", "swap_analysis", "mob_performance", "var_binning", "portrait"])]).fit(ReportContext(df, "y", "tag", "old", features=FEATURES))
    assert all(s[0].table.columns == ["note"] for s in bare.sections.values())
    ctx.close()


def test_workbook(tmp_path):
    assert [column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    book = Workbook()
    book.add("s", "t", ["a", "bad_rate"], [(1, 0.5), (None, float("nan")), ("<&>", 1e99)])
    assert book.sheet("s") == "s_1" and "dataBar" in book._sheet("s") and "&lt;&amp;&gt;" in book._sheet("s")


def test_sources_and_filters(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("id,loan_status,term,emp_length,int_rate,recoveries,loan_amnt\n1,Fully Paid, 36 months,10+ years,12.5%,1,10\n2,Charged Off,x,?,bad,2,20\n3,Current, 60 months,1 year,1%,3,30\n")
    rows = load(spark, str(path)).orderBy("loan_amnt").collect()
    assert [tuple(r) for r in rows] == [(10.0, 12.5, 10, 36.0, 0), (None, None, 20, None, 1)]
    assert select_features(["id", "recoveries", "q"], "all") == ["q"] and select_features(["id", "recoveries"], "all", False) == ["recoveries"]
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-31",), ("2024-02-01",), (None,)], "d string").withColumn("t", F.col("d").cast("timestamp"))
    assert TimeWindow("t", "2024-01-01", "2024-01-31").filter(df).count() == 2 and TimeWindow("d", end="2024-01-31").filter(df).count() == 2
    assert without_gray(spark.createDataFrame([(-1,), (0,), (1,)], "y int"), "y").count() == 2
    n = spark.range(100)
    assert hash_sample(n, "id", 10).collect() == hash_sample(n.repartition(7), "id", 10).collect()


@pytest.mark.parametrize(("keys", "most", "rows_"), [([], 7, 40), (["k"], 7, 40), (["k"], 3, 100_000), ([], 32, 30)])
def test_exact_quantiles(spark, keys, most, rows_, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 3000), np.exp(rng.normal(size=3000) * 4).round(2))] + [(9, 1.0), (9, None), (8, None), (7, 1.0), (7, 2.0)]
    monkeypatch.setattr(ranks, "RANGES", most)
    monkeypatch.setattr(ranks, "ROWS", rows_)
    monkeypatch.setattr(ranks, "VALUE_BYTES", 0)
    ps = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]
    counts = ranks.value_counts(spark.createDataFrame(rows, "k int, v double"), keys, "v")
    got = {(r.k if keys else None): (r.q, r.n) for r in ranks.quantiles(counts, keys, ps, "v").collect()}
    want = {}
    for k in ({r[0] for r in rows} if keys else {None}):
        v = [x for i, x in rows if x is not None and (k is None or i == k)]
        if v:
            want[k] = (pytest.approx(np.quantile(v, ps).tolist(), rel=1e-12), len(v))
    assert got == want


def test_correlations_of_many_columns(spark, monkeypatch):
    """Tiles give what one matrix gives."""
    monkeypatch.setattr(stats, "TILE", 40)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 90))
    x[:, 85] = x[:, 3] + rng.normal(size=60) / 10
    names = [f"c{i}" for i in range(90)]
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>").repartition(2).select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    got = {(r.f1, r.f2): r.r for r in stats.correlations(df, names, 0.6).collect()}
    want = np.corrcoef(x.T)
    i, j = np.nonzero(np.triu(np.abs(want) > 0.6, 1))
    assert got == pytest.approx({(names[a], names[b]): want[a, b] for a, b in zip(i, j, strict=True)}, abs=1e-9) and ("c3", "c85") in got


def test_ranges_by_the_number_of_values(spark, monkeypatch):
    """Ranges ascend with the value and none holds much more than ROWS, whether quantiles or pieces bound them."""
    monkeypatch.setattr(ranks, "ROWS", 100)
    monkeypatch.setattr(ranks, "VALUE_BYTES", 0)
    for most, n in ((32, 20_000), (8, 20_000), (32, 900)):
        monkeypatch.setattr(ranks, "RANGES", most)
        counts = ranks.value_counts(spark.range(n).selectExpr("exp(id / 3000D) AS v"), [], "v")
        rows = sorted((r.v, r.range) for r in ranks.ranged(counts, [], "v").collect())
        assert [r for _, r in rows] == sorted(r for _, r in rows) and len(rows) == n
        sizes = np.unique([r for _, r in rows], return_counts=True)[1]
        assert sizes.max() <= 250 and len(sizes) >= min(most, n // 100)


def test_counted_cells(spark):
    rng = np.random.default_rng(2)
    pick = lambda *v: v[rng.integers(len(v))]
    rows = [(pick("a", "b", None), pick(1, 2, None), pick(0, 1), pick(0.0, -0.0, 1.0, 5e9, None, float("nan"), -3.0), pick(0.5, 1e300, float("inf"), -2.0)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, `odd key` int, y int, x double, z double").repartition(3)
    for keys in ([], ["k"], ["k", "odd key"]):
        got = {tuple(r[: len(keys) + 2]): r[len(keys) + 2 :] for r in map(tuple, stats.counted(df, ["x", "z"], keys, "y").collect())}
        want = {}
        for r in rows:
            for place, v in enumerate(r[3:]):
                cell = (*r[: len(keys)], place, None if v is None or v != v else v)
                n, pos = want.get(cell, (0, 0))
                want[cell] = (n + 1, pos + r[2])
        assert got == want
    assert not stats.counted(df.limit(0), ["x"], ["k"]).collect()


@pytest.mark.parametrize(("few", "tile"), [(8, 512), (0, 512), (0, 2)])  # single aggregates, one tile, three tiles
def test_correlations_pairwise(spark, few, tile, monkeypatch):
    monkeypatch.setattr(stats, "FEW", few)
    monkeypatch.setattr(stats, "TILE", tile)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) + 1e6
    x[:, 1] += x[:, 0] - 1e6
    x[::7, 2] = np.nan
    rows = [(*map(float, r), 5.0, None) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, gone double").repartition(3)
    got = {(r.f1, r.f2): r.r for r in stats.correlations(df, ["a", "b", "c", "flat", "gone"]).collect()}
    ok = ~np.isnan(x[:, 2])
    assert got["a", "b"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1], abs=1e-9) and got["b", "c"] == pytest.approx(np.corrcoef(x[ok, 1], x[ok, 2])[0, 1], abs=1e-9)
    assert len(got) == 10 and all(got[p] is None for p in got if {"flat", "gone"} & set(p))
    assert stats.correlations(df.limit(0), ["a", "b"]).collect()[0].r is None if stats.correlations(df.limit(0), ["a", "b"]).count() else True


def test_tree_dumps(spark):
    xgb = [
        {"nodeid": 0, "split": "a", "split_condition": 0.1, "yes": 1, "no": 2, "missing": 2, "gain": 8.0, "cover": 10.0, "children": [{"nodeid": 2, "leaf": 0.3, "cover": 4.0}, {"nodeid": 1, "split": "b", "split_condition": 5, "yes": 3, "no": 4, "missing": 3, "gain": 2.0, "cover": 6.0, "children": [{"nodeid": 3, "leaf": -0.2}, {"nodeid": 4, "leaf": 0.1}]}]},
        {"nodeid": 0, "leaf": 0.05},
    ]
    m = from_xgboost_dump(json.dumps(xgb), ["a", "b"], 0.2)
    rows = [(0.0, 4.0), (0.0, 5.0), (0.1, 0.0), (None, 0.0), (-1.0, None)]
    base = np.log(0.2 / 0.8)
    want = [1 / (1 + np.exp(-(base + x + 0.05))) for x in (-0.2, 0.1, 0.3, 0.3, -0.2)]
    df = spark.createDataFrame(rows, "a double, b double").coalesce(1)
    assert [r.risk_score for r in m.transform(df).collect()] == pytest.approx(want, abs=1e-7)
    assert [m.apply_row({"a": a, "b": b})["risk_score"] for a, b in rows] == pytest.approx(want, abs=1e-7)
    assert importance(m, "gain") == {"a": 8.0, "b": 2.0} and importance(m, "weight") == {"a": 1.0, "b": 1.0} and importance(m, "total_cover") == {"a": 10.0, "b": 6.0}
    lgb = {"feature_names": ["a", "b"], "tree_info": [{"tree_structure": {"split_feature": 1, "threshold": 5.0, "decision_type": "<=", "default_left": True, "split_gain": 3.0, "internal_count": 9, "left_child": {"leaf_value": -0.4}, "right_child": {"split_feature": "a", "threshold": 0.0, "decision_type": "<=", "default_left": False, "left_child": {"leaf_value": 0.2}, "right_child": {"leaf_value": 0.6}}}}]}
    m = from_lightgbm_dump(json.dumps(lgb))
    want = [1 / (1 + np.exp(-x)) for x in (-0.4, -0.4, -0.4, -0.4, -0.4)]
    assert [r.risk_score for r in m.transform(df).collect()] == pytest.approx(want)
    assert m.apply_row({"a": None, "b": 6.0})["risk_score"] == pytest.approx(1 / (1 + np.exp(-0.6))) and m.apply_row({"a": 0.0, "b": 6.0})["risk_score"] == pytest.approx(1 / (1 + np.exp(-0.2)))
    assert m.predict(df, 0.4).select("prediction").distinct().collect() == [(1,)]
    assert PipelineModel.from_json(PipelineModel((m,), ("a", "b")).to_json()).steps[0] == m
    for broken in (lambda: from_xgboost_dump(xgb, ["b"]), lambda: from_lightgbm_dump({"feature_names": ["a"], "tree_info": [{"tree_structure": {"split_feature": 0, "threshold": "1||2", "decision_type": "=="}}]})):
        with pytest.raises(SpecError):
            broken()


def test_many_trees_stay_in_catalyst(spark):
    tree = {"feature": "a", "threshold": 0.0, "left": {"feature": "b", "threshold": 1.0, "left": 0.001, "right": 0.002}, "right": 0.003}
    m = literal_trees([tree] * 200, ["a", "b"])
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 2.0)], "a double, b double").coalesce(1)
    out = m.transform(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.risk_score for r in out.collect()] == pytest.approx([1 / (1 + np.exp(-0.6)), 1 / (1 + np.exp(-0.4))])


def test_importance_of_fitted_trees(spark, model):
    last = model.steps[-1]
    gain, cover = importance(last, "total_gain"), importance(last, "cover")
    used = {f for f, n in importance(last, "weight").items() if n}
    assert used and all((gain[f] > 0) == (f in used) and (cover[f] > 0) == (f in used) for f in last.features)
    assert sum(importance(last, "share").values()) == pytest.approx(1)


def test_trees_on_strings(spark):
    df = spark.createDataFrame([(c, x, int(c in ("b", "d"))) for c in ("a", "b", "c", "d", None) for x in (1.0, 2.0, 3.0)] * 4, "s string, x double, y int")
    m = BoostedClassifier(trees=3, depth=3, subsample=1.0, columns="all").fit(df, "y", ["s", "x"])
    assert m.categories == {"s": {"a": 0.0, "b": 1.0, "c": 2.0, "d": 3.0}}
    got = {r.s: r.risk_score for r in m.transform(df).collect()}
    assert min(got["b"], got["d"]) > 0.5 > max(got["a"], got["c"], got[None])
    again = PipelineModel.from_json(PipelineModel((m,), ("s", "x")).to_json())
    assert assert_consistent(again, df) < 1e-9 and again.apply_row({"s": "new", "x": 1.0})["risk_score"] == pytest.approx(got[None])


def test_search_with_folds(spark, data):
    ks = next(m for m in metrics.DEFAULT_METRICS if m.name == "ks")
    search = RandomSearch({"depth": (1, 2)}, trials=2, folds=2, metric=ks, prune_after=1)
    fitted, chosen, value = search.fit(Pipeline([BoostedClassifier(trees=2, depth=2)]), data.withColumn("row", F.monotonically_increasing_id()), "y", ["amount", "age"], "row")
    assert chosen["depth"] in (1, 2) and 0 < value < 1 and fitted.steps[-1].trees


def test_report_of_a_fitted_pipeline(spark, data, model):
    from corbel.plans.report import OPERATORS, Attributes

    known = Attributes.of(model)
    assert known.missing_threshold == 0.95 and known.iv_range == (0.0, 5.0) and known.correlation_threshold == 0.95 and known.impute and known.woe and known.labels
    assert known.params["trees"] == 4 and known.params["depth"] == 3 and sum(known.weight.values()) > 0
    ctx = ReportContext(data.withColumn("part", F.when(F.col("age") < 35, "first").otherwise("second")), "y", "part", model=model, features=FEATURES)
    method = {r.setting: r.value for r in OPERATORS["model_method"](ctx)[1].table.collect()}
    assert method["depth"] == "3" and method["rate"] == "0.1"
    assert any(r.step == "missing values filled" and r.n for r in OPERATORS["var_cleaning"](ctx)[0].table.collect())
    assert {r.setting for r in OPERATORS["model_assumption"](ctx)[0].table.collect()} >= {"trees", "seed"}
    rows = {r.feature: r for r in OPERATORS["var_analysis"](ctx)[0].table.collect()}
    assert set(rows) == set(FEATURES) and {"first", "second", "gain", "gain_pct", "weight", "psi"} <= set(rows["age"].asDict()) and rows["amount"].psi > 0
    none = ReportContext(data.withColumn("tag", F.lit("train")), "y", "tag", score="amount", features=["age"])
    assert [OPERATORS[n](none)[-1].table.columns for n in ("model_method", "var_cleaning")] == [["note"]] * 2
    ctx.close()


def test_loan_columns(spark):
    columns = [*SELECTED, *LEAKING, "id", "loan_status", "other"]
    assert len(SELECTED) == 31 and len(LEAKING) == 36 and set(DICTIONARY) == set(SELECTED)
    assert select_features(columns, "all") == sorted([*SELECTED, "other"]) and not set(select_features(columns, LEAKING))
    assert set(LEAKING) <= set(select_features(columns, "all", drop_leaking=False))


def test_sheets_of_one_name(tmp_path):
    book = Workbook(FormatConfig(real="0.00", gap=2))
    for k in range(2):
        at = book.sheet("Same")
        book.add(at, "One", ["n", "bad_rate"], [(1, 0.5), (2, 0.25)])
        book.add(at, "Two", ["x"], [(1.5,)])
        assert at == ("Same", "Same_1")[k]
    book.save(str(tmp_path / "two.xlsx"))
    with zipfile.ZipFile(tmp_path / "two.xlsx") as z:
        text, styles = z.read("xl/worksheets/sheet2.xml").decode(), z.read("xl/styles.xml").decode()
    # the second row of a table is banded, numbers too; two rows lie between tables
    assert 'r="A3" s="3"' in text and 'r="A4" s="7"' in text and 'r="B4" s="9"' in text and 'r="A7"' in text and "0.00&quot;" not in styles and 'formatCode="0.00"' in styles


def test_features_of_too_many_categories(spark, monkeypatch):
    from corbel.operators import binning

    monkeypatch.setattr(binning, "MOST_CATEGORIES", 3)
    df = spark.createDataFrame([(str(k), k % 2) for k in range(9)], "s string, y int")
    with pytest.raises(ValueError, match="categories"):
        ChiMergeBinner().fit(df, "y", ["s"])


def test_streams(spark, data, model, tmp_path):
    src = str(tmp_path / "in")
    data.limit(100).withColumn("t", F.lit("2024-01-01 10:00:00").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    start_scoring(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    q = binned_counts(stream, "t", "freq", [0.0, 2.0, 100.0]).writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("bins").agg(F.sum("n")).first()[0] == 100


def test_rows_of_a_key_do_not_meet_in_one_task(spark):
    """What is known of a key goes to its rows, however large Spark takes it to be; only tables of keys and bins may be shuffled."""
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("bad"), F.lit("t").alias("tag"), F.col("id").cast("double").alias("s"), (F.col("id") % 7).cast("double").alias("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = lambda t: sum(t._jdf.queryExecution().executedPlan().toString().count(x) for x in ("SortMergeJoin", "ShuffledHashJoin"))
        counts = ranks.value_counts(df.withColumnRenamed("s", "value"), ["tag"])
        assert [shuffled(t) for t in (
            ranks.quantiles(counts, ["tag"], [0.5]), metrics.auc(df, "bad", "s", ["tag"]), metrics.ks(df, "bad", "s", ["tag"]), metrics.lift_at(df, "bad", "s", (10,), ["tag"]),
            metrics.effect_table(df, "bad", "s", ["tag"]), metrics.swap_table(df, "bad", "s", "b", keys=["tag"]), metrics.feature_ks(df, ["b"], "s", keys=["tag"]),
        )] == [0] * 7
        assert shuffled(metrics.lift_table(df, "bad", "s", ["tag"], baseline="b")) == 2 and shuffled(stats.psi(df, df, ["s", "b"], ["tag"])) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
