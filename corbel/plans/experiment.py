"""Experiment grids: labels, windows, weights and features; a runner; results, the best, and a Markdown report."""

from __future__ import annotations

import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import product
from math import ceil, log, sqrt
from statistics import NormalDist, fmean, median
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corbel.operators.cleaning import FeatureCleaner
from corbel.operators.encoding import BinnerWoeEncoder
from corbel.operators.filters import TimeWindow
from corbel.operators.metrics import DEFAULT_METRICS, Metric, metric_table
from corbel.operators.selection import CorrelationSelector, IVSelector
from corbel.operators.stage import Estimator
from corbel.plans.pipeline import Pipeline, PipelineModel
from corbel.plans.trees import BoostedClassifier, TreeModel, importance


@dataclass(frozen=True)
class ExperimentConfig:
    name: str
    label: str
    window: TimeWindow | None = None
    weight: str | None = None
    features: tuple[str, ...] | None = None
    pipeline: Pipeline | None = None


def make_grid(labels: Sequence[str], windows: Sequence[TimeWindow | None] = (None,), weights: Sequence[str | None] = (None,), prefix: str = "exp", **rest: object) -> list[ExperimentConfig]:
    """Every combination, named prefix_000_label[_window][_w=weight]."""
    out = []
    for k, (y, w, c) in enumerate(product(labels, windows, weights)):
        name = f"{prefix}_{k:03d}_{y}" + (f"_{w.start or ''}~{w.end or ''}" if w else "") + (f"_w={c}" if c else "")
        out.append(ExperimentConfig(name, y, w, c, **rest))  # type: ignore[arg-type]
    return out


def feature_grid(label: str, groups: dict[str, Sequence[str]], prefix: str = "feat", **rest: object) -> list[ExperimentConfig]:
    return [ExperimentConfig(f"{prefix}_{k:03d}_{g}", label, features=tuple(fs), **rest) for k, (g, fs) in enumerate(groups.items())]  # type: ignore[arg-type]


def default_pipeline(weight: str | None = None, **model: object) -> Pipeline:
    return Pipeline([FeatureCleaner(), BinnerWoeEncoder(), IVSelector(), CorrelationSelector(), BoostedClassifier(weight=weight, **model)])  # type: ignore[arg-type]


@dataclass(frozen=True)
class RandomSearch:
    """Seeded random search: fits on a hash split of the rows, scores the rest, refits the best on all.

    ``space`` maps a field of the pipeline's last step to (low, high): whole numbers if both are and the field is;
    by the logarithm if low > 0 and high / low > 100.  With ``folds`` each trial is the mean over that many parts, each
    held out once; after ``prune_after`` trials one ends at the first fold at which its mean is below the median of
    those that got so far (None: never).  ``metric`` is any, by default AUC.
    """

    space: dict[str, tuple[float, float]]
    trials: int = 10
    seed: int = 42
    held: float = 0.25
    metric: Metric = DEFAULT_METRICS[0]
    folds: int = 1
    prune_after: int | None = 5

    def _at(self, step: Estimator | None, name: str, u: float) -> float:
        """The value of a field at a place between 0 and 1 of its range."""
        lo, hi = self.space[name]
        if self._whole(step, name):
            return min(int(hi), int(lo) + int(u * (int(hi) - int(lo) + 1)))
        return lo * (hi / lo) ** u if lo > 0 and hi / lo > 100 else lo + u * (hi - lo)

    def _place(self, step: Estimator | None, name: str, value: float) -> float:
        """The place of a value; of a whole number the middle of its share."""
        lo, hi = self.space[name]
        if self._whole(step, name):
            return (value - lo + 0.5) / (hi - lo + 1)
        return log(value / lo) / log(hi / lo) if lo > 0 and hi / lo > 100 else (value - lo) / (hi - lo) if hi > lo else 0.5

    def _whole(self, step: Estimator | None, name: str) -> bool:
        lo, hi = self.space[name]
        return isinstance(lo, int) and isinstance(hi, int) and (step is None or isinstance(getattr(step, name), int))

    def suggest(self, step: Estimator | None, rng: random.Random, history: Sequence[tuple[dict, float]] = ()) -> dict:
        """Values for the next trial; ``history`` holds the values and results of the earlier ones."""
        return {name: self._at(step, name, rng.random()) for name in self.space}

    def fit(self, pipeline: Pipeline, df: DataFrame, label: str, features: Sequence[str], key: str) -> tuple[PipelineModel, dict, float]:
        rng = random.Random(self.seed)
        place = F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(10_000))
        parts = [place < int(self.held * 10_000)] if self.folds < 2 else [F.pmod(place, F.lit(self.folds)) == k for k in range(self.folds)]
        last, best = pipeline.steps[-1], None
        means: list[list[float]] = [[] for _ in parts]  # of earlier trials, after each fold
        history: list[tuple[dict, float]] = []
        for trial in range(self.trials):
            chosen, values = self.suggest(last, rng, history), []  # type: ignore[arg-type]
            tried = Pipeline([*pipeline.steps[:-1], replace(last, **chosen)])  # type: ignore[type-var]
            for k, part in enumerate(parts):
                model = tried.fit(df.filter(~part), label, features)
                values.append(self.metric.compute(model.score(df.filter(part)), label, model.steps[-1].output, ()).first()["value"])  # type: ignore[attr-defined]
                mean, others = fmean(values), list(means[k])
                means[k].append(mean)
                if self.prune_after is not None and trial >= self.prune_after and others and mean < median(others):
                    break
            history.append((chosen, mean))  # of a trial that was cut short what it had got
            if len(values) == len(parts) and (best is None or mean > best[1]):
                best = (chosen, mean)
        chosen, value = best or ({}, 0.0)
        return Pipeline([*pipeline.steps[:-1], replace(last, **chosen)]).fit(df, label, features), chosen, value  # type: ignore[type-var]


@dataclass(frozen=True)
class ParzenSearch(RandomSearch):
    """A tree-structured Parzen estimator: after ``startup`` random trials the best ones and the others get a density each.

    The best are the first ``better`` * square root of the number of trials, rounded up.  A density of a field is an even mixture of normal
    curves cut to the range, one about each value as wide as the farther of its neighbours, and of the whole range.  Of ``candidates`` drawn
    from the density of the best, the one with the greatest ratio to that of the others is tried; fields are independent.
    """

    startup: int = 10
    candidates: int = 24
    better: float = 1.0

    def suggest(self, step: Estimator | None, rng: random.Random, history: Sequence[tuple[dict, float]] = ()) -> dict:
        if len(history) < self.startup:
            return super().suggest(step, rng, history)
        ranked = sorted(history, key=lambda h: -h[1])
        n = min(len(ranked) - 1, ceil(self.better * sqrt(len(ranked))))
        out = {}
        for name in self.space:
            good, rest = (_mixture([self._place(step, name, h[0][name]) for h in part]) for part in (ranked[:n], ranked[n:]))
            drawn = [_draw(good, rng) for _ in range(self.candidates)]
            out[name] = self._at(step, name, max(drawn, key=lambda u: _density(good, u) - _density(rest, u)))  # noqa: B023
        return out


def _mixture(places: Sequence[float]) -> list[tuple[float, float]]:
    """(middle, width) of each curve; the last one is the whole range."""
    at = sorted(places)
    least = 1 / min(100, len(at) + 1)
    near = [0.0, *at, 1.0]
    return [(x, min(1.0, max(least, x - near[i], near[i + 2] - x))) for i, x in enumerate(at)] + [(0.5, 1.0)]


def _draw(mixture: Sequence[tuple[float, float]], rng: random.Random) -> float:
    middle, width = rng.choice(mixture)
    while not 0 <= (u := rng.gauss(middle, width)) < 1:
        pass
    return u


def _density(mixture: Sequence[tuple[float, float]], u: float) -> float:
    """The logarithm of a mixture's density."""
    part = lambda m, w: NormalDist(m, w).pdf(u) / (NormalDist(m, w).cdf(1) - NormalDist(m, w).cdf(0))
    return log(sum(part(m, w) for m, w in mixture) / len(mixture))


def infer_features(df: DataFrame, without: Sequence[str]) -> list[str]:
    """All columns but the named ones and times."""
    return [f.name for f in df.schema if f.name not in without and f.dataType.typeName() not in ("timestamp", "timestamp_ntz", "date")]


@dataclass
class ExperimentRunner:
    """Runs configs on one cached table, several at a time; a failure is kept with its config."""

    configs: Sequence[ExperimentConfig]
    metrics: Sequence[Metric] = DEFAULT_METRICS
    eval_labels: Sequence[str] = ()
    search: RandomSearch | None = None
    key: str | None = None
    workers: int = 2
    scoring: str = "auc"
    models: dict[str, PipelineModel] = field(default_factory=dict)
    rows: list[dict] = field(default_factory=list)

    def fit(self, df: DataFrame, oot: DataFrame | None = None) -> ExperimentRunner:
        with ThreadPoolExecutor(self.workers) as pool:
            self.rows = list(pool.map(lambda c: self._run(c, df, oot), self.configs))
        return self

    def _run(self, config: ExperimentConfig, df: DataFrame, oot: DataFrame | None) -> dict:
        began, row = perf_counter(), {"name": config.name, "label_col": config.label, "weight_col": config.weight, "status": "ok", "error": None}
        try:
            data = config.window.filter(df) if config.window else df
            other = [c.label for c in self.configs] + [c.weight for c in self.configs if c.weight] + list(self.eval_labels) + ([self.key] if self.key else [])
            features = list(config.features or infer_features(data, other))
            pipeline = config.pipeline or default_pipeline(config.weight)
            if self.search:
                model, row["params"], row["best_trial_score"] = self.search.fit(pipeline, data, config.label, features, self.key or features[0])
            else:
                model = pipeline.fit(data, config.label, features)
            self.models[config.name] = model
            count = data.filter(F.col(config.label).isin(0, 1)).agg(F.count("*").alias("n"), F.avg(config.label).alias("rate")).first()
            iv = model.context.get("iv_values") or {}
            row |= {"n_samples": count.n, "default_rate": count.rate, "n_features": len(model.context["features"]), "mean_iv": sum(iv.values()) / len(iv) if iv else None}
            score = model.steps[-1].output  # type: ignore[attr-defined]
            for prefix, table in (("", data), ("oot_", oot)):
                if table is None:
                    continue
                scored = model.score(table)
                for label in [config.label, *[y for y in self.eval_labels if y != config.label]]:
                    for r in metric_table(scored, label, score, (), self.metrics).collect():  # a row a metric
                        row[prefix + ("" if label == config.label else f"{label}_") + r.metric] = r.value
        except Exception as e:  # noqa: BLE001 - reported in the result
            row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
        return row | {"training_time": perf_counter() - began}

    def results(self, spark: SparkSession) -> DataFrame:
        names = list(dict.fromkeys(k for r in self.rows for k in r if k != "params"))
        kinds = {"name": "string", "label_col": "string", "weight_col": "string", "status": "string", "error": "string", "n_samples": "long", "n_features": "long"}
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.rows], ", ".join(f"`{n}` {kinds.get(n, 'double')}" for n in names))

    def best(self) -> tuple[str, float]:
        """The first config with the greatest metric, out of time if there is one; failed ones do not count."""
        name = f"oot_{self.scoring}" if any(f"oot_{self.scoring}" in r for r in self.rows) else self.scoring
        good = [r for r in self.rows if r["status"] == "ok" and r.get(name) is not None]
        if not good:
            raise ValueError("no experiment succeeded")
        top = max(good, key=lambda r: r[name])
        return top["name"], top[name]

    def best_model(self) -> PipelineModel:
        return self.models[self.best()[0]]

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` scored by the best model."""
        return self.best_model().score(df)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` as the best model's steps leave it, with ``probability``."""
        model = self.best_model()
        return model.steps[-1].predict_proba(replace(model, steps=model.steps[:-1]).transform(df))  # type: ignore[attr-defined]

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """The same with ``prediction``: 1 where the probability is at least ``threshold``."""
        return self.predict_proba(df).withColumn("prediction", (F.col("probability") >= threshold).cast("int"))

    def importances(self, spark: SparkSession, kind: str = "gain") -> DataFrame:
        rows = [(n, f, v) for n, m in self.models.items() if isinstance(m.steps[-1], TreeModel) for f, v in importance(m.steps[-1], kind).items()]
        return spark.createDataFrame(rows, "experiment string, feature string, importance double")

    def to_markdown(self, spark: SparkSession, top: int = 10) -> str:
        out = ["# Experiments", "", "## Overview", "", f"{len(self.rows)} experiments, {sum(r['status'] == 'ok' for r in self.rows)} succeeded.", ""]
        shown = [c for c in dict.fromkeys(k for r in self.rows for k in r) if c not in ("params", "error")]
        out += ["## Results", "", markdown_table(shown, [[r.get(c) for c in shown] for r in self.rows]), ""]
        if any(r.get("params") for r in self.rows):
            out += ["## Parameters", "", markdown_table(["name", "params"], [[r["name"], r.get("params")] for r in self.rows]), ""]
        if decay := decay_rows(self.rows, [m.name for m in self.metrics]):
            out += ["## Decay out of time", "", markdown_table(["name", "metric", "train", "oot", "decay_pct", "flag"], decay), ""]
        if self.models:
            imp = self.importances(spark)
            rank = average_ranks(imp, top).limit(top).collect()
            out += ["## Importance", "", markdown_table(["feature", "avg_rank", "n_top"], [[r.feature, r.avg_rank, r.n_top] for r in rank]), ""]
            common = common_features(imp, top).first()
            out += ["## Stability", "", f"In the top {top} of every experiment: {', '.join(common.common) or 'none'}.", ""]
            name, value = self.best()
            out += ["## Best", "", f"{name}: {value:.4f}", ""]
        return "\n".join(out)


def markdown_table(header: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(header) + " |", "|" + "---|" * len(header), *["| " + " | ".join(map(show, r)) + " |" for r in rows]])


def decay_rows(rows: Sequence[dict], metrics: Sequence[str], flag: float = 20.0) -> list[list]:
    """(name, metric, train, oot, decay in percent of train, flagged)."""
    out = []
    for r in rows:
        for m in metrics:
            if r.get(m) and r.get(f"oot_{m}") is not None:
                d = (r[m] - r[f"oot_{m}"]) / r[m] * 100
                out.append([r["name"], m, r[m], r[f"oot_{m}"], d, d > flag])
    return out


def top_features(importances: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each experiment, with rank and share in percent; ties by name."""
    each = Window.partitionBy("experiment")
    ranked = importances.withColumn("rank", F.row_number().over(each.orderBy(F.desc("importance"), "feature"))).withColumn("pct", F.coalesce(F.try_divide(F.col("importance") * 100, F.sum("importance").over(each)), F.lit(0.0)))
    return ranked.filter(F.col("rank") <= n)


def average_ranks(importances: DataFrame, n: int) -> DataFrame:
    """(feature, avg_rank, n_top): the mean rank over experiments, n + 1 where a feature is not among the first ``n``."""
    top = top_features(importances, n)
    runs = importances.agg(F.count_distinct("experiment").alias("runs"))
    each = top.groupBy("feature").agg(F.sum("rank").alias("ranks"), F.count("*").alias("n_top"))
    out = each.join(F.broadcast(runs))  # one row
    return out.select("feature", ((F.col("ranks") + (F.col("runs") - F.col("n_top")) * (n + 1)) / F.col("runs")).alias("avg_rank"), "n_top").orderBy("avg_rank", "feature")


def common_features(importances: DataFrame, n: int) -> DataFrame:
    """One row: features in the first ``n`` of all experiments, and those in the first ``n`` of one only."""
    counts = top_features(importances, n).groupBy("feature").agg(F.count("*").alias("c"))
    runs = importances.agg(F.count_distinct("experiment").alias("runs"))
    out = counts.join(F.broadcast(runs))  # one row
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("feature"))))
    return out.agg(pick(F.col("c") == F.col("runs")).alias("common"), pick(F.col("c") == 1).alias("unique"))
