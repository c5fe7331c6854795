"""Model reports: one scored table, twenty-two keyed tables over it, and a document that puts them on sheets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.functions.expressions import number
from corbel.operators import metrics, stats
from corbel.operators.binning import BinModel
from corbel.operators.cleaning import CleanModel
from corbel.operators.encoding import WoeModel
from corbel.operators.filters import with_gray, with_month
from corbel.operators.selection import SelectModel
from corbel.plans.pipeline import PipelineModel
from corbel.plans.trees import TreeModel, importance
from corbel.sources.workbook import FormatConfig, Workbook


@dataclass(frozen=True)
class SubSection:
    title: str
    table: DataFrame
    note: str = ""


@dataclass
class ReportContext:
    """The analysis table, with ``tag`` telling datasets apart and label 0 good, 1 bad, -1 gray.

    If ``model`` is given, rows are scored once, into ``score``, and kept (in memory, or on disk where it is short);
    ``close`` lets them go.
    """

    df: DataFrame
    label: str
    tag: str
    score: str = "risk_score"
    model: PipelineModel | None = None
    features: Sequence[str] | None = None
    baseline: str | None = None
    time: str | None = None
    extra_labels: Sequence[str] = ()
    gray_tag: str | None = None
    iv: dict[str, float] | None = None
    facts: dict[str, dict[str, str]] = field(default_factory=dict)
    portrait: DataFrame | None = None
    sub_scores: Sequence[str] = ()
    train_tag: str = "train"
    oot_tag: str = "oot"

    def __post_init__(self) -> None:
        if self.model is not None and self.score not in self.df.columns:
            self.df = self.model.score(self.df).withColumnRenamed(self.model.steps[-1].output, self.score).persist()  # type: ignore[attr-defined]
        if self.features is None:
            gone = {self.label, self.tag, self.score, self.baseline, self.time, *self.extra_labels, *self.sub_scores}
            self.features = [c for c in self.df.columns if c not in gone]

    def close(self) -> None:
        self.df.unpersist()

    @property
    def spark(self):
        return self.df.sparkSession

    def scored(self) -> DataFrame:
        return self.df.filter(F.col(self.label) >= 0)

    def monthly(self) -> DataFrame:
        return with_month(self.scored(), self.time or "")

    def tags(self) -> list[str]:
        return sorted(r[0] for r in self.df.select(self.tag).distinct().collect() if r[0] is not None and r[0] != self.gray_tag)

    def train(self) -> DataFrame:
        """Rows of ``train_tag``, or of the first tag where no row has it."""
        tags = self.tags()
        return self.df.filter(F.col(self.tag) == (self.train_tag if self.train_tag in tags or not tags else tags[0]))

    def later(self) -> DataFrame:
        """Rows of ``oot_tag``, or of the last tag where no row has it."""
        tags = self.tags()
        return self.df.filter(F.col(self.tag) == (self.oot_tag if self.oot_tag in tags or not tags else tags[-1]))

    def table(self, rows: Sequence[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def placeholder(self, why: str) -> DataFrame:
        return self.table([(why,)], "note string")

    def information(self) -> dict[str, float]:
        """Given, of the model, or of the raw training rows (each value a bin)."""
        if self.iv is None and self.model is not None:
            self.iv = self.model.context.get("iv_values")
        if self.iv is None:
            rows = stats.information_value(self.train(), list(self.features or ()), self.label).collect()
            self.iv = {r.feature: r.iv for r in rows}
        return self.iv


@dataclass
class Attributes:
    """What a fitted pipeline tells of itself: of each kind of step the results and the settings that decided."""

    dropped: dict[str, str] = field(default_factory=dict)  # by the cleaner, with the reason
    impute: dict[str, float | str] = field(default_factory=dict)
    bounds: dict[str, tuple] = field(default_factory=dict)
    missing_threshold: float | None = None
    variance_threshold: float | None = None
    edges: dict[str, list] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    woe: dict[str, dict[float, float]] = field(default_factory=dict)
    iv: dict[str, float] = field(default_factory=dict)
    iv_range: tuple[float, float] | None = None
    correlated: dict[str, str] = field(default_factory=dict)
    correlation_threshold: float | None = None
    psi: dict[str, float] = field(default_factory=dict)
    psi_threshold: float | None = None
    gain: dict[str, float] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)

    @classmethod
    def of(cls, model: PipelineModel | None) -> Attributes:
        out, given = cls(), (model.context.get("params") or {}) if model else {}
        for step in model.steps if model else ():
            own = given.get(getattr(step, "name", "") or step.kind, {})
            if isinstance(step, CleanModel):
                out.dropped, out.impute, out.bounds = dict(step.dropped), dict(step.impute), dict(step.bounds)
                out.missing_threshold, out.variance_threshold = own.get("missing_threshold"), own.get("variance_threshold")
            bins = step.bins if isinstance(step, WoeModel) else step if isinstance(step, BinModel) else None
            if bins:
                out.edges, out.labels = dict(bins.edges), {f: [text for _, text in bins.table(f)] for f in bins.edges}
            if isinstance(step, WoeModel):
                out.woe, out.iv = dict(step.woe), dict(step.iv)
            if isinstance(step, SelectModel) and step.name == "iv":
                out.iv, out.iv_range = dict(step.values), (own["least"], own["most"]) if own else None
            if isinstance(step, SelectModel) and step.name == "corr":
                out.correlated, out.correlation_threshold = dict(step.dropped), own.get("threshold")
            if isinstance(step, SelectModel) and step.name == "psi":
                out.psi, out.psi_threshold = dict(step.values), own.get("threshold")
            if isinstance(step, TreeModel):
                out.gain, out.weight = importance(step, "total_gain"), importance(step, "weight")
                out.params = {**own, "trees": len(step.trees), "features": len(step.features)}
        return out


def _shares(values: dict[str, float]) -> dict[str, float]:
    total = sum(values.values())
    return {f: v / total if total else 0.0 for f, v in values.items()}


#: What the settings of a model mean; they stand first, in this order.
MEANINGS = {"trees": "number of trees", "depth": "greatest depth", "rate": "learning rate", "subsample": "share of rows by tree", "columns": "share of features by tree", "min_rows": "least rows of a leaf", "seed": "seed", "weight": "column of weights", "fill": "value for missing ones", "features": "number of features"}


def _settings(ctx: ReportContext, title: str, least: bool) -> list[SubSection]:
    params = Attributes.of(ctx.model).params
    if not params:
        return [SubSection(title, ctx.placeholder("no fitted model is given"))]
    order = [k for k in MEANINGS if k in params] + ([] if least else [k for k in params if k not in MEANINGS])
    return [SubSection(title, ctx.table([(MEANINGS.get(k, k), k, str(params[k])[:100]) for k in order], "meaning string, setting string, value string"))]


def model_assumption(ctx: ReportContext) -> list[SubSection]:
    """Given facts, and the settings of the fitted model."""
    facts = _facts("model_assumption", "Assumptions", {})(ctx) if ctx.facts.get("model_assumption") else []
    return facts + _settings(ctx, "Settings of the model", False)


def model_method(ctx: ReportContext) -> list[SubSection]:
    method = _facts("model_method", "Method", {"algorithm": "gradient-boosted trees"})(ctx)
    return method + _settings(ctx, "Settings", True)


def var_cleaning(ctx: ReportContext) -> list[SubSection]:
    """Steps of the fitted cleaner, with how many columns each touched and which (ten at most are named)."""
    known, title = Attributes.of(ctx.model), "Cleaning"
    if ctx.model is None:
        return [SubSection(title, ctx.placeholder("no fitted model is given"))]
    named = lambda xs: ", ".join(xs[:10]) + (f" and {len(xs) - 10} more" if len(xs) > 10 else "")
    rows: list[tuple] = [(f"dropped: {why}", len(xs), named(xs)) for why in sorted(set(known.dropped.values())) if (xs := [f for f, w in known.dropped.items() if w == why])]
    if known.impute:
        rows.append(("missing values filled", len(known.impute), named([f"{f}={v:g}" if isinstance(v, float) else f"{f}={v}" for f, v in known.impute.items()])))
    if known.bounds:
        rows.append(("outliers bounded", len(known.bounds), named([f"{f} [{a:g}, {b:g}]" for f, (a, b) in known.bounds.items()])))
    for name, value in (("threshold of missing rate", known.missing_threshold), ("threshold of variance", known.variance_threshold)):
        if value is not None:
            rows.append((name, None, f"{value:g}"))
    if not rows:
        return [SubSection(title, ctx.placeholder("the model does not clean"))]
    return [SubSection(title, ctx.table(rows, "step string, n int, columns string"))]


def _facts(name: str, title: str, defaults: dict[str, str]) -> Callable[[ReportContext], list[SubSection]]:
    def run(ctx: ReportContext) -> list[SubSection]:
        given = defaults | ctx.facts.get(name, {})
        return [SubSection(title, ctx.table(list(given.items()), "item string, value string"))]

    return run


def sample_selection(ctx: ReportContext) -> list[SubSection]:
    origin = stats.sample_stats(ctx.scored(), ctx.label, [ctx.tag], total="total").select(ctx.tag, "goods", "bads", "total", "bad_rate")
    dev = stats.sample_stats(ctx.df, ctx.label, [ctx.tag], total="total")
    return [SubSection("Good and bad by dataset", origin), SubSection("Development sample with gray", dev)]


def modeling_sample(ctx: ReportContext) -> list[SubSection]:
    out = [SubSection("Modelling sample", stats.sample_stats(ctx.df, ctx.label, [ctx.tag], total="total"))]
    return out + [SubSection(f"By label {y}", stats.sample_stats(ctx.df, y, [ctx.tag])) for y in ctx.extra_labels]


def effect_summary(ctx: ReportContext) -> list[SubSection]:
    out = [SubSection("Model", metrics.effect_table(ctx.scored(), ctx.label, ctx.score, [ctx.tag], (10,)))]
    return out + [SubSection(f"Part {s}", metrics.effect_table(ctx.scored(), ctx.label, s, [ctx.tag], (10,))) for s in ctx.sub_scores]


def var_filter(ctx: ReportContext) -> list[SubSection]:
    """How many features each step left."""
    rows, left = [], len(ctx.model.features) if ctx.model else len(ctx.features or ())
    rows.append(("all", 0, left))
    for step in ctx.model.steps if ctx.model else ():
        gone = getattr(step, "dropped", None)
        if gone is not None:
            left -= len(gone)
            rows.append((getattr(step, "name", "") or step.kind, len(gone), left))
    if ctx.model and isinstance(ctx.model.steps[-1], TreeModel):
        unused = sum(v == 0 for v in importance(ctx.model.steps[-1], "weight").values())
        rows.append(("importance", unused, left - unused))
    return [SubSection("Features left by each step", ctx.table(rows, "step string, dropped int, remaining int"))]


def var_analysis(ctx: ReportContext) -> list[SubSection]:
    features = list(ctx.features or ())
    base = stats.missing_rates(ctx.df, features, [ctx.tag]).groupBy("feature").pivot(ctx.tag, ctx.tags()).agg(F.first("missing_rate"))
    known = Attributes.of(ctx.model)
    iv, (gain, weight) = ctx.information(), (_shares(known.gain), _shares(known.weight))
    known = ctx.table([(f, iv.get(f), known.gain.get(f), gain.get(f), known.weight.get(f), weight.get(f)) for f in features], "feature string, iv double, gain double, gain_pct double, weight double, weight_pct double")
    ks = metrics.feature_ks(ctx.scored(), features, ctx.score)
    out = base.join(known, "feature", "left").join(ks, "feature", "left")
    return [SubSection("Features", out.join(stats.psi(ctx.train(), ctx.later(), features), "feature", "left"))]


def var_binning(ctx: ReportContext) -> list[SubSection]:
    """Bins of the model with counts and WOE, by the model's own interval rule."""
    step = next((s for s in ctx.model.steps if isinstance(s, WoeModel) and s.bins), None) if ctx.model else None
    if step is None:
        return [SubSection("Bins", ctx.placeholder("the model has no bins"))]
    df = ctx.df
    for before in ctx.model.steps[: ctx.model.steps.index(step)]:
        df = before.transform(df)
    return [SubSection("Bins", binned_counts(df, step, ctx.label))]


def binned_counts(df: DataFrame, step: WoeModel, label: str) -> DataFrame:
    """(feature, bin, label, goods, bads, total, bad_rate, woe)."""
    names = list(step.bins.edges)  # type: ignore[union-attr]
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), step.bins.column(f).alias("bin")) for f in names]))  # type: ignore[union-attr]
    counts = df.filter(F.col(label).isin(0, 1)).select(F.col(label).alias("y"), cells.alias("c")).groupBy("c.feature", "c.bin").agg(F.count_if(F.col("y") == 0).alias("goods"), F.count_if(F.col("y") == 1).alias("bads"))
    rows = [(f, b, text, step.woe[f].get(float(b))) for f in names for b, text in step.bins.table(f)]  # type: ignore[union-attr]
    known = df.sparkSession.createDataFrame(rows, "feature string, bin int, range string, woe double")
    total = F.col("goods") + F.col("bads")
    return counts.join(known, ["feature", "bin"], "left").select("feature", "bin", "range", "goods", "bads", total.alias("total"), (F.col("bads") / total).alias("bad_rate"), "woe")


def model_effect(ctx: ReportContext) -> list[SubSection]:
    out = [SubSection("By dataset", metrics.effect_table(ctx.scored(), ctx.label, ctx.score, [ctx.tag]))]
    return out + ([SubSection("By month", metrics.effect_table(ctx.monthly(), ctx.label, ctx.score, [ctx.tag, "month"]))] if ctx.time else [])


def score_lift(ctx: ReportContext) -> list[SubSection]:
    out = [SubSection("By dataset", metrics.lift_table(ctx.scored(), ctx.label, ctx.score, [ctx.tag]))]
    return out + ([SubSection("By month", metrics.lift_table(ctx.monthly(), ctx.label, ctx.score, [ctx.tag, "month"]))] if ctx.time else [])


def score_lift_gray(ctx: ReportContext) -> list[SubSection]:
    df = with_gray(ctx.df, ctx.tag, ctx.gray_tag, ctx.tags()) if ctx.gray_tag else ctx.df.withColumn("dataset", F.col(ctx.tag))
    return [SubSection("With gray rows", metrics.lift_table(df, ctx.label, ctx.score, ["dataset"], baseline=ctx.baseline))]


def model_comparison(ctx: ReportContext) -> list[SubSection]:
    if not ctx.baseline:
        return [SubSection("New and old model", ctx.placeholder("no baseline score"))]
    return [SubSection("New and old model", compare_scores(ctx.scored(), ctx.label, [ctx.score, ctx.baseline], [ctx.tag]))]


def compare_scores(df: DataFrame, label: str, scores: Sequence[str], keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Effect of several scores, told apart by column ``model``."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), number(F.col(f"`{s}`")).alias("value")) for s in scores]))
    rows = df.select(*keys, F.col(label).alias("y"), each.alias("m")).select(*keys, "y", "m.model", F.col("m.value").alias("value"))
    return metrics.effect_table(rows, "y", "value", [*keys, "model"], (10,), digits)


def mob_performance(ctx: ReportContext) -> list[SubSection]:
    if not ctx.extra_labels:
        return [SubSection("By label", ctx.placeholder("no further labels"))]
    return [SubSection("By label", compare_labels(ctx.df, [ctx.label, *ctx.extra_labels], ctx.score, [ctx.tag]))]


def compare_labels(df: DataFrame, labels: Sequence[str], score: str, keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Effect on several labels, told apart by column ``label``."""
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("label"), F.col(f"`{y}`").cast("int").alias("y")) for y in labels]))
    rows = df.select(*keys, F.col(score).alias("s"), each.alias("l")).select(*keys, "s", "l.label", F.col("l.y").alias("y"))
    return metrics.effect_table(rows, "y", "s", [*keys, "label"], (10,), digits)


def swap_analysis(ctx: ReportContext) -> list[SubSection]:
    if not ctx.baseline:
        return [SubSection("Swap sets", ctx.placeholder("no baseline score"))]
    return [SubSection("Swap sets", metrics.swap_table(ctx.scored(), ctx.label, ctx.score, ctx.baseline, keys=[ctx.tag]))]


def var_range(ctx: ReportContext) -> list[SubSection]:
    t = stats.profile(ctx.df, list(ctx.features or ()))
    names = ("min", "p25", "p50", "p75", "max")
    return [SubSection("Ranges", t.select("feature", "missing_rate", "distinct_ratio", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)]))]


def portrait(ctx: ReportContext) -> list[SubSection]:
    return [SubSection("Portrait", ctx.portrait if ctx.portrait is not None else ctx.placeholder("none given"))]


def attribution(ctx: ReportContext) -> list[SubSection]:
    return [SubSection("Attribution", ctx.table([("", "", "")] * 5, "factor string, effect string, comment string"))]


Operator = Callable[[ReportContext], list[SubSection]]
OPERATORS: dict[str, Operator] = {
    "meta_info": _facts("meta_info", "Document", {k: "" for k in ("model", "version", "author", "department", "created", "reviewed", "status")}),
    "dev_purpose": _facts("dev_purpose", "Purpose", {"purpose": "", "scope": ""}),
    "model_assumption": model_assumption,
    "label_definition": _facts("label_definition", "Labels", {"0": "good", "1": "bad", "-1": "gray"}),
    "sample_selection": sample_selection,
    "modeling_sample": modeling_sample,
    "effect_summary": effect_summary,
    "var_description": _facts("var_description", "Variables", {"sources": ""}),
    "var_cleaning": var_cleaning,
    "var_filter": var_filter,
    "var_analysis": var_analysis,
    "var_binning": var_binning,
    "model_method": model_method,
    "model_effect": model_effect,
    "score_lift": score_lift,
    "score_lift_gray": score_lift_gray,
    "attribution": attribution,
    "model_comparison": model_comparison,
    "mob_performance": mob_performance,
    "portrait": portrait,
    "swap_analysis": swap_analysis,
    "var_range": var_range,
}

#: Sheets and their operators.
DOCUMENT: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Overview", ("meta_info", "dev_purpose", "model_assumption", "effect_summary")),
    ("Sample", ("label_definition", "sample_selection", "modeling_sample")),
    ("Variables", ("var_description", "var_cleaning", "var_filter", "var_analysis", "var_range")),
    ("Bins", ("var_binning",)),
    ("Method", ("model_method", "attribution")),
    ("Effect", ("model_effect", "score_lift", "score_lift_gray")),
    ("Comparison", ("model_comparison", "swap_analysis", "mob_performance")),
    ("Portrait", ("portrait",)),
)


@dataclass
class ModelReport:
    """Lazily built tables by operator; sinks collect them."""

    document: Sequence[tuple[str, Sequence[str]]] = DOCUMENT
    operators: dict[str, Operator] = field(default_factory=lambda: dict(OPERATORS))
    sections: dict[str, list[SubSection]] = field(default_factory=dict)

    def fit(self, ctx: ReportContext) -> ModelReport:
        self.sections = {name: self.operators[name](ctx) for _, names in self.document for name in names}
        return self

    def get(self, name: str) -> list[SubSection]:
        return self.sections[name]

    def to_xlsx(self, path: str, style: FormatConfig | None = None) -> None:
        book = Workbook(style or FormatConfig())
        for sheet, names in self.document:
            at = book.sheet(sheet)
            for name in names:
                for s in self.sections[name]:
                    book.add(at, s.title, s.table.columns, [tuple(r) for r in s.table.collect()], s.note)  # report tables have few rows
        book.save(path)

    def to_parquet(self, root: str) -> None:
        for name, sections in self.sections.items():
            for i, s in enumerate(sections):
                s.table.write.mode("overwrite").parquet(f"{root}/{name}_{i}")
