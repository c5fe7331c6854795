"""Pipelines: steps fitted in turn, a model that applies them as one projection, and their scoring specification."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.errors import ConsistencyError, SpecError, UnsupportedStepError
from corbel.functions.expressions import derive, evaluate, variables
from corbel.operators.binning import BinModel
from corbel.operators.cleaning import CleanModel
from corbel.operators.encoding import WoeModel
from corbel.operators.selection import SelectModel
from corbel.operators.stage import Estimator, Model
from corbel.plans.trees import TreeModel
from corbel.workspace import Workspace

#: Of specifications that this library writes, and the least reader they need.
VERSION, LEAST_READER = (1, 0, 0), (1, 0, 0)


@dataclass(frozen=True)
class DeriveModel(Model):
    kind = "derive"
    expressions: tuple[tuple[str, str], ...] = ()
    fill: float | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return derive(df, list(self.expressions), self.fill)

    def apply_row(self, row: dict) -> dict:
        return row | {t: evaluate(e, row, self.fill) for t, e in self.expressions}

    def to_dict(self) -> dict:
        return {"kind": self.kind, "expressions": [list(e) for e in self.expressions], "fill": self.fill}

    @classmethod
    def from_dict(cls, spec: dict) -> DeriveModel:
        return cls(tuple((t, e) for t, e in spec["expressions"]), spec["fill"])


@dataclass(frozen=True)
class FeatureDerivation(Estimator):
    """Adds columns computed by expressions; later steps see them as features."""

    expressions: tuple[tuple[str, str], ...]
    fill: float | None = None

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> DeriveModel:
        model = DeriveModel(tuple(self.expressions), self.fill)
        model.transform(df)  # names and safety are checked against the schema
        return model


#: Kinds of models that specifications may hold.
KINDS: dict[str, type[Model]] = {m.kind: m for m in (CleanModel, BinModel, WoeModel, SelectModel, TreeModel, DeriveModel)}


def register(model: type[Model]) -> type[Model]:
    """Let specifications hold an own kind of model."""
    if not model.kind or model.kind in KINDS and KINDS[model.kind] is not model:
        raise SpecError(f"kind {model.kind!r} is empty or taken")
    KINDS[model.kind] = model
    return model


@dataclass(frozen=True)
class PipelineModel(Model):
    kind = "pipeline"
    steps: tuple[Model, ...] = ()
    features: tuple[str, ...] = ()
    context: dict = field(default_factory=dict, compare=False)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` as it came, with the score: steps see copies of its columns, so nothing of it changes."""
        last = self.steps[-1] if self.steps else None
        if not isinstance(last, TreeModel):
            raise UnsupportedStepError("the last step gives no score")
        if any(isinstance(s, CleanModel) and s.drop_rows for s in self.steps):
            raise UnsupportedStepError("a step that drops rows cannot score")
        kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != last.output]).alias("__row")
        return self.transform(df.withColumn("__row", kept)).select("__row.*", last.output)

    def apply_row(self, row: dict) -> dict:
        for step in self.steps:
            row = step.apply_row(row)
        return row

    def to_dict(self) -> dict:
        for s in self.steps:
            if KINDS.get(s.kind) is not type(s):
                raise UnsupportedStepError(f"{type(s).__name__} has no registered kind")
        return {"version": list(VERSION), "least_reader": list(LEAST_READER), "features": list(self.features), "steps": [s.to_dict() for s in self.steps]}

    @classmethod
    def from_dict(cls, spec: dict) -> PipelineModel:
        if tuple(spec["least_reader"]) > VERSION:
            raise SpecError(f"the specification needs reader {spec['least_reader']}, this is {list(VERSION)}")
        unknown = [s["kind"] for s in spec["steps"] if s["kind"] not in KINDS]
        if unknown:
            raise SpecError(f"unknown kinds: {unknown}")
        return cls(tuple(KINDS[s["kind"]].from_dict(s) for s in spec["steps"]), tuple(spec["features"]))

    def to_json(self) -> str:
        return json.dumps(_written(self.to_dict()), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> PipelineModel:
        try:
            return cls.from_dict(_read(json.loads(text)))
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            raise SpecError(f"not a specification: {e}") from e

    def describe(self) -> list[tuple[int, str, int]]:
        return [(i, s.kind, len(json.dumps(_written(s.to_dict())))) for i, s in enumerate(self.steps)]


def _written(x: object) -> object:
    """JSON has neither infinities nor NaN."""
    if isinstance(x, float) and (x != x or abs(x) == float("inf")):
        return None if x != x else {"number": "Infinity" if x > 0 else "-Infinity"}
    if isinstance(x, dict):
        return {k: _written(v) for k, v in x.items()}
    return [_written(v) for v in x] if isinstance(x, (list, tuple)) else x


def _read(x: object) -> object:
    if isinstance(x, dict):
        return float(x["number"]) if set(x) == {"number"} else {k: _read(v) for k, v in x.items()}
    return [_read(v) for v in x] if isinstance(x, list) else x


def needs(step: Estimator) -> set[str]:
    """Columns that a step reads besides features and label: its weight, and the variables of its expressions."""
    return {c for c in (getattr(step, "weight", None),) if c} | {v for _, e in getattr(step, "expressions", ()) for v in variables(e)}


def parameters(step: Estimator) -> dict[str, object]:
    """The settings of an estimator that are plain values."""
    return {f.name: v for f in fields(step) if isinstance(v := getattr(step, f.name), (int, float, str, bool, tuple, list, dict))} if is_dataclass(step) else {}


@dataclass(frozen=True)
class Pipeline:
    """Steps in turn.  What a step's model tells of itself reaches later steps; the first teller of a name wins."""

    steps: Sequence[Estimator | tuple[str, Estimator]]

    def fit(self, df: DataFrame, label: str, features: Sequence[str], validation: DataFrame | None = None) -> PipelineModel:
        """Steps are fitted on what the ones before make of ``df``.

        After binning or encoding the columns that are still needed are written below the checkpoint folder, so later steps
        read them instead of projecting the whole input again; the table goes when all steps are fitted.
        """
        ws = Workspace(df.sparkSession, "pipeline")
        try:
            return self._fit(df, label, features, validation, ws)
        finally:
            ws.close()

    def _fit(self, df: DataFrame, label: str, features: Sequence[str], validation: DataFrame | None, ws: Workspace) -> PipelineModel:
        names, context, models = list(features), {}, []
        steps = [item[1] if isinstance(item, tuple) else item for item in self.steps]
        for place, step in enumerate(steps):
            model = step.fit(df, label, names, context, validation)
            context.setdefault("params", {})[getattr(model, "name", "") or model.kind] = parameters(step)
            for k, v in model.attributes().items():
                context.setdefault(k, v)
            if isinstance(model, SelectModel):
                names = [f for f in names if f not in model.dropped]
            elif isinstance(model, CleanModel):
                names = [f for f in names if f not in model.dropped]
            elif isinstance(model, DeriveModel):
                names += [t for t, _ in model.expressions]
            models.append(model)
            if place + 1 < len(steps):
                df = model.transform(df)
                validation = model.transform(validation) if validation is not None else None
            if isinstance(model, (BinModel, WoeModel)) and place + 2 < len(steps):
                later = {c for s in steps[place + 1 :] for c in needs(s)}
                df = ws.save(df.select(*[c for c in df.columns if c in {*names, label, *later}]), f"train{place}")
                if validation is not None:
                    validation = ws.save(validation.select(*[c for c in validation.columns if c in {*names, label, *later}]), f"validation{place}")
        return PipelineModel(tuple(models), tuple(features), context | {"features": names})


# --- consistency ---------------------------------------------------------------------------------------------------


def boundary_values(model: PipelineModel, eps: float = 1e-7) -> dict[str, list[float]]:
    """For every binned feature the values just below, on and just above its edges."""
    found: dict[str, list[float]] = {}
    for step in model.steps:
        bins = step.bins if isinstance(step, WoeModel) else step if isinstance(step, BinModel) else None
        for f, edges in (bins.edges if bins else {}).items():
            if f not in bins.categories:
                found[f] = [e + d for e in edges if e is not None for d in (-eps, 0.0, eps)]
    return found


def assert_consistent(model: PipelineModel, df: DataFrame, rows: int = 200, tolerance: float = 1e-9, make: Callable[[dict], dict] | None = None, seed: int = 42) -> float:
    """The greatest difference of scores by Spark and by row: of ``df``, random ones, and with values missing, marked and on edges."""
    sample = [r.asDict() for r in df.select(*model.features).limit(rows).collect()]
    if not sample:
        return 0.0
    base = sample[0]
    extra = [{**base, f: None} for f in model.features]
    sentinels = next((s.sentinels for s in model.steps if isinstance(s, CleanModel)), ())
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.select(*model.features).schema])
    numeric = {f.name for f in schema if f.dataType.typeName() not in ("string",)}
    extra += [{**base, f: type(base[f])(s) if base[f] is not None else None} for f in model.features if f in numeric for s in sentinels]
    double = {f.name for f in schema if f.dataType.typeName() == "double"}
    extra += [{**base, f: v} for f, vs in boundary_values(model).items() if f in double for v in vs]
    # rows of random values in the range of each column, or of its values
    rng, known = random.Random(seed), {f.name: [r[f.name] for r in sample if r[f.name] is not None] for f in schema}
    for _ in range(rows):
        extra.append({f: rng.uniform(min(v), max(v)) if v and f in double else rng.choice(v) if v else None for f, v in known.items()})
    every = [make(r) for r in sample + extra] if make else sample + extra
    output = model.steps[-1].output  # type: ignore[attr-defined]
    got = [r[output] for r in model.score(df.sparkSession.createDataFrame([tuple(r[f] for f in model.features) for r in every], schema).coalesce(1)).collect()]
    worst = max(abs(a - model.apply_row(r)[output]) for a, r in zip(got, every, strict=True))
    if worst > tolerance:
        raise ConsistencyError(f"scores differ by {worst}")
    return worst


def add_risk_score(df: DataFrame, spec: str) -> DataFrame:
    """``df`` with the score of a written specification."""
    return PipelineModel.from_json(spec).score(df)
