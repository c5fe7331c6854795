"""Feature selection by information value, correlation and population stability."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.functions.expressions import number
from corbel.operators.stage import Estimator, Model
from corbel.operators.stats import EPS, correlations, information_value, psi


@dataclass(frozen=True)
class SelectModel(Model):
    """Features dropped with the reason, and the values that decided."""

    kind = "select"
    kept: list[str] = field(default_factory=list)
    dropped: dict[str, str] = field(default_factory=dict)
    values: dict[str, float] = field(default_factory=dict)
    name: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)

    def apply_row(self, row: dict) -> dict:
        return {k: v for k, v in row.items() if k not in self.dropped}

    def attributes(self) -> dict:
        return {f"{self.name}_values": self.values} if self.name else {}

    def to_dict(self) -> dict:
        return {"kind": self.kind, "kept": self.kept, "dropped": self.dropped, "values": self.values, "name": self.name}

    @classmethod
    def from_dict(cls, spec: dict) -> SelectModel:
        return cls(list(spec["kept"]), dict(spec["dropped"]), dict(spec["values"]), spec["name"])


@dataclass(frozen=True)
class IVSelector(Estimator):
    """Keeps features with ``least <= IV <= most``; more is taken for a leak."""

    least: float = 0.02
    most: float = 0.5
    eps: float = EPS

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> SelectModel:
        iv = {r.feature: r.iv for r in information_value(df, features, label, eps=self.eps).collect()}
        iv = {f: iv.get(f, 0.0) for f in features}
        why = {f: "iv_low" if v < self.least else "iv_high" for f, v in iv.items() if not self.least <= v <= self.most}
        return SelectModel([f for f in features if f not in why], why, iv, "iv")


def greedy_drops(pairs: list[tuple[str, str, float]], priority: dict[str, float], both: bool = False) -> dict[str, str]:
    """From pairs by falling |r|: drop the one of lower priority, on ties the second; pairs with a dropped end are passed over."""
    gone: dict[str, str] = {}
    for a, b, _ in pairs:
        if a in gone or b in gone:
            continue
        if both:
            gone |= {a: b, b: a}
        elif priority.get(a, 0.0) >= priority.get(b, 0.0):
            gone[b] = a
        else:
            gone[a] = b
    return gone


@dataclass(frozen=True)
class CorrelationSelector(Estimator):
    """Drops features until no pair has |r| above ``threshold``; IV decides, from the context if none is given, else variance."""

    threshold: float = 0.7
    iv_values: dict[str, float] | None = None
    strategy: str = "drop_lower_iv"

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> SelectModel:
        rank = {f: i for i, f in enumerate(features)}
        pairs = [(r.f1, r.f2, r.r) for r in correlations(df, features, self.threshold).collect()]  # pairs of features
        pairs.sort(key=lambda p: (-abs(p[2]), rank[p[0]], rank[p[1]]))
        priority = self.iv_values if self.iv_values is not None else (context or {}).get("iv_values")
        if priority is None:
            row = df.agg(*[F.var_samp(number(F.col(f"`{f}`"))).alias(f"v{i}") for i, f in enumerate(features)]).first() if features else None
            priority = {f: row[f"v{i}"] or 0.0 for i, f in enumerate(features)}
        gone = greedy_drops(pairs, priority, self.strategy == "drop_both")
        strongest: dict[str, float] = {}
        for a, b, r in pairs:
            for f in (a, b):
                strongest[f] = max(strongest.get(f, 0.0), abs(r))
        return SelectModel([f for f in features if f not in gone], {f: f"corr:{g}" for f, g in gone.items()}, {f: strongest.get(f, 0.0) for f in features}, "corr")


@dataclass(frozen=True)
class PSISelector(Estimator):
    """Keeps features whose PSI between training and validation rows is at most ``threshold``.

    The mask is fixed when fitted; without validation rows everything stays.
    """

    threshold: float = 0.25
    n_bins: int = 10

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> SelectModel:
        if validation is None or not features:
            return SelectModel(list(features), {}, dict.fromkeys(features, 0.0), "psi")
        values = {r.feature: r.psi for r in psi(df, validation, features, n_bins=self.n_bins).collect()}
        gone = {f: "psi" for f in features if values.get(f, 0.0) > self.threshold}
        return SelectModel([f for f in features if f not in gone], gone, {f: values.get(f, 0.0) for f in features}, "psi")
