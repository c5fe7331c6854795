"""Cleaning: sentinels, useless columns, missing values and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.functions.expressions import SENTINELS, clip, number
from corbel.operators.ranks import quantiles, value_counts
from corbel.operators.stage import Estimator, Model, require


@dataclass(frozen=True)
class CleanModel(Model):
    kind = "clean"
    sentinels: tuple[float, ...] = SENTINELS
    dropped: dict[str, str] = field(default_factory=dict)
    impute: dict[str, float | str] = field(default_factory=dict)
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    action: str = "clip"
    drop_rows: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        """Columns that the model knows but ``df`` lacks are passed over."""
        out = {}
        for f in df.schema:
            c = F.col(f"`{f.name}`")
            if f.name in self.dropped:
                continue
            if isinstance(f.dataType, T.NumericType) and (f.name in self.impute or f.name in self.bounds or self.sentinels):
                known = f.name in self.impute or f.name in self.bounds
                c = self._numeric(f.name, number(c) if known or isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c)
            elif f.name in self.impute:
                c = F.coalesce(c, F.lit(self.impute[f.name]))
            out[f.name] = c.alias(f.name)
        cleaned = df.select(*out.values())
        return cleaned.dropna(subset=[c for c in self.impute if c in out]) if self.drop_rows else cleaned

    def _numeric(self, name: str, c: Column) -> Column:
        if self.sentinels:
            c = F.when(~c.isin(*self.sentinels), c)
        if name in self.impute and not self.drop_rows:
            c = F.coalesce(c, F.lit(float(self.impute[name])))
        if name in self.bounds:
            lo, hi = self.bounds[name]
            if self.action == "clip":
                c = clip(c, lo, hi)
            else:
                c = F.when((c >= lo if lo is not None else F.lit(True)) & (c <= hi if hi is not None else F.lit(True)), c)
        return c

    def apply_row(self, row: dict) -> dict:
        out = {k: v for k, v in row.items() if k not in self.dropped}
        for k in set(self.impute) | set(self.bounds):
            v = out.get(k)
            if isinstance(self.impute.get(k), str):
                out[k] = self.impute[k] if v is None else v
                continue
            v = None if v is None or v != v or v in self.sentinels else float(v)
            v = self.impute.get(k) if v is None else v
            lo, hi = self.bounds.get(k, (None, None))
            if v is not None and lo is not None and v < lo:
                v = lo if self.action == "clip" else None
            if v is not None and hi is not None and v > hi:
                v = hi if self.action == "clip" else None
            out[k] = v
        return out

    def to_dict(self) -> dict:
        return {"kind": self.kind, **asdict(self)}

    @classmethod
    def from_dict(cls, spec: dict) -> CleanModel:
        return cls(tuple(spec["sentinels"]), dict(spec["dropped"]), dict(spec["impute"]), {k: tuple(v) for k, v in spec["bounds"].items()}, spec["action"], spec["drop_rows"])


@dataclass(frozen=True)
class FeatureCleaner(Estimator):
    """Drops features that are mostly missing, constant or without variance; fills the rest; bounds outliers.

    ``missing``: median, mean, constant, drop_row or none; strings get their mode, the least on ties.  ``outliers``:
    none, percentile (``percentiles``) or iqr (``iqr_factor``); ``action``: clip or set_null.  One aggregation and one
    count of distinct values fit all.
    """

    sentinels: Sequence[float] = SENTINELS
    missing_threshold: float = 0.95
    missing: str = "median"
    fill_value: float | None = None
    outliers: str = "none"
    percentiles: tuple[float, float] = (0.01, 0.99)
    iqr_factor: float = 1.5
    action: str = "clip"
    variance_threshold: float = 0.0
    distinct_threshold: int = 1

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> CleanModel:
        require(df, features)
        if self.missing not in ("median", "mean", "constant", "drop_row", "none") or self.outliers not in ("none", "percentile", "iqr") or self.action not in ("clip", "set_null"):
            raise ValueError("unknown missing, outliers or action")
        numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
        lo, hi = self.percentiles if self.outliers == "percentile" else (0.25, 0.75)
        cell = {}
        for name in features:
            c = number(F.col(f"`{name}`")) if name in numeric else F.col(f"`{name}`")
            cell[name] = F.when(~c.isin(*self.sentinels), c) if self.sentinels and name in numeric else c
        sums = [x for i, f in enumerate(features) for x in (F.count(cell[f]).alias(f"k{i}"), *([F.var_samp(cell[f]).alias(f"v{i}"), F.avg(cell[f]).alias(f"m{i}")] if f in numeric else []))]
        row = df.agg(F.count("*").alias("n"), *sums).first().asDict()
        row |= {f"d{i}": 0 for i in range(len(features))} | {f"{k}{i}": None for i in range(len(features)) for k in "vqm" if f"{k}{i}" not in row}
        for names, value in ((numeric, "double"), (set(features) - numeric, "string")):
            some = [(i, f) for i, f in enumerate(features) if f in names]
            if not some:
                continue
            # one count of distinct values serves quantiles, modes and numbers of distinct values
            counts = value_counts(df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), cell[f].cast(value).alias("value")) for i, f in some])).alias("c")).select("c.*"), ["place"])
            own = counts.groupBy("place").agg(F.count("*").alias("d"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
            own = own.join(quantiles(counts, ["place"], [0.5, lo, hi]).drop("n"), "place") if value == "double" else own.withColumn("q", F.lit(None))
            for r in own.collect():  # a row a feature
                row |= {f"d{r.place}": r.d, f"q{r.place}": r.q} | ({f"m{r.place}": r.mode} if value == "string" else {})
        dropped, impute, bounds = {}, {}, {}
        for i, name in enumerate(features):
            n, known, distinct = row["n"], row[f"k{i}"], row[f"d{i}"]
            if not n or 1 - known / n >= self.missing_threshold:
                dropped[name] = "missing"
            elif distinct <= self.distinct_threshold:
                dropped[name] = "distinct"
            elif name in numeric and (row[f"v{i}"] or 0.0) <= self.variance_threshold:
                dropped[name] = "variance"
            if name in dropped:
                continue
            if self.missing == "constant":
                impute[name] = (self.fill_value or 0.0) if name in numeric else str(self.fill_value or "")
            elif self.missing != "none":
                impute[name] = row[f"m{i}"] if name not in numeric or self.missing == "mean" else row[f"q{i}"][0]
            if name in numeric and self.outliers != "none":
                _, a, b = row[f"q{i}"]
                spread = self.iqr_factor * (b - a) if self.outliers == "iqr" else 0.0
                bounds[name] = (a - spread, b + spread)
        return CleanModel(tuple(self.sentinels), dropped, impute, bounds, self.action, self.missing == "drop_row")
