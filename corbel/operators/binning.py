"""Supervised binning: a histogram on the cluster, chi-square merging of its few bins on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.functions.expressions import bin_index, bin_labels, lookup, number
from corbel.operators.ranks import by_key, placed, quantiles
from corbel.operators.stage import Estimator, Model, require

#: A string feature of more values, such as an id, is refused: its model would hold them all.
MOST_CATEGORIES = 10_000


def chi2_quantile(confidence: float) -> float:
    """Of one degree of freedom."""
    return NormalDist().inv_cdf((1 + confidence) / 2) ** 2


def bin_value(x: float | None, edges: Sequence[float | None]) -> int | None:
    """``bin_index(..., "right")`` for one value; outer None edges are infinite."""
    if x is None or x != x:
        return None
    inner = [e for e in edges[1:-1]]
    if edges[0] is not None and x < edges[0] or edges[-1] is not None and x > edges[-1]:
        return None
    return sum(x > e for e in inner)


@dataclass(frozen=True)
class BinModel(Model):
    """Per feature the edges, outer ones None for infinity; for string features also the codes of categories."""

    kind = "bin"
    edges: dict[str, list[float | None]] = field(default_factory=dict)
    categories: dict[str, dict[str, int]] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        c = F.col(f"`{name}`")
        value = lookup(c.cast("string"), self.categories[name]).cast("double") if name in self.categories else number(c)
        return bin_index(value, self.edges[name], "right")

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, list(self.edges))
        return df.withColumns({f: self.column(f).cast("double") for f in self.edges})

    def apply_row(self, row: dict) -> dict:
        return row | {f: self.row_bin(f, row.get(f)) for f in self.edges}

    def row_bin(self, name: str, value: object) -> int | None:
        if name in self.categories:
            value = self.categories[name].get(str(value)) if value is not None else None
        try:
            return bin_value(None if value is None else float(value), self.edges[name])  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return None

    def table(self, name: str) -> list[tuple[int, str]]:
        return list(enumerate(bin_labels(self.edges[name])))

    def to_dict(self) -> dict:
        return {"kind": self.kind, "edges": self.edges, "categories": self.categories}

    @classmethod
    def from_dict(cls, spec: dict) -> BinModel:
        return cls({k: list(v) for k, v in spec["edges"].items()}, {k: {c: int(i) for c, i in v.items()} for k, v in spec["categories"].items()})


# --- merging: bins are [upper, positives, total] --------------------------------------------------------------------


def chi2(a: list, b: list) -> float:
    """Of two neighbouring bins; cells without expectation are left out."""
    n = a[2] + b[2]
    if not n:
        return 0.0
    pos, out = a[1] + b[1], 0.0
    for x in (a, b):
        for seen, share in ((x[1], pos / n), (x[2] - x[1], (n - pos) / n)):
            expected = x[2] * share
            if expected:
                out += (seen - expected) ** 2 / expected
    return out


def _join(bins: list[list], i: int) -> None:
    b = bins.pop(i + 1)
    bins[i] = [b[0], bins[i][1] + b[1], bins[i][2] + b[2]]


def merge(bins: list[list], max_bins: int, min_bins: int, limit: float, min_share: float) -> list[list]:
    """Merge the first least similar pair until few and distinct bins are left, then small ones into neighbours."""
    bins = [list(b) for b in bins]
    while len(bins) > max(min_bins, 1):
        scores = [chi2(a, b) for a, b in zip(bins, bins[1:], strict=False)]
        if len(bins) <= max_bins and min(scores) >= limit:
            break
        _join(bins, scores.index(min(scores)))
    total, again = sum(b[2] for b in bins), True
    while again and len(bins) > max(min_bins, 1):
        again = False
        for i, b in enumerate(bins):
            if total and b[2] / total < min_share:
                left = chi2(bins[i - 1], b) if i else float("inf")
                right = chi2(b, bins[i + 1]) if i + 1 < len(bins) else float("inf")
                _join(bins, i - 1 if left <= right else i)
                again = True
                break
    return bins


@dataclass(frozen=True)
class ChiMergeBinner(Estimator):
    """Chi-square binning of numbers, with special values kept apart, and of categories in the order of bad rates.

    Initial cuts are equally spaced percentiles of the distinct values, three times ``max_bins`` at most.  Categories
    with equal bad rates stand in alphabetical order.  ``special_values`` holds values for all features, or by feature.
    """

    max_bins: int = 10
    min_bins: int = 2
    min_share: float = 0.05
    confidence: float = 0.9
    special_values: Sequence[float] | dict[str, Sequence[float]] = ()
    categorical: Sequence[str] | None = None

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> BinModel:
        require(df, [*features, label])
        types = {f.name: f.dataType for f in df.schema}
        strings = [f for f in features if (f in self.categorical if self.categorical is not None else isinstance(types[f], T.StringType))]
        numbers = [f for f in features if f not in strings]
        edges, categories = {}, {}
        if numbers:
            edges |= self._numbers(df, label, numbers)
        for f in strings:
            categories[f], edges[f] = self._categories(df, label, f)
        return BinModel({f: edges[f] for f in features}, categories)

    def _special(self, feature: str) -> list[float]:
        given = self.special_values.get(feature, ()) if isinstance(self.special_values, dict) else self.special_values
        return sorted({float(v) for v in given if v is not None and abs(float(v)) != float("inf") and v == v})

    def _numbers(self, df: DataFrame, label: str, features: list[str]) -> dict[str, list[float | None]]:
        special = {f: self._special(f) for f in features}
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), number(F.col(f"`{f}`")).alias("v")) for f in features]))
        rows = df.filter(F.col(label).isin(0, 1)).select(F.col(label).alias("y"), cells.alias("c")).select("y", "c.feature", "c.v").filter("v is not null")
        is_special = F.lit(False)
        for f, values in special.items():
            if values:
                is_special = is_special | ((F.col("feature") == f) & F.col("v").isin(*values))
        values = rows.groupBy("feature", "v").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
        regular = values.filter(~is_special)
        most = 3 * self.max_bins
        # with fewer distinct values than cuts every value is a cut
        sizes = regular.groupBy("feature").agg((F.count("*") <= most).alias("few"))
        sized = by_key(regular, sizes, ["feature"])
        every = sized.filter("few").groupBy("feature").agg(F.array_sort(F.collect_set("v")).alias("cuts"))
        spaced = quantiles(sized.filter("not few").select("feature", "v", F.lit(1).alias("n")), ["feature"], [i / most for i in range(most + 1)], "v").select("feature", F.col("q").alias("cuts"))
        cuts = every.unionByName(spaced).withColumn("cuts", F.array_sort(F.array_distinct("cuts")))
        counted = placed(by_key(regular, cuts, ["feature"]), "bin", "v", "cuts", most + 1).withColumn("bin", F.greatest(F.lit(0), F.least(F.col("bin") - 1, F.size("cuts") - 2)))
        bins = counted.groupBy("feature", "bin").agg(F.first("cuts").alias("cuts"), F.sum("p").alias("p"), F.sum("n").alias("n")).collect()  # at most ``most`` rows a feature
        near: dict[str, list] = {}
        for f in [f for f in features if special[f]]:
            around = [F.max(F.when(F.col("v") < s, F.col("v"))).alias(f"lo{i}") for i, s in enumerate(special[f])] + [F.min(F.when(F.col("v") > s, F.col("v"))).alias(f"hi{i}") for i, s in enumerate(special[f])] + [F.count_if(F.col("v") == s).alias(f"n{i}") for i, s in enumerate(special[f])]
            r = values.filter(F.col("feature") == f).agg(*around).first()
            near[f] = [(s, r[f"lo{i}"], r[f"hi{i}"]) for i, s in enumerate(special[f]) if r[f"n{i}"]]
        out = {}
        for f in features:
            own = sorted((r for r in bins if r.feature == f), key=lambda r: r.bin)
            inner: list[float] = []
            if own and len(own[0].cuts) > 1:
                uppers = own[0].cuts[1:]
                start = [[uppers[r.bin], r.p, r.n] for r in own]
                inner = [b[0] for b in merge(start, self.max_bins, self.min_bins, chi2_quantile(self.confidence), self.min_share)[:-1]]
            for s, lo, hi in near.get(f, []):
                inner += [(s + x) / 2 for x in (lo, hi) if x is not None]
            out[f] = [None, *sorted(set(inner)), None]
        return out

    def _categories(self, df: DataFrame, label: str, feature: str) -> tuple[dict[str, int], list[float | None]]:
        c = F.col(f"`{feature}`").cast("string").alias("c")
        rows = df.filter(F.col(label).isin(0, 1)).groupBy(c).agg(F.sum(label).alias("p"), F.count("*").alias("n")).filter("c is not null").limit(MOST_CATEGORIES + 1).collect()
        if len(rows) > MOST_CATEGORIES:
            raise ValueError(f"{feature} has more than {MOST_CATEGORIES} categories: group them first")
        order = sorted(rows, key=lambda r: (r.p / r.n, r.c))
        start = [[float(i), r.p, r.n] for i, r in enumerate(order)]
        # neighbours that no initial bin tells apart share one, as with numbers
        size = -(-len(start) // (3 * self.max_bins)) or 1
        merged = []
        for i in range(0, len(start), size):
            part = start[i : i + size]
            merged.append([part[-1][0], sum(b[1] for b in part), sum(b[2] for b in part)])
        done = merge(merged, self.max_bins, self.min_bins, chi2_quantile(self.confidence), self.min_share) if merged else []
        return {r.c: i for i, r in enumerate(order)}, [None, *[b[0] for b in done[:-1]], None]


@dataclass(frozen=True)
class FixedBinner(Estimator):
    """Binning with given edges, or by a function of the table: the hook for own methods."""

    edges: dict[str, list[float | None]]

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> BinModel:
        return BinModel({f: list(self.edges[f]) for f in features if f in self.edges})
