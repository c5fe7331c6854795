"""Stability over streams: the index of each window against frozen bins of a reference, emitted when the window is over."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel.functions.expressions import bin_index, number
from corbel.operators import stats
from corbel.operators.stage import require


@dataclass(frozen=True)
class PsiMonitor:
    """Edges of each feature and the reference's count in each bin: all that later tables and streams are held against.

    Bins are [a, b) with the last closed; values outside are left out.  A feature with a single edge, and rows that hold no value
    inside, give 0.
    """

    edges: dict[str, list[float]]
    counts: dict[str, list[int]]
    eps: float = stats.PSI_EPS

    @classmethod
    def fit(cls, reference: DataFrame, features: Sequence[str], n_bins: int = 10, eps: float = stats.PSI_EPS, digits: int | None = None) -> PsiMonitor:
        """Quantile bins of ``reference``; a few numbers a feature reach the driver."""
        require(reference, list(features))
        found = {r.feature: list(r.edges) for r in stats.quantile_edges(reference, features, n_bins, digits=digits).collect()}
        edges = {f: found.get(f, []) for f in features}
        own = cls(edges, {}, eps)
        rows = {r.feature: list(r.c) for r in own._counted(reference, []).collect()}
        return cls(edges, {f: rows.get(f, [])[: max(0, len(e) - 1)] for f, e in edges.items()}, eps)

    def _counted(self, df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
        """(keys..., feature, c): counts of bins in an array; one row of state a key and feature."""
        cells = [F.struct(F.lit(f).alias("feature"), bin_index(number(F.col(f"`{f}`")), e, "left").alias("bin")) for f, e in self.edges.items() if len(e) > 1]
        cells += [F.struct(F.lit(f).alias("feature"), F.lit(None).cast("int").alias("bin")) for f, e in self.edges.items() if len(e) < 2]
        most = max((len(e) for e in self.edges.values()), default=1)
        rows = df.withColumn("__cell", F.explode(F.array(*cells)))
        counts = F.array(*[F.count_if(F.col("__cell.bin") == b) for b in range(max(1, most - 1))])
        return rows.groupBy(*keys, F.col("__cell.feature").alias("feature")).agg(counts.alias("c"))

    def _index(self) -> Column:
        share = F.lit(None).cast("array<double>")
        for f, reference in self.counts.items():
            if reference and sum(reference):
                p = [(c + self.eps) / (sum(reference) + self.eps * len(reference)) for c in reference]
                share = F.when(F.col("feature") == f, F.array(*[F.lit(x) for x in p])).otherwise(share)
        own = F.slice("c", F.lit(1), F.size(share))
        total = F.aggregate(own, F.lit(0).cast("long"), lambda s, c: s + c)
        parts = F.zip_with(own, share, lambda c, p: F.struct(((c + self.eps) / (total + self.eps * F.size(share))).alias("q"), p.alias("p")))
        whole = F.aggregate(parts, F.lit(0.0), lambda s, x: s + (x["q"] - x["p"]) * F.ln(x["q"] / x["p"]))
        return F.when(share.isNotNull() & (total > 0), F.greatest(F.lit(0.0), whole)).otherwise(0.0)

    def psi(self, df: DataFrame, keys: Sequence[Column | str] = ()) -> DataFrame:
        """(keys..., feature, psi) of a table, or of a stream whose keys hold a window."""
        require(df, list(self.edges))
        counted = self._counted(df, list(keys))
        return counted.select(*[c for c in counted.columns if c != "c"], self._index().alias("psi"))

    def stream(self, stream: DataFrame, time: str, window: str = "1 day", late: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
        """(window, keys..., feature, psi) of tumbling windows.

        In append mode a window comes once, when the watermark, ``late`` behind the newest row, has passed its end; rows that come
        after that are left out.
        """
        return self.psi(stream.withWatermark(time, late), [F.window(time, window).alias("window"), *keys])

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, spec: dict) -> PsiMonitor:
        return cls({f: list(e) for f, e in spec["edges"].items()}, {f: list(c) for f, c in spec["counts"].items()}, spec["eps"])
