"""Quantiles and stability from stored sketches: each period of a table is read once, and later reports merge what is kept.

A KLL sketch of ``K`` holds about 3 ``K`` values whatever the number of rows; a rank that it tells is off by less than
``RANK_ERROR`` of the rows (with a probability of 99 %).  Sketches merge, so those of periods give any union of them, and those of
parts of a table give the whole.  ``ranks`` is the exact way, which reads all rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.operators.stats import PSI_EPS, _named, places

#: Size of a sketch, and the bound of the error of a rank that comes with it.
K = 2000
RANK_ERROR = 0.004


def sketches(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """(keys..., feature, n, n_missing, sketch): one scan, partial sketches by task; a NULL sketch where all is missing."""
    cells = places(df, features, keys)
    some = F.count("value")
    own = cells.groupBy(*keys, "place").agg(F.count("*").alias("n"), (F.count("*") - some).alias("n_missing"), F.when(some > 0, F.kll_sketch_agg_double("value", k)).alias("sketch"))
    return own.select(*keys, _named(features), "n", "n_missing", "sketch")


def merged(parts: DataFrame, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """The sketches of ``parts(..., feature, n, n_missing, sketch)`` by feature and the ``keys`` that are left."""
    some = F.count("sketch")
    return parts.groupBy(*keys, "feature").agg(F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.when(some > 0, F.kll_merge_agg_double("sketch", k)).alias("sketch"))


def sketch_quantiles(parts: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``parts`` with ``quantiles`` instead of the sketch; NULL where there is none."""
    q = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in probabilities])
    return parts.withColumn("quantiles", F.when(F.col("sketch").isNotNull(), q)).drop("sketch")


def sketch_psi(reference: DataFrame, other: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, eps: float = PSI_EPS) -> DataFrame:
    """(keys..., feature, psi) of sketches ``other(keys..., feature, sketch)`` against ``reference(feature, sketch)``; no rows are read.

    Bins lie between the reference's quantiles; the outer ones are open, so new extremes count.  0 where either has no values.  The
    reference's cuts, a few numbers a feature, are frozen on the driver: Spark asks a sketch for ranks of literals only.
    """
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(i / n_bins)) for i in range(1, n_bins)])
    cuts = {r.feature: sorted(set(r.q)) for r in reference.filter("sketch is not null").select("feature", quantiles.alias("q")).collect()}

    def ranks(df: DataFrame) -> DataFrame:
        out = F.lit(None).cast("array<double>")
        for f, c in cuts.items():
            out = F.when(F.col("feature") == f, F.array(*[F.kll_sketch_get_rank_double("sketch", F.lit(float(x))) for x in c])).otherwise(out)
        up = F.concat(F.array(F.lit(0.0)), out, F.array(F.lit(1.0)))
        share = F.zip_with(F.slice(up, F.lit(2), F.size(up) - 1), F.slice(up, F.lit(1), F.size(up) - 1), lambda b, a: (b - a + eps) / (1 + eps * (F.size(up) - 1)))
        return df.withColumn("__share", F.when(F.col("sketch").isNotNull(), share))

    own = ranks(reference).select("feature", F.col("__share").alias("__ref"))
    both = ranks(other).join(own, "feature", "left")
    parts = F.zip_with("__share", "__ref", lambda q, p: (q - p) * F.ln(q / p))
    value = F.when(F.col("__share").isNotNull() & F.col("__ref").isNotNull(), F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))).otherwise(0.0)
    return both.select(*keys, "feature", value.alias("psi"))


class SketchStore:
    """Sketches by period below a folder: a period is written once, or anew as a whole, and no report reads its rows again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, period: str, df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> None:
        """Store what ``df`` holds of a period; what was stored of it before is replaced."""
        if not period or set(period) & set("/\\ ="):
            raise ValueError(f"not a name of a period: {period!r}")
        sketches(df, features, keys).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/period={period}")

    def read(self, periods: Sequence[str] | None = None) -> DataFrame:
        """(period, keys..., feature, n, n_missing, sketch); only the folders of ``periods`` are read."""
        df = self.spark.read.option("basePath", self.root).option("mergeSchema", "false").parquet(self.root)
        df = df.withColumn("period", F.col("period").cast("string"))
        return df if periods is None else df.filter(F.col("period").isin(list(periods)))

    def quantiles(self, probabilities: Sequence[float], keys: Sequence[str] = (), periods: Sequence[str] | None = None) -> DataFrame:
        return sketch_quantiles(merged(self.read(periods), keys), probabilities)

    def psi(self, reference: Sequence[str], periods: Sequence[str] | None = None, n_bins: int = 10) -> DataFrame:
        """(period, feature, psi) of each period against those of ``reference`` together."""
        return sketch_psi(merged(self.read(reference)), merged(self.read(periods), ["period"]), ["period"], n_bins)
