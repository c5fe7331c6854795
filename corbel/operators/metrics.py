"""Keyed model metrics over (label 0/1, score): AUC, KS, lift, lift tables, swap sets.

Rows are first reduced to distinct scores, bins or counts; all measures of a table share these counts.  Running sums are
taken in ranges of scores, so no window holds a key's scores.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corbel.functions.expressions import number
from corbel.operators.ranks import by_key, placed, quantiles, ranged, running, value_counts, whole


def _counts(df: DataFrame, label: str, score: str, keys: Sequence[str]) -> DataFrame:
    """(keys..., s, n, p): distinct scores with their rows and their bad ones."""
    t = df.select(*keys, F.col(label).alias("y"), number(F.col(f"`{score}`")).alias("s")).filter("y in (0, 1)")
    return value_counts(t, keys, "s", p=F.sum("y"))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _by(keys: Sequence[str]) -> list:
    return list(keys) or [F.lit(1).alias("__all")]


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; 0 where a class is missing."""
    return _auc(_counts(df, label, score, keys), keys)


def _auc(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = ranged(counts, keys, "s").withColumn("m", F.col("n") - F.col("p"))
    inside = Window.partitionBy(*keys, "range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    part = g.withColumn("before", F.coalesce(F.sum("m").over(inside), F.lit(0))).groupBy(*keys, "range").agg(F.sum(F.col("p") * (F.col("before") + F.col("m") / 2)).alias("area"), F.sum("p").alias("p"), F.sum("m").alias("m"))
    part = running(part, keys, ["m"])
    return part.groupBy(*keys).agg(_or_zero(F.try_divide(F.sum(F.col("area") + F.col("p") * F.col("before_m")), F.sum("p") * F.sum("m"))).alias("auc"))


def ks(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), bins: int = 100) -> DataFrame:
    """Greatest distance of the classes' cumulative shares over equal bins of [0, 1], or of the range of other scores."""
    return _ks(_counts(df, label, score, keys), keys, bins)


def _ks(counts: DataFrame, keys: Sequence[str], bins: int = 100) -> DataFrame:
    spans = counts.groupBy(*keys).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    unit = (F.col("lo") >= 0) & (F.col("hi") <= 1)
    spans = spans.withColumns({"start": F.when(unit, 0.0).otherwise(F.col("lo")), "stop": F.when(unit, 1.0).otherwise(F.col("hi"))})
    t = by_key(counts, spans, keys)
    step = (F.col("stop") - F.col("start")) / bins
    k = F.floor(F.coalesce(F.try_divide(F.col("s") - F.col("start"), step), F.lit(0.0)))
    edge = lambda i: F.when(i >= bins, F.col("stop")).otherwise(F.col("start") + i * step)
    k = k + F.when(F.col("s") >= edge(k + 1), 1).when(F.col("s") < edge(k), -1).otherwise(0)
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), k))
    g = t.groupBy(*keys, k.alias("bin")).agg(F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("m"), F.first("pos").alias("pos"), F.first("neg").alias("neg"), F.first(F.col("lo") == F.col("hi")).alias("flat"))
    run = Window.partitionBy(*_by(keys)).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = F.abs(F.try_divide(F.sum("p").over(run), F.col("pos")) - F.try_divide(F.sum("m").over(run), F.col("neg")))
    out = g.withColumn("d", F.when(~F.col("flat"), apart))
    return out.groupBy(*keys).agg(_or_zero(F.max("d")).alias("ks"))


def lift_at(df: DataFrame, label: str, score: str, percent: Sequence[float] = (10,), keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """lift_<p>: the bad rate of scores at or above the (100 - p)th percentile over the whole bad rate; 0 without bads."""
    return _lift(_counts(df, label, score, keys), percent, keys, digits)


def _lift(counts: DataFrame, percent: Sequence[float], keys: Sequence[str], digits: int | None) -> DataFrame:
    cuts = quantiles(counts, keys, [1 - p / 100 for p in percent], "s", digits).drop("n")
    t = by_key(counts, cuts, keys)
    above = [F.col("s") >= F.get("q", F.lit(i)) for i in range(len(percent))]
    rate = F.try_divide(F.sum("p"), F.sum("n"))
    top = [F.try_divide(F.sum(F.when(x, F.col("p"))), F.sum(F.when(x, F.col("n")))) for x in above]
    return t.groupBy(*keys).agg(*[_or_zero(F.try_divide(x, rate)).alias(f"lift_{p:g}") for p, x in zip(percent, top, strict=True)])


def effect_table(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), percent: Sequence[float] = (10, 5, 2, 1), digits: int | None = None) -> DataFrame:
    """n, auc, ks and lifts by key; keys without rows of both labels 0 and 1 still show.  One count of scores serves all."""
    t = df.select(*keys, F.col(label).alias("y"), number(F.col(f"`{score}`")).alias("s")).filter("y in (0, 1)")
    out = t.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("bads"))
    counts = whole(value_counts(t, keys, "s", p=F.sum("y")), keys, "s")
    for p in (_auc(counts, keys), _ks(counts, keys), _lift(counts, percent, keys, digits)):
        out = by_key(out, p, keys, "left")
    return out


def lift_table(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), n_bins: int = 10, baseline: str | None = None, digits: int | None = None) -> DataFrame:
    """Equal-frequency bins of the score: bin, min, max, goods, bads, total, total_pct, bad_rate, ks, lift, cum_lift.

    Bins are [a, b) between distinct inner quantiles of all scores, gray ones (label < 0) too; empty bins show; ``total``
    leaves gray rows out while ``total_pct`` divides by all.  ``ks`` is the signed difference of cumulative bads and
    goods, scores ascending.  A constant score has no rows.  ``baseline`` adds base_* counts of it on the same edges.
    """
    t = df.select(*keys, F.col(label).alias("y"), number(F.col(f"`{score}`")).alias("s"), *([number(F.col(f"`{baseline}`")).alias("b")] if baseline else [])).filter("s is not null")
    goods, bads = F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)
    counts = whole(value_counts(t, keys, "s", goods=goods, bads=bads), keys, "s")
    q = quantiles(counts, keys, [i / n_bins for i in range(n_bins + 1)], "s", digits).select(*keys, F.array_sort(F.array_distinct("q")).alias("e"))
    cuts = by_key(q, counts.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.sum("bads").alias("all_bads"), F.sum("goods").alias("all_goods")), keys)
    cuts = cuts.filter("size(e) > 1").withColumn("inner", F.slice("e", F.lit(2), F.size("e") - 2))
    inner = q.filter("size(e) > 1").select(*keys, F.slice("e", F.lit(2), F.size("e") - 2).alias("inner"))

    def counted(table: DataFrame, col: str, prefix: str) -> DataFrame:
        rows = placed(by_key(table, inner, keys), "bin", col, "inner", n_bins)
        return rows.groupBy(*keys, "bin").agg(F.sum("goods").alias(f"{prefix}goods"), F.sum("bads").alias(f"{prefix}bads"), *([F.min(col).alias("min"), F.max(col).alias("max")] if not prefix else []))

    every = cuts.withColumn("bin", F.explode(F.sequence(F.lit(0), F.size("inner"))))
    on = [*keys, "bin"]
    out = every.join(counted(counts, "s", ""), on, "left").fillna(0, ["goods", "bads"])
    run = Window.partitionBy(*_by(keys)).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("goods") + F.col("bads")
    cum_bad, cum_total = F.sum("bads").over(run), F.sum(total).over(run)
    rate = F.try_divide(F.col("all_bads"), F.col("all_bads") + F.col("all_goods"))
    cols = [
        *keys, "bin", "min", "max", "goods", "bads", total.alias("total"), _or_zero(F.try_divide(total, F.col("n_all"))).alias("total_pct"), _or_zero(F.try_divide(F.col("bads"), total)).alias("bad_rate"),
        (_or_zero(F.try_divide(cum_bad, F.col("all_bads"))) - _or_zero(F.try_divide(F.sum("goods").over(run), F.col("all_goods")))).alias("ks"),
        _or_zero(F.try_divide(F.try_divide(F.col("bads"), total), rate)).alias("lift"), _or_zero(F.try_divide(F.try_divide(cum_bad, cum_total), rate)).alias("cum_lift"),
    ]
    if baseline:
        out = out.join(counted(value_counts(t, keys, "b", goods=goods, bads=bads), "b", "base_"), on, "left").fillna(0, ["base_goods", "base_bads"])
        cols += ["base_goods", "base_bads", _or_zero(F.try_divide(F.col("base_bads"), F.col("base_goods") + F.col("base_bads"))).alias("base_bad_rate")]
    return out.select(*cols)


def swap_table(df: DataFrame, label: str, new: str, old: str, percent: Sequence[float] = (10, 20), keys: Sequence[str] = (), higher_is_safer: bool = True, digits: int | None = None) -> DataFrame:
    """Per cutoff: what the new score rejects and passes against the old one.  Rejected are scores at or below the percentile.

    swap_in are rows the old score rejects and the new one passes, swap_out the reverse, net their difference.
    """
    sign = 1 if higher_is_safer else -1
    t = df.select(*keys, F.col(label).alias("y"), (number(F.col(f"`{new}`")) * sign).alias("a"), (number(F.col(f"`{old}`")) * sign).alias("b")).filter("y in (0, 1) and a is not null and b is not null")
    cuts = [quantiles(value_counts(t, keys, c), keys, [p / 100 for p in percent], c, digits).select(*keys, F.col("q").alias(f"c{c}")) for c in ("a", "b")]
    t = by_key(t, by_key(*cuts, keys), keys)
    cut = F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in percent]).alias("pct"), "ca", "cb"))
    t = t.select(*keys, "y", "a", "b", cut.alias("cut")).select(*keys, "y", F.col("cut.pct").alias("pct"), (F.col("a") <= F.col("cut.ca")).alias("no"), (F.col("b") <= F.col("cut.cb")).alias("old_no"))
    no, old_no, bad = F.col("no"), F.col("old_no"), F.col("y") == 1
    swap_in, swap_out = F.count_if(old_no & ~no), F.count_if(~old_no & no)
    return t.groupBy(*keys, "pct").agg(
        F.count_if(no).alias("new_reject"), F.count_if(~no).alias("new_pass"), F.count_if(no & bad).alias("new_reject_bad"), F.count_if(~no & ~bad).alias("new_pass_good"),
        F.count_if(old_no).alias("old_reject"), F.count_if(~old_no).alias("old_pass"), swap_in.alias("swap_in"), swap_out.alias("swap_out"), (swap_in - swap_out).alias("net"),
    )


def feature_ks(df: DataFrame, features: Sequence[str], score: str, n_bins: int = 10, keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """(keys..., feature, ks): distance over quantile bins of rows scored at or above the median from those below."""
    from corbel.operators.stats import long_form, quantile_edges

    s = number(F.col(f"`{score}`"))
    mid = quantiles(value_counts(df.select(*keys, s.alias("s")), keys, "s"), keys, [0.5], "s", digits).select(*keys, F.get("q", F.lit(0)).alias("__mid"))
    t = by_key(df.filter(s.isNotNull()), mid, keys).withColumn("__high", (s >= F.col("__mid")).cast("int"))
    edges = quantile_edges(df, features, n_bins, keys, digits)
    cells = long_form(t, features, [*keys, "__high"]).filter("value is not null")
    cells = cells.groupBy(*keys, "feature", "value").agg(F.sum("__high").alias("p"), F.sum(1 - F.col("__high")).alias("n"))
    cells = placed(by_key(cells, edges, [*keys, "feature"]).withColumn("inner", F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))), "bin", "value", "inner", n_bins)
    g = cells.groupBy(*keys, "feature", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    each = Window.partitionBy(*keys, "feature")
    run = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = F.abs(F.try_divide(F.sum("p").over(run), F.sum("p").over(each)) - F.try_divide(F.sum("n").over(run), F.sum("n").over(each)))
    return g.withColumn("d", apart).groupBy(*keys, "feature").agg(_or_zero(F.max("d")).alias("ks"))


class Metric:
    """A metric that tables and experiments can use: a name, and ``compute(df, label, score, keys)`` -> (keys..., value)."""

    def __init__(self, name: str, compute: Callable[[DataFrame, str, str, Sequence[str]], DataFrame]):
        self.name, self.compute = name, compute


DEFAULT_METRICS = (
    Metric("auc", lambda df, y, s, k: auc(df, y, s, k).withColumnRenamed("auc", "value")),
    Metric("ks", lambda df, y, s, k: ks(df, y, s, k).withColumnRenamed("ks", "value")),
    Metric("lift_10", lambda df, y, s, k: lift_at(df, y, s, (10,), k).withColumnRenamed("lift_10", "value")),
)


def metric_table(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), metrics: Sequence[Metric] = DEFAULT_METRICS) -> DataFrame:
    """(keys..., metric, value) of every metric."""
    out = None
    for m in metrics:
        part = m.compute(df, label, score, keys).select(*keys, F.lit(m.name).alias("metric"), F.col("value").cast("double"))
        out = part if out is None else out.unionByName(part)
    return out
