"""Keyed statistics: profiles, information value, WOE, PSI, correlations, sample counts.

Each takes ``keys``, the columns that tell datasets apart, so one job answers all of them.  Features become rows
(feature, value) by one ``unpivot``, so one scan serves any number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.functions.expressions import number
from corbel.operators.ranks import by_key, placed, quantiles, value_counts

EPS = 0.001
PSI_EPS = 1e-4


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value double), NaN as NULL."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), number(F.col(f"`{f}`")).alias("value")) for f in features]))
    return df.select(*keep, cells.alias("cell")).select(*keep, "cell.feature", "cell.value")


#: Columns of one scan: wider projections lose Spark's generated code (its limit is 100 fields).
WIDTH = 64


def places(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., place, value): as ``long_form``, with a feature's place instead of its name, for grouping many rows."""
    parts = []
    for lo in range(0, len(features), WIDTH):
        cells = F.posexplode(F.array(*[number(F.col(f"`{f}`")) for f in features[lo : lo + WIDTH]])).alias("at", "value")
        parts.append(df.select(*keep, cells).select(*keep, (F.col("at") + lo).alias("place"), "value"))
    return reduce(DataFrame.unionAll, parts)


def _classes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row by the values of key columns, and a row of each group."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = c.dictionary_encode("encode")
        code = code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    return code, np.unique(code, return_index=True)[1]


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values without NaN, and the place of each value among them; whole numbers of a small span are not sorted."""
    if len(values) and np.abs(values).max() < 1 << 40:
        whole_ = values.astype(np.int64)
        low, span = whole_.min(), int(np.ptp(whole_)) + 1
        if span <= 2 * len(values) + 1024 and (whole_ == values).all():
            there = np.zeros(span, bool)
            there[whole_ - low] = True
            return (np.flatnonzero(there) + low).astype(float), (np.cumsum(there) - 1)[whole_ - low]
    return np.unique(values, return_inverse=True)


def _counter(d: int, keys: Sequence[str], label: bool, names: Sequence[str], most: int = 1 << 18):
    """(keys, place, value, n[, n_pos]) of each batch: one row for each distinct value of a feature and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, row = _classes([batch.column(f"k{i}") for i in range(len(keys))]) if keys else (0, np.zeros(1, np.int64))
            code = np.broadcast_to(code, batch.num_rows)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float) if label else None
            out, size = [], 0
            for i in range(d):
                x = batch.column(f"c{i}").to_numpy(zero_copy_only=False)
                gone = np.isnan(x)
                some = gone.any()
                values, at = _distinct(x[~gone] if some else x)
                if some:
                    place = np.full(len(x), len(values))
                    place[~gone] = at
                    values, at = np.append(values, np.nan), place
                cell = code * len(values) + at
                n = np.bincount(cell, minlength=len(row) * len(values))
                full = np.flatnonzero(n)
                out.append((row[full // len(values)], np.full(len(full), i, np.int32), values[full % len(values)], n[full], np.bincount(cell, y, len(n))[full] if label else n[:0]))
                size += len(full)
                if size > most or i + 1 == d:
                    at_row, place, value, n, pos = (np.concatenate(c) for c in zip(*out, strict=True))
                    cols = [*[batch.column(f"k{j}").take(pa.array(at_row)) for j in range(len(keys))], pa.array(place), pa.array(value, mask=np.isnan(value)), pa.array(n), *([pa.array(pos.astype(np.int64))] if label else [])]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    out, size = [], 0

    return run


def counted(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """(keys..., place, value, n[, n_pos]) of each distinct value, NULL too; ``n_pos`` adds up a whole-numbered ``label``.

    Each task counts in numpy, so a column of few values is shuffled as a few rows a batch and never as one row a cell: for binned
    features.  Where most values differ ``places`` and a plain count are faster.
    """
    by = [*keys, "place", "value"]
    cols = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)] + [number(F.col(f"`{f}`")).alias(f"c{i}") for i, f in enumerate(features)] + ([F.col(f"`{label}`").cast("double").alias("y")] if label else [])
    rows = df.select(*cols)
    fields = [T.StructField(k, rows.schema[f"k{i}"].dataType) for i, k in enumerate(keys)] + [T.StructField("place", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType())] + ([T.StructField("n_pos", T.LongType())] if label else [])
    sums = [F.sum(c).alias(c) for c in ("n", *(["n_pos"] if label else []))]
    return rows.mapInArrow(_counter(len(features), keys, bool(label), [f.name for f in fields]), T.StructType(fields)).groupBy(*by).agg(*sums)


def _named(features: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in features]), F.col("place") + 1).alias("feature")


def profile(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), probabilities: Sequence[float] = (0, 0.25, 0.5, 0.75, 1)) -> DataFrame:
    """Per feature: n, n_missing, missing_rate, n_distinct, distinct_ratio, mean, variance (ddof 1), quantiles (NULL without values)."""
    cells, by = places(df, features, keys), [*keys, "place"]
    counts = value_counts(cells, by)
    sums = cells.groupBy(*by).agg(F.count("*").alias("n"), F.count("value").alias("known"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    found = quantiles(counts, by, probabilities).drop("n").join(counts.groupBy(*by).agg(F.count("*").alias("n_distinct")), by)
    missing, distinct = F.col("n") - F.col("known"), F.coalesce("n_distinct", F.lit(0))
    return sums.join(found, by, "left").select(
        *keys, _named(features), "n", missing.alias("n_missing"), (missing / F.col("n")).alias("missing_rate"), distinct.alias("n_distinct"),
        F.try_divide(distinct, F.col("known")).alias("distinct_ratio"), "mean", "variance", F.col("q").alias("quantiles"),
    )


def missing_rates(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per key and feature of any type: n, n_missing, missing_rate; NaN counts as missing."""
    def miss(f: str) -> Column:
        c = F.col(f"`{f}`")
        return c.isNull() | F.isnan(c) if isinstance(df.schema[f].dataType, (T.DoubleType, T.FloatType)) else c.isNull()

    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(miss(f)).alias(f"m{i}") for i, f in enumerate(features)])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("n_missing")) for i, f in enumerate(features)]))
    return sums.select(*keys, "n", cells.alias("c")).select(*keys, "c.feature", "n", "c.n_missing", (F.col("c.n_missing") / F.col("n")).alias("missing_rate"))


def woe_table(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = (), eps: float = EPS) -> DataFrame:
    """Per feature and distinct non-null value: n_pos, n_neg, woe, iv_part.

    Totals count every row, also where the value is missing; the smoothing uses the number of the feature's values.
    """
    by = [*keys, "place"]
    cell = counted(df.filter(F.col(label).isin(0, 1)), features, keys, label)
    totals = cell.groupBy(*by).agg(F.sum("n_pos").alias("pos"), F.sum("n").alias("all"), F.count("value").alias("k"))
    cell = by_key(cell.filter("value is not null"), totals, by).withColumn("n_neg", F.col("n") - F.col("n_pos"))
    dp, dn = (F.col("n_pos") + eps) / (F.col("pos") + eps * F.col("k")), (F.col("n_neg") + eps) / (F.col("all") - F.col("pos") + eps * F.col("k"))
    return cell.select(*keys, _named(features), "value", "n_pos", "n_neg", F.ln(dp / dn).alias("woe"), ((dp - dn) * F.ln(dp / dn)).alias("iv_part"))


def information_value(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = (), eps: float = EPS) -> DataFrame:
    """(keys..., feature, iv); every distinct value is a group, so bin continuous columns first."""
    return woe_table(df, features, label, keys, eps).groupBy(*keys, "feature").agg(F.sum("iv_part").alias("iv"))


def quantile_edges(df: DataFrame, features: Sequence[str], n_bins: int, keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """(keys..., feature, edges): distinct ascending quantiles i / n_bins of the non-null values."""
    by = [*keys, "place"]
    return _edges(value_counts(places(df, features, keys), by), by, n_bins, digits).select(*keys, _named(features), "edges")


def _edges(counts: DataFrame, by: Sequence[str], n_bins: int, digits: int | None) -> DataFrame:
    q = quantiles(counts, by, [i / n_bins for i in range(n_bins + 1)], digits=digits)
    return q.select(*by, F.array_sort(F.array_distinct("q")).alias("edges"))


def psi(reference: DataFrame, other: DataFrame, features: Sequence[str], keys: Sequence[str] = (), n_bins: int = 10, eps: float = PSI_EPS, digits: int | None = None) -> DataFrame:
    """(keys of ``other``..., feature, psi) against quantile bins of ``reference``; 0 for constant or empty columns.

    Bins are [a, b) with the last closed; values outside are left out; empty bins count by their smoothing.
    """
    known = value_counts(places(reference, features), ["place"])
    edges = _edges(known, ["place"], n_bins, digits)

    def shares(counts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        at = by_key(counts, edges.filter("size(edges) > 1"), ["place"]).filter("value between edges[0] and element_at(edges, -1)")
        at = placed(at, "bin", "value", "edges", n_bins + 1).withColumn("bin", F.least(F.col("bin") - 1, F.size("edges") - 2))
        bins = at.groupBy(*by, "place", "bin").agg(F.sum("n").alias("c"), F.first("edges").alias("edges"))
        each = bins.groupBy(*by, "place").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("__m"), F.sum("c").alias("__n"), (F.size(F.first("edges")) - 1).alias("__k"))
        share = F.transform(F.sequence(F.lit(0), F.col("__k") - 1), lambda b: (F.coalesce(F.try_element_at("__m", b), F.lit(0)) + eps) / (F.col("__n") + eps * F.col("__k")))
        return each.select(*by, "place", share.alias(name))

    p, q = shares(known, [], "p"), shares(value_counts(places(other, features, keys), [*keys, "place"]), keys, "q")
    parts = F.zip_with("q", "p", lambda a, b: (a - b) * F.ln(a / b))
    found = q.join(p, "place").select(*keys, "place", F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)).alias("psi"))
    some = other.select(*keys).distinct() if keys else other.select(F.lit(1).alias("__one")).distinct()
    every = some.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("place"))
    return every.join(found, [*keys, "place"], "left").select(*keys, _named(features), F.coalesce("psi", F.lit(0.0)).alias("psi"))


#: Up to so many features their pairs are single aggregates; beyond, features are taken in tiles of ``TILE``, two at a time.
FEW = 8
TILE = 512
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _products(first: int, second: int):
    """Sums of a task's rows: for pairs of the first and the second columns, over rows where both are there, n, sums and products about a shift.

    Without second columns the pairs are those of the first ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shift, d = np.zeros((len(_SUMS), first, second or first)), None, first + second
        for batch in batches:
            if not batch.num_rows:
                continue
            if shift is None:
                shift = np.array([s if s is not None else 0.0 for s in (batch.column("shift")[0].as_py())])
            x = np.stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(d)]).astype(float) - shift[:, None]
            there = np.isfinite(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            (a, ma), (b, mb) = (x[:first], m[:first]), ((x[first:], m[first:]) if second else (x, m))
            for t, (left, right) in zip(total, ((ma, mb), (a, mb), (ma, b), (a * a, mb), (ma, b * b), (a, b)), strict=True):
                t += left @ right.T
        i, j = np.indices(total.shape[1:]).reshape(2, -1) if second else np.triu_indices(first, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[i, j]) for t in total]], names=["i", "j", *_SUMS])

    return run


def _tile(df: DataFrame, features: Sequence[str], one: Sequence[int], two: Sequence[int]) -> DataFrame:
    """Sums (i, j, ...) of the pairs of two tiles of features, or of one with itself; only their columns are read."""
    places_ = [*one, *two]
    cells = [number(F.col(f"`{features[p]}`")).alias(f"c{k}") for k, p in enumerate(places_)]
    shift = df.select(*cells).limit(1000).agg(F.array(*[F.avg(f"c{k}") for k in range(len(cells))]).alias("shift"))  # any shift is right, one near the mean keeps digits
    sums = df.select(*cells).crossJoin(F.broadcast(shift)).mapInArrow(_products(len(one), len(two)), "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS))
    return sums.groupBy((F.col("i") + one[0]).alias("i"), (F.col("j") + (two or one)[0]).alias("j")).agg(*[F.sum(c).alias(c) for c in _SUMS])


def correlations(df: DataFrame, features: Sequence[str], threshold: float | None = None) -> DataFrame:
    """(f1, f2, r) of all pairs over all rows; pairs with a NULL are left out pairwise, infinite values count as NULL.

    Few features are one aggregate each pair.  Of more, each task adds up matrix products of its rows, about a value near the mean, for two
    tiles of features at a time, so its matrices do not grow with the features; only sums are shuffled, a row a pair and task.
    NULL where a column has no variance.  With a threshold only |r| above it, largest first.
    """
    if len(features) < 2:
        return df.sparkSession.createDataFrame([], "f1 string, f2 string, r double")
    name = lambda c: F.element_at(F.array(*[F.lit(f) for f in features]), F.col(c) + 1)
    inside = lambda r: F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    if len(features) <= FEW:
        cells = [number(F.col(f"`{f}`")) for f in features]
        rows = df.select(*[F.when(F.abs(c) < float("inf"), c).alias(f"c{k}") for k, c in enumerate(cells)])
        pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
        spread = lambda a, b: F.sqrt(F.var_pop(F.when(F.col(f"c{b}").isNotNull(), F.col(f"c{a}"))))
        one = rows.agg(*[F.try_divide(F.covar_pop(f"c{i}", f"c{j}"), spread(i, j) * spread(j, i)).alias(f"r{i}_{j}") for i, j in pairs])
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{i}_{j}").alias("r")) for i, j in pairs]))
        out = one.select(each.alias("x")).select(name("x.i").alias("f1"), name("x.j").alias("f2"), inside(F.col("x.r")).alias("r"))
    else:
        tiles = [range(lo, min(lo + TILE, len(features))) for lo in range(0, len(features), TILE)]
        one = reduce(DataFrame.unionAll, [_tile(df, features, a, b if b is not a else []) for k, a in enumerate(tiles) for b in tiles[k:]])
        about = lambda ab, a, b: F.col(ab) - F.try_divide(F.col(a) * F.col(b), F.col("n"))
        vx, vy = about("xx", "x", "x"), about("yy", "y", "y")
        # what rounding leaves of a constant column is no variance
        flat = (vx <= F.col("xx") * 1e-14) | (vy <= F.col("yy") * 1e-14)
        r = F.when(~flat, inside(F.try_divide(about("xy", "x", "y"), F.sqrt(vx) * F.sqrt(vy))))
        out = one.select(name("i").alias("f1"), name("j").alias("f2"), r.alias("r"))
    return out if threshold is None else out.filter(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "f1", "f2")


def sample_stats(df: DataFrame, label: str, keys: Sequence[str] = (), gray: int = -1, total: str | None = None) -> DataFrame:
    """goods, bads, gray, total, total_with_gray, bad_rate by key; ``total`` names an added row over all keys."""
    y = F.col(label)
    goods, bads, grays = F.count_if(y == 0), F.count_if(y == 1), F.count_if(y == gray)
    grouped = df.rollup(*keys) if total is not None else df.groupBy(*keys)
    out = grouped.agg(goods.alias("goods"), bads.alias("bads"), grays.alias("gray"), (goods + bads).alias("total"), (goods + bads + grays).alias("total_with_gray"), F.coalesce(F.try_divide(bads, goods + bads), F.lit(0.0)).alias("bad_rate"), *([F.grouping_id().alias("g")] if total is not None else []))
    if total is None:
        return out
    whole = 2 ** len(keys) - 1
    out = out.filter(F.col("g").isin(0, whole))
    return out.withColumns({k: F.when(F.col("g") == whole, F.lit(total) if i == 0 else F.lit(None)).otherwise(F.col(k)) for i, k in enumerate(keys)}).drop("g")
