"""Exact ranks and quantiles of keyed values, at any number of distinct values.

Values are first counted, so repeated ones are one row.  Approximate quantiles of the distinct values cut each key's
values into ``RANGES`` ranges of about even size, and where these would hold more than ``ROWS`` values each of them into pieces of
its span, as many as the number of values asks for, on a scale that is logarithmic far from the middle.  Sums over ranges (few
rows a key) say which ranges hold the wanted ranks, and only those are put in order.  No task holds a key's values: keys
are few (features, datasets, months), so what is known of each of them, at most some dozens of numbers, is broadcast to the rows, which
are never shuffled by key alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a key's distinct values are cut into, the accuracy of the cuts, and the values from which a range has pieces.
RANGES = 32
ACCURACY = 1000
ROWS = 100_000
#: Bytes that a distinct value takes at least where there are many; a smaller table has no need of pieces.
VALUE_BYTES = 4


def by_key(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join what is known of each key to ``left``; without keys ``right`` is one row.

    ``right`` has one row a key and is broadcast.  Spark cannot tell that an aggregate is small, and a join by shuffling would bring all
    rows of a key to one task.
    """
    return left.join(F.broadcast(right), list(by), how) if by else left.crossJoin(F.broadcast(right))


def value_counts(cells: DataFrame, by: Sequence[str], value: str = "value", **sums: Column) -> DataFrame:
    """(by..., value, n, sums...) for the distinct values that are not NULL."""
    return cells.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()])


def whole(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``counts`` with a condition that always holds and names all its sums.

    Without it each use would be pruned to its own columns, and Spark would scan and shuffle once for every use; so all
    uses share one shuffle.
    """
    sums = [c for c in counts.columns if c not in by and c != value]
    return counts.filter(" or ".join(f"`{c}` > 0" for c in sorted(sums, key=lambda c: c != "n")))


def placed(df: DataFrame, name: str, value: str, edges: str, most: int, strict: bool = False) -> DataFrame:
    """``df`` with ``name``: how many of ``edges``, at most ``most`` ascending ones, are at or below (strictly below) the value.

    Found by halving in plain expressions, which Spark compiles, up to 32 edges.  Beyond that they would grow too large together, and a
    lambda takes the few steps.
    """
    v, step = F.col(value), 1 << max(0, most.bit_length() - 1)
    if most > 32:
        steps = F.array(*[F.lit(step >> i) for i in range(step.bit_length())])
        below = lambda at, by: F.get(edges, at + by - 1) < v if strict else F.get(edges, at + by - 1) <= v
        return df.withColumn(name, F.aggregate(steps, F.lit(0), lambda at, by: F.when(below(at, by), at + by).otherwise(at)))
    out = df.withColumn(name, F.lit(0))
    while step:
        e = F.get(edges, F.col(name) + (step - 1))  # NULL beyond the last
        out = out.withColumn(name, F.when(e < v if strict else e <= v, F.col(name) + step).otherwise(F.col(name)))
        step //= 2
    return out


def _may_need_pieces(df: DataFrame) -> bool:
    """Whether a key might hold more than RANGES * ROWS values, by the size that Spark knows of the table; results are the same."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > VALUE_BYTES * RANGES * ROWS


def ranged(counts: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """``counts`` with ``range``: ascending with the value, and about as many rows in each."""
    counts = whole(counts, by, value)
    quantiles_ = F.percentile_approx(value, [k / RANGES for k in range(RANGES + 1)], ACCURACY)
    if not _may_need_pieces(counts):
        cuts = counts.groupBy(*by).agg(F.slice(quantiles_, 2, RANGES - 1).alias("__cuts"))
        return placed(by_key(counts, cuts, by), "range", value, "__cuts", RANGES - 1, strict=True).drop("__cuts")
    about = counts.groupBy(*by).agg(F.count("*").alias("__d"), quantiles_.alias("__all"))
    at = lambda k: F.get("__all", F.lit(k))
    unit = at(RANGES * 5 // 8) - at(RANGES * 3 // 8)
    about = about.select(*by, F.slice("__all", 2, RANGES - 1).alias("__cuts"), "__all", F.ceil(F.col("__d") / (ROWS * RANGES)).alias("__pieces"), F.when(unit > 0, unit).otherwise(1.0).alias("__unit"))
    out = placed(by_key(counts, about, by), "__range", value, "__cuts", RANGES - 1, strict=True)
    scale = lambda v: F.signum(v) * F.log1p(F.abs(v) / F.col("__unit"))

    def piece(r: Column) -> Column:
        low, high = F.get("__all", r), F.get("__all", r + 1)
        part = F.floor(F.coalesce(F.try_divide(scale(F.col(value)) - scale(low), scale(high) - scale(low)), F.lit(0.0)) * F.col("__pieces"))
        return r * F.col("__pieces") + F.greatest(F.lit(0), F.least(F.col("__pieces") - 1, part))

    # one reference to the search: it would be repeated with every other; and a column that cannot be NULL, for the same reason
    place = F.coalesce(F.get(F.transform(F.array("__range"), piece), F.lit(0)), F.lit(0).cast("long"))
    return out.withColumn("range", place).drop("__cuts", "__all", "__pieces", "__unit", "__range")


def running(parts: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``parts(by..., range, sums...)`` with before_<sum>: what lies in earlier ranges of the key."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({f"before_{s}": F.coalesce(F.sum(s).over(order), F.lit(0)) for s in sums})


def quantiles(counts: DataFrame, by: Sequence[str], probabilities: Sequence[float], value: str = "value", digits: int | None = None) -> DataFrame:
    """(by..., q, n): the exact quantiles of ``counts(by..., value, n)``, interpolated between neighbours, in an array."""
    inside = ranged(counts, by, value)
    parts = running(inside.groupBy(*by, "range").agg(F.sum("n").alias("n")), by, ["n"])
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    parts = parts.withColumn("all", F.sum("n").over(whole))
    # the places of the two neighbours that each probability lies between
    at = lambda p: F.lit(float(p)) * (F.col("all") - 1)
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), F.least(F.floor(at(p)) + up, F.col("all") - 1).alias("rank"), (at(p) - F.floor(at(p))).alias("part")) for i, p in enumerate(probabilities) for up in (0, 1)])
    here = F.filter(places, lambda x: (x["rank"] >= F.col("before_n")) & (x["rank"] < F.col("before_n") + F.col("n")))
    wanted = parts.withColumn("__places", here).filter(F.size("__places") > 0).select(*by, "range", "all", F.col("before_n").alias("__before"), "__places")
    order = Window.partitionBy(*by, "range").orderBy(value)
    rows = inside.join(F.broadcast(wanted), [*by, "range"]).withColumn("__last", F.col("__before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    found = F.filter("__places", lambda x: (x["rank"] <= F.col("__last")) & (x["rank"] > F.col("__last") - F.col("n")))
    hits = rows.withColumn("x", F.explode(found)).groupBy(*by, "x.i").agg(F.max("x.part").alias("part"), F.max(F.when(F.col("x.up") == 0, F.col(value))).alias("lo"), F.max(F.when(F.col("x.up") == 1, F.col(value))).alias("hi"), F.first("all").alias("n"))
    q = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - F.col("part")) * F.col("lo") + F.col("part") * F.col("hi"))
    q = q if digits is None else F.round(q, digits)
    each = hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))).alias("s"), F.first("n").alias("n"))
    return each.select(*by, F.transform("s", lambda x: x["q"]).alias("q"), "n")
