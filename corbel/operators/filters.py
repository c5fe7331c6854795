"""Row filters: time windows, tags, gray labels, samples and months."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TimeWindow:
    """Rows from ``start`` to ``end``, both included; a bare end date means its first instant.  Either may be None."""

    column: str
    start: str | None = None
    end: str | None = None

    def filter(self, df: DataFrame) -> DataFrame:
        c, kind = F.col(self.column), dict(df.dtypes)[self.column]
        if kind == "string":
            c, kind = c.try_cast("timestamp"), "timestamp"
        if self.start is not None:
            df = df.filter(c >= F.lit(self.start).cast(kind))
        if self.end is not None:
            df = df.filter(c <= F.lit(self.end).cast(kind))
        return df


def with_tag(df: DataFrame, tag: str, value: str) -> DataFrame:
    return df.filter(F.col(tag) == value)


def without_gray(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label) >= 0)


def with_gray(df: DataFrame, tag: str, gray: str, tags: Sequence[str]) -> DataFrame:
    """Column ``dataset``: every row under its tag, and gray rows under each of ``tags`` too, in one pass."""
    own = F.array(F.col(tag))
    return df.withColumn("dataset", F.explode(F.when(F.col(tag) == gray, F.concat(own, F.array(*[F.lit(t) for t in tags]))).otherwise(own)))


def with_month(df: DataFrame, time: str, name: str = "month") -> DataFrame:
    return df.withColumn(name, F.date_format(time, "yyyy-MM"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the least hashes of ``key``: the same ones whatever the partitions."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
