"""Stability of streams and of stored sketches against exact tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corbel.operators import sketches, stats
from corbel.streaming.monitor import PsiMonitor


def rows(spark, n, shift, seed):
    rng = np.random.default_rng(seed)
    cells = [(float(a) if a > -2 else None, float(b), 5.0) for a, b in zip(rng.normal(shift, 1, n), rng.exponential(1 + shift, n), strict=True)]
    return spark.createDataFrame(cells, "a double, b double, flat double").repartition(3)


def test_monitor_equals_the_table(spark):
    reference, other = rows(spark, 800, 0.0, 1), rows(spark, 500, 0.4, 2).withColumn("k", F.when(F.col("b") > 1, "x").otherwise("y"))
    monitor = PsiMonitor.from_dict(PsiMonitor.fit(reference, ["a", "b", "flat"]).to_dict())
    got = {(r.k, r.feature): r.psi for r in monitor.psi(other, ["k"]).collect()}
    want = {(r.k, r.feature): r.psi for r in stats.psi(reference, other, ["a", "b", "flat"], ["k"]).collect()}
    assert got == pytest.approx(want) and got["x", "flat"] == 0 and max(want.values()) > 0.1
    assert monitor.psi(other.limit(0), ["k"]).collect() == []


def test_monitor_over_a_replayed_stream(spark, tmp_path):
    """Windows are emitted once, on the watermark; rows later than that are left out, others that are late are not."""
    reference = rows(spark, 600, 0.0, 3)
    monitor = PsiMonitor.fit(reference, ["a", "b"])
    day = lambda df, t: df.withColumn("t", F.lit(t).cast("timestamp"))
    batches = [
        [day(rows(spark, 200, 0.3, 4), "2024-01-01 10:00:00")],
        [day(rows(spark, 150, 0.1, 5), "2024-01-02 09:00:00"), day(rows(spark, 50, 0.9, 6), "2024-01-01 23:00:00")],  # late, but counted
        [day(rows(spark, 100, 0.5, 7), "2024-01-03 12:00:00")],
        [day(rows(spark, 70, 2.0, 8), "2024-01-01 11:00:00"), day(rows(spark, 10, 0.0, 9), "2024-01-04 12:00:00")],  # the first is too late
        [day(rows(spark, 10, 0.0, 10), "2024-01-06 12:00:00")],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for parts in batches:  # a restarted query goes on where the last one stopped
        for p in parts:
            p.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(parts[0].schema).parquet(source)
        found = monitor.stream(stream, "t", "1 day", "2 hours").withColumn("day", F.date_format("window.start", "dd")).drop("window")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = [(r.day, r.feature, r.psi) for r in spark.read.parquet(out).collect()]
    kept = batches[0][0].union(batches[1][0]).union(batches[1][1]).union(batches[2][0]).union(batches[3][1]).withColumn("day", F.date_format("t", "dd"))
    want = {(r.day, r.feature): r.psi for r in stats.psi(reference, kept, ["a", "b"], ["day"]).collect()}
    assert len(got) == len({g[:2] for g in got}) == 8  # four days, two features
    assert {g[:2]: g[2] for g in got} == pytest.approx(want)


def test_sketches_keep_their_bound(spark, tmp_path):
    store = sketches.SketchStore(spark, str(tmp_path / "store"))
    rng = np.random.default_rng(1)
    periods = {"2024-01": rng.normal(0, 1, 20_000), "2024-02": rng.normal(0.5, 1, 15_000), "2024-03": np.exp(rng.normal(0, 2, 9_000))}
    for name, x in periods.items():
        df = spark.createDataFrame([(float(v) if i % 10 else None, None) for i, v in enumerate(x)], "x double, gone double").repartition(4)
        for _ in range(2):  # a period written again counts once
            store.add(name, df, ["x", "gone"])
    ps = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    for chosen in (None, ["2024-01", "2024-03"]):
        every = np.sort(np.concatenate([np.delete(x, np.arange(0, len(x), 10)) for n, x in periods.items() if not chosen or n in chosen]))
        got = {r.feature: r for r in store.quantiles(ps, periods=chosen).collect()}
        assert got["gone"].quantiles is None and got["x"].n - got["x"].n_missing == len(every)
        for p, q in zip(ps, got["x"].quantiles, strict=True):
            at = np.searchsorted(every, [q, np.nextafter(q, np.inf)]) / len(every)
            assert at[0] - sketches.RANK_ERROR <= p <= at[1] + sketches.RANK_ERROR
    psi = {(r.period, r.feature): r.psi for r in store.psi(["2024-01"]).collect()}
    assert psi["2024-01", "x"] < 1e-6 < 0.1 < psi["2024-02", "x"] and psi["2024-03", "gone"] == 0
    cuts = np.quantile(periods["2024-01"], np.arange(0.1, 1, 0.1))
    p, q = (np.diff(np.r_[0, np.searchsorted(np.sort(periods[n]), cuts) / len(periods[n]), 1]) for n in ("2024-01", "2024-02"))
    assert psi["2024-02", "x"] == pytest.approx(((q - p) * np.log(q / p)).sum(), abs=0.03)
    with pytest.raises(ValueError):
        store.add("a/b", df, ["x"])
