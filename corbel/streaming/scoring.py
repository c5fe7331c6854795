"""Fitted pipelines over streams: models are projections, so they plan on streaming DataFrames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corbel.functions.expressions import bin_index, number
from corbel.plans.pipeline import PipelineModel


def score_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    return model.score(stream)


def start_scoring(stream: DataFrame, model: PipelineModel, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append scored rows to Parquet; a restarted query goes on where the last one stopped."""
    writer = model.score(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def binned_counts(stream: DataFrame, time: str, score: str, edges: list[float], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of score bins in tumbling windows, rows later than ``late`` left out: what a PSI monitor compares."""
    bins = bin_index(number(F.col(score)), edges, "left")
    rows = stream.withWatermark(time, late).withColumn("bin", bins).filter("bin is not null")
    return rows.groupBy(F.window(time, window).alias("window"), "bin").agg(F.count("*").alias("n"))
