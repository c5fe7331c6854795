"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is written to a sink that keeps nothing, so all its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corbel.operators import stats
from corbel.plans import queries as scorecard

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("score_lift", "effect_table", "effect_monthly", "iv_table", "woe_encode", "psi_table", "corr_pairs", "profile", "clean_impute_clip", "swap_analysis", "derive_multi", "tree_score", "pipeline_score")
LLM = ("op1_licence_scan", "op2_ngram_jaccard", "op3_token_counts", "op4_quality", "op5_secret_scan", "op6_pii", "op7_decontamination", "op8_preferences", "op9_packing", "op10_embedding_neardup", "op11_exact_dedup", "op12_filter_audit", "op13_source_divergence", "pipeline")


def wide(spark: SparkSession, columns: int, rows: int):
    """Information value of many binned columns: the one figure the reference publishes for its statistics."""
    df = spark.range(rows).select((F.rand(1) < 0.3).cast("int").alias("y"), *[F.floor(F.rand(k + 2) * 10).cast("double").alias(f"f{k}") for k in range(columns)]).cache()
    df.count()
    return lambda: stats.information_value(df, [f"f{k}" for k in range(columns)], "y")


def main() -> None:
    tmp = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    names: dict = {n: (lambda f=scorecard.QUERIES[n]: f(spark, SF)) for n in HEADLINE}
    names |= {"iv_100x50k": wide(spark, 100, 50_000), "iv_200x100k": wide(spark, 200, 100_000)}
    try:
        import corpus_pipeline
        from corbel.llm import queries as llm

        of = llm.QUERIES | {"pipeline": corpus_pipeline.run}
        names |= {n: (lambda f=of[n]: f(spark, SF)) for n in LLM}
    except ImportError as e:
        print(f"without the llm subpackage: {e}", file=sys.stderr)
    names["score_lift"]().write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name, make in names.items():
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
