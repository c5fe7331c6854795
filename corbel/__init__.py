"""Credit-risk and fraud scorecard analytics on Spark: fit by a few aggregations, apply by projections."""
