"""Pipelines, scoring specifications, experiments and reports."""
