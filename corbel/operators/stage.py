"""What pipeline steps are: an estimator's ``fit`` aggregates a table to a small model, a model's ``transform`` projects."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Model:
    """An immutable fitted step.  ``kind`` names it in specifications; ``to_dict`` and ``from_dict`` are inverse."""

    kind = ""

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def to_dict(self) -> dict:
        raise NotImplementedError

    @classmethod
    def from_dict(cls, spec: dict) -> Model:
        raise NotImplementedError

    def apply_row(self, row: dict) -> dict:
        """The same for one row of values, without Spark."""
        raise NotImplementedError

    def attributes(self) -> dict:
        """What later steps may ask for, such as ``iv_values``."""
        return {}


class Estimator:
    """``fit(df, label, features, context, validation)`` -> Model.  ``context`` holds attributes of earlier models."""

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> Model:
        raise NotImplementedError


def require(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
