"""Weight-of-evidence encoding, alone or fused with binning into one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.functions.expressions import lookup, number
from corbel.operators.binning import MOST_CATEGORIES, BinModel, ChiMergeBinner
from corbel.operators.stage import Estimator, Model, require
from corbel.operators.stats import EPS, woe_table


@dataclass(frozen=True)
class WoeModel(Model):
    """Value (a bin) -> WOE by feature; unknown and missing values give NULL.  With ``bins`` raw values are binned first."""

    kind = "woe"
    woe: dict[str, dict[float, float]] = field(default_factory=dict)
    iv: dict[str, float] = field(default_factory=dict)
    bins: BinModel | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, list(self.woe))
        value = lambda f: self.bins.column(f).cast("double") if self.bins else number(F.col(f"`{f}`"))
        return df.withColumns({f: lookup(value(f), m) for f, m in self.woe.items()})

    def apply_row(self, row: dict) -> dict:
        out = dict(row)
        for f, m in self.woe.items():
            v = self.bins.row_bin(f, row.get(f)) if self.bins else row.get(f)
            out[f] = m.get(float(v)) if v is not None and v == v else None
        return out

    def attributes(self) -> dict:
        return {"iv_values": self.iv}

    def table(self, feature: str) -> list[tuple[float, float]]:
        return sorted(self.woe[feature].items())

    def to_dict(self) -> dict:
        return {"kind": self.kind, "woe": {f: sorted(m.items()) for f, m in self.woe.items()}, "iv": self.iv, "bins": self.bins.to_dict() if self.bins else None}

    @classmethod
    def from_dict(cls, spec: dict) -> WoeModel:
        return cls({f: {float(k): float(v) for k, v in m} for f, m in spec["woe"].items()}, dict(spec["iv"]), BinModel.from_dict(spec["bins"]) if spec["bins"] else None)


@dataclass(frozen=True)
class WoeEncoder(Estimator):
    """Encodes columns that hold bins already, or those that ``binner`` bins."""

    binner: Estimator | None = None
    eps: float = EPS

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> WoeModel:
        bins = self.binner.fit(df, label, features, context) if self.binner else None
        most = MOST_CATEGORIES * max(1, len(features))
        rows = woe_table(bins.transform(df) if bins else df, features, label, eps=self.eps).limit(most + 1).collect()  # a row for each bin
        if len(rows) > most:
            raise ValueError(f"more than {MOST_CATEGORIES} values a feature: bin them first")
        woe: dict[str, dict[float, float]] = {f: {} for f in features}
        iv = dict.fromkeys(features, 0.0)
        for r in sorted(rows, key=lambda r: (r.feature, r.value)):
            woe[r.feature][r.value] = r.woe
            iv[r.feature] += r.iv_part
        return WoeModel(woe, iv, bins)


def BinnerWoeEncoder(eps: float = EPS, **binner: object) -> WoeEncoder:  # noqa: N802
    """Chi-square binning and WOE in one step."""
    return WoeEncoder(ChiMergeBinner(**binner), eps)  # type: ignore[arg-type]
