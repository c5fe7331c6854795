"""Score scales: probabilities of bad as points."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from math import log, log1p

from pyspark.sql import Column
from pyspark.sql import functions as F

from corbel.errors import ScoringError

#: Probabilities are held this far from 0 and 1.
NEAR = 1e-15


@dataclass(frozen=True)
class LogitScale:
    """offset -/+ factor * ln(p / (1 - p)); safer rows score higher by default."""

    offset: float = 600.0
    factor: float = 50.0
    higher_is_safer: bool = True
    kind = "logit"

    @property
    def slope(self) -> float:
        return -self.factor if self.higher_is_safer else self.factor

    def of_probability(self, p: Column) -> Column:
        """NULL for NULL; an error for values outside [0, 1]."""
        q = F.least(F.greatest(p, F.lit(NEAR)), F.lit(1 - NEAR))
        bad = F.raise_error(F.concat(F.lit("not a probability: "), p.cast("string"))).cast("double")
        return F.when(p.isNotNull(), F.when((p < 0) | (p > 1) | F.isnan(p), bad).otherwise(F.lit(self.offset) + F.lit(self.slope) * (F.ln(q) - F.log1p(-q))))

    def of_margin(self, margin: Column) -> Column:
        """The same from the log-odds, without a detour over the probability."""
        return F.lit(self.offset) + F.lit(self.slope) * margin

    def __call__(self, p: float) -> float:
        if not 0 <= p <= 1:
            raise ScoringError(f"not a probability: {p}")
        q = min(max(p, NEAR), 1 - NEAR)
        return self.offset + self.slope * (log(q) - log1p(-q))

    def to_dict(self) -> dict:
        return {"kind": self.kind, **asdict(self)}


def pdo_scale(base_score: float = 600.0, base_p: float = 1 / 51, pdo: float = 50.0, higher_is_safer: bool = True) -> LogitScale:
    """``base_score`` at ``base_p``; ``pdo`` points double the odds."""
    if not 0 < base_p < 1 or pdo <= 0:
        raise ScoringError("base_p must lie between 0 and 1, and pdo above 0")
    factor = pdo / log(2)
    odds = log((1 - base_p) / base_p)
    return LogitScale(base_score - factor * odds if higher_is_safer else base_score + factor * odds, factor, higher_is_safer)
