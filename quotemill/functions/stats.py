"""Numbers: the normal distribution, even rounding, clamps and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26, a rational approximation of erf with an error below 1.5e-7.
_P = 0.3275911
_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + _P * F.abs(x))
    series = t * (_A[0] + t * (_A[1] + t * (_A[2] + t * (_A[3] + t * _A[4]))))
    return F.signum(x) * (1 - series * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / 2**0.5))


def chance_above(mean: Column, threshold: Column, sigma: Column) -> Column:
    """P(X > threshold) for X normal; without spread a step."""
    return F.when(sigma <= 0, (mean > threshold).cast("double")).otherwise(1 - normal_cdf((threshold - mean) / F.nullif(sigma, F.lit(0.0))))


def bucket(p: Column, parts: int) -> Column:
    """The nearest of parts + 1 even steps from 0 to 1; halves go to the even step."""
    return F.rint(p * parts) / parts


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; NaN becomes the lower one."""
    return F.when(F.isnan(x), F.lit(low)).when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def freshness(age_minutes: Column) -> Column:
    """1 up to a quarter of an hour, falling evenly to 0 at a day; 0 if unknown."""
    return F.coalesce(clamp(1 - (age_minutes - 15) / (1440.0 - 15), 0.0, 1.0), F.lit(0.0))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


# Weights of the reliability score, and the Brier score of a forecaster without skill.
FRESH, COMPLETE, CALIBRATED = 0.4, 0.4, 0.2
NO_SKILL = 0.25


def calibration_score(brier: Column) -> Column:
    """1 for a perfect Brier score, falling evenly to 0 at that of no skill or worse; null if unknown."""
    return clamp(1 - brier / NO_SKILL, 0.0, 1.0)


def reliability(fresh: Column, complete: Column, calibrated: Column | None = None) -> Column:
    """The blended score out of 100, one place; where calibration is unknown its weight goes to the other two in proportion."""
    known = FRESH * fresh + COMPLETE * complete
    bare = known / (FRESH + COMPLETE)
    return F.round(100 * (bare if calibrated is None else F.when(calibrated.isNull(), bare).otherwise(known + CALIBRATED * calibrated)), 1)


def match_tier(confidence: Column, overridden: Column | None = None) -> Column:
    """'strong' from 0.80 or by hand, 'probable' from 0.60, else 'weak'; an unknown confidence is weak."""
    c = F.coalesce(clamp(confidence, 0.0, 1.0), F.lit(0.0))
    by_score = F.when(c >= 0.80, "strong").when(c >= 0.60, "probable").otherwise("weak")
    return by_score if overridden is None else F.when(F.coalesce(overridden, F.lit(False)), "strong").otherwise(by_score)
