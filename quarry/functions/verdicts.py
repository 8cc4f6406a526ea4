"""Verdict, severity and confidence expressions (H6, H8, H9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.registry import CONFIDENCE_ORDER, SEVERITY_ORDER


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank_of(value, order: dict[str, int]) -> Column:
    """Case-sensitive rank lookup; unknown values rank 0."""
    v = _c(value)
    expr = None
    for k, r in order.items():
        expr = F.when(v == k, F.lit(r)) if expr is None else expr.when(v == k, F.lit(r))
    return expr.otherwise(F.lit(0))


def severity_rank(value) -> Column:
    return rank_of(value, SEVERITY_ORDER)


def confidence_rank(value) -> Column:
    return rank_of(value, CONFIDENCE_ORDER)


def threshold_rank(threshold: str | None, order: dict[str, int]) -> int | None:
    """Driver-side parse of a CLI-style threshold ('high', 'never', None)."""
    if threshold is None or threshold.lower() == "never":
        return None
    return order.get(threshold.capitalize(), 0)


def verdict_bucket(has_record, verdict, confidence, exploitable) -> Column:
    """H6: refutation-first bucket of one finding's verdict record.

    No record -> unverified; 'refuted' -> refuted; 'confirmed' -> confirmed
    only when exploitable is 'yes', else not_actionable; legacy records
    (any other verdict, incl. blank) derive: confidence Low -> refuted,
    exploitable no/conditional -> not_actionable, otherwise confirmed.
    """
    v, c, e = _c(verdict), _c(confidence), _c(exploitable)
    return (F.when(~_c(has_record), "unverified")
            .when(v.eqNullSafe("refuted"), "refuted")
            .when(v.eqNullSafe("confirmed"),
                  F.when(e.eqNullSafe("yes"), "confirmed").otherwise("not_actionable"))
            .when(c.eqNullSafe("Low"), "refuted")
            .when(e.isin("no", "conditional"), "not_actionable")
            .otherwise("confirmed"))


def effective_confidence(has_record, confidence) -> Column:
    """Confidence used for gating: the record's value when it is a known level,
    else 'Unverified' ('Unknown' is kept; it ranks 0 like Unverified)."""
    c = _c(confidence)
    return F.when(_c(has_record) & c.isin(*CONFIDENCE_ORDER.keys()), c).otherwise("Unverified")


def confidence_level(conf) -> Column:
    """Four-level confidence used by the sectioned report (Unknown folds into Unverified)."""
    c = _c(conf)
    return F.when(c.isin("High", "Medium", "Low"), c).otherwise("Unverified")
