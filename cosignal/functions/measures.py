"""Disproportionality measures over a 2x2 contingency table.

For a (pair, event) cell: ``a`` reports with the pair and the event, ``pair_total``
reports with the pair, ``event_total`` reports with the event, ``n`` all reports.
Every cell gets the same continuity correction ``eps`` (0.5 by default). All
arithmetic is in doubles: a decimal literal would turn the ratio into a decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_EPS = 0.5


def _d(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def cells(a, pair_total, event_total, n, eps: float = DEFAULT_EPS):
    """The four corrected cells (a, b, c, d) of the contingency table."""
    a, pt, et, n = _d(a), _d(pair_total), _d(event_total), _d(n)
    e = F.lit(float(eps))
    ca = a + e
    cb = (pt - a) + e
    cc = (et - a) + e
    cd = (n - pt - et + a) + e
    return ca, cb, cc, cd


def prr(a, pair_total, event_total, n, eps: float = DEFAULT_EPS) -> Column:
    """Proportional reporting ratio: (a/(a+b)) / (c/(c+d))."""
    ca, cb, cc, cd = cells(a, pair_total, event_total, n, eps)
    return (ca / (ca + cb)) / (cc / (cc + cd))


def ror(a, pair_total, event_total, n, eps: float = DEFAULT_EPS) -> Column:
    """Reporting odds ratio: (a*d) / (b*c)."""
    ca, cb, cc, cd = cells(a, pair_total, event_total, n, eps)
    return (ca * cd) / (cb * cc)


def risk_score(a, prr_col) -> Column:
    """Support-weighted signal: ln(1+a) * ln(1+PRR)."""
    return F.ln(F.lit(1.0) + _d(a)) * F.ln(F.lit(1.0) + _d(prr_col))
