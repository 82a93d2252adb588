"""Scalar rules: the adaptive rate, device shares, work tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adaptive_rate(z: float, interval: Column, hits: Column, start: float) -> Column:
    """max(start, 1 - z^(hits / interval)) to four places; start where nothing was hit; 1 for an interval of 0."""
    power = F.when(interval == 0, F.lit(0.0)).otherwise(F.pow(F.lit(z), hits / interval))
    return F.when(hits > 0, F.greatest(F.lit(start), F.round(1 - power, 4))).otherwise(F.lit(start))


def link_factor(bandwidth: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), bandwidth / 64.0))


def density_class(mean_degree: Column, bound: float = 10.0) -> Column:
    return F.when(mean_degree > bound, "dense").otherwise("sparse")
