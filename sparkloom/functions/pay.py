"""Pay figures made annual, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How often a period is paid in a year; a figure of a day is never made annual.
PAID_A_YEAR = {"hour": 2080, "week": 52, "month": 12, "year": 1}
#: The least figure that counts as a year's without a period, and the largest year's figure believed.
LEAST_WITHOUT_PERIOD, MOST_A_YEAR = 1000, 1_000_000


def annualised(figure: Column, period: Column) -> Column:
    """The figure for a year, rounded half to even; null where its period doesn't tell it or it is beyond belief."""
    factor = F.when(period.isNull(), F.when(figure >= LEAST_WITHOUT_PERIOD, 1))
    for name, times in PAID_A_YEAR.items():
        factor = factor.when(period == name, times)
    year = figure * factor
    return F.when((year > 0) & (year <= MOST_A_YEAR), F.bround(year)).cast("long")
