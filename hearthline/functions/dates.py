"""Dates kept as ISO text, and what their age is worth."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_null


def date_key(c: Column) -> Column:
    return F.coalesce(F.left(c, F.lit(10)), F.lit(""))


def days_old(c: Column, as_of: datetime.date) -> Column:
    """Null for missing or malformed dates."""
    day = F.try_to_timestamp(F.left(or_null(c), F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")
    return F.date_diff(F.lit(as_of), day)


def _banded(days: Column, bands, otherwise: float) -> Column:
    out = F.when(days <= bands[0][0], bands[0][1])
    for limit, weight in bands[1:]:
        out = out.when(days <= limit, weight)
    return out.otherwise(otherwise)


def sale_recency_weight(c: Column, as_of: datetime.date) -> Column:
    """How far a valuation trusts a matched sale of that date."""
    return _banded(days_old(c, as_of), ((365, 0.9), (1095, 0.85), (1825, 0.8), (2920, 0.75)), 0.65)


def average_recency_weight(c: Column, as_of: datetime.date) -> Column:
    """The weight of a sale in its sector's averages."""
    days = days_old(c, as_of)
    return F.when(days.isNull(), 0.2).otherwise(_banded(days, ((365, 1.0), (1095, 0.7), (1825, 0.5)), 0.25))


def anchor_weight(c: Column, as_of: datetime.date) -> Column:
    return F.least(F.lit(0.85), F.greatest(F.lit(0.65), sale_recency_weight(c, as_of)))


def month_key(c: Column) -> Column:
    return F.date_format(F.try_to_timestamp(F.left(or_null(c), F.lit(10)), F.lit("yyyy-MM-dd")), "yyyy-MM")
