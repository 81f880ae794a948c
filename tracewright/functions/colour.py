"""Colours of plotted points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def gradient(ordinal, total) -> Column:
    """``#RRGGBB`` from red (first) to blue (last) by the ordinal of a point, from 0."""
    red = (F.lit(255) - F.floor(F.try_divide(col(ordinal) * 255, F.greatest(col(total) - 1, F.lit(1))))).cast("int")
    return F.format_string("#%02x00%02x", red, F.lit(255) - red)
