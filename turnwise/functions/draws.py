"""Portable random numbers: the same on every engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, n: Column | int) -> Column:
    """An integer from 0 to n - 1 that depends on ``key`` alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n
