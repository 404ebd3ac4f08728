"""Times in microseconds cut to days and minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US, MINUTE_US = 86400 * 1000000, 60 * 1000000


def cut(us: Column, unit_us: int) -> Column:
    """The beginning of the day or minute; also right before 1970."""
    return (us - F.pmod(us, F.lit(unit_us))).cast("long")


def minutes_between(a: Column, b: Column) -> Column:
    return F.abs(a - b) / MINUTE_US


def with_clock(rows: DataFrame) -> DataFrame:
    """Add day_us, minute_us and whether a row is the first of its session on that day."""
    by = Window.partitionBy("session_id").orderBy("ts_us", "request_id")
    rows = rows.withColumns({"day_us": cut(F.col("ts_us"), DAY_US), "minute_us": cut(F.col("ts_us"), MINUTE_US)})
    return rows.withColumn("new_day", ~F.lag("day_us").over(by).eqNullSafe(F.col("day_us")))
