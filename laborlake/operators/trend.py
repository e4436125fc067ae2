"""Daily counts and trailing calendar averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def on_or_before(ts: Column, as_of: str, data_type) -> Column:
    """``date(ts) <= as_of`` written as a plain range, so that it reaches the scan."""
    return ts < F.date_add(F.lit(as_of).cast("date"), 1).cast(data_type)


def on_or_after(ts: Column, day: str, data_type) -> Column:
    return ts >= F.lit(day).cast("date").cast(data_type)


def trailing_averages(daily: DataFrame, entity: str, day: str = "date", count: str = "job_count") -> DataFrame:
    """Add the 7- and 30-day averages over the days present for each entity.

    Absent days are not zeros. Input has one row per entity and day, so a window
    group is at most the number of calendar days, however popular the entity.
    Both frames share one partitioning and one sort.
    """
    w = Window.partitionBy(entity).orderBy(F.unix_date(day))
    average = F.avg(count)
    return daily.withColumns(
        {
            "moving_avg_7d": F.round(average.over(w.rangeBetween(-6, 0)), 2),
            "moving_avg_30d": F.round(average.over(w.rangeBetween(-29, 0)), 2),
        }
    )
