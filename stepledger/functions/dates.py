"""Days and seconds counted from 1960-01-01."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1960-01-01"


def day_number_to_date(days: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), days.cast("int"))


def date_to_day_number(value: Column) -> Column:
    return F.datediff(value, F.lit(EPOCH).cast("date"))


def second_number_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("long"), F.lit(EPOCH).cast("timestamp"))


def timestamp_to_second_number(value: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp"), value)
