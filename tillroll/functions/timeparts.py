"""Parts of the relative time text ``"<day> HH:MM:SS"``."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Day 219 is 8 March 2020, so day 0 is Friday, 2 August 2019.
ANCHOR_DATE = datetime.date(2020, 3, 8)
ANCHOR_DAY = 219
EPOCH = ANCHOR_DATE - datetime.timedelta(days=ANCHOR_DAY)


def part_of(text: Column, position: int) -> Column:
    """Day, hour, minute or second (positions 0 to 3); NULL where the text has no such number."""
    return F.get(F.split(F.translate(text, " ", ":"), ":"), F.lit(position)).try_cast("int")


def day_of(text: Column) -> Column:
    return part_of(text, 0)


def hour_of(text: Column) -> Column:
    return part_of(text, 1)


def clock_of(text: Column) -> Column:
    return F.split_part(text, F.lit(" "), F.lit(2))


def timestamp_of(text: Column) -> Column:
    """Epoch plus interval; second 60 rolls over into the next minute."""
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(*[part_of(text, i) for i in range(4)])


def date_of(day: Column) -> Column:
    return F.date_add(F.lit(EPOCH), day)


def weekday_of(day: Column) -> Column:
    """Weekday of a day number, Monday = 0."""
    return F.weekday(date_of(day))


def with_time_parts(df: DataFrame) -> DataFrame:
    """Adds day, time (clock text), hour, trans_ts, weekday (of the day number) and day_mod7."""
    text = F.col("trans_time")
    return df.withColumns(
        {
            "day": day_of(text),
            "time": clock_of(text),
            "hour": hour_of(text),
            "trans_ts": timestamp_of(text),
            "weekday": weekday_of(day_of(text)),
            "day_mod7": F.pmod(day_of(text), F.lit(7)),
        }
    )
