"""Date functions: delivery dates named in a message, defaults by hour, business nights, recency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weekdays, Monday first.
WEEKDAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")


def next_weekday(day: Column, weekday: Column) -> Column:
    """The next date strictly after day that falls on weekday (0 for Monday)."""
    ahead = F.pmod(weekday - F.weekday(day) - 1, F.lit(7)) + 1
    return F.date_add(day, ahead.cast("int"))


def named_delivery_date(text: Column, day: Column) -> Column:
    """The date that a canonical text names relative to day: apres demain, demain or a weekday; the earliest mention, the longest of those. Null if none."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    mentions = [("apres demain", F.date_add(day, 2)), ("demain", F.date_add(day, 1))]
    mentions += [(name, next_weekday(day, F.lit(i))) for i, name in enumerate(WEEKDAYS)]
    found = [
        F.when(F.contains(padded, F.lit(f" {name} ")), F.struct(F.instr(padded, f" {name} ").alias("at"), F.lit(-len(name)).alias("less"), date.alias("date")))
        for name, date in mentions
    ]
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull())).getField("date")


def default_delivery_date(at: Column) -> Column:
    """Before six in the morning the day itself, later the day after."""
    day = F.to_date(at)
    return F.when(F.hour(at) < 6, day).otherwise(F.date_add(day, 1))


def delivery_date(text: Column, day: Column, hour: Column) -> Column:
    """The delivery date of a message of `day` with canonical `text`: the named one, else a default.

    Before six the night belongs to the day before, from which relative words count; the default then is the day itself, later the day
    after, and the day itself where the hour is not known.
    """
    night = F.coalesce(hour < 6, F.lit(False))
    named = named_delivery_date(text, F.when(night, F.date_sub(day, 1)).otherwise(day))
    return F.coalesce(named, F.when(night | hour.isNull(), day).otherwise(F.date_add(day, 1)))


def delivery_reason(text: Column, day: Column, hour: Column) -> Column:
    """Where delivery_date has its date from: named, or which default."""
    return (
        F.when(named_delivery_date(text, day).isNotNull(), "named").when(hour.isNull(), "hour unknown").when(hour < 6, "before six")
        .when(hour >= 22, "after ten").otherwise("next day")
    )


def business_night(at: Column) -> Column:
    """The evening that a time of 22:00 to 01:59 belongs to; null at other times."""
    day = F.to_date(at)
    return F.when(F.hour(at) >= 22, day).when(F.hour(at) <= 1, F.date_sub(day, 1))


def in_night_window(at: Column) -> Column:
    """Whether a time is within 22:00 and 01:00, both included."""
    minutes = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return (minutes >= 22 * 3600) | (minutes <= 3600)


def in_window(day: Column, first: Column, last: Column) -> Column:
    """Closed interval; a date that is not known is let in."""
    return F.coalesce(day.between(first, last), F.lit(True))
