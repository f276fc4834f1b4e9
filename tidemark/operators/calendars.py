"""Decisions on proposed events: plausible ones, clashes with the calendar, and slots on the local clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import mail as M
from tidemark.operators.intervals import DAY, HOUR, free_windows, working_windows

MINUTE = 60_000_000


def validate_proposals(answers: DataFrame) -> DataFrame:
    """Answers (email_id, sender, title, start, end as text) as proposals: times that can't be read or are out of order give none, a title is made where there is none."""
    aware = lambda c: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(F.col(c)), "[zZ]$", "+00:00"), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)$", "$1+00:00"))
    rows = answers.withColumn("start", aware("start")).withColumn("end", aware("end"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Meeting with "), "sender"))
    good = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    when = lambda c: F.when(good, F.unix_micros(c))
    return rows.select("email_id", F.when(good, title).alias("title"), when("start").alias("start"), when("end").alias("end"), F.when(good, "suggested").otherwise("none").alias("status"))


def plausible(proposals: DataFrame, now: Column, most_hours: int = 24) -> DataFrame:
    """Suggested events that have both ends, don't start in the past and last ``most_hours`` at most."""
    return proposals.where((F.col("status") == "suggested") & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") >= now) & (F.col("end") - F.col("start") <= most_hours * HOUR))


def covered(proposals: DataFrame, contexts: DataFrame) -> DataFrame:
    """The proposals (email_id, start, end) whose message has a calendar context (email_id, range_start, range_end) around them."""
    return proposals.join(contexts, "email_id").where("range_start <= start and end <= range_end").select(proposals["*"]).distinct()


def check_slots(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """(email_id, verdict, event_id): duplicate where an overlapping event has the same title, else conflict where one overlaps, else clear; whole-day events don't count.

    ``proposals``: (email_id, calendar_id, title, start, end); ``events``: (event_id, calendar_id, title, start, end, all_day). Both sides meet by calendar and day.
    """
    span = lambda df: df.where("end > start").withColumn("day", F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor((F.col("end") - 1) / DAY))))
    a, b = span(proposals).alias("a"), span(events.where("not all_day")).alias("b")
    hit = a.join(b, (F.col("a.calendar_id") == F.col("b.calendar_id")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))
    same = M.normalized_title(F.col("a.title")) == M.normalized_title(F.col("b.title"))
    worst = F.min(F.struct(F.when(same, 0).otherwise(1).alias("rank"), F.col("b.start").alias("start"), F.col("b.event_id").alias("event_id"))).alias("worst")
    found = hit.groupBy(F.col("a.email_id").alias("email_id")).agg(worst)
    verdict = F.when(F.col("worst").isNull(), "clear").when(F.col("worst.rank") == 0, "duplicate").otherwise("conflict")
    return proposals.select("email_id").join(found, "email_id", "left").select("email_id", verdict.alias("verdict"), F.col("worst.event_id").alias("event_id"))


def auto_add(proposals: DataFrame, contexts: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """(email_id, decision, event_id): adopt an event that is there already, leave conflicts and what no calendar read covers or isn't plausible, create the others. Nothing is written to a calendar."""
    good = plausible(proposals, now)
    seen = covered(good, contexts)
    checked = check_slots(seen, events)
    decided = F.when(F.col("verdict") == "duplicate", "adopt").when(F.col("verdict") == "clear", "create").otherwise("leave")
    both = proposals.select("email_id").join(checked, "email_id", "left")
    return both.select("email_id", decided.alias("decision"), F.when(F.col("verdict") == "duplicate", F.col("event_id")).alias("event_id"))


def ceil_to(micros: Column, minutes: int, zone: str) -> Column:
    """The next point of the local clock's grid of ``minutes`` from midnight on."""
    local = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone))
    step = minutes * MINUTE
    return micros + F.pmod(-F.pmod(local, F.lit(DAY)), F.lit(step))


def pad(rows: DataFrame, minutes: int) -> DataFrame:
    """Intervals with ``minutes`` added on both sides."""
    return rows.withColumn("start", F.col("start") - minutes * MINUTE).withColumn("end", F.col("end") + minutes * MINUTE)


def suggest_slots(ranges: DataFrame, busy: DataFrame, now: Column, zone: str = "UTC", minutes: int = 30, grid: int = 15, lead: int = 60, padding: int = 0, first: int = 9, last: int = 17, weekends: bool = False, count: int = 3) -> DataFrame:
    """(calendar_id, nth, start, end): the first slot that fits on each local day, ``count`` days at most.

    Slots lie in working hours of ``zone`` inside the ranges (calendar_id, from, to), beside padded busy time (calendar_id, start, end), on the local clock's grid, and ``lead`` minutes from now at least.
    """
    free = free_windows(working_windows(ranges, zone, first, last, weekends), pad(busy, padding))
    start = ceil_to(F.greatest("free_from", now + lead * MINUTE), grid, zone)
    fits = free.withColumn("start", start).withColumn("end", F.col("start") + minutes * MINUTE).where("end <= free_to")
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros("start"), zone))
    daily = fits.groupBy("calendar_id", day.alias("day")).agg(F.min("start").alias("start"))
    nth = F.row_number().over(Window.partitionBy("calendar_id").orderBy("day"))
    return daily.withColumn("nth", nth).where(F.col("nth") <= count).select("calendar_id", "nth", "start", (F.col("start") + minutes * MINUTE).alias("end"))


def with_zone(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``rows`` with ``column`` kept where it is among ``known`` (zone), the names of the platform, else UTC."""
    names = known.select(F.col("zone").alias(column)).distinct().withColumn("_known", F.lit(True))
    return rows.join(names, column, "left").withColumn(column, F.when(F.col("_known"), F.col(column)).otherwise("UTC")).drop("_known").select(*rows.columns)
