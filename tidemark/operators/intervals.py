"""Interval algebra over calendars; times are microseconds, ends exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def merge_intervals(rows: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of each calendar as one; empty and inverted ones dropped."""
    w = Window.partitionBy("calendar_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.where("end > start").withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("island", island).groupBy("calendar_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def free_windows(windows: DataFrame, busy: DataFrame) -> DataFrame:
    """What of each window (calendar_id, from, to) the merged busy time leaves: gaps between one busy end and the next start.

    Windows and busy time meet by calendar and day, so a full calendar is many small groups.
    """
    merged = merge_intervals(busy)
    days = lambda a, b: F.sequence(F.floor(a / DAY), F.floor((b - 1) / DAY))
    by_day = merged.withColumn("day", F.explode(days(F.col("start"), F.col("end"))))
    wanted = windows.withColumn("day", F.explode(days(F.col("from"), F.col("to"))))
    hit = wanted.join(by_day, ["calendar_id", "day"]).where("start < to and end > from").select("calendar_id", "from", "to", "start", "end").distinct()
    bounds = hit.unionByName(windows.select("calendar_id", "from", "to", F.col("to").alias("start"), F.col("to").alias("end")))
    w = Window.partitionBy("calendar_id", "from", "to").orderBy("start", "end")
    since = F.coalesce(F.lag("end").over(w), F.col("from"))
    return bounds.withColumn("free_from", F.greatest(since, F.col("from"))).where("free_from < start").select("calendar_id", "free_from", F.col("start").alias("free_to"))


def first_slots(free: DataFrame, length: int, count: int = 3) -> DataFrame:
    """The first slot of ``length`` of each day, on at most ``count`` days a calendar."""
    fits = free.where(F.col("free_to") - F.col("free_from") >= length).withColumn("day", F.floor(F.col("free_from") / DAY))
    daily = fits.groupBy("calendar_id", "day").agg(F.min("free_from").alias("slot"))
    nth = F.row_number().over(Window.partitionBy("calendar_id").orderBy("day"))
    return daily.withColumn("nth", nth).where(F.col("nth") <= count).select("calendar_id", "nth", "slot")


def slot_conflicts(slots: DataFrame, busy: DataFrame) -> DataFrame:
    """For each slot (slot_id, calendar_id, start, end) how many busy intervals overlap it; both sides meet by calendar and day."""
    span = lambda df: df.withColumn("day", F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor((F.col("end") - 1) / DAY))))
    a, b = span(slots.where("end > start")).alias("a"), span(busy.where("end > start")).alias("b")
    hit = a.join(b, (F.col("a.calendar_id") == F.col("b.calendar_id")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))
    n = hit.groupBy("a.slot_id").agg(F.count_distinct("b.event_id").alias("n"))
    return slots.join(n, "slot_id", "left").select("slot_id", F.coalesce("n", F.lit(0)).alias("conflicts"))


def working_windows(ranges: DataFrame, zone: str, first: int = 9, last: int = 17, weekends: bool = False) -> DataFrame:
    """(calendar_id, from, to): working hours of ``zone`` on each local day of the ranges (calendar_id, from, to), clipped to them. Hours are wall-clock, so their length in UTC shifts with daylight saving."""
    local = lambda c: F.from_utc_timestamp(F.timestamp_micros(c), zone)
    days = ranges.withColumn("day", F.explode(F.sequence(F.to_date(local(F.col("from"))), F.to_date(local(F.col("to"))))))
    if not weekends:
        days = days.where(F.weekday("day") < 5)
    utc = lambda hour: F.unix_micros(F.to_utc_timestamp(F.col("day").cast("timestamp") + F.expr(f"interval {hour} hours"), zone))
    clipped = days.select("calendar_id", F.greatest("from", utc(first)).alias("from"), F.least("to", utc(last)).alias("to"))
    return clipped.where(F.col("from") < F.col("to"))
