"""Trading calendar of the currency market, over UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sessions by local hours (fixed values): name, zone, first hour, end.
SESSIONS = (("Sydney", "Australia/Sydney", 7, 16), ("Tokyo", "Asia/Tokyo", 9, 18), ("London", "Europe/London", 8, 17), ("New York", "America/New_York", 8, 17))


def local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp_ntz").cast("timestamp"), zone)


def trading_day(ts: Column) -> Column:
    """The day that rolls at 17:00 in New York."""
    return F.to_date(local(ts, "America/New_York") + F.expr("interval 7 hours"))


def market_open(ts: Column) -> Column:
    """Whether the trading day is a weekday."""
    return F.weekday(trading_day(ts)) < 5


def active_sessions(ts: Column) -> Column:
    """Names of the sessions whose local hours hold the time, joined by +."""
    each = [F.when((F.hour(local(ts, zone)) >= first) & (F.hour(local(ts, zone)) < end), name) for name, zone, first, end in SESSIONS]
    return F.concat_ws("+", *each)


def weekdays_between(a: Column, z: Column) -> Column:
    """Weekdays after a, up to and with z: whole weeks and what is left of one."""
    upto = lambda d: F.floor(F.datediff(d, F.lit("1900-01-01")) / 7) * 5 + F.least(F.pmod(F.datediff(d, F.lit("1900-01-01")), F.lit(7)) + 1, F.lit(5))
    return (upto(z) - upto(a)).cast("long")


#: Exchanges by local hours (fixed values): name, zone, open, close, as minutes of the day.
EXCHANGES = {"XNYS": ("America/New_York", 570, 960), "XETR": ("Europe/Berlin", 540, 1050)}
#: Orders for the opening auction are taken from the evening before until shortly before the open, New York time (fixed values).
AUCTION_FROM, AUCTION_UNTIL = 19 * 60, 9 * 60 + 28


def at_local(day: Column, minutes: int, zone: str, seconds: int = 0) -> Column:
    """The UTC time of a local minute of a day, moved by so many seconds."""
    local_time = F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + minutes * 60)
    return (F.to_utc_timestamp(local_time, zone) + F.make_dt_interval(secs=F.lit(float(seconds)))).cast("timestamp_ntz")


def schedule(days: DataFrame, exchange: str, grace: int = 30) -> DataFrame:
    """Weekdays of days(day) as sessions: open, close, and when a session may be processed, `grace` minutes after its close."""
    zone, first, last = EXCHANGES[exchange]
    d = days.select(F.to_date("day").alias("day")).where(F.weekday("day") < 5).distinct()
    return d.select(F.lit(exchange).alias("exchange"), "day", at_local(F.col("day"), first, zone).alias("open_utc"), at_local(F.col("day"), last, zone).alias("close_utc"), at_local(F.col("day"), last + grace, zone).alias("eligible_at"))


def auction_windows(sessions: DataFrame, safety: int = 60) -> DataFrame:
    """Sessions with the times between which an order for the opening auction may be sent; null on the first session."""
    before = F.lag("day").over(Window.partitionBy("exchange").orderBy("day"))
    s = sessions.withColumn("previous", before)
    return s.withColumns({"opens_at": at_local(F.col("previous"), AUCTION_FROM, "America/New_York", safety), "closes_at": at_local(F.col("day"), AUCTION_UNTIL, "America/New_York", -safety)})


def day_bounds(times: DataFrame, holidays: DataFrame, ahead: int = 7) -> DataFrame:
    """times(ts) with day, the trading day; starts_at and ends_at (UTC, 17:00 to 17:00 in New York); open: whether it is a weekday and no holiday (day); next_open: ts itself while open, else
    when the next open day within ahead days begins."""
    zone = "America/New_York"
    dated = times.withColumn("day", trading_day(F.col("ts")))
    days = dated.select("day").distinct()
    each = days.withColumn("later", F.explode(F.sequence(F.col("day"), F.date_add("day", ahead))))
    shut = holidays.select(F.to_date("day").alias("later")).distinct()
    opened = each.where(F.weekday("later") < 5).join(shut, "later", "left_anti").groupBy("day").agg(F.max(F.col("later") == F.col("day")).alias("open"), F.min(F.when(F.col("later") > F.col("day"), F.col("later"))).alias("next_day"))
    out = dated.join(opened, "day", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    begins = lambda d: at_local(F.date_sub(d, 1), 17 * 60, zone)
    return out.select("ts", "day", begins(F.col("day")).alias("starts_at"), at_local(F.col("day"), 17 * 60, zone).alias("ends_at"), "open", F.when(F.col("open"), F.col("ts")).otherwise(begins(F.col("next_day"))).alias("next_open"))
