"""Time normalisation (I3, I4) as column expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FMT = "%Y-%m-%d %H:%M:%S"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def second_ts(date: Column | str = "date", bucket_s: int = 1) -> Column:
    """I4: epoch-ms -> timestamp floored to the second (or to ``bucket_s``).
    Integer division (``div``), never ``/`` which is double in Spark."""
    secs = F.expr(f"{date} div 1000") if isinstance(date, str) else F.floor(date / 1000)
    if bucket_s != 1:
        secs = F.floor(secs / F.lit(bucket_s)) * F.lit(bucket_s)
    return F.timestamp_seconds(secs)


def ms_ts(date: Column | str = "date") -> Column:
    """I4: epoch-ms -> timestamp at millisecond precision."""
    return F.timestamp_millis(col(date))


def day_of(ts: Column | str) -> Column:
    """I4: calendar day (UTC) of a timestamp."""
    return F.to_date(col(ts))


def day_text(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def parse_period(from_date: str, until_date: str) -> tuple[int, int]:
    """I3 bounds: ``yyyy-MM-dd HH:mm:ss`` or date-only (extended to
    00:00:00 / 23:59:59), interpreted as UTC, whole seconds -> epoch ms."""
    try:
        start = _dt.datetime.strptime(from_date, FMT)
        end = _dt.datetime.strptime(until_date, FMT)
    except ValueError:
        start = _dt.datetime.strptime(from_date + " 00:00:00", FMT)
        end = _dt.datetime.strptime(until_date + " 23:59:59", FMT)
    utc = _dt.timezone.utc
    ms_start = int(start.replace(tzinfo=utc).timestamp()) * 1000
    ms_end = int(end.replace(tzinfo=utc).timestamp()) * 1000
    return ms_start, ms_end


def period_filter(log: DataFrame, from_date: str | None, until_date: str | None,
                  date_col: str = "date") -> DataFrame:
    """``ms_start <= date <= ms_end`` on the raw epoch column (a plain
    LONG comparison that reaches the Parquet scan), plus a ``day`` range for
    partition pruning when the log is partitioned by day."""
    if from_date is None or until_date is None:
        return log
    ms_start, ms_end = parse_period(from_date, until_date)
    out = log.filter((F.col(date_col) >= F.lit(ms_start)) & (F.col(date_col) <= F.lit(ms_end)))
    if "day" in log.columns:
        d0 = _dt.datetime.fromtimestamp(ms_start / 1000, _dt.timezone.utc).date()
        d1 = _dt.datetime.fromtimestamp(ms_end / 1000, _dt.timezone.utc).date()
        out = out.filter(F.col("day").between(F.lit(d0), F.lit(d1)))
    return out


def with_second(log: DataFrame, bucket_s: int = 1, name: str = "ts") -> DataFrame:
    return log.withColumn(name, second_ts("date", bucket_s))


def with_ms(log: DataFrame, name: str = "ts") -> DataFrame:
    return log.withColumn(name, ms_ts("date"))


def with_day(log: DataFrame, ts: str = "ts", name: str = "day") -> DataFrame:
    return log.withColumn(name, day_of(ts))
