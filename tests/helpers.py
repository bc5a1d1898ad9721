"""Small builders for hand-written fixtures."""

from __future__ import annotations

import datetime as dt

UTC = dt.timezone.utc


def ms(text: str) -> int:
    """Epoch ms of 'YYYY-MM-DD HH:MM:SS[.fff]' in UTC."""
    fmt = "%Y-%m-%d %H:%M:%S.%f" if "." in text else "%Y-%m-%d %H:%M:%S"
    return int(round(dt.datetime.strptime(text, fmt).replace(tzinfo=UTC).timestamp() * 1000))


def float_log(spark, rows):
    """rows: (time text, id_var, value)"""
    data = [(ms(t), int(v), None if x is None else float(x), i) for i, (t, v, x) in enumerate(rows)]
    return spark.createDataFrame(data, "date bigint, id_var int, value double, seq bigint")


def string_log(spark, rows):
    data = [(ms(t), int(v), x, i) for i, (t, v, x) in enumerate(rows)]
    return spark.createDataFrame(data, "date bigint, id_var int, value string, seq bigint")


def alarm(code: str, text: str = "x") -> str:
    return f'["{code}","{text}",3,3,1]'


def arr(*entries: str) -> str:
    return "[" + ",".join(entries) + "]"
