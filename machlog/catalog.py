"""Registered queries: one Spark callable and (where SQL can express it) one
DuckDB oracle statement per operator of the inventory.

Each Spark callable takes ``(spark, sf_dir)``, reads the driver tables through
the adapters and returns a DataFrame over the whole tables.  Double columns
are rounded to 6 places on both sides so the comparison is exact.

Test-data parameters (chosen once from the data profile, not tuned to pass):
the driver's ``events`` log has about one variable per second, so the
activity rollups use ten-minute buckets (``BUCKET_S``) and the four-state
thresholds 2.45 / 2.7; the sensor pivot uses hourly buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.oracle import with_views
from machlog.sources import adapters as ad

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BUCKET_S = 600
LOW, MID = 2.45, 2.7
T1, T2 = 2, 3
PIVOT_BUCKET_S = 3600


NUDGE = 1e-12


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column to ``digits`` places.  Float sums differ in
    the last bits between engines, and sums of short decimal fractions often
    sit exactly on a rounding tie; a relative nudge of 1e-12 (applied the
    same way in the oracle SQL) keeps such ties from flipping."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name) * F.lit(1.0 + NUDGE), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def nudge_rounds(sql: str, digits: int = 6) -> str:
    """Rewrite every ``round(expr, 6)`` of an oracle statement into
    ``round((expr) * (1 + 1e-12), 6)``, the SQL twin of ``finish``."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth, last_comma = j + len(key), 1, None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                last_comma = k
            k += 1
        inner = sql[j + len(key):k - 1]
        if last_comma is not None and sql[last_comma + 1:k - 1].strip() == str(digits):
            expr = sql[j + len(key):last_comma]
            out.append(sql[i:j] + f"round(({nudge_rounds(expr, digits)}) * (1 + {NUDGE}), {digits})")
        else:
            out.append(sql[i:j] + key + nudge_rounds(inner, digits) + ")")
        i = k


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(nudge_rounds(sql))
        return fn
    return deco


class Tables:
    """Lazy access to the adapted driver tables of one ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.ev = ad.events(spark, sf_dir)

    @property
    def fl(self):
        return ad.float_log(self.ev)

    @property
    def fl16(self):
        return ad.sensor_log(self.ev)

    @property
    def sl(self):
        return ad.alarm_log(self.ev)

    @property
    def load(self):
        return ad.load_log(self.ev)

    @property
    def prog(self):
        return ad.program_log(self.ev)

    @property
    def msgs(self):
        return ad.message_log(self.ev)

    @property
    def vars(self):
        return ad.variables(self.ev)

    @property
    def units(self):
        return ad.units(ad.variables(self.ev))

    @property
    def elog(self):
        return ad.energy_log(self.ev)

    @property
    def prog_runs(self):
        return ad.program_runs(self.ev)


def load_all() -> None:
    """Import the per-family registrations (they call ``register``)."""
    from machlog.registry import activity, alarms, energy, kpi, sources  # noqa: F401
