"""Energy (E1-E14): integrate a load-percent signal into kWh.

The load signal is a float log of one variable.  Every interval runs from a
sample to the next one (``lead`` in global time order, done with
``ordered_window`` over day buckets), energy = pct / 100 * rated kW * hours.
Intervals crossing midnight are split with ``explode(sequence(day..day))``:
one piece per calendar day touched, bounded by the interval's length in
days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from machlog import config as C
from machlog.functions.classify import like_any
from machlog.functions.timefn import day_of, ms_ts, period_filter, second_ts
from machlog.plans.sequence import ROWS_PER_BUCKET, cut_by_density, ordered_window



def _order(df: DataFrame) -> list[str]:
    return ["date"] + (["seq"] if "seq" in df.columns else [])


def _hours(start: Column | str, end: Column | str) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3_600_000_000.0)


def clamp_pct(value: Column) -> Column:
    """``GREATEST(LEAST(v, 100), 0)``: NaN -> 100, NULL -> 100 (LEAST and
    GREATEST skip NULLs, exactly as in the original)."""
    return F.greatest(F.least(value, F.lit(100.0)), F.lit(0.0))


def _days(days: DataFrame | Sequence[str], spark) -> DataFrame:
    if isinstance(days, DataFrame):
        return days.select(F.col("day").cast("date").alias("day")).distinct()
    return spark.createDataFrame([(d,) for d in days], "day string").select(
        F.col("day").cast("date").alias("day"))


def _on_days(df: DataFrame, day_col: str, days: DataFrame | Sequence[str]) -> DataFrame:
    # The day list has one row per selected day: broadcast semi join.
    d = _days(days, df.sparkSession).withColumnRenamed("day", day_col)
    return df.join(F.broadcast(d), day_col, "left_semi")


def _var_by_name(log: DataFrame, vars_df: DataFrame, name: str) -> DataFrame:
    v = vars_df.filter(F.col("name") == name).select(F.col("id").alias("id_var"))
    return log.join(F.broadcast(v), "id_var", "left_semi")


# ------------------------------------------------------------------ E1 - E4

def energy_variables(vars_df: DataFrame, patterns: Sequence[str] = C.E1_PATTERNS) -> DataFrame:
    """Variables whose lower-cased name is LIKE any pattern."""
    return vars_df.filter(like_any(F.lower(F.col("name")), patterns)).select("id", "name", "datatype")


def unit_rows(units: DataFrame, patterns: Sequence[str] = C.E2_PATTERNS) -> DataFrame:
    """Unit rows whose name matches any pattern (case-insensitive)."""
    return units.filter(like_any(F.col("name"), patterns, lower=True))


def resolve_units(vars_df: DataFrame, units: DataFrame, name: str | None = None) -> DataFrame:
    """Unit and label of variables, by unit name first, then by pretty
    name (both case-insensitive).  The units table grows with the variables, so
    the join strategy is left to the planner."""
    v = vars_df if name is None else vars_df.filter(F.col("name") == name)
    by_name = units.select(F.lower("name").alias("k1"), F.col("units").alias("u1"),
                           F.col("prettyname").alias("p1"))
    by_pretty = units.select(F.lower("prettyname").alias("k2"), F.col("units").alias("u2"),
                             F.col("prettyname").alias("p2"))
    j = (v.join(by_name, F.lower(v["name"]) == F.col("k1"), "left")
         .join(by_pretty, F.lower(v["name"]) == F.col("k2"), "left"))
    return j.select(F.col("name").alias("variable_name"), F.coalesce("u1", "u2").alias("unit"),
                    F.coalesce("p1", "p2").alias("unit_label"))


def daily_load_stats(log: DataFrame, vars_df: DataFrame, days: DataFrame | Sequence[str],
                     name: str = C.ENERGY_VAR_NAME) -> DataFrame:
    """Count, sum and mean of one variable (by name) on the listed days.
    ``value = value`` removes NULLs only; NaN stays and spreads into sums."""
    v = vars_df.filter(F.col("name") == name).select(F.col("id").alias("id_var"),
                                                      F.col("name").alias("variable_name"))
    d = (log.filter(F.col("value") == F.col("value"))
         .join(F.broadcast(v), "id_var", "inner")
         .withColumn("day", day_of(ms_ts("date"))))
    d = _on_days(d, "day", days)
    return d.groupBy("variable_name", "day").agg(
        F.count("*").alias("measure_count"), F.sum("value").alias("total_consumption"),
        F.avg("value").alias("average_consumption"))


# ------------------------------------------------------------------ E5 - E10

def load_samples(log: DataFrame, var_id: int | None = None, vars_df: DataFrame | None = None,
                 name: str | None = None, drop_null: bool = True, drop_nan: bool = False) -> DataFrame:
    """Samples of the load variable: (date[, seq], ts at ms precision, pct
    clamped to 0..100).  ``drop_null`` is the original ``value = value``
    (NULLs only); ``drop_nan`` removes NaN as well."""
    s = log.filter(F.col("id_var") == var_id) if var_id is not None else _var_by_name(log, vars_df, name)
    if drop_null:
        s = s.filter(F.col("value") == F.col("value"))
    if drop_nan:
        s = s.filter(~F.isnan("value"))
    keep = ["date"] + (["seq"] if "seq" in s.columns else [])
    return s.select(*keep, ms_ts("date").alias("ts"), clamp_pct(F.col("value")).alias("pct"))


def with_next(samples: DataFrame, rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """``ts_next``: the next sample's time in global order (NULL for the
    last); the window runs per bucket of about ``rows`` samples."""
    cut = cut_by_density(samples, F.col("date"), "_cut", rows)
    return ordered_window(cut, order=_order(samples), bucket=F.col("_cut"), leads={"ts_next": ("ts", None)}).drop("_cut")


def split_days(iv: DataFrame) -> DataFrame:
    """One piece per calendar day an interval ``[ts, ts_next]`` touches
    (an interval ending exactly at midnight adds a zero-length piece)."""
    gs = F.explode(F.sequence(F.date_trunc("day", "ts"), F.date_trunc("day", "ts_next"),
                              F.expr("INTERVAL 1 DAY")))
    p = iv.withColumn("_gs", gs)
    seg_start = F.greatest(F.col("ts"), F.col("_gs"))
    seg_end = F.least(F.col("ts_next"), F.col("_gs") + F.expr("INTERVAL 1 DAY"))
    return p.withColumn("day", F.to_date("_gs")).withColumn(
        "hours", _hours(seg_start, seg_end)).drop("_gs")


def _kwh(pct: Column, hours: Column, power_kw: float) -> Column:
    return pct / F.lit(100.0) * F.lit(power_kw) * hours


def energy_unsplit(log: DataFrame, vars_df: DataFrame, days: DataFrame | Sequence[str],
                   name: str = C.ENERGY_VAR_NAME, power_kw: float = C.RATED_POWER_KW) -> DataFrame:
    """E5: samples of the listed days only; each lasts until the next listed
    sample (0 h for the last) and counts on its start day.  Intervals
    bridge unselected days, as in the original."""
    s = load_samples(log, vars_df=vars_df, name=name)
    s = _on_days(s.withColumn("day", F.to_date("ts")), "day", days)
    s = with_next(s)
    hours = _hours(F.col("ts"), F.coalesce("ts_next", "ts"))
    return s.groupBy("day").agg(F.sum(_kwh(F.col("pct"), hours, power_kw)).alias("energy_kwh"))


def energy_per_day(log: DataFrame, vars_df: DataFrame, name: str = C.ENERGY_VAR_NAME,
                   power_kw: float = C.RATED_POWER_KW) -> DataFrame:
    """Duration and energy per day, intervals split at midnight."""
    s = with_next(load_samples(log, vars_df=vars_df, name=name))
    iv = s.filter(F.col("ts_next").isNotNull() & (F.col("ts_next") > F.col("ts")))
    p = split_days(iv)
    return p.groupBy("day").agg(
        F.sum("hours").alias("total_duration_h"),
        F.sum(_kwh(F.col("pct"), F.col("hours"), power_kw)).alias("total_energy_kwh"))


def _runs(s: DataFrame, on_threshold: float, rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Valid intervals with ``is_on`` and ``run_id``: the number of off
    intervals before them, equal for consecutive on-intervals and different
    across any off interval.

    Of samples at the same millisecond only the last one has a length, so the
    others are dropped first and one ordered window gives both the interval's
    end and the count."""
    pct = F.max_by("pct", "seq") if "seq" in s.columns else F.max("pct")
    s = s.filter(F.col("date").isNotNull()).groupBy("date").agg(pct.alias("pct"))
    s = s.select("date", ms_ts("date").alias("ts"), "pct", (F.col("pct") > F.lit(on_threshold)).alias("is_on"))
    s = s.withColumn("off", F.when(F.col("is_on"), F.lit(0)).otherwise(F.lit(1)))
    s = cut_by_density(s, F.col("date"), "_cut", rows)
    s = ordered_window(s, order=["date"], bucket=F.col("_cut"),
                       leads={"ts_next": ("ts", None)}, running_sums={"run_id": "off"}).drop("_cut")
    return s.filter(F.col("ts_next").isNotNull())


def load_runs(log: DataFrame, vars_df: DataFrame, days: DataFrame | Sequence[str],
              name: str = C.ENERGY_VAR_NAME, power_kw: float = C.RATED_POWER_KW,
              on_threshold: float = C.ON_THRESHOLD) -> DataFrame:
    """Per run (consecutive on-intervals) with samples on the listed
    days: start, end, hours, kWh and samples."""
    r = _runs(load_samples(log, vars_df=vars_df, name=name), on_threshold)
    r = _on_days(r.filter("is_on").withColumn("day", F.to_date("ts")), "day", days)
    hours = _hours("ts", "ts_next")
    return r.groupBy("run_id").agg(
        F.min("ts").alias("run_start"), F.max("ts_next").alias("run_end"),
        F.sum(hours).alias("total_duration_h"),
        F.sum(_kwh(F.col("pct"), hours, power_kw)).alias("total_energy_kwh"),
        F.count("*").alias("samples_in_run")).drop("run_id")


def energy_runs_per_day(log: DataFrame, vars_df: DataFrame, days: DataFrame | Sequence[str],
                        name: str = C.ENERGY_VAR_NAME, power_kw: float = C.RATED_POWER_KW,
                        on_threshold: float = C.ON_THRESHOLD) -> DataFrame:
    """On-pieces split at midnight: hours, kWh and distinct runs per
    listed day."""
    r = _runs(load_samples(log, vars_df=vars_df, name=name), on_threshold).filter("is_on")
    p = _on_days(split_days(r), "day", days)
    return p.groupBy("day").agg(
        F.sum("hours").alias("total_duration_h"),
        F.sum(_kwh(F.col("pct"), F.col("hours"), power_kw)).alias("total_energy_kwh"),
        F.count_distinct("run_id").alias("run_count"))


def daily_energy(log: DataFrame, from_date: str | None = None, until_date: str | None = None,
                 var_id: int = C.ENERGY_VAR_FINAL, power_kw: float = C.RATED_POWER_KW,
                 on_threshold: float = C.ON_THRESHOLD, rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """E9 (final): kWh per day for a period; the period filter applies
    before ``lead`` (the last sample of the period has no interval).  Only
    the on-filter matters for kWh, so no run ids are built."""
    s = load_samples(period_filter(log, from_date, until_date), var_id=var_id)
    s = with_next(s, rows)
    iv = s.filter(F.col("ts_next").isNotNull() & (F.col("ts_next") > F.col("ts"))
                  & (F.col("pct") > F.lit(on_threshold)))
    p = split_days(iv)
    return (p.groupBy("day").agg(F.sum(_kwh(F.col("pct"), F.col("hours"), power_kw))
                                 .alias("total_energy_kwh")).orderBy("day"))


def daily_energy_gap_cap(log: DataFrame, from_date: str | None = None, until_date: str | None = None,
                         var_id: int = C.ENERGY_VAR_OLD, power_kw: float = C.RATED_POWER_KW,
                         max_gap_s: float = C.ENERGY_GAP_CAP_S) -> DataFrame:
    """Var 630, intervals of ``max_gap_s`` or longer ignored, no
    on-filter, split at midnight.  No NULL filter: a NULL reading counts as
    100 % (LEAST skips NULLs)."""
    s = load_samples(period_filter(log, from_date, until_date), var_id=var_id, drop_null=False)
    s = with_next(s)
    iv = s.filter(F.col("ts_next").isNotNull() & (F.col("ts_next") > F.col("ts"))
                  & (F.unix_micros("ts_next") - F.unix_micros("ts") < F.lit(int(max_gap_s * 1_000_000))))
    p = split_days(iv)
    return p.groupBy(F.col("day").alias("date")).agg(
        F.sum(_kwh(F.col("pct"), F.col("hours"), power_kw)).alias("total_energy_kwh"))


def energy_log_daily(elog: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Σ kWh of an energy log per day, inclusive timestamp bounds."""
    e = elog
    if start is not None:
        e = e.filter(F.col("energy_timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        e = e.filter(F.col("energy_timestamp") <= F.lit(end).cast("timestamp"))
    return e.groupBy(F.to_date("energy_timestamp").alias("date")).agg(
        F.sum("kwh_value").alias("total_energy_kwh"))


def load_buckets(log: DataFrame, days: DataFrame | Sequence[str], var_id: int = C.ENERGY_VAR_OLD,
                 minutes: int = 10) -> DataFrame:
    """Positive readings on the listed days: samples, mean and peak
    per ten-minute bucket (of the second-truncated time)."""
    s = log.filter((F.col("id_var") == var_id) & (F.col("value") > 0)).withColumn(
        "ts", second_ts("date"))
    s = _on_days(s.withColumn("day", F.to_date("ts")), "day", days)
    bucket = F.window("ts", f"{minutes} minutes").start
    return s.groupBy(bucket.alias("bucket_10min")).agg(
        F.count("*").alias("n_samples"), F.avg("value").alias("avg_load"),
        F.max("value").alias("peak_load"))


# ------------------------------------------------------------------ E13 - E14

def energy_kpis(daily: DataFrame, price: float = C.ELECTRICITY_PRICE,
                day: str = "day", value: str = "total_energy_kwh") -> DataFrame:
    """Total, daily mean, record day and value (earliest on ties),
    cost = total x price.  One aggregate."""
    rec = F.min_by(F.struct(F.col(day).alias("d"), F.col(value).alias("v")),
                   F.struct(F.negative(value), F.col(day)))
    return daily.agg(F.sum(value).alias("total_kwh"), F.avg(value).alias("daily_mean_kwh"),
                     rec.alias("r")).select(
        "total_kwh", "daily_mean_kwh", F.col("r.d").alias("record_day"),
        F.col("r.v").alias("record_kwh"),
        (F.col("total_kwh") * F.lit(price)).alias("cost"))


def energy_per_operating_hour(daily: DataFrame, operating: DataFrame, runs: DataFrame,
                              value: str = "total_energy_kwh") -> DataFrame:
    """Total energy / operating hours and / number of program runs
    (0 when the divisor is 0).  Three one-row aggregates combined as scalar
    subqueries."""
    total = daily.select(F.coalesce(F.sum(value), F.lit(0.0))).scalar()
    hours = operating.select(F.coalesce(F.sum("Operating"), F.lit(0.0))).scalar()
    n = runs.select(F.count("*")).scalar()
    return daily.sparkSession.range(1).select(
        total.alias("total_energy_kwh"), hours.alias("operating_hours"), n.alias("program_runs"),
        F.when(hours > 0, total / hours).otherwise(F.lit(0.0)).alias("energy_per_operating_h"),
        F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("energy_per_program"))


def energy_by_program(daily: DataFrame, runs: DataFrame, value: str = "total_energy_kwh") -> DataFrame:
    """Allocation of the total energy to programs by run share."""
    total = daily.select(F.coalesce(F.sum(value), F.lit(0.0))).scalar()
    n_all = runs.select(F.count("*")).scalar()
    counts = runs.groupBy("program").agg(F.count("*").alias("count"))
    return counts.select("program", "count",
                         (F.col("count") / n_all * total).alias("energy_kwh"))
