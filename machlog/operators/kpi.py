"""KPI and reporting tables.

State tables have ``state`` and ``total_hours`` (optionally ``date``).  KPI
rows are single aggregates; several inputs are combined through scalar
subqueries (``DataFrame.scalar``), never through cross joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from machlog import config as C
from machlog.plans.quantiles import exact_quantiles, salted_join


def _hours_where(cond: Column, hours: str = "total_hours") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(hours))), F.lit(0.0))


def _pct(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den * F.lit(100.0)).otherwise(F.lit(0.0))


def state_kpis(states: DataFrame, active_tags: Sequence[str] = C.K1_TAGS_FULL) -> DataFrame:
    """K1: total, active (upper(state) in the tag list), idle, availability %."""
    active = F.upper(F.col("state")).isin(list(active_tags))
    agg = states.agg(F.coalesce(F.sum("total_hours"), F.lit(0.0)).alias("total_hours"),
                     _hours_where(active).alias("active_hours"))
    return agg.select("total_hours", "active_hours",
                      F.when(F.col("total_hours") > 0, F.col("total_hours") - F.col("active_hours"))
                      .otherwise(F.lit(0.0)).alias("idle_hours"),
                      _pct(F.col("active_hours"), F.col("total_hours")).alias("availability_pct"))


def core_state_kpis(states: DataFrame, energy: DataFrame, alarms: DataFrame,
                    core: Sequence[str] = C.K2_CORE_STATES) -> DataFrame:
    """K2 (final): K1 on the four core states plus Σ kWh and Σ alarm
    occurrences (row count when there is no ``occurrence_count``)."""
    s = states.filter(F.col("state").isin(list(core)))
    active = F.upper(F.col("state")).isin([c.upper() for c in core[:3]])
    energy_total = energy.select(F.coalesce(F.sum("total_energy_kwh"), F.lit(0.0))).scalar()
    weight = F.col("occurrence_count") if "occurrence_count" in alarms.columns else F.lit(1)
    alarm_total = alarms.select(F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")).scalar()
    agg = s.agg(F.coalesce(F.sum("total_hours"), F.lit(0.0)).alias("total_h"),
                _hours_where(active).alias("active_h"))
    return agg.select("total_h", "active_h", (F.col("total_h") - F.col("active_h")).alias("idle_h"),
                      energy_total.alias("energy"), alarm_total.alias("alarms"),
                      _pct(F.col("active_h"), F.col("total_h")).alias("avail"))


def idle_by_substring(states: DataFrame) -> DataFrame:
    """K3: idle = states containing 'idle' (any case); utilisation %."""
    idle = F.col("state").ilike("%idle%")
    agg = states.agg(F.coalesce(F.sum("total_hours"), F.lit(0.0)).alias("total_hours"),
                     _hours_where(idle).alias("idle_hours"),
                     F.count("*").alias("distinct_states"))
    return agg.select("total_hours", "idle_hours",
                      (F.col("total_hours") - F.col("idle_hours")).alias("active_hours"),
                      _pct(F.col("total_hours") - F.col("idle_hours"), F.col("total_hours"))
                      .alias("utilization_pct"), "distinct_states")


def economic_impact(kpis: DataFrame, rate: float = C.HOURLY_RATE,
                    idle: str = "idle_h", active: str = "active_h") -> DataFrame:
    """K4: idle hours and active hours valued at an hourly rate."""
    return kpis.select((F.col(idle) * F.lit(rate)).alias("opportunity_cost"),
                       (F.col(active) * F.lit(rate)).alias("active_value"))


def state_share(states: DataFrame, excluded: Sequence[str] = C.K5_EXCLUDED,
                order: Sequence[str] = C.K5_ORDER) -> DataFrame:
    """K5: hours per state without the excluded states, display rank
    (unknown states 99) and share of the total."""
    s = states.filter(~F.upper(F.col("state")).isin(list(excluded)))
    g = s.groupBy("state").agg(F.sum("total_hours").alias("total_hours"))
    total = g.select(F.sum("total_hours")).scalar()
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("state"))
                      .cast("int") - 1, F.lit(99))
    rank = F.when(rank < 0, F.lit(99)).otherwise(rank)
    return g.select("state", "total_hours", rank.alias("rank"),
                    F.when(total > 0, F.col("total_hours") / total).otherwise(F.lit(0.0)).alias("percent"))


def high_activity_ratio(states: DataFrame, core: Sequence[str] = C.K2_CORE_STATES) -> DataFrame:
    """K5: share (%) of High Activity in the four core states."""
    s = states.filter(F.col("state").isin(list(core)))
    agg = s.agg(_hours_where(F.col("state") == "High Activity").alias("high_hours"),
                F.coalesce(F.sum("total_hours"), F.lit(0.0)).alias("total_time"))
    return agg.select("high_hours", "total_time",
                      _pct(F.col("high_hours"), F.col("total_time")).alias("ratio_pct"))


def day_state_pivot(states: DataFrame, values: Sequence[str] = C.K2_CORE_STATES,
                    names: Sequence[str] | None = None, excluded: Sequence[str] = C.K5_EXCLUDED) -> DataFrame:
    """K6: rows = day, columns = state (explicit values), Σ hours, 0 when
    missing."""
    names = list(names or [v.lower().replace(" ", "_").replace("(", "").replace(")", "") for v in values])
    s = states.filter(~F.upper(F.col("state")).isin(list(excluded)))
    p = (s.groupBy(F.to_date("date").alias("jour")).pivot("state", list(values))
         .agg(F.sum("total_hours")).fillna(0.0, subset=list(values)))
    return p.select("jour", *[F.col(f"`{v}`").alias(n) for v, n in zip(values, names)])


def _zoom_day(segs: DataFrame, day: str | None) -> Column:
    if day is not None:
        return F.lit(day).cast("date")
    return segs.select(F.max(F.to_date("date"))).scalar()


def day_zoom(segs: DataFrame, day: str | None = None, min_hours: float = 0.02) -> DataFrame:
    """K7: segments of one day (default: the last day with data), each with
    ``end_time = date + max(hours, 0.02 h)`` for display."""
    d = segs.filter(F.to_date("date") == _zoom_day(segs, day))
    vis = F.greatest(F.col("total_hours"), F.lit(min_hours))
    return d.select("date", "state", "total_hours",
                    F.timestamp_micros(F.unix_micros("date") + F.round(vis * F.lit(3.6e9)).cast("bigint"))
                    .alias("end_time"))


def day_zoom_summary(segs: DataFrame, day: str | None = None) -> DataFrame:
    """K7: Σ hours per state of the zoomed day, largest first."""
    d = segs.filter(F.to_date("date") == _zoom_day(segs, day))
    return d.groupBy("state").agg(F.sum("total_hours").alias("total_hours")).orderBy(F.desc("total_hours"))


def energy_by_date(df: DataFrame, ts: str, value: str = "total_energy_kwh") -> DataFrame:
    """K8: Σ kWh per calendar date of a timestamp column."""
    return df.groupBy(F.to_date(ts).alias("jour")).agg(F.sum(value).alias("total_energy_kwh"))


def _runs_in(runs: DataFrame, machine: str | None, start: str | None, end: str | None) -> DataFrame:
    r = runs
    if machine is not None and machine != "All":
        r = r.filter(F.col("machine") == machine)
    if start is not None:
        r = r.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        r = r.filter(F.col("date") <= F.lit(end).cast("date"))
    return r


def program_kpis(runs: DataFrame, machine: str | None = None, start: str | None = None,
                 end: str | None = None) -> DataFrame:
    """K9: run count and mean duration (0 when none)."""
    r = _runs_in(runs, machine, start, end)
    return r.agg(F.count("*").alias("program_runs"),
                 F.coalesce(F.avg("duration_min"), F.lit(0.0)).alias("avg_duration_min"))


def runs_per_day(runs: DataFrame, machine: str | None = None, start: str | None = None,
                 end: str | None = None) -> DataFrame:
    """K9: program executions per day."""
    r = _runs_in(runs, machine, start, end)
    return r.groupBy("date").agg(F.count("program").alias("program_count"))


def duration_boxplot(runs: DataFrame, value: str = "duration_min", group: str = "machine") -> DataFrame:
    """Per group min, Q1, median, Q3, max, 1.5 IQR whiskers (most
    extreme values inside the fences) and the number of outliers.  The
    quartiles are exact (``percentile_cont``) and computed without
    buffering a group in one task."""
    q = exact_quantiles(runs, [group], value, [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    counted = runs.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    j = salted_join(counted, q, [group], value)  # one stats row per group
    lo = F.col("q1") - F.lit(1.5) * F.col("iqr")
    hi = F.col("q3") + F.lit(1.5) * F.col("iqr")
    v = F.col(value)
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.min(F.when(v >= lo, v)).alias("whisker_low"),
        F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.coalesce(F.sum(F.when((v < lo) | (v > hi), F.col("n"))), F.lit(0)).alias("outliers"))


def operating_long(operating: DataFrame) -> DataFrame:
    """(date, machine, Operating, Standby) -> (date, machine, Status, Hours)."""
    return operating.unpivot(["date", "machine"], ["Operating", "Standby"], "Status", "Hours")


def _band(value: Column, good: float, warning: float) -> Column:
    return (F.when(value >= good, F.lit("good")).when(value >= warning, F.lit("warning"))
            .otherwise(F.lit("bad")))


def oee(operating: DataFrame, performance: float | Column, quality: float | Column,
        shift_hours: float = C.SHIFT_HOURS) -> DataFrame:
    """planned = shift x machines x days, availability = run / planned,
    OEE = availability x performance x quality (performance and quality are
    inputs, fractions), downtime = planned - run, utilisation = run / planned
    (the summary panel's figure), and a status band per KPI."""
    agg = operating.agg(F.coalesce(F.sum("Operating"), F.lit(0.0)).alias("run_h"),
                        F.count_distinct("machine").alias("machines"),
                        F.count_distinct("date").alias("days"))
    perf = performance if isinstance(performance, Column) else F.lit(float(performance))
    qual = quality if isinstance(quality, Column) else F.lit(float(quality))
    planned = F.lit(shift_hours) * F.col("machines") * F.col("days")
    a = agg.select("run_h", planned.alias("planned_h"))
    avail = F.when(F.col("planned_h") > 0, F.col("run_h") / F.col("planned_h")).otherwise(F.lit(0.0))
    b = a.select("planned_h", "run_h", (F.col("planned_h") - F.col("run_h")).alias("downtime_h"),
                 (avail * 100).alias("availability_pct"), (avail * 100).alias("utilization_pct"),
                 (perf * 100).alias("performance_pct"),
                 (qual * 100).alias("quality_pct"), (avail * perf * qual * 100).alias("oee_pct"))
    bands = C.BANDS
    return b.select("*",
                    _band(F.col("oee_pct"), *bands["oee"]).alias("oee_status"),
                    _band(F.col("availability_pct"), *bands["availability"]).alias("availability_status"),
                    _band(F.col("performance_pct"), *bands["performance"]).alias("performance_status"),
                    _band(F.col("quality_pct"), *bands["quality"]).alias("quality_status"))
