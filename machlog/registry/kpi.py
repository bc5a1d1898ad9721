"""Registered KPI queries (K1-K12) and their DuckDB oracles.

State table: A24's four-state totals (K1-K5); per-day four states (K6);
three-state segments of A20 (K7); E7 runs (K8); program runs (K9-K12).
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from machlog import config as C
from machlog import services
from machlog.catalog import BUCKET_S, LOW, MID, T1, T2, Tables, register
from machlog.operators import activity as A
from machlog.operators import alarms as B
from machlog.operators import energy as E
from machlog.operators import kpi as K
from machlog.oracle import bucket_ts
from machlog.registry.activity import FOUR_STATE_SQL, LEVEL_ROWS, ROLLUP, SMOOTH, spans
from machlog.registry.alarms import RAW
from machlog.registry.energy import E9_SQL, IN_PERIOD, MS0, MS1, PERIOD, REP_DAYS, RUN_ON, RUNS, day_energy
from machlog.sources import adapters as ad

PERF, QUAL = 0.9, 0.95


def _states(t):
    return A.four_state_totals(t.fl, bucket_s=BUCKET_S, low=LOW, mid=MID)


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _segs(t):
    s = A.three_state_segments(t.fl, T1, T2, BUCKET_S)
    return s.select(F.col("period_start").alias("date"), "state",
                    (F.col("duration_s") / 3600.0).alias("total_hours"))


K1_SQL = f"""SELECT round(coalesce(SUM(total_hours), 0), 6) AS total_hours,
  round(coalesce(SUM(CASE WHEN upper(state) IN ({_in(C.K1_TAGS_FULL)}) THEN total_hours END), 0), 6) AS active_hours,
  round(CASE WHEN coalesce(SUM(total_hours), 0) > 0 THEN coalesce(SUM(total_hours), 0)
    - coalesce(SUM(CASE WHEN upper(state) IN ({_in(C.K1_TAGS_FULL)}) THEN total_hours END), 0) ELSE 0 END, 6) AS idle_hours,
  round(CASE WHEN coalesce(SUM(total_hours), 0) > 0 THEN coalesce(SUM(CASE WHEN upper(state) IN ({_in(C.K1_TAGS_FULL)})
    THEN total_hours END), 0) / SUM(total_hours) * 100.0 ELSE 0 END, 6) AS availability_pct
FROM states"""

def k2_cte(energy: str) -> str:
    return f"""{FOUR_STATE_SQL}, {energy}, {RAW},
core AS (SELECT * FROM states WHERE state IN ({_in(C.K2_CORE_STATES)})),
k2 AS (SELECT coalesce(SUM(total_hours), 0) AS total_h,
  coalesce(SUM(CASE WHEN upper(state) IN ({_in([s.upper() for s in C.K2_CORE_STATES[:3]])}) THEN total_hours END), 0) AS active_h,
  (SELECT coalesce(SUM(total_energy_kwh), 0) FROM e9) AS energy,
  (SELECT CAST(coalesce(SUM(occurrence_count), 0) AS BIGINT) FROM stats) AS alarms FROM core)"""


K2_CTE = k2_cte(E9_SQL)
K2_ROW = """SELECT round(total_h, 6) AS total_h, round(active_h, 6) AS active_h, round(total_h - active_h, 6) AS idle_h,
  round(energy, 6) AS energy, alarms, round(CASE WHEN total_h > 0 THEN active_h / total_h * 100.0 ELSE 0 END, 6) AS avail
FROM k2"""
# Both logs are cut to the period before anything else reads them.
K2_IN_PERIOD = (f"fl_in AS (SELECT * FROM fl WHERE date BETWEEN {MS0} AND {MS1}), sl_in AS (SELECT * FROM sl WHERE date BETWEEN {MS0} AND {MS1}),\n"
                + re.sub(r"\bFROM (fl|sl)\b", r"FROM \1_in", k2_cte(day_energy(IN_PERIOD))))


@register("K1_state_kpis", f"WITH {FOUR_STATE_SQL} {K1_SQL}")
def k1(spark, sf):
    return K.state_kpis(_states(Tables(spark, sf)))


@register("K2_core_state_kpis", f"""
WITH {K2_CTE}
{K2_ROW}""")
def k2(spark, sf):
    t = Tables(spark, sf)
    return K.core_state_kpis(_states(t), E.daily_energy(t.load),
                             B.alarm_statistics(B.alarm_incidents(t.sl)))


@register("K2_services_one_period", f"""
WITH {K2_IN_PERIOD}
{K2_ROW}""")
def k2_services(spark, sf):
    """The three services over one common period, combined."""
    t = Tables(spark, sf)
    return services.dashboard_kpis(t.fl, t.sl, *PERIOD, bucket_s=BUCKET_S, low=LOW, mid=MID, load=t.load)


@register("K3_idle_by_substring", f"""
WITH {FOUR_STATE_SQL}
SELECT round(coalesce(SUM(total_hours), 0), 6) AS total_hours,
  round(coalesce(SUM(CASE WHEN state ILIKE '%idle%' THEN total_hours END), 0), 6) AS idle_hours,
  round(coalesce(SUM(total_hours), 0) - coalesce(SUM(CASE WHEN state ILIKE '%idle%' THEN total_hours END), 0), 6) AS active_hours,
  round(CASE WHEN coalesce(SUM(total_hours), 0) > 0 THEN (coalesce(SUM(total_hours), 0)
    - coalesce(SUM(CASE WHEN state ILIKE '%idle%' THEN total_hours END), 0)) / SUM(total_hours) * 100.0 ELSE 0 END, 6)
    AS utilization_pct,
  COUNT(*) AS distinct_states
FROM states""")
def k3(spark, sf):
    return K.idle_by_substring(_states(Tables(spark, sf)))


@register("K4_economic_impact", f"""
WITH {K2_CTE}
SELECT round((total_h - active_h) * {C.HOURLY_RATE}, 6) AS opportunity_cost,
  round(active_h * {C.HOURLY_RATE}, 6) AS active_value FROM k2""")
def k4(spark, sf):
    t = Tables(spark, sf)
    kp = K.core_state_kpis(_states(t), E.daily_energy(t.load),
                           B.alarm_statistics(B.alarm_incidents(t.sl)))
    return K.economic_impact(kp)


_rank_case = " ".join(f"WHEN state = '{s}' THEN {i}" for i, s in enumerate(C.K5_ORDER))


@register("K5_state_share", f"""
WITH {FOUR_STATE_SQL},
g AS (SELECT state, SUM(total_hours) AS total_hours FROM states
  WHERE upper(state) NOT IN ({_in(C.K5_EXCLUDED)}) GROUP BY state)
SELECT state, round(total_hours, 6) AS total_hours, CASE {_rank_case} ELSE 99 END AS rank,
  round(CASE WHEN (SELECT SUM(total_hours) FROM g) > 0 THEN total_hours / (SELECT SUM(total_hours) FROM g)
    ELSE 0 END, 6) AS percent
FROM g""")
def k5(spark, sf):
    return K.state_share(_states(Tables(spark, sf)))


@register("K5_high_activity_ratio", f"""
WITH {FOUR_STATE_SQL},
core AS (SELECT * FROM states WHERE state IN ({_in(C.K2_CORE_STATES)}))
SELECT round(coalesce(SUM(CASE WHEN state = 'High Activity' THEN total_hours END), 0), 6) AS high_hours,
  round(coalesce(SUM(total_hours), 0), 6) AS total_time,
  round(CASE WHEN coalesce(SUM(total_hours), 0) > 0
    THEN coalesce(SUM(CASE WHEN state = 'High Activity' THEN total_hours END), 0) / SUM(total_hours) * 100.0
    ELSE 0 END, 6) AS ratio_pct
FROM core""")
def k5b(spark, sf):
    return K.high_activity_ratio(_states(Tables(spark, sf)))


DAILY_STATES = f"""rollup AS ({ROLLUP}), seen AS (SELECT ts, row_number() OVER (ORDER BY ts) AS place FROM rollup), sm AS ({SMOOTH}),
dstates AS (
  SELECT CAST(b.ts AS DATE) AS date, 'True Idle (Off)' AS state, SUM(epoch(b.ts) - epoch(a.ts) - {BUCKET_S}) / 3600.0 AS total_hours
  FROM seen a JOIN seen b ON b.place = a.place + 1 WHERE epoch(b.ts) - epoch(a.ts) > {BUCKET_S} GROUP BY 1
  UNION ALL
  SELECT day, list_extract(['Low Activity', 'Intermediate Activity', 'High Activity'], 1 + (mean > {LOW})::INT + (mean > {MID})::INT),
    COUNT(*) * {BUCKET_S} / 3600.0 FROM sm WHERE place >= 15 GROUP BY 1, 2)"""

_piv_cols = ", ".join(
    f"round(coalesce(SUM(CASE WHEN state = '{s}' THEN total_hours END), 0), 6) AS "
    f"{s.lower().replace(' ', '_').replace('(', '').replace(')', '')}" for s in C.K2_CORE_STATES)


@register("K6_day_state_pivot", f"""
WITH {DAILY_STATES}
SELECT date AS jour, {_piv_cols} FROM dstates WHERE upper(state) NOT IN ({_in(C.K5_EXCLUDED)}) GROUP BY date""")
def k6(spark, sf):
    t = Tables(spark, sf)
    return K.day_state_pivot(A.daily_four_states(t.fl, BUCKET_S, LOW, MID))


SEGS3 = spans("level_span", LEVEL_ROWS.format(where=""),
              f"(SELECT max(ts) + INTERVAL {BUCKET_S} SECOND FROM level_span_row)") + """,
zoom AS (SELECT period_start AS date, state, (epoch(period_end) - epoch(period_start)) / 3600.0 AS total_hours FROM level_span
  WHERE CAST(period_start AS DATE) = (SELECT max(CAST(period_start AS DATE)) FROM level_span))"""


@register("K7_day_zoom", f"""
WITH {SEGS3}
SELECT date, state, round(total_hours, 6) AS total_hours,
  make_timestamp(epoch_us(date) + CAST(round(greatest(total_hours, 0.02) * 3600000000.0) AS BIGINT)) AS end_time
FROM zoom""")
def k7(spark, sf):
    return K.day_zoom(_segs(Tables(spark, sf)))


@register("K7_day_zoom_summary", f"""
WITH {SEGS3} SELECT state, round(SUM(total_hours), 6) AS total_hours FROM zoom GROUP BY state""")
def k7b(spark, sf):
    return K.day_zoom_summary(_segs(Tables(spark, sf)))


@register("K8_energy_by_date", f"""
WITH {REP_DAYS}, {RUNS},
r7 AS (SELECT MIN(ts) AS run_start, SUM(pct / 100.0 * 15.0 * lasts) AS total_energy_kwh
  FROM running WHERE CAST(ts AS DATE) IN (SELECT day FROM rep) GROUP BY run)
SELECT CAST(run_start AS DATE) AS jour, round(SUM(total_energy_kwh), 6) AS total_energy_kwh FROM r7 GROUP BY 1""")
def k8(spark, sf):
    t = Tables(spark, sf)
    runs = E.load_runs(t.load, t.vars, A.representative_days(t.fl, t.sl), on_threshold=RUN_ON)
    return K.energy_by_date(runs, "run_start")


@register("K9_program_kpis", """
SELECT COUNT(*) AS program_runs, round(coalesce(AVG(duration_min), 0), 6) AS avg_duration_min FROM prog_runs""")
def k9(spark, sf):
    return K.program_kpis(Tables(spark, sf).prog_runs)


@register("K9_runs_per_day", """
SELECT date, COUNT(program) AS program_count FROM prog_runs GROUP BY date""")
def k9b(spark, sf):
    return K.runs_per_day(Tables(spark, sf).prog_runs)


@register("K10_duration_boxplot", """
WITH q AS (SELECT machine, quantile_cont(duration_min, 0.25) AS q1, quantile_cont(duration_min, 0.5) AS median,
  quantile_cont(duration_min, 0.75) AS q3 FROM prog_runs GROUP BY machine),
j AS (SELECT p.machine, p.duration_min AS v, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr
  FROM prog_runs p JOIN q USING (machine))
SELECT machine, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(MIN(v), 6) AS min, round(MAX(v), 6) AS max,
  round(MIN(CASE WHEN v >= q1 - 1.5 * iqr THEN v END), 6) AS whisker_low,
  round(MAX(CASE WHEN v <= q3 + 1.5 * iqr THEN v END), 6) AS whisker_high,
  COUNT(CASE WHEN v < q1 - 1.5 * iqr OR v > q3 + 1.5 * iqr THEN 1 END) AS outliers
FROM j GROUP BY machine, q1, median, q3""")
def k10(spark, sf):
    return K.duration_boxplot(Tables(spark, sf).prog_runs)


@register("K11_operating_long", """
SELECT date, machine, 'Operating' AS "Status", round("Operating", 6) AS "Hours" FROM operating
UNION ALL SELECT date, machine, 'Standby', round("Standby", 6) FROM operating""")
def k11(spark, sf):
    return K.operating_long(ad.operating_time(Tables(spark, sf).prog_runs))


def _band_sql(col: str, good: float, warn: float) -> str:
    return f"CASE WHEN {col} >= {good} THEN 'good' WHEN {col} >= {warn} THEN 'warning' ELSE 'bad' END"


@register("K12_oee", f"""
WITH a AS (SELECT coalesce(SUM("Operating"), 0) AS run_h,
  {C.SHIFT_HOURS} * COUNT(DISTINCT machine) * COUNT(DISTINCT date) AS planned_h FROM operating),
b AS (SELECT planned_h, run_h, planned_h - run_h AS downtime_h,
  CASE WHEN planned_h > 0 THEN run_h / planned_h ELSE 0 END * 100 AS availability_pct,
  {PERF} * 100 AS performance_pct, {QUAL} * 100 AS quality_pct,
  CASE WHEN planned_h > 0 THEN run_h / planned_h ELSE 0 END * {PERF} * {QUAL} * 100 AS oee_pct FROM a)
SELECT round(planned_h, 6) AS planned_h, round(run_h, 6) AS run_h, round(downtime_h, 6) AS downtime_h,
  round(availability_pct, 6) AS availability_pct, round(availability_pct, 6) AS utilization_pct,
  round(performance_pct, 6) AS performance_pct,
  round(quality_pct, 6) AS quality_pct, round(oee_pct, 6) AS oee_pct,
  {_band_sql('oee_pct', *C.BANDS['oee'])} AS oee_status,
  {_band_sql('availability_pct', *C.BANDS['availability'])} AS availability_status,
  {_band_sql('performance_pct', *C.BANDS['performance'])} AS performance_status,
  {_band_sql('quality_pct', *C.BANDS['quality'])} AS quality_status
FROM b""")
def k12(spark, sf):
    return K.oee(ad.operating_time(Tables(spark, sf).prog_runs), PERF, QUAL)
