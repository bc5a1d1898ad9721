"""Registered energy queries (E1-E14) and their DuckDB oracles.

Load signal: the ``loadlog`` adapter (630 = ``view`` events, 260 = ``click``
events, other variables besides).  Listed days = A6's representative days.
E7/E8 use an on-threshold of 30 % so runs actually start and stop on this
data (every reading is above the original 0 %); E9 keeps the original 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from machlog import config as C
from machlog.catalog import Tables, register
from machlog.functions.timefn import parse_period
from machlog.operators import activity as A
from machlog.operators import energy as E
from machlog.oracle import ms_ts, sec_ts
from machlog.registry.activity import REP_DAYS
from machlog.sources import adapters as ad

NAME = C.ENERGY_VAR_NAME
RUN_ON = 30.0
#: E9 and E10 take a period; this one cuts rows off at both ends of the test log.
PERIOD = ("2024-01-03", "2024-01-27")
MS0, MS1 = parse_period(*PERIOD)


def _rep(t):
    return A.representative_days(t.fl, t.sl)


def samples(name: str, where: str) -> str:
    """Readings of one load signal with their places in time order."""
    return f"""{name} AS (SELECT row_number() OVER (ORDER BY l.date, l.seq) AS place, {ms_ts('l.date')} AS ts,
    greatest(least(l.value, 100), 0) AS pct FROM loadlog l WHERE {where})"""


def spells(source: str, where: str = "TRUE") -> str:
    """Each reading holds until the next one."""
    return f"""spell AS (SELECT a.place, a.ts, b.ts AS until, a.pct, (epoch_us(b.ts) - epoch_us(a.ts)) / 3600000000.0 AS lasts
  FROM {source} a JOIN {source} b ON b.place = a.place + 1 WHERE b.ts > a.ts AND ({where}))"""


def by_day(source: str = "spell") -> str:
    """Spells against a calendar of days."""
    return f"""calendar AS (SELECT unnest(generate_series(date_trunc('day', (SELECT min(ts) FROM {source})),
    (SELECT max(until) FROM {source}), INTERVAL 1 DAY)) AS midnight),
part AS (SELECT s.*, CAST(midnight AS DATE) AS day,
    (epoch_us(least(until, midnight + INTERVAL 1 DAY)) - epoch_us(greatest(ts, midnight))) / 3600000000.0 AS hours
  FROM {source} s JOIN calendar ON ts < midnight + INTERVAL 1 DAY AND until >= midnight)"""


MAIN_LOAD = f"l.value = l.value AND l.id_var IN (SELECT id FROM vars WHERE name = '{NAME}')"

# A run is known by how many off-spells lie before it.
RUNS = f"""{samples('reading', MAIN_LOAD)}, {spells('reading')},
off AS (SELECT place FROM spell WHERE NOT pct > {RUN_ON}),
running AS (SELECT s.*, (SELECT COUNT(*) FROM off WHERE off.place < s.place) AS run FROM spell s WHERE pct > {RUN_ON})"""


def day_energy(within: str = "TRUE") -> str:
    """E9's kWh per day; ``within`` bounds the readings."""
    return f"""{samples('reading', f"l.id_var = 260 AND l.value = l.value AND {within}")}, {spells('reading', 'a.pct > 0')}, {by_day()},
e9 AS (SELECT day, SUM(pct / 100.0 * 15.0 * hours) AS total_energy_kwh FROM part GROUP BY day)"""


E9_SQL = day_energy()
IN_PERIOD = f"l.date BETWEEN {MS0} AND {MS1}"


# ------------------------------------------------------------------ E1 - E4

@register("E1_energy_variables", """
SELECT id, name, datatype FROM vars WHERE lower(name) LIKE '%energy%' OR lower(name) LIKE '%power%'
  OR lower(name) LIKE '%consum%' OR lower(name) LIKE '%electric%' OR lower(name) LIKE '%kw%'
  OR lower(name) LIKE '%kwh%' OR lower(name) LIKE '%watt%'""")
def e1(spark, sf):
    return E.energy_variables(Tables(spark, sf).vars)


@register("E2_unit_rows", """
SELECT * FROM units WHERE name ILIKE '%MANDRINO%' OR name ILIKE '%POWER%' OR name ILIKE '%ENERGY%'
  OR name ILIKE '%CONSUM%'""")
def e2(spark, sf):
    return E.unit_rows(Tables(spark, sf).units)


@register("E3_resolve_units", """
WITH v AS MATERIALIZED (SELECT name, lower(name) AS k FROM vars),
named AS MATERIALIZED (SELECT lower(name) AS k, units, prettyname FROM units),
shown AS MATERIALIZED (SELECT lower(prettyname) AS k, units, prettyname FROM units)
SELECT v.name AS variable_name, coalesce(named.units, shown.units) AS unit, coalesce(named.prettyname, shown.prettyname) AS unit_label
FROM v LEFT JOIN named ON named.k = v.k LEFT JOIN shown ON shown.k = v.k""")
def e3(spark, sf):
    t = Tables(spark, sf)
    return E.resolve_units(t.vars, t.units)


@register("E4_daily_load_stats", f"""
WITH {REP_DAYS}
SELECT v.name AS variable_name, CAST({ms_ts('l.date')} AS DATE) AS day, COUNT(*) AS measure_count,
  round(SUM(l.value), 6) AS total_consumption, round(AVG(l.value), 6) AS average_consumption
FROM loadlog l JOIN vars v ON v.id = l.id_var
WHERE v.name = '{NAME}' AND l.value = l.value AND CAST({ms_ts('l.date')} AS DATE) IN (SELECT day FROM rep)
GROUP BY 1, 2""")
def e4(spark, sf):
    t = Tables(spark, sf)
    return E.daily_load_stats(t.load, t.vars, _rep(t))


# ------------------------------------------------------------------ E5 - E12

@register("E5_energy_unsplit", f"""
WITH {REP_DAYS}, {samples('reading', MAIN_LOAD + f" AND CAST({ms_ts('l.date')} AS DATE) IN (SELECT day FROM rep)")}
SELECT CAST(a.ts AS DATE) AS day,
  round(SUM(a.pct / 100.0 * 15.0 * coalesce(epoch_us(b.ts) - epoch_us(a.ts), 0) / 3600000000.0), 6) AS energy_kwh
FROM reading a LEFT JOIN reading b ON b.place = a.place + 1 GROUP BY 1""")
def e5(spark, sf):
    t = Tables(spark, sf)
    return E.energy_unsplit(t.load, t.vars, _rep(t))


@register("E6_energy_per_day", f"""
WITH {samples('reading', MAIN_LOAD)}, {spells('reading')}, {by_day()}
SELECT day, round(SUM(hours), 6) AS total_duration_h, round(SUM(pct / 100.0 * 15.0 * hours), 6) AS total_energy_kwh
FROM part GROUP BY day""")
def e6(spark, sf):
    t = Tables(spark, sf)
    return E.energy_per_day(t.load, t.vars)


@register("E7_load_runs", f"""
WITH {REP_DAYS}, {RUNS}
SELECT MIN(ts) AS run_start, MAX(until) AS run_end, round(SUM(lasts), 6) AS total_duration_h,
  round(SUM(pct / 100.0 * 15.0 * lasts), 6) AS total_energy_kwh, COUNT(*) AS samples_in_run
FROM running WHERE CAST(ts AS DATE) IN (SELECT day FROM rep) GROUP BY run""")
def e7(spark, sf):
    t = Tables(spark, sf)
    return E.load_runs(t.load, t.vars, _rep(t), on_threshold=RUN_ON)


@register("E8_energy_runs_per_day", f"""
WITH {REP_DAYS}, {RUNS}, {by_day('running')}
SELECT day, round(SUM(hours), 6) AS total_duration_h, round(SUM(pct / 100.0 * 15.0 * hours), 6) AS total_energy_kwh,
  COUNT(DISTINCT run) AS run_count
FROM part WHERE day IN (SELECT day FROM rep) GROUP BY day""")
def e8(spark, sf):
    t = Tables(spark, sf)
    return E.energy_runs_per_day(t.load, t.vars, _rep(t), on_threshold=RUN_ON)


@register("E9_daily_energy", f"""
WITH {day_energy(IN_PERIOD)} SELECT day, round(total_energy_kwh, 6) AS total_energy_kwh FROM e9""")
def e9(spark, sf):
    return E.daily_energy(Tables(spark, sf).load, *PERIOD)


@register("E10_daily_energy_gap_cap", f"""
WITH {samples('reading', f"l.id_var = 630 AND {IN_PERIOD}")}, {spells('reading', "epoch_us(b.ts) - epoch_us(a.ts) < 3600000000")}, {by_day()}
SELECT day AS date, round(SUM(pct / 100.0 * 15.0 * hours), 6) AS total_energy_kwh FROM part GROUP BY day""")
def e10(spark, sf):
    return E.daily_energy_gap_cap(Tables(spark, sf).load, *PERIOD)


@register("E11_energy_log_daily", """
SELECT CAST(energy_timestamp AS DATE) AS date, round(SUM(kwh_value), 6) AS total_energy_kwh FROM elog GROUP BY 1""")
def e11(spark, sf):
    return E.energy_log_daily(Tables(spark, sf).elog)


@register("E12_load_buckets", f"""
WITH {REP_DAYS},
b AS (SELECT {sec_ts('date // 1000')} AS ts, value FROM loadlog WHERE id_var = 630 AND value > 0)
SELECT date_trunc('hour', ts) + to_minutes(CAST(floor(minute(ts) / 10) * 10 AS BIGINT)) AS bucket_10min,
  COUNT(*) AS n_samples, round(AVG(value), 6) AS avg_load, round(MAX(value), 6) AS peak_load
FROM b WHERE CAST(ts AS DATE) IN (SELECT day FROM rep) GROUP BY 1""")
def e12(spark, sf):
    t = Tables(spark, sf)
    return E.load_buckets(t.load, _rep(t))


# ------------------------------------------------------------------ E13 - E14

@register("E13_energy_kpis", f"""
WITH {E9_SQL}
SELECT round(SUM(total_energy_kwh), 6) AS total_kwh, round(AVG(total_energy_kwh), 6) AS daily_mean_kwh,
  arg_min(day, (-total_energy_kwh, day)) AS record_day, round(max(total_energy_kwh), 6) AS record_kwh,
  round(SUM(total_energy_kwh) * 0.15, 6) AS cost
FROM e9""")
def e13(spark, sf):
    return E.energy_kpis(E.daily_energy(Tables(spark, sf).load))


@register("E14_energy_per_operating_hour", f"""
WITH {E9_SQL},
tot AS (SELECT coalesce(SUM(total_energy_kwh), 0.0) AS t FROM e9),
hrs AS (SELECT coalesce(SUM("Operating"), 0.0) AS h FROM operating),
n AS (SELECT COUNT(*) AS n FROM prog_runs)
SELECT round(t, 6) AS total_energy_kwh, round(h, 6) AS operating_hours, n AS program_runs,
  round(CASE WHEN h > 0 THEN t / h ELSE 0.0 END, 6) AS energy_per_operating_h,
  round(CASE WHEN n > 0 THEN t / n ELSE 0.0 END, 6) AS energy_per_program
FROM tot, hrs, n""")
def e14(spark, sf):
    t = Tables(spark, sf)
    runs = t.prog_runs
    return E.energy_per_operating_hour(E.daily_energy(t.load), ad.operating_time(runs), runs)


@register("E14_energy_by_program", f"""
WITH {E9_SQL},
tot AS (SELECT coalesce(SUM(total_energy_kwh), 0.0) AS t FROM e9),
c AS (SELECT program, COUNT(*) AS count FROM prog_runs GROUP BY program)
SELECT program, count, round(CAST(count AS DOUBLE) / (SELECT SUM(count) FROM c) * t, 6) AS energy_kwh FROM c, tot""")
def e14b(spark, sf):
    t = Tables(spark, sf)
    return E.energy_by_program(E.daily_energy(t.load), t.prog_runs)
