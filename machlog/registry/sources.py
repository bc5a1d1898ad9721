"""Registered source / sink queries (I1-I9) and their DuckDB oracles.

Round trips (I1, I2, I9) write data derived from the driver tables into the
shared checkpoint folder and read it back through the library's readers, so
the reader's output is compared with the rows that went in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from machlog.catalog import BUCKET_S, LOW, MID, T1, T2, Tables, register
from machlog.functions.timefn import period_filter, with_day, with_ms, with_second
from machlog.operators import activity as A
from machlog.operators import alarms as B
from machlog.oracle import bucket_ts, ms_ts, sec_ts
from machlog.registry.activity import FOUR_STATE_SQL, LEVEL_ROWS, numbered
from machlog.registry.alarms import CATALOGUE, SPOKEN
from machlog.sources import logs as L

#: I3's period; it cuts rows off at both ends of the test log.
PERIOD = ("2024-01-03", "2024-01-27")
#: The period that I6 and I7 print: their states come from the whole log.
WHOLE = ("", "")
SECS = sec_ts("date // 1000")
#: Rows of a chunk of the logs stored by variable; small, so that the test logs have several per variable.
STORED_ROWS = 2_000


@register("I1_load_logs", f"""
SELECT date, id_var, value, CAST({SECS} AS DATE) AS day FROM fl""")
def i1(spark, sf):
    t = Tables(spark, sf)
    path = L.scratch_path(spark, "variable_log_float")
    L.write_log(t.fl.select("date", "id_var", "value"), path)
    return L.read_log(spark, path)


@register("I1_load_all_tables", f"""
SELECT 'fl' AS log, id_var AS id, COUNT(*) AS n, CAST(MIN({SECS}) AS DATE) AS first_day, CAST(MAX({SECS}) AS DATE) AS last_day FROM fl GROUP BY id_var
UNION ALL SELECT 'sl', id_var, COUNT(*), CAST(MIN({SECS}) AS DATE), CAST(MAX({SECS}) AS DATE) FROM sl GROUP BY id_var
UNION ALL SELECT 'vars', id, COUNT(*), NULL, NULL FROM vars GROUP BY id
UNION ALL SELECT 'units', NULL, COUNT(*), NULL, NULL FROM units""")
def i1_all(spark, sf):
    """All four tables stored and loaded again; logs summed up per variable."""
    t = Tables(spark, sf)
    path = L.scratch_path(spark, "machine")
    L.write_log(t.fl.select("date", "id_var", "value"), f"{path}/variable_log_float")
    L.write_log(t.sl.select("date", "id_var", "value"), f"{path}/variable_log_string")
    t.vars.write.mode("overwrite").parquet(f"{path}/variable")
    t.units.write.mode("overwrite").parquet(f"{path}/units")
    got = L.load_logs(spark, path)
    day = F.lit(None).cast("date")
    logs = [got[k].groupBy(F.col("id_var").alias("id")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
            .select(F.lit(k).alias("log"), "id", "n", "first_day", "last_day") for k in ("fl", "sl")]
    names = got["vars"].groupBy("id").agg(F.count("*").alias("n")).select(F.lit("vars").alias("log"), "id", "n", day.alias("first_day"), day.alias("last_day"))
    units = got["units"].agg(F.count("*").alias("n")).select(F.lit("units").alias("log"), F.lit(None).cast("int").alias("id"), "n",
                                                             day.alias("first_day"), day.alias("last_day"))
    return logs[0].unionByName(logs[1]).unionByName(names).unionByName(units)


@register("I1_variable_buckets", f"""
WITH timed AS (SELECT id_var, date, date - lag(date) OVER (PARTITION BY id_var ORDER BY date) AS gap FROM fl WHERE date IS NOT NULL AND id_var IS NOT NULL)
SELECT id_var, COUNT(*) AS readings, {sec_ts('MIN(date) // 1000')} AS first_ts, {sec_ts('MAX(date) // 1000')} AS last_ts,
  MAX(gap) AS longest_gap_ms, COUNT(*) FILTER (WHERE gap > 60000) AS pauses
FROM timed GROUP BY id_var""")
def i1_by_variable(spark, sf):
    """The float log stored by variable, opened again, and its gaps read without an exchange of the rows."""
    path = L.scratch_path(spark, "variable_log_by_variable")
    L.write_variable_log(Tables(spark, sf).fl, path, rows=STORED_ROWS)
    return L.reading_gaps(L.open_variable_log(spark, path))


@register("B3_time_since_previous_stored", f"""
WITH {SPOKEN}
SELECT id_var, moment AS log_time, message AS value, since AS previous_log_time, CAST(lasted AS DOUBLE) AS seconds_since_last_log
FROM silence WHERE id_var = 447""")
def b3_stored(spark, sf):
    """B3 over the string log stored by variable: the same rows without an exchange of the log."""
    path = L.scratch_path(spark, "string_log_by_variable")
    L.write_variable_log(Tables(spark, sf).sl, path, rows=STORED_ROWS)
    return B.time_since_previous(L.open_variable_log(spark, path))


@register("I2_malformed_lines", """
SELECT CASE seq % 50 WHEN 1 THEN 'no quoted row' WHEN 2 THEN 'wrong number of fields' WHEN 3 THEN 'no time' WHEN 4 THEN 'no variable' ELSE 'row' END AS problem,
  COUNT(*) AS n FROM sl GROUP BY 1""")
def i2_bad(spark, sf):
    """The string log exported with every 50th line broken in each of four ways: all lines are accounted for."""
    sl = Tables(spark, sf).sl
    whole, path = L.scratch_path(spark, "export-whole"), L.scratch_path(spark, "export-broken")
    k = F.col("seq") % 50
    L.write_string_export(sl.filter(~k.isin(1, 2, 3, 4)), whole)
    broken = (F.when(k == 1, F.concat(F.lit("not quoted "), "seq")).when(k == 2, F.lit('"2021-03-18 03:27:10";;;'))
              .when(k == 3, F.lit('"no time,""447"",""v""";;;')).otherwise(F.lit('"2021-03-18 03:27:10,""x"",""v""";;;')))
    sl.filter(k.isin(1, 2, 3, 4)).select(broken.alias("line")).write.option("lineSep", "\r\n").text(path)
    rows, bad = L.split_string_export(spark, [whole, path])
    return (rows.select(F.lit("row").alias("problem")).unionByName(bad.select("problem"))
            .groupBy("problem").agg(F.count("*").alias("n")))


@register("I2_string_export_roundtrip", f"""
SELECT {SECS} AS ts, id_var, coalesce(value, '') AS value FROM sl""")
def i2(spark, sf):
    t = Tables(spark, sf)
    path = L.scratch_path(spark, "string-export")
    L.write_string_export(t.sl, path)
    return L.read_string_export(spark, path)


@register("I3_period_filter", f"""
SELECT date, id_var, value, seq FROM fl
WHERE date >= epoch(TIMESTAMP '{PERIOD[0]} 00:00:00') * 1000 AND date <= epoch(TIMESTAMP '{PERIOD[1]} 23:59:59') * 1000""")
def i3(spark, sf):
    return period_filter(Tables(spark, sf).fl, *PERIOD)


@register("I4_epoch_normalisation", f"""
SELECT date, {SECS} AS ts_s, {ms_ts('date')} AS ts_ms, CAST({SECS} AS DATE) AS day FROM fl""")
def i4(spark, sf):
    d = with_ms(with_second(Tables(spark, sf).fl.select("date"), name="ts_s"), name="ts_ms")
    return with_day(d, "ts_s")


@register("I5_extract_day", f"""
SELECT strftime({SECS}, '%Y-%m-%d %H:%M:%S') AS timestamp, id_var, value FROM sl""")
def i5(spark, sf):
    return L.extract_day(Tables(spark, sf).sl)


@register("I6_json_envelope", f"""
WITH {FOUR_STATE_SQL}
SELECT 'success' AS status, '{WHOLE[0]}' AS period_from, '{WHOLE[1]}' AS period_until, COUNT(*) AS count, NULL AS state,
  CAST(NULL AS DOUBLE) AS total_hours FROM states
UNION ALL SELECT NULL, NULL, NULL, NULL, state, round(total_hours, 4) FROM states""")
def i6(spark, sf):
    # Written as JSON lines and read back into typed fields.
    states = A.four_state_totals(Tables(spark, sf).fl, bucket_s=BUCKET_S, low=LOW, mid=MID)
    shape = ("status string, period struct<from: string, until: string>, count bigint, state string, total_hours double")
    line = F.from_json("json", shape)
    return L.to_json_lines(states, *WHOLE).select(line.alias("j")).select(
        "j.status", F.col("j.period.from").alias("period_from"), F.col("j.period.until").alias("period_until"), "j.count",
        "j.state", "j.total_hours")


@register("I7_totals_envelope", f"""
WITH {numbered("level", LEVEL_ROWS.format(where=""))},
tot AS (SELECT label AS state, SUM(epoch(coalesce(next_ts, (SELECT max(ts) + INTERVAL {BUCKET_S} SECOND FROM level_at))) - epoch(ts)) / 3600.0 AS h
  FROM level GROUP BY label)
SELECT 'success' AS status, '{WHOLE[0]}' AS period_from, '{WHOLE[1]}' AS period_until,
  round(coalesce((SELECT h FROM tot WHERE state = 'Active'), 0), 2) AS active,
  round(coalesce((SELECT h FROM tot WHERE state = 'Intermediate'), 0), 2) AS intermediate,
  round(coalesce((SELECT h FROM tot WHERE state = 'Idle'), 0), 2) AS idle""")
def i7(spark, sf):
    states = A.three_state_totals(Tables(spark, sf).fl, t1=T1, t2=T2, bucket_s=BUCKET_S)
    return L.totals_envelope(states, *WHOLE)


@register("I8_standardise_columns", f"""
WITH rollup AS (SELECT {bucket_ts('date', BUCKET_S)} AS ts, COUNT(DISTINCT id_var) AS distinct_vars_count FROM fl GROUP BY 1)
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date, distinct_vars_count AS state, ts AS start FROM rollup""")
def i8(spark, sf):
    # An export with other column names: ' Jour ', 'ETAT', 'Start' (jour -> date, etat -> state).
    r = A.distinct_vars_per_second(Tables(spark, sf).fl, BUCKET_S)
    raw = r.select(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias(" Jour "),
                   F.col("distinct_vars_count").alias("ETAT"), F.col("ts").alias("Start"))
    return L.standardise_columns(raw)


@register("I9_catalogue_csv", f"WITH {CATALOGUE} SELECT alarm_code, description FROM cat")
def i9(spark, sf):
    path = L.scratch_path(spark, "catalogue-csv")
    L.write_catalogue_csv(B.alarm_catalogue(Tables(spark, sf).sl), path)
    return L.read_catalogue_csv(spark, path)
