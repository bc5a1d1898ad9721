"""Registered stop / alarm / alert queries (B1-B28) and their DuckDB oracles.

Day lists: the stop and dictionary reports (B5-B8) run on the representative
days of A6 (one per decile); the alert reports (B25-B28) on the top days of
B20, scored by A4's day relevance.  Both lists are derived from the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from machlog import config as C
from machlog.catalog import Tables, register
from machlog.operators import activity as A
from machlog.operators import alarms as B
from machlog.oracle import ms_ts, sec_ts
from machlog.registry.activity import REP_DAYS

SECS = sec_ts("date // 1000")
NOISE = "(" + "|".join(C.NOISE_CODES) + ")"


def _rep_days(t):
    return A.representative_days(t.fl, t.sl)


def _top_days(t, n: int = C.TOP_N_DAYS):
    scores = A.day_relevance(t.fl, t.sl).select("day", F.col("total_count").alias("interesting_score"))
    return B.interesting_days(scores, n)


def _contains_any(text: str, words) -> str:
    return " OR ".join(f"contains({text}, '{w}')" for w in words)


def severity_sql(code: str, desc: str, crit, warn, crit_label: str) -> str:
    text = f"upper(concat_ws(' ', {code}, {desc}))"
    return (f"CASE WHEN {_contains_any(text, crit)} THEN '{crit_label}' "
            f"WHEN {_contains_any(text, warn)} THEN 'WARNING' ELSE 'INFO' END")


def classify_sql(msg: str, classes) -> str:
    whens = " ".join(f"WHEN regexp_matches({msg}, '{p}', 'i') THEN '{lbl}'" for p, lbl in classes)
    return f"CASE {whens} ELSE 'OTHER' END"


def token_sql(texts, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{p}', 1), '')"
                                   for t in texts for p in patterns) + ")"


# A message's silence lasts from the message at the place before it, of the same variable.
SPOKEN = f"""spoken AS (SELECT id_var, value AS message, {SECS} AS moment, date // 1000 AS second,
  row_number() OVER (PARTITION BY id_var ORDER BY date, seq) AS place
  FROM sl WHERE value <> '[]' AND (id_var = 447 OR id_var = 557)),
silence AS (SELECT late.id_var, late.message, late.moment, early.moment AS since, late.second - early.second AS lasted,
  (200 * (late.second - early.second) + 60) // 120 AS cents
  FROM spoken late LEFT JOIN spoken early ON early.id_var = late.id_var AND early.place + 1 = late.place)"""

STOPS = f"""{REP_DAYS}, {SPOKEN},
stop AS (SELECT CAST(moment AS DATE) AS day, id_var, moment, message, cents FROM silence
  WHERE lasted > 300 AND CAST(moment AS DATE) IN (SELECT day FROM rep))"""


def usual_message(keys: str) -> str:
    """told: stops, their length and the most frequent message per ``keys``; of equally frequent ones the least."""
    return f"""same AS (SELECT {keys}, message, COUNT(*) AS n, SUM(cents) AS cents FROM stop GROUP BY {keys}, message),
told AS (SELECT {keys}, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(cents) AS BIGINT) AS cents,
  arg_min(message, (-n, message)) AS usual FROM same GROUP BY {keys})"""


B10P = C.B10_PATTERN
# An alarm shown by a log holds until the next log; an incident is a showing that no
# earlier showing of the same alarm touches.
RAW = f"""logged AS (SELECT {SECS} AS moment, value, row_number() OVER (ORDER BY date, seq) AS place FROM sl
  WHERE id_var = 447 AND NOT regexp_matches(value, '{NOISE}')),
found AS (SELECT a.place, a.moment, b.moment AS until, unnest(list_zip(regexp_extract_all(a.value, '{B10P}', 1),
  regexp_extract_all(a.value, '{B10P}', 2))) AS pair FROM logged a JOIN logged b ON b.place = a.place + 1),
shown AS (SELECT DISTINCT place, moment, until, pair[1] AS alarm_code, pair[2] AS alarm_text FROM found),
periods AS (SELECT alarm_code, alarm_text, moment AS start_time FROM shown s WHERE NOT EXISTS (SELECT 1 FROM shown e
  WHERE e.alarm_code = s.alarm_code AND e.alarm_text = s.alarm_text AND e.place < s.place AND e.until >= s.moment)),
stats AS (SELECT alarm_code, alarm_text, COUNT(*) AS occurrence_count, MAX(start_time) AS last_seen
  FROM periods GROUP BY alarm_code, alarm_text)"""

TOP_DAYS = f"""f AS (SELECT CAST({SECS} AS DATE) AS day, COUNT(*) AS float_count FROM fl GROUP BY 1),
s AS (SELECT CAST({SECS} AS DATE) AS day, COUNT(*) AS string_count FROM sl GROUP BY 1),
scores AS (SELECT day, float_count + string_count AS interesting_score FROM f JOIN s USING (day)),
days AS (SELECT day FROM scores ORDER BY interesting_score DESC NULLS LAST, day DESC LIMIT 30)"""

# Text variables whose name holds a word of trouble, upper or lower case.
TROUBLE = f"""trouble AS (SELECT id, name, {token_sql(['name'], C.B24_NAME_PATTERNS)} AS place FROM vars
  WHERE contains(lower(datatype), 'string')
    AND list_bool_or([contains(upper(name), word) FOR word IN ['ALARM', 'ALERT', 'FAULT', 'ERROR']]))"""

# A program runs from an instant with any signal at 1 to the next instant on the listed days.
PROG = f"""{TOP_DAYS},
ps AS (SELECT {ms_ts('date')} AS ts_utc, CAST({ms_ts('date')} AS DATE) AS day, CAST(max(value) AS INTEGER) AS state
  FROM prog WHERE id_var IN (575, 828) AND value IN (0, 1) GROUP BY 1, 2),
instant AS (SELECT ts_utc, day, state, row_number() OVER (ORDER BY ts_utc) AS place FROM ps WHERE day IN (SELECT day FROM days)),
piece AS (SELECT a.day, a.ts_utc AS start_ts, least(b.ts_utc, CAST(a.day + 1 AS TIMESTAMP)) AS end_ts
  FROM instant a JOIN instant b ON b.place = a.place + 1 WHERE a.state = 1)"""

MESSAGES = f"""message AS (SELECT {ms_ts('m.date')} AS moment, CAST({ms_ts('m.date')} AS DATE) AS day,
  {classify_sql('m.value', C.B23_CLASSES)} AS alert_type,
  coalesce({token_sql(['m.value', 'v.name'], C.B24_MSG_PATTERNS)}, 'UNK') AS location
  FROM msgs m JOIN vars v ON v.id = m.id_var AND v.name IN ('ALARMS', 'EASY_LOG_MESSAGE')
  WHERE CAST({ms_ts('m.date')} AS DATE) IN (SELECT day FROM days))"""

# ------------------------------------------------------------------ B1 - B9


@register("B1_keyword_values", """
SELECT DISTINCT id_var, value FROM sl
WHERE value ILIKE '%error%' OR value ILIKE '%stop%' OR value ILIKE '%fail%' OR value ILIKE '%fault%'
   OR value ILIKE '%imposible%' OR value ILIKE '%BROCA%' OR value ILIKE '%PLC%'""")
def b1(spark, sf):
    return B.keyword_values(Tables(spark, sf).sl)


@register("B2_shutdown_log", f"""
SELECT id_var, {SECS} AS log_time, value FROM sl
WHERE id_var IN (447, 557) AND value IS NOT NULL AND value <> '[]'""")
def b2(spark, sf):
    return B.shutdown_log(Tables(spark, sf).sl)


@register("B3_time_since_previous", f"""
WITH {SPOKEN}
SELECT id_var, moment AS log_time, message AS value, since AS previous_log_time, CAST(lasted AS DOUBLE) AS seconds_since_last_log
FROM silence WHERE id_var = 447""")
def b3(spark, sf):
    return B.time_since_previous(Tables(spark, sf).sl)


@register("B4_significant_stops", f"""
WITH {SPOKEN}
SELECT id_var, moment AS log_time, message, since AS previous_log_time, cents / 100.0 AS minutes_since_last_log
FROM silence WHERE id_var = 447 AND cents > 500""")
def b4(spark, sf):
    return B.significant_stops(Tables(spark, sf).sl)


@register("B4_stop_previews", f"""
WITH {SPOKEN}
SELECT moment AS log_time, message, cents / 100.0 AS minutes_since_last_log
FROM silence WHERE id_var = 447""")
def b4b(spark, sf):
    return B.stop_previews(Tables(spark, sf).sl)


@register("B5_stops_on_days", f"""
WITH {STOPS}
SELECT day, id_var, moment AS log_time, message, cents / 100.0 AS minutes_since_last_log FROM stop""")
def b5(spark, sf):
    t = Tables(spark, sf)
    return B.stops_on_days(t.sl, _rep_days(t))


@register("B6_stops_per_day", f"""
WITH {STOPS}, {usual_message("day")}
SELECT day, n AS nb_arrets, cents / 100.0 AS total_minutes_arret, split_part(usual, ',', 1) AS raison_typique FROM told""")
def b6(spark, sf):
    t = Tables(spark, sf)
    return B.stops_per_day(t.sl, _rep_days(t))


@register("B7_stops_per_day_variable", f"""
WITH {STOPS}, {usual_message("day, id_var")}
SELECT day, id_var, n AS nb_arrets, cents / 100.0 AS total_minutes_arret, ((2 * cents + n) // (2 * n)) / 100.0 AS duree_moyenne_arret,
  split_part(usual, ',', 1) AS raison_typique FROM told""")
def b7(spark, sf):
    t = Tables(spark, sf)
    return B.stops_per_day_variable(t.sl, _rep_days(t))


@register("B8_alarm_dictionary", f"""
WITH {REP_DAYS}, {SPOKEN},
found AS (SELECT unnest(list_zip(regexp_extract_all(message, '{C.B8_PATTERN}', 1), regexp_extract_all(message, '{C.B8_PATTERN}', 2))) AS pair
  FROM spoken WHERE CAST(moment AS DATE) IN (SELECT day FROM rep)),
pairs AS (SELECT pair[1] AS code, pair[2] AS libelle FROM found),
labels_of AS (SELECT code, libelle, COUNT(*) AS n FROM pairs GROUP BY code, libelle)
SELECT code, arg_min(libelle, (-n, libelle)) AS libelle_dominant, max(n) AS occurrences FROM labels_of GROUP BY code""")
def b8(spark, sf):
    t = Tables(spark, sf)
    return B.alarm_dictionary(t.sl, _rep_days(t))


CATALOGUE = f"""cat AS (SELECT DISTINCT alarm_code, description FROM (
  SELECT unnest(regexp_extract_all(value, '{C.B9_PATTERN}', 1)) AS alarm_code,
         unnest(regexp_extract_all(value, '{C.B9_PATTERN}', 2)) AS description
  FROM sl WHERE id_var = 447))"""


@register("B9_alarm_catalogue", f"WITH {CATALOGUE} SELECT alarm_code, description FROM cat")
def b9(spark, sf):
    return B.alarm_catalogue(Tables(spark, sf).sl)


# ------------------------------------------------------------------ B10 - B13

@register("B10_explode_alarms", f"""
SELECT date, seq, unnest(regexp_extract_all(value, '{B10P}', 1)) AS alarm_code,
  unnest(regexp_extract_all(value, '{B10P}', 2)) AS alarm_text,
  CAST(unnest(regexp_extract_all(value, '{B10P}', 3)) AS INTEGER) AS n1,
  CAST(unnest(regexp_extract_all(value, '{B10P}', 4)) AS INTEGER) AS n2,
  CAST(unnest(regexp_extract_all(value, '{B10P}', 5)) AS BIGINT) AS n3
FROM sl WHERE id_var = 447""")
def b10(spark, sf):
    sl = Tables(spark, sf).sl
    return B.explode_alarms(sl.filter(F.col("id_var") == C.ALARM_VAR)).select(
        "date", "seq", "alarm_code", "alarm_text", "n1", "n2", "n3")


@register("B11_noise_filter", f"""
SELECT date, seq, value FROM sl WHERE id_var = 447 AND NOT regexp_matches(value, '{NOISE}')""")
def b11(spark, sf):
    sl = Tables(spark, sf).sl
    return B.noise_filter(sl.filter(F.col("id_var") == C.ALARM_VAR)).select("date", "seq", "value")


@register("B12_alarm_incidents", f"WITH {RAW} SELECT alarm_code, alarm_text, start_time FROM periods")
def b12(spark, sf):
    return B.alarm_incidents(Tables(spark, sf).sl)


@register("B13_alarm_statistics", f"WITH {RAW} SELECT * FROM stats")
def b13(spark, sf):
    return B.alarm_statistics(B.alarm_incidents(Tables(spark, sf).sl))


def _stats(t):
    return B.alarm_statistics(B.alarm_incidents(t.sl))


# ------------------------------------------------------------------ B14 - B19

SEV14 = severity_sql("alarm_code", "alarm_text", C.B14_CRITICAL, C.B14_WARNING, "CRITIQUE")


@register("B14_alarm_severity", f"WITH {RAW} SELECT *, {SEV14} AS severity FROM stats")
def b14(spark, sf):
    return B.with_severity(_stats(Tables(spark, sf)))


@register("B15_alarm_severity_simple", f"""
WITH {RAW} SELECT *, {severity_sql('alarm_code', 'alarm_text', C.B15_CRITICAL, C.B15_WARNING, 'CRITICAL')}
  AS severity FROM stats""")
def b15(spark, sf):
    return B.with_severity(_stats(Tables(spark, sf)), simple=True)


_cat_values = ", ".join(f"('{c}', '{s}', '{g}', '{d}')" for c, s, g, d in C.ALARM_CATALOGUE)


@register("B16_catalogue_enrichment", f"""
WITH {CATALOGUE},
ref AS (SELECT * FROM (VALUES {_cat_values}) t(cat_code, cat_severity, cat_category, cat_desc))
SELECT alarm_code, description, coalesce(cat_severity, 'WARNING') AS catalogue_severity,
  coalesce(cat_category, 'UNKNOWN') AS category, coalesce(cat_desc, 'Unknown Alarm Code') AS catalogue_description
FROM cat LEFT JOIN ref ON cat.alarm_code = ref.cat_code""")
def b16(spark, sf):
    return B.enrich_catalogue(B.alarm_catalogue(Tables(spark, sf).sl))


@register("B17_severity_counts", f"""
WITH {RAW}, sev AS (SELECT *, {SEV14} AS severity FROM stats)
SELECT severity, CAST(SUM(occurrence_count) AS BIGINT) AS alarm_count FROM sev GROUP BY severity""")
def b17(spark, sf):
    return B.severity_counts(B.with_severity(_stats(Tables(spark, sf))))


@register("B18_top_incidents", f"""
WITH {RAW} SELECT * FROM stats ORDER BY occurrence_count DESC, alarm_code, alarm_text LIMIT 15""")
def b18(spark, sf):
    return B.top_incidents(_stats(Tables(spark, sf)))


@register("B18_top_codes", f"""
SELECT alarm_code, COUNT(*) AS row_count FROM (
  SELECT unnest(regexp_extract_all(value, '{B10P}', 1)) AS alarm_code FROM sl WHERE id_var = 447)
GROUP BY alarm_code ORDER BY row_count DESC, alarm_code LIMIT 10""")
def b18b(spark, sf):
    sl = Tables(spark, sf).sl
    return B.top_codes(B.explode_alarms(sl.filter(F.col("id_var") == C.ALARM_VAR)))


@register("B18_alarm_summary", f"""
WITH {RAW}, best AS (SELECT alarm_code, alarm_text, occurrence_count FROM stats
  ORDER BY occurrence_count DESC, alarm_code, alarm_text LIMIT 1)
SELECT (SELECT CAST(SUM(occurrence_count) AS BIGINT) FROM stats) AS total_occurrences,
  (SELECT COUNT(*) FROM stats) AS distinct_alarms, alarm_code AS top_code, alarm_text AS top_text,
  occurrence_count AS top_occurrences FROM best""")
def b18c(spark, sf):
    return B.alarm_summary(_stats(Tables(spark, sf)))


@register("B19_latest_alarms", f"""
WITH {RAW} SELECT * FROM stats ORDER BY last_seen DESC, alarm_code, alarm_text LIMIT 10""")
def b19(spark, sf):
    return B.latest_alarms(_stats(Tables(spark, sf)))


@register("B19_severity_tables", f"WITH {RAW} SELECT *, {SEV14} AS severity FROM stats")
def b19b(spark, sf):
    return B.alarms_by_severity(B.with_severity(_stats(Tables(spark, sf))))


# ------------------------------------------------------------------ B20 - B28

@register("B20_interesting_days", f"WITH {TOP_DAYS} SELECT day FROM days")
def b20(spark, sf):
    return _top_days(Tables(spark, sf))


@register("B20_ten_days", f"WITH {TOP_DAYS} SELECT day FROM scores ORDER BY interesting_score DESC NULLS LAST, day DESC LIMIT 10")
def b20_ten(spark, sf):
    """B20 with fewer days asked for than the log has."""
    return _top_days(Tables(spark, sf), 10)


@register("B21_alert_variables", f"WITH {TROUBLE} SELECT id, name FROM trouble")
def b21(spark, sf):
    return B.alert_variables(Tables(spark, sf).vars)


@register("B22_alert_class_en", f"""
SELECT seq, {classify_sql('value', C.B22_CLASSES)} AS alert_type FROM msgs""")
def b22(spark, sf):
    return B.message_classes(Tables(spark, sf).msgs, C.B22_CLASSES).select("seq", "alert_type")


@register("B23_alert_class_multilingual", f"""
SELECT seq, {classify_sql('value', C.B23_CLASSES)} AS alert_type FROM msgs""")
def b23(spark, sf):
    return B.message_classes(Tables(spark, sf).msgs, C.B23_CLASSES).select("seq", "alert_type")


@register("B24_location_token", f"""
SELECT m.seq, coalesce({token_sql(['m.value', 'v.name'], C.B24_MSG_PATTERNS)}, 'UNK') AS location,
  coalesce({token_sql(['v.name'], C.B24_NAME_PATTERNS)}, 'UNK') AS name_location
FROM msgs m JOIN vars v ON v.id = m.id_var""")
def b24(spark, sf):
    t = Tables(spark, sf)
    return B.message_locations(t.msgs, t.vars).select("seq", "location", "name_location")


@register("B25_alerts_per_day", f"""
WITH {TOP_DAYS}, {TROUBLE},
text_of_day AS (SELECT CAST({ms_ts('date')} AS DATE) AS day, id_var, value, COUNT(*) AS n FROM msgs GROUP BY ALL)
SELECT t.day, {classify_sql('t.value', C.B22_CLASSES)} AS alert_type, coalesce(v.place, 'UNK') AS location,
  CAST(SUM(t.n) AS BIGINT) AS events
FROM text_of_day t JOIN trouble v ON v.id = t.id_var WHERE t.day IN (SELECT day FROM days) GROUP BY ALL""")
def b25(spark, sf):
    t = Tables(spark, sf)
    return B.alerts_per_day(t.msgs, t.vars, _top_days(t))


@register("B26_program_state", f"WITH {PROG} SELECT ts_utc, day, state FROM ps")
def b26(spark, sf):
    return B.program_state(Tables(spark, sf).prog)


@register("B27_program_pieces", f"WITH {PROG} SELECT day, start_ts, end_ts FROM piece")
def b27(spark, sf):
    t = Tables(spark, sf)
    return B.program_pieces(B.program_state(t.prog), _top_days(t))


@register("B28_alerts_during_runs", f"""
WITH {PROG}, {MESSAGES},
touched AS (SELECT m.*, (SELECT COUNT(*) FROM piece p WHERE p.day = m.day AND m.moment BETWEEN p.start_ts AND p.end_ts) AS pieces FROM message m)
SELECT day, alert_type, location, CAST(SUM(greatest(pieces, 1)) AS BIGINT) AS events_total,
  CAST(SUM(pieces) AS BIGINT) AS events_during_program
FROM touched GROUP BY 1, 2, 3""")
def b28(spark, sf):
    t = Tables(spark, sf)
    days = _top_days(t)
    pieces = B.program_pieces(B.program_state(t.prog), days)
    return B.alerts_during_runs(B.classified_messages(t.msgs, t.vars, days), pieces)
