"""Stops, alarms and alerts.

String logs ``sl`` have ``date`` (epoch ms), ``id_var``, ``value`` (text,
NULL and ``'[]'`` mean "no alarm") and an optional unique ``seq``.  Alarm
cells hold arrays like ``[["PLC00010","Door open",3,3,50331658], ...]`` and
are cut with regular expressions (``regexp_extract_all`` + ``arrays_zip`` +
``explode``), never parsed row by row in Python.

Windows over the alarm log or per variable go through ``ordered_window`` with
buckets cut by row density, so a hot variable is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from machlog import config as C
from machlog.functions import classify as CL
from machlog.functions.timefn import day_of, ms_ts, period_filter, second_ts
from machlog.plans.sequence import ROWS_PER_BUCKET, cut_by_density, ms_of, ordered_window



def _order(df: DataFrame, first: Sequence[str] = ("date",)) -> list[str]:
    cols = list(first)
    for c in ("date", "seq"):
        if c in df.columns and c not in cols:
            cols.append(c)
    return cols


def valid_values(sl: DataFrame) -> DataFrame:
    """Rows that carry a message: not NULL and not ``'[]'`` (a NULL value
    already fails the comparison)."""
    return sl.filter(F.col("value") != "[]")


def _cents(gap_col: str = "gap_s") -> Column:
    """Minutes since the previous log, rounded half-up to 2 decimals, as
    integer hundredths: sums and means of them stay exact, as with the
    decimal arithmetic of the original."""
    return F.expr(f"(200 * {gap_col} + 60) div 120")


def _minutes(gap_col: str = "gap_s") -> Column:
    return _cents(gap_col) / F.lit(100.0)


# ------------------------------------------------------------------ B1 - B9

def keyword_values(sl: DataFrame, keywords: Sequence[str] = C.B1_KEYWORDS,
                   limit: int | None = None) -> DataFrame:
    """B1: distinct (id_var, value) whose value contains any keyword
    (case-insensitive).  ``limit`` keeps the first rows in (id_var, value)
    order; by default the whole result is returned."""
    # ILIKE '%k%' for any k == the lower-cased value contains a lower-cased
    # keyword: one lower(), one prefix-factored regex, the value read once.
    cond = F.lower(F.col("value")).rlike(CL.literal_set_pattern([k.lower() for k in keywords]))
    out = sl.filter(cond).select("id_var", "value").distinct()
    return out.orderBy("id_var", "value").limit(limit) if limit else out


def shutdown_log(sl: DataFrame, ids: Sequence[int] = (C.ALARM_VAR, C.FILE_STATUS_VAR),
                 limit: int | None = None) -> DataFrame:
    """B2: non-empty messages of the alarm / file-status variables; with
    ``limit`` the first ones in time order."""
    out = valid_values(sl.filter(F.col("id_var").isin(list(ids)))).select(
        "id_var", second_ts("date").alias("log_time"), "value", *(["date", "seq"] if "seq" in sl.columns else ["date"]))
    if limit:
        out = out.orderBy(*_order(out)).limit(limit)
    return out.select("id_var", "log_time", "value")


def log_gaps(sl: DataFrame, ids: Sequence[int], rows: int = ROWS_PER_BUCKET, keep: Sequence[str] = ("value",)) -> DataFrame:
    """Previous log time per variable over the non-empty messages (``lag`` per
    ``id_var``, in buckets of about ``rows`` rows, so one busy variable is split).
    Only ``keep`` travels beside the time.  A log stored by variable
    (``sources.logs.open_variable_log``) brings its own buckets and is not exchanged."""
    stored = "chunk" in sl.columns
    logs = valid_values(sl.filter(F.col("id_var").isin(list(ids))))
    logs = logs.select("id_var", *_order(sl), *keep, second_ts("date").alias("log_time"), *(["chunk"] if stored else []))
    if not stored:
        logs = cut_by_density(logs, F.col("date"), "_cut", rows, counted=sl.filter(F.col("id_var").isin(list(ids))))
    logs = ordered_window(logs, order=_order(logs), keys=["id_var"], bucket="chunk" if stored else F.col("_cut"),
                          lags={"previous_log_time": ("log_time", None)}).drop("_cut", "chunk")
    return logs.withColumn(
        "gap_s", F.unix_seconds("log_time") - F.unix_seconds("previous_log_time"))


def time_since_previous(sl: DataFrame, var: int = C.ALARM_VAR, limit: int | None = None) -> DataFrame:
    """Per log of ``var``, the previous log time and seconds since."""
    g = log_gaps(sl, [var])
    out = g.select("id_var", "log_time", "value", "previous_log_time",
                   F.col("gap_s").cast("double").alias("seconds_since_last_log"), *_order(g))
    if limit:
        out = out.orderBy(*_order(g)).limit(limit)
    return out.select("id_var", "log_time", "value", "previous_log_time", "seconds_since_last_log")


def significant_stops(sl: DataFrame, var: int = C.ALARM_VAR,
                      min_minutes: float = C.STOP_GAP_MINUTES) -> DataFrame:
    """Gaps (minutes rounded to 2) above ``min_minutes``."""
    g = log_gaps(sl, [var]).withColumn("minutes_since_last_log", _minutes())
    return g.filter(_cents() > F.lit(int(round(min_minutes * 100)))).select(
        "id_var", "log_time", F.col("value").alias("message"), "previous_log_time",
        "minutes_since_last_log")


def stop_previews(sl: DataFrame, var: int = C.ALARM_VAR, preview: int | None = None,
                  limit: int | None = None) -> DataFrame:
    """B4, second form: every log with its whole message and the minutes
    since the previous log (no gap filter); ``preview`` adds a column with
    the first characters."""
    g = log_gaps(sl, [var])
    shown = _preview(preview)
    out = g.select("log_time", F.col("value").alias("message"), *shown,
                   _minutes().alias("minutes_since_last_log"), *_order(g))
    if limit:
        out = out.orderBy(*_order(g)).limit(limit)
    return out.drop(*(c for c in out.columns if c not in ("log_time", "message", "message_preview", "minutes_since_last_log")))


def _preview(length: int | None) -> list[Column]:
    return [F.left(F.col("value"), F.lit(length)).alias("message_preview")] if length else []


def _days_frame(days: DataFrame | Sequence[str], spark) -> DataFrame:
    if isinstance(days, DataFrame):
        return days.select(F.col("day").cast("date").alias("day"))
    return spark.createDataFrame([(d,) for d in days], "day string").select(
        F.col("day").cast("date").alias("day"))


def stops_on_days(sl: DataFrame, days: DataFrame | Sequence[str],
                  ids: Sequence[int] = (C.ALARM_VAR, C.FILE_STATUS_VAR),
                  min_minutes: float = C.STOP_GAP_MINUTES, preview: int | None = None,
                  keep_cents: bool = False) -> DataFrame:
    """Gaps over the whole log first, then the logs of the selected days
    (``log_time`` in ``[day, day + 1)`` = equi-join on the log's date; the day
    list has one row per selected day, so it is broadcast), gap strictly
    above ``min_minutes``; whole messages, a preview column on request."""
    # The few stops are found on the times alone; their messages are joined then.
    at = ["id_var", *_order(sl)]
    g = log_gaps(sl, ids, keep=()).withColumn("day", day_of("log_time"))
    d = _days_frame(days, sl.sparkSession)
    g = g.filter(F.col("gap_s") > F.lit(min_minutes * 60)).join(F.broadcast(d), "day", "inner")
    if "seq" in sl.columns:
        texts = valid_values(sl.filter(F.col("id_var").isin(list(ids)))).select(*at, "value")
        g = g.join(texts, at, "inner")
    else:  # equal times cannot be told apart: the text travels
        g = (log_gaps(sl, ids).withColumn("day", day_of("log_time")).filter(F.col("gap_s") > F.lit(min_minutes * 60))
             .join(F.broadcast(d), "day", "inner"))
    cols = ["day", "id_var", "log_time",
            F.col("value").alias("message"), *_preview(preview),
            _minutes().alias("minutes_since_last_log"), _cents().alias("_cents")]
    out = g.select(*cols)
    return out if keep_cents else out.drop("_cents")


def _stop_summary(stops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ``keys``: stops, Σ hundredths of minutes and the most frequent
    message (``MODE() WITHIN GROUP``: ties -> smaller message), cut at its
    first comma.  Two aggregation levels instead of ``mode``: counts per
    (keys, message) combine map-side, then ``min_by`` keeps one candidate per
    group, so no group's distinct messages are buffered in one task."""
    per_msg = stops.groupBy(*keys, "message").agg(
        F.count("*").alias("_n"), F.sum("_cents").alias("_c"))
    top = F.min_by(F.col("message"), F.struct(F.negative("_n"), F.col("message")))
    g = per_msg.groupBy(*keys).agg(
        F.sum("_n").alias("nb_arrets"), F.sum("_c").alias("_cs"), top.alias("_mode"))
    return g.withColumn("raison_typique", F.split_part(F.col("_mode"), F.lit(","), F.lit(1)))


def stops_per_day(sl: DataFrame, days: DataFrame | Sequence[str], **kw) -> DataFrame:
    """Per day: number of stops, total minutes (sum of the rounded gaps),
    most frequent whole message, shown up to its first comma."""
    s = stops_on_days(sl, days, keep_cents=True, **kw)
    g = _stop_summary(s, ["day"])
    return g.select("day", "nb_arrets", (F.col("_cs") / F.lit(100.0)).alias("total_minutes_arret"),
                    "raison_typique")


def stops_per_day_variable(sl: DataFrame, days: DataFrame | Sequence[str], **kw) -> DataFrame:
    """B6 per (day, id_var) with the mean stop length (rounded half-up)."""
    s = stops_on_days(sl, days, keep_cents=True, **kw)
    g = _stop_summary(s, ["day", "id_var"])
    return g.select("day", "id_var", "nb_arrets",
                    (F.col("_cs") / F.lit(100.0)).alias("total_minutes_arret"),
                    (F.expr("(2 * _cs + nb_arrets) div (2 * nb_arrets)") / F.lit(100.0))
                    .alias("duree_moyenne_arret"), "raison_typique")


def extract_pairs(value: Column, pattern: str) -> Column:
    """Array of (code, label) structs for every match of ``pattern``."""
    return F.arrays_zip(F.regexp_extract_all(value, F.lit(pattern), 1).alias("code"),
                        F.regexp_extract_all(value, F.lit(pattern), 2).alias("label"))


def alarm_dictionary(sl: DataFrame, days: DataFrame | Sequence[str],
                     ids: Sequence[int] = (C.ALARM_VAR, C.FILE_STATUS_VAR),
                     pattern: str = C.B8_PATTERN) -> DataFrame:
    """On the selected days, count every (PLC code, label) pair and keep
    the dominant label per code (ties: smaller label)."""
    logs = valid_values(sl.filter(F.col("id_var").isin(list(ids)))).withColumn(
        "day", day_of(second_ts("date")))
    logs = logs.join(F.broadcast(_days_frame(days, sl.sparkSession)), "day", "inner")
    pairs = logs.select(F.explode(extract_pairs(F.col("value"), pattern)).alias("m")).select(
        F.col("m.code").alias("code"), F.col("m.label").alias("libelle"))
    counts = pairs.groupBy("code", "libelle").agg(F.count("*").alias("occ"))
    # Dominant label per code: most occurrences, then the smaller label.
    best = counts.groupBy("code").agg(
        F.min_by(F.struct("libelle", "occ"), F.struct(F.negative("occ"), F.col("libelle"))).alias("b"))
    return best.select("code", F.col("b.libelle").alias("libelle_dominant"),
                       F.col("b.occ").alias("occurrences"))


def alarm_catalogue(sl: DataFrame, var: int = C.ALARM_VAR, pattern: str = C.B9_PATTERN) -> DataFrame:
    """Distinct (alarm_code, description) over the whole history."""
    return (sl.filter(F.col("id_var") == var)
            .select(F.explode(extract_pairs(F.col("value"), pattern)).alias("m"))
            .select(F.col("m.code").alias("alarm_code"), F.col("m.label").alias("description"))
            .distinct().orderBy("alarm_code", "description"))


# ------------------------------------------------------------------ B10 - B13

def explode_alarms(df: DataFrame, value: str = "value", pattern: str = C.B10_PATTERN,
                   numbers: bool = True) -> DataFrame:
    """One row per ``["code","text",n1,n2,n3]`` entry (strict 5-field
    form); ``'[]'``/NULL rows yield none.  ``numbers=False`` extracts only
    code and text (two regex passes instead of five)."""
    if not numbers:
        return df.select(*[F.col(c) for c in df.columns], F.inline(alarm_entries(F.col(value), pattern)))
    groups = [F.regexp_extract_all(F.col(value), F.lit(pattern), i) for i in range(1, 6)]
    z = F.arrays_zip(*[g.alias(nm) for g, nm in zip(groups, ["c", "t", "n1", "n2", "n3"])])
    cols = [F.col("_m.c").alias("alarm_code"), F.col("_m.t").alias("alarm_text"),
            F.col("_m.n1").cast("int").alias("n1"), F.col("_m.n2").cast("int").alias("n2"),
            F.col("_m.n3").cast("bigint").alias("n3")]
    return df.withColumn("_m", F.explode(z)).select(*[c for c in df.columns], *cols)


def alarm_entries(value: Column, pattern: str = C.B10_PATTERN) -> Column:
    """Array of (alarm_code, alarm_text), one per entry of the value."""
    return F.arrays_zip(F.regexp_extract_all(value, F.lit(pattern), 1).alias("alarm_code"),
                        F.regexp_extract_all(value, F.lit(pattern), 2).alias("alarm_text"))


def noise_filter(sl: DataFrame, codes: Sequence[str] = C.NOISE_CODES) -> DataFrame:
    """Drop every row whose value mentions a noise code (the whole row,
    also when real alarms share it); NULL values drop as well."""
    return sl.filter(~F.col("value").rlike(CL.literal_set_pattern(codes)))


def alarm_rows(sl: DataFrame, from_date: str | None = None, until_date: str | None = None,
               var: int = C.ALARM_VAR, noise: Sequence[str] = C.NOISE_CODES, rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows of the alarm variable after the period and noise filters, each with the
    entries (code, text) of its value in place of it, ``next_ts`` (the next surviving
    row's second), ``shown_ts`` and ``shown`` (the previous one's second and entries).
    ``'[]'`` rows stay: they end alarms.  ``_cut`` is the row's bucket; no second is
    split between buckets.  Rows without a time are left out."""
    log = period_filter(sl.filter(F.col("id_var") == var), from_date, until_date).filter(F.col("date").isNotNull())
    raw = noise_filter(log, noise).select(*_order(sl), second_ts("date").alias("ts"), alarm_entries(F.col("value")).alias("entries"))
    second = F.col("date") - F.pmod(F.col("date"), F.lit(1000))
    raw = cut_by_density(raw, second, "_cut", rows, counted=log)  # counted before the texts are searched
    return ordered_window(raw, order=_order(raw), bucket="_cut", leads={"next_ts": ("ts", None)},
                          lags={"shown_ts": ("ts", None), "shown": ("entries", None)})


def alarm_incidents(sl: DataFrame, from_date: str | None = None, until_date: str | None = None,
                    var: int = C.ALARM_VAR, noise: Sequence[str] = C.NOISE_CODES, rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Incidents (gaps and islands).  Each row is valid on
    ``[ts, next_ts)``; the last row is dropped.  Per (code, text), a new
    incident starts where the previous entry's end is NULL or before ``ts``.
    Output: one row per incident with its start.

    An entry's end is the next row's second, so it reaches ``ts`` only if the entry was in
    the last row of the second before, or earlier in this second.  A row is therefore
    compared with one array, the last one of the second before, and equal starts within a
    second are one: only starts leave the array, and no window per alarm is needed."""
    raw = alarm_rows(sl, from_date, until_date, var, noise, rows)
    # Set by the first row of every second and carried over the second's other rows.
    turn = (F.when(F.col("shown_ts").isNull(), F.slice("entries", 1, 0))
            .when(F.col("shown_ts") < F.col("ts"), F.col("shown")))
    w = Window.partitionBy("_cut").orderBy(*_order(sl)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = raw.withColumn("_before", F.last(turn, ignorenulls=True).over(w)).filter(F.col("next_ts").isNotNull())
    starts = new.select(F.col("ts").alias("start_time"), F.inline(F.array_except("entries", "_before")))
    return starts.select("alarm_code", "alarm_text", "start_time").distinct()


def alarm_statistics(incidents: DataFrame) -> DataFrame:
    """Incidents and start of the latest incident per (code, text)."""
    return (incidents.groupBy("alarm_code", "alarm_text")
            .agg(F.count("*").alias("occurrence_count"), F.max("start_time").alias("last_seen"))
            .orderBy(F.desc("occurrence_count"), "alarm_code", "alarm_text"))


# ------------------------------------------------------------------ B14 - B19

def with_severity(alarms: DataFrame, code: str = "alarm_code", description: str | None = "alarm_text",
                  simple: bool = False, critical_label: str | None = None) -> DataFrame:
    """Add ``severity``."""
    desc = F.col(description) if description else None
    if simple:
        sev = CL.simple_severity(F.col(code), desc, critical_label or "CRITICAL")
    else:
        sev = CL.severity(F.col(code), desc, critical_label=critical_label or "CRITIQUE")
    return alarms.withColumn("severity", sev)


def enrich_catalogue(alarms: DataFrame, code: str = "alarm_code") -> DataFrame:
    """Severity, category and description from the fixed catalogue
    (21 codes, broadcast); unknown codes get WARNING / UNKNOWN."""
    spark = alarms.sparkSession
    cat = spark.createDataFrame(C.ALARM_CATALOGUE,
                                "cat_code string, cat_severity string, cat_category string, cat_desc string")
    sev, category, desc = C.UNKNOWN_ALARM
    out = alarms.join(F.broadcast(cat), F.col(code) == F.col("cat_code"), "left")
    return out.select(*alarms.columns,
                      F.coalesce("cat_severity", F.lit(sev)).alias("catalogue_severity"),
                      F.coalesce("cat_category", F.lit(category)).alias("category"),
                      F.coalesce("cat_desc", F.lit(desc)).alias("catalogue_description"))


def severity_counts(alarms: DataFrame) -> DataFrame:
    """Σ ``occurrence_count`` per severity (row count when absent)."""
    weight = F.col("occurrence_count") if "occurrence_count" in alarms.columns else F.lit(1)
    return alarms.groupBy("severity").agg(F.sum(weight).cast("bigint").alias("alarm_count"))


def top_incidents(stats: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most recurring alarms (ties by code, text)."""
    return stats.orderBy(F.desc("occurrence_count"), "alarm_code", "alarm_text").limit(n)


def top_codes(alarms: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` codes with most rows (``value_counts``)."""
    return (alarms.groupBy("alarm_code").agg(F.count("*").alias("row_count"))
            .orderBy(F.desc("row_count"), "alarm_code").limit(n))


def alarm_summary(stats: DataFrame) -> DataFrame:
    """Σ occurrences, number of distinct alarms and the most frequent
    code/text (ties: smaller code, text), in one aggregate."""
    top = F.min_by(F.struct("alarm_code", "alarm_text", "occurrence_count"),
                   F.struct(F.negative("occurrence_count"), F.col("alarm_code"), F.col("alarm_text")))
    agg = stats.agg(F.sum("occurrence_count").cast("bigint").alias("total_occurrences"),
                    F.count("*").alias("distinct_alarms"), top.alias("b"))
    return agg.select("total_occurrences", "distinct_alarms",
                      F.col("b.alarm_code").alias("top_code"), F.col("b.alarm_text").alias("top_text"),
                      F.col("b.occurrence_count").alias("top_occurrences"))


def latest_alarms(stats: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most recent alarms by ``last_seen`` (by occurrence
    when there is no date)."""
    if "last_seen" in stats.columns:
        return stats.orderBy(F.desc("last_seen"), "alarm_code", "alarm_text").limit(n)
    return stats.orderBy(F.desc("occurrence_count"), "alarm_code", "alarm_text").limit(n)


def alarms_by_severity(alarms: DataFrame, severity: str | None = None) -> DataFrame:
    """The detail table of one severity (all when None), newest first
    (by ``last_seen``; by ``occurrence_count`` when there is no date)."""
    d = alarms if severity is None else alarms.filter(F.col("severity") == severity)
    key = "last_seen" if "last_seen" in alarms.columns else "occurrence_count"
    return d.orderBy("severity", F.desc(key), "alarm_code", "alarm_text")


# ------------------------------------------------------------------ B20 - B28

def interesting_days(scores: DataFrame, n: int = C.TOP_N_DAYS,
                     score: str = "interesting_score") -> DataFrame:
    """Top ``n`` days by score (NULLs last), then latest day first."""
    return scores.orderBy(F.desc_nulls_last(score), F.desc("day")).limit(n).select("day")


def alert_variables(vars_df: DataFrame, name_pattern: str = C.ALERT_VAR_NAME) -> DataFrame:
    """String variables whose name mentions ALARM/ALERT/FAULT/ERROR."""
    return vars_df.filter(F.col("datatype").rlike("(?i)String")
                          & F.col("name").rlike(f"(?i){name_pattern}")).select("id", "name")


def message_locations(msgs: DataFrame, vars_df: DataFrame) -> DataFrame:
    """B24 on every message: ``location`` from the message, then the variable name,
    and ``name_location`` from the name only; ``UNK`` where nothing matches.  Names
    are searched once per variable, messages once per distinct text."""
    token = CL.first_token([F.col("name")], C.B24_MSG_PATTERNS)
    names = vars_df.select(F.col("id").alias("id_var"), token.alias("_name_token"), CL.location(F.col("name")).alias("name_location"))
    found = CL.by_distinct_text(msgs, "value", _token=CL.first_token([F.col("value")], C.B24_MSG_PATTERNS))
    return (found.join(names, "id_var")
            .select(*msgs.columns, F.coalesce("_token", "_name_token", F.lit("UNK")).alias("location"), "name_location"))


def message_classes(msgs: DataFrame, classes=C.B23_CLASSES) -> DataFrame:
    """B22 / B23 on every message: ``alert_type``, decided once per distinct text."""
    return CL.by_distinct_text(msgs, "value", alert_type=CL.classify(F.col("value"), classes))


def alerts_per_day(msgs: DataFrame, vars_df: DataFrame, days: DataFrame) -> DataFrame:
    """Messages of alert variables on the selected days, classified
    (B22) and located from the variable name (B24), counted."""
    av = alert_variables(vars_df)
    a = (msgs.withColumn("ts_utc", ms_ts("date")).withColumn("day", day_of("ts_utc"))
         .join(av, F.col("id_var") == F.col("id"), "inner")
         .join(F.broadcast(days.select("day")), "day", "inner"))
    # Class and location depend only on (message, variable name): count the
    # rows per (day, message, name) first (combined map-side; alert messages
    # repeat), run the regexes once per distinct triple, then add up.
    per_msg = a.groupBy("day", "value", "name").agg(F.count("*").alias("_n"))
    c = per_msg.select("day", CL.classify(F.col("value"), C.B22_CLASSES).alias("alert_type"),
                       CL.location(F.col("name")).alias("location"), "_n")
    return c.groupBy("day", "alert_type", "location").agg(F.sum("_n").alias("events"))


def program_state(prog: DataFrame, ids: Sequence[int] = C.PROGRAM_VARS) -> DataFrame:
    """Union of the 0/1 program variables; state per timestamp = 1 when
    any is 1."""
    p = prog.filter(F.col("id_var").isin(list(ids)) & F.col("value").isin(0, 1))
    p = p.select(ms_ts("date").alias("ts_utc"), F.col("value").cast("int").alias("state"))
    return p.groupBy("ts_utc", day_of("ts_utc").alias("day")).agg(
        F.when(F.sum("state") > 0, F.lit(1)).otherwise(F.lit(0)).alias("state"))


def program_pieces(state: DataFrame, days: DataFrame) -> DataFrame:
    """On the selected days, each state-1 sample runs to the next
    sample (over the selected days, global order), cut at the end of its
    day.  Consecutive 1-samples are separate pieces."""
    s = state.join(F.broadcast(days.select("day")), "day", "inner")
    s = cut_by_density(s, ms_of("ts_utc"), "_cut")
    s = ordered_window(s, order=["ts_utc"], bucket=F.col("_cut"), leads={"next_ts": ("ts_utc", None)})
    end = F.least(F.col("next_ts"), F.date_trunc("day", "ts_utc") + F.expr("INTERVAL 1 DAY"))
    return s.filter((F.col("state") == 1) & F.col("next_ts").isNotNull()).select(
        "day", F.col("ts_utc").alias("start_ts"), end.alias("end_ts"))


def classified_messages(msgs: DataFrame, vars_df: DataFrame, days: DataFrame,
                        names: Sequence[str] = C.MESSAGE_VARS) -> DataFrame:
    """B23 + B24 on the message variables of the selected days: one row per
    (time, variable, message) with ``n``, the number of its log rows."""
    mv = vars_df.filter(F.col("name").isin(list(names))).select("id", F.col("name").alias("var_name"))
    a = (msgs.withColumn("ts_utc", ms_ts("date")).withColumn("day", day_of("ts_utc"))
         .join(F.broadcast(mv), F.col("id_var") == F.col("id"), "inner")
         .join(F.broadcast(days.select("day")), "day", "inner"))
    # Alerts of one tick repeat: count them map-side, then classify each once.
    a = a.groupBy("day", "ts_utc", "var_name", F.col("value").alias("msg")).agg(F.count("*").alias("n"))
    return a.select("day", "ts_utc", "var_name", "msg", "n",
                    CL.classify(F.col("msg"), C.B23_CLASSES).alias("alert_type"),
                    CL.location(F.col("var_name"), F.col("msg")).alias("location"))


def alerts_during_runs(classified: DataFrame, pieces: DataFrame, rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Left interval join of alerts with program pieces (same day,
    ``start <= ts <= end``, closed at both ends: an alert on a shared boundary
    matches two pieces and is counted twice, as in the original), then total
    and in-program counts.

    A sorted sweep instead of a join: starts, alerts and ends of a day are one
    sequence (at one moment in this order), and the pieces open at an alert are
    the running sum of starts less ends.  A piece costs two rows however long it
    is; equal starts, alerts and ends are counted before the sequence is made.
    It runs in buckets cut by density, so a busy day is split as well."""
    n = F.sum("n") if "n" in classified.columns else F.count("*")  # counted rows or single ones
    alerts = classified.groupBy("day", F.col("ts_utc").alias("at"), "alert_type", "location").agg(n.cast("bigint").alias("n"))
    none = F.lit(None).cast("string")

    def ends(moment: str, step: int, order: int) -> DataFrame:
        counted = pieces.groupBy("day", F.col(moment).alias("at")).agg((F.count("*") * step).alias("step"))
        return counted.select("day", "at", F.lit(order).alias("kind"), none.alias("alert_type"), none.alias("location"),
                              F.lit(0).cast("bigint").alias("n"), "step")

    inside = F.col("start_ts") <= F.col("end_ts")  # a piece without length at its end matches nothing
    pieces = pieces.filter(inside)
    sweep = (ends("start_ts", 1, 0).unionByName(ends("end_ts", -1, 2))
             .unionByName(alerts.select("day", "at", F.lit(1).alias("kind"), "alert_type", "location", "n", F.lit(0).cast("bigint").alias("step")))
             .filter(F.col("day").isNotNull()))
    sweep = cut_by_density(sweep, ms_of("at"), "_cut", rows)
    order = ["at", "kind", "alert_type", "location"]
    swept = ordered_window(sweep, order=order, keys=["day"], bucket=F.col("_cut"), running_sums={"open": "step"}).filter("kind = 1")
    counted = swept.groupBy("day", "alert_type", "location").agg(
        F.sum(F.col("n") * F.greatest("open", F.lit(1))).alias("events_total"), F.sum(F.col("n") * F.col("open")).alias("events_during_program"))
    return counted
