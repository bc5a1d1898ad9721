"""Hand-computed edge cases (FIXTURES.md section 5)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from machlog.functions.timefn import period_filter
from machlog.operators import activity as A
from machlog.operators import alarms as B
from machlog.operators import energy as E
from machlog.operators import kpi as K

from helpers import alarm, arr, float_log, string_log


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ------------------------------------------------------------------ activity

def test_no_gap_gives_one_null_row(spark):
    fl = float_log(spark, [("2024-01-01 10:00:00", 1, 1), ("2024-01-01 10:00:01", 2, 1),
                           ("2024-01-01 10:00:02", 1, 1)])
    out = A.idle_gaps(A.distinct_vars_per_second(fl)).collect()
    assert len(out) == 1 and out[0]["state"] == "True Idle (Off)" and out[0]["total_hours"] is None


def test_short_day_has_no_classified_rows(spark):
    rows = [(f"2024-01-01 10:00:{s:02d}", 1, 1) for s in range(20)]
    rows += [(f"2024-01-02 10:00:{s:02d}", 1, 1) for s in range(10)]
    fl = float_log(spark, rows)
    sm = A.smoothed_signal(A.distinct_vars_per_second(fl))
    assert _rows(sm, "day") == [(__import__("datetime").date(2024, 1, 1),)] * 6
    tot = {r["state"]: r["total_hours"] for r in A.four_state_totals(fl).collect()}
    assert math.isclose(tot["Low Activity"], 6 / 3600)


def test_missing_days_behave_as_one_global_window(spark):
    fl = float_log(spark, [("2024-01-01 23:59:58", 1, 1), ("2024-01-01 23:59:59", 1, 1),
                           ("2024-01-05 00:00:02", 1, 1)])
    out = A.idle_gaps(A.distinct_vars_per_second(fl)).collect()[0]["total_hours"]
    # gap = (Jan 5 00:00:02) - (Jan 1 23:59:59 + 1 s) = 3 days + 2 s
    assert math.isclose(out, (3 * 86400 + 2) / 3600)


def test_segments_total_equals_span(spark):
    rows = [(f"2024-01-01 06:00:{s:02d}", 1 + (s // 7) % 2, 1) for s in range(40)]
    fl = float_log(spark, rows)
    states = A.distinct_vars_per_second(fl).select(
        "ts", (F.col("distinct_vars_count") > 0).cast("int").alias("state_num"))
    segs = A.segments(states, end="2024-01-01 06:01:00")
    total = sum(r["total_duration_s"] for r in A.state_totals(segs).collect())
    assert total == 60.0  # from the first record to the window end


def test_even_sized_decile_tie(spark):
    # 20 days: each decile holds two days, the median sits midway -> earlier day
    rows = []
    for d in range(1, 21):
        for k in range(21 - d):  # day 1 busiest
            rows.append((f"2024-01-{d:02d} 10:{k:02d}:00", 1, 1))
    fl = float_log(spark, rows)
    rep = {r["decile"]: r["day"].day for r in A.representative_days(fl, string_log(spark, [])).collect()}
    # decile 1 holds the two quietest days (20 and 19): earlier day is 19
    assert rep[1] == 19 and rep[10] == 1


# ------------------------------------------------------------------ alarms

def _incidents(spark, rows, noise=("PLC00010",)):
    sl = string_log(spark, [(t, 447, v) for t, v in rows])
    inc = B.alarm_incidents(sl, noise=list(noise))
    return B.alarm_statistics(inc).collect()


def test_repeated_alarm_in_one_array_is_one_incident(spark):
    out = _incidents(spark, [("2024-01-01 10:00:00", arr(alarm("A"), alarm("A"))),
                             ("2024-01-01 10:05:00", "[]")])
    assert [(r["alarm_code"], r["occurrence_count"]) for r in out] == [("A", 1)]


def test_alarm_cleared_twice_gives_two_incidents(spark):
    out = _incidents(spark, [("2024-01-01 10:00:00", arr(alarm("A"))), ("2024-01-01 10:01:00", "[]"),
                             ("2024-01-01 10:02:00", arr(alarm("A"))), ("2024-01-01 10:03:00", "[]")])
    assert len(out) == 1 and out[0]["occurrence_count"] == 2
    assert out[0]["last_seen"].strftime("%H:%M:%S") == "10:02:00"


def test_noise_row_removed_whole_and_alarm_lasts(spark):
    out = _incidents(spark, [("2024-01-01 10:00:00", arr(alarm("A"))),
                             ("2024-01-01 10:01:00", arr(alarm("A"), alarm("PLC00010"))),
                             ("2024-01-01 10:02:00", "[]")])
    assert [(r["alarm_code"], r["occurrence_count"]) for r in out] == [("A", 1)]


def test_alarm_in_last_row_not_reported(spark):
    out = _incidents(spark, [("2024-01-01 10:00:00", "[]"), ("2024-01-01 10:01:00", arr(alarm("A")))])
    assert out == []


def test_stop_gap_across_midnight_kept_and_5_min_dropped(spark):
    sl = string_log(spark, [("2024-01-01 23:50:00", 447, "m1"), ("2024-01-02 00:10:00", 447, "m2"),
                            ("2024-01-02 00:15:00", 447, "m3")])
    out = B.stops_on_days(sl, ["2024-01-02"]).collect()
    assert [(r["message"], r["minutes_since_last_log"]) for r in out] == [("m2", 20.0)]
    assert B.significant_stops(sl).count() == 1  # 5.00 minutes is not > 5


def test_typical_reason_tie_takes_smaller_message(spark):
    sl = string_log(spark, [("2024-01-02 00:00:00", 447, "zeta, 1"), ("2024-01-02 01:00:00", 447, "beta, 2"),
                            ("2024-01-02 02:00:00", 447, "zeta, 1"), ("2024-01-02 03:00:00", 447, "beta, 2")])
    # first row has no previous log; remaining: beta, zeta, beta -> beta wins outright;
    # add one more zeta to tie
    sl = sl.unionByName(string_log(spark, [("2024-01-02 04:00:00", 447, "zeta, 1")]).withColumn("seq", F.lit(9).cast("bigint")))
    r = B.stops_per_day(sl, ["2024-01-02"]).collect()[0]
    assert r["nb_arrets"] == 4 and r["raison_typique"] == "beta"


def test_empty_day_list_keeps_schema(spark):
    sl = string_log(spark, [("2024-01-02 00:00:00", 447, "a"), ("2024-01-02 01:00:00", 447, "b")])
    empty = spark.createDataFrame([], "day date")
    for df in (B.stops_on_days(sl, empty), B.stops_per_day(sl, empty),
               B.stops_per_day_variable(sl, empty), B.alarm_dictionary(sl, empty)):
        assert df.count() == 0 and len(df.columns) > 1
    fl = float_log(spark, [("2024-01-02 00:00:00", 630, 5)])
    v = spark.createDataFrame([(630, "MANDRINO_CONSUMO_VISUALIZADO", "Float")], "id int, name string, datatype string")
    e4 = E.daily_load_stats(fl, v, empty)
    assert e4.count() == 0 and "measure_count" in e4.columns


def test_lowercase_zone_is_unknown(spark):
    from machlog.functions.classify import location
    df = spark.createDataFrame([("zone_3 alarm", "x"), ("ZONE_3 alarm", "x")], "msg string, name string")
    assert [r[0] for r in df.select(location(F.col("name"), F.col("msg"))).collect()] == ["UNK", "3"]


def test_alert_on_shared_boundary_counted_twice(spark):
    state = spark.createDataFrame(
        [("2024-01-02 10:00:00", 1), ("2024-01-02 10:10:00", 1), ("2024-01-02 10:20:00", 0)],
        "t string, state int").select(F.to_timestamp("t").alias("ts_utc"), F.to_date(F.to_timestamp("t")).alias("day"), "state")
    days = spark.createDataFrame([("2024-01-02",)], "d string").select(F.to_date("d").alias("day"))
    pieces = B.program_pieces(state, days)
    assert pieces.count() == 2
    alerts = spark.createDataFrame([("2024-01-02 10:10:00", "door", "UNK")], "t string, alert_type string, location string") \
        .select(F.to_timestamp("t").alias("ts_utc"), F.to_date(F.to_timestamp("t")).alias("day"), "alert_type", "location")
    r = B.alerts_during_runs(alerts, pieces).collect()[0]
    assert r["events_total"] == 2 and r["events_during_program"] == 2


# ------------------------------------------------------------------ energy

VARS = "id int, name string, datatype string"


def _vars(spark):
    return spark.createDataFrame([(630, "MANDRINO_CONSUMO_VISUALIZADO", "Float")], VARS)


def test_midnight_interval_unsplit_vs_split(spark):
    fl = float_log(spark, [("2024-01-01 23:30:00", 630, 100), ("2024-01-02 00:30:00", 630, 0)])
    e5 = {r["day"].day: r["energy_kwh"] for r in E.energy_unsplit(fl, _vars(spark), ["2024-01-01", "2024-01-02"]).collect()}
    assert math.isclose(e5[1], 15.0) and e5[2] == 0.0
    e6 = {r["day"].day: r["total_energy_kwh"] for r in E.energy_per_day(fl, _vars(spark)).collect()}
    assert math.isclose(e6[1], 7.5) and math.isclose(e6[2], 7.5)


def test_interval_ending_at_midnight_adds_zero_piece(spark):
    fl = float_log(spark, [("2024-01-01 23:00:00", 630, 50), ("2024-01-02 00:00:00", 630, 50)])
    e6 = {r["day"].day: r["total_duration_h"] for r in E.energy_per_day(fl, _vars(spark)).collect()}
    assert e6 == {1: 1.0, 2: 0.0}


def test_nan_null_and_clamping(spark):
    rows = [("2024-01-01 10:00:00", 630, float("nan")), ("2024-01-01 11:00:00", 630, None),
            ("2024-01-01 12:00:00", 630, -5), ("2024-01-01 13:00:00", 630, 150),
            ("2024-01-01 14:00:00", 630, 10)]
    fl = float_log(spark, rows)
    e4 = E.daily_load_stats(fl, _vars(spark), ["2024-01-01"]).collect()[0]
    assert e4["measure_count"] == 4 and math.isnan(e4["total_consumption"])  # NULL removed, NaN spreads
    e6 = E.energy_per_day(fl, _vars(spark)).collect()[0]
    # NaN -> 100 for 2 h (NULL row removed), -5 -> 0, 150 -> 100
    assert math.isclose(e6["total_energy_kwh"], 15 * 2 + 0 + 15)
    half = float_log(spark, [("2024-01-01 10:00:00", 630, float("nan")), ("2024-01-01 10:30:00", 630, None),
                             ("2024-01-01 11:00:00", 630, -5), ("2024-01-01 11:30:00", 630, 150),
                             ("2024-01-01 12:00:00", 630, 10)])
    e10 = E.daily_energy_gap_cap(half, var_id=630).collect()[0]
    # no NULL filter: NULL counts as 100 for its half hour
    assert math.isclose(e10["total_energy_kwh"], 7.5 + 7.5 + 0 + 7.5)


def test_gap_of_exactly_3600s_dropped(spark):
    fl = float_log(spark, [("2024-01-01 10:00:00", 630, 100), ("2024-01-01 11:00:00", 630, 100),
                           ("2024-01-01 11:30:00", 630, 100)])
    e10 = E.daily_energy_gap_cap(fl, var_id=630).collect()[0]
    assert math.isclose(e10["total_energy_kwh"], 7.5)


def test_split_preserves_hours(spark):
    rows = [(f"2024-01-0{d} {h:02d}:17:00", 630, 40 + h) for d in (1, 2, 4) for h in (0, 7, 23)]
    fl = float_log(spark, rows)
    split = sum(r["total_duration_h"] for r in E.energy_per_day(fl, _vars(spark)).collect())
    # unsplit: last - first
    assert math.isclose(split, (3 * 24 + 23) - 0)


# ------------------------------------------------------------------ sources / KPIs

def test_date_only_bounds(spark):
    fl = float_log(spark, [("2024-01-01 00:00:00", 1, 1), ("2024-01-02 23:59:59", 1, 1),
                           ("2024-01-02 23:59:59.500", 1, 1), ("2024-01-03 00:00:00", 1, 1)])
    assert period_filter(fl, "2024-01-01", "2024-01-02").count() == 2


def test_zero_hours_give_zero_availability(spark):
    st = spark.createDataFrame([("High Activity", 0.0), ("True Idle (Off)", 0.0)], "state string, total_hours double")
    r = K.state_kpis(st).collect()[0]
    assert r["availability_pct"] == 0.0 and r["idle_hours"] == 0.0
    assert {x["percent"] for x in K.state_share(st).collect()} == {0.0}


def test_energy_log_bounds_inclusive(spark):
    e = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("2024-01-01 12:00:00", 2.0),
                               ("2024-01-02 00:00:00", 4.0)], "t string, kwh_value double") \
        .select(F.to_timestamp("t").alias("energy_timestamp"), "kwh_value")
    out = {r["date"].day: r["total_energy_kwh"] for r in
           E.energy_log_daily(e, "2024-01-01 00:00:00", "2024-01-02 00:00:00").collect()}
    assert out == {1: 3.0, 2: 4.0}


def test_program_kpis_filters(spark):
    runs = spark.createDataFrame([("2024-01-01", "M0", "p", 10.0), ("2024-01-02", "M0", "p", 20.0),
                                  ("2024-01-02", "M1", "q", 30.0)], "d string, machine string, program string, duration_min double") \
        .select(F.to_date("d").alias("date"), "machine", "program", "duration_min")
    r = K.program_kpis(runs, machine="M0", start="2024-01-02").collect()[0]
    assert (r["program_runs"], r["avg_duration_min"]) == (1, 20.0)
    r = K.program_kpis(runs, machine="M9").collect()[0]
    assert (r["program_runs"], r["avg_duration_min"]) == (0, 0.0)
    per_day = {x["date"].day: x["program_count"] for x in K.runs_per_day(runs, "All").collect()}
    assert per_day == {1: 1, 2: 2}


def test_boxplot_against_brute_force(spark):
    import random
    import statistics

    rnd = random.Random(3)
    rows = [(f"M{rnd.randint(0, 1)}", float(rnd.choice([1, 2, 3, 5, 8, 13, 40, 200]) + rnd.random()))
            for _ in range(300)]
    runs = spark.createDataFrame(rows, "machine string, duration_min double")
    got = {r["machine"]: r for r in K.duration_boxplot(runs).collect()}
    for m in ("M0", "M1"):
        v = sorted(x for k, x in rows if k == m)
        q1, med, q3 = statistics.quantiles(v, n=4, method="inclusive")
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        r = got[m]
        assert math.isclose(r["q1"], q1) and math.isclose(r["median"], med) and math.isclose(r["q3"], q3)
        assert r["whisker_low"] == min(x for x in v if x >= lo)
        assert r["whisker_high"] == max(x for x in v if x <= hi)
        assert r["outliers"] == sum(1 for x in v if x < lo or x > hi)


def test_energy_record_day_first_on_ties(spark):
    d = spark.createDataFrame([("2024-01-03", 5.0), ("2024-01-01", 7.0), ("2024-01-02", 7.0)],
                              "d string, total_energy_kwh double").select(F.to_date("d").alias("day"), "total_energy_kwh")
    r = E.energy_kpis(d).collect()[0]
    assert r["record_day"].day == 1 and r["record_kwh"] == 7.0
    assert math.isclose(r["cost"], 19.0 * 0.15)


def test_stop_reasons_count_whole_messages(spark):
    """Messages that only differ after their first 150 characters are not one message."""
    long = "x" * 200
    rows, texts = [], [f"b{long}1", f"b{long}2", "a,one", "a,one"]
    for k, text in enumerate(["first", *texts]):
        rows.append((f"2024-01-02 {10 + k}:00:00", 447, text))
    sl = string_log(spark, rows)
    assert [r["raison_typique"] for r in B.stops_per_day(sl, ["2024-01-02"]).collect()] == ["a"]
    assert {r["message"] for r in B.stops_on_days(sl, ["2024-01-02"]).collect()} == set(texts)


def test_energy_of_a_longer_log_is_not_cut(spark, tmp_path):
    """E13 and E14 on a log that goes on after the test data's 30 days."""
    import __spark_entry__ as entry
    src = "/root/testdata/sf0.001"
    ev = spark.read.parquet(f"{src}/events.parquet")
    later = ev.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(30))).withColumn("event_id", F.col("event_id") + 10**9)
    ev.unionByName(later).write.parquet(str(tmp_path / "events.parquet"))
    q = entry.queries()
    one, two = (q["E13_energy_kpis"](spark, d).first()["total_kwh"] for d in (src, str(tmp_path)))
    assert 1.9 < two / one < 2.1
    one, two = (q["E14_energy_per_operating_hour"](spark, d).first()["energy_per_operating_h"] for d in (src, str(tmp_path)))
    assert 0.9 < two / one < 1.1
