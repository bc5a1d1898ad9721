"""Storage, pruning, rollup refresh (batch and streaming) and envelopes."""

from __future__ import annotations

import json

import pytest

from machlog.functions.timefn import period_filter
from machlog.operators import activity as A
from machlog.sources import logs as L
from machlog.streaming import rollup as R

from helpers import float_log


def test_period_filter_prunes_day_partitions(spark, tmp_path):
    fl = float_log(spark, [("2024-01-01 10:00:00", 1, 1), ("2024-01-02 10:00:00", 1, 2),
                           ("2024-01-03 10:00:00", 1, 3)])
    path = str(tmp_path / "fl")
    L.write_log(fl.select("date", "id_var", "value"), path)
    log = L.read_log(spark, path)
    out = period_filter(log, "2024-01-02", "2024-01-02")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date," in plan
    assert [r["value"] for r in out.collect()] == [2.0]


def test_rollup_refresh_merges_touched_days_only(spark, tmp_path):
    base = float_log(spark, [("2024-01-01 10:00:00", 1, 1), ("2024-01-02 10:00:00", 1, 1), ("2024-01-02 10:00:01", 7, 1)])
    path = str(tmp_path / "rollup")
    R.build_rollup(base, path=path)
    before = {f.name for f in (tmp_path / "rollup" / "day=2024-01-01").iterdir()}
    new = float_log(spark, [("2024-01-02 10:00:00", 2, 1), ("2024-01-02 10:00:00", 1, 5), ("2024-01-03 09:00:00", 4, 1)])
    merged = R.merged_days(new, path, 1, R.touched_days(new))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [day" in plan and plan.count("FileScan parquet") == 1  # the touched partitions and the new rows
    for _ in range(2):  # a repeated batch changes nothing
        out = R.refresh_rollup(new, path)
        got = {(r["day"].day, r["ts"].second, r["distinct_vars_count"]) for r in out.collect()}
        assert got == {(1, 0, 1), (2, 0, 2), (2, 1, 1), (3, 0, 1)}
    assert {f.name for f in (tmp_path / "rollup" / "day=2024-01-01").iterdir()} == before  # not rewritten
    assert R.refresh_rollup(new.limit(0), path).count() == 4
    with pytest.raises(ValueError):
        R.refresh_rollup(new, path, bucket_s=60)


def test_log_by_variable_is_read_without_exchange(spark, tmp_path):
    """A variable with most of the rows is split; windows per variable take the stored buckets; another session's catalogue opens it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from machlog.operators import alarms as B

    day = 86_400_000
    rows = [(1_704_067_200_000 + i * 977_000, 447, f"m{i % 7}", i) for i in range(900)]
    rows += [(1_704_067_200_000 + i * day, 557, "[]" if i % 4 == 0 else "x", 1000 + i) for i in range(12)]
    rows += [(None, 447, "no time", 2000), (1_704_067_200_000, None, "no variable", 2001)]
    log = spark.createDataFrame(rows, "date bigint, id_var int, value string, seq bigint")
    path = str(tmp_path / "by-variable")
    L.write_variable_log(log, path, buckets=4, rows=100)
    spark.sql(f"DROP TABLE {L._variable_table(path)}")  # as in a session that has not seen it
    stored = L.open_variable_log(spark, path)
    assert stored.drop("chunk").exceptAll(log).count() == 0 and stored.count() == len(rows)
    per = {(r["id_var"], r["chunk"]): r["n"] for r in stored.groupBy("id_var", "chunk").agg(F.count("*").alias("n")).collect()}
    assert per[447, -1] == per[None, -1] == 1 and per[557, 0] == 12
    hot = [n for (v, c), n in per.items() if v == 447 and c >= 0]
    assert len(hot) >= 9 and max(hot) <= 200
    spans = stored.filter("chunk >= 0 AND id_var = 447").groupBy("chunk").agg(F.min("date").alias("a"), F.max("date").alias("b")).orderBy("chunk").collect()
    assert all(p["b"] < q["a"] for p, q in zip(spans, spans[1:]))

    timed = stored.filter("chunk >= 0")
    got = B.log_gaps(timed, [447, 557])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning(id_var" in plan  # the edges
    assert not any("hashpartitioning(id_var" in line and "chunk" in line for line in plan.splitlines()), plan
    valid = log.filter("value <> '[]' AND date IS NOT NULL AND id_var IS NOT NULL")
    ts = F.timestamp_seconds(F.expr("date div 1000"))
    want = valid.select("seq", F.lag(ts).over(Window.partitionBy("id_var").orderBy("date", "seq")).alias("p"))
    found = got.select("seq", F.col("previous_log_time").alias("p"))
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0

    gaps = L.reading_gaps(stored)
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # one row per chunk
    by_var = {r["id_var"]: r for r in gaps.collect()}
    assert by_var.keys() == {447, 557}
    assert (by_var[447]["readings"], by_var[447]["longest_gap_ms"], by_var[447]["pauses"]) == (900, 977_000, 899)
    assert (by_var[557]["readings"], by_var[557]["longest_gap_ms"], by_var[557]["pauses"]) == (12, day, 11)
    empty = str(tmp_path / "empty")
    L.write_variable_log(log.limit(0), empty, buckets=2)
    assert L.reading_gaps(L.open_variable_log(spark, empty)).count() == 0


def test_ensure_rollup_builds_once(spark, tmp_path):
    base = float_log(spark, [("2024-01-01 10:00:00", 1, 1), ("2024-01-01 10:00:00", 2, 1)])
    path = str(tmp_path / "rollup")
    first = R.ensure_rollup(base, path)
    assert [r["distinct_vars_count"] for r in first.collect()] == [2]
    other = float_log(spark, [("2024-01-01 10:00:00", 1, 1)])
    again = R.ensure_rollup(other, path)  # exists: not rebuilt
    assert [r["distinct_vars_count"] for r in again.collect()] == [2]


def test_rollup_refresh_stream(spark, tmp_path):
    base = float_log(spark, [("2024-01-01 10:00:00", 1, 1), ("2024-01-02 10:00:00", 1, 1)])
    path, src, ckpt = str(tmp_path / "rollup"), str(tmp_path / "incoming"), str(tmp_path / "ckpt")
    R.build_rollup(base, path=path)

    def refreshed():
        R.refresh_stream(stream, path, ckpt).awaitTermination(120)
        return {(r["day"].day, r["distinct_vars_count"]) for r in spark.read.parquet(path).collect()}

    for variable, want in ((3, {(1, 1), (2, 2)}), (4, {(1, 1), (2, 3)})):
        new = float_log(spark, [("2024-01-02 10:00:00", variable, 1)])
        if variable == 3:
            new.write.parquet(src)
            stream = spark.readStream.schema(new.schema).parquet(src)
        else:  # written after the stream was made
            new.write.mode("append").parquet(src)
        assert refreshed() == want


def test_rollup_of_another_width_is_rebuilt(spark, tmp_path):
    base = float_log(spark, [("2024-01-01 10:00:00", 1, 1), ("2024-01-01 10:00:01", 2, 1)])
    path = str(tmp_path / "rollup")
    assert R.ensure_rollup(base, path).count() == 2
    assert [r["distinct_vars_count"] for r in R.ensure_rollup(base, path, bucket_s=60).collect()] == [2]


def test_json_lines(spark):
    st = spark.createDataFrame([("High Activity", 1.234567)], "state string, total_hours double")
    lines = [json.loads(r["json"]) for r in L.to_json_lines(st, "a", "b").collect()]
    assert lines[0]["count"] == 1 and lines[0]["status"] == "success" and lines[1] == {"state": "High Activity", "total_hours": 1.2346}
    empty = [json.loads(r["json"]) for r in L.to_json_lines(st.limit(0), "a", "b").collect()]
    assert [x["status"] for x in empty] == ["no_data"]


def test_malformed_lines_are_kept_and_counted(spark, tmp_path):
    good = ['"2021-03-18 03:27:10,""447"",""[[""""PLC00051"""",""""Stop, conditional"""",3,3,50331699]]""";;;',
            '"2021-03-18 05:08:35,""557"",""""";;;']
    bad = {"plain text": "no quoted row", "": "no quoted row", '"2021-03-18 03:27:10,""447""': "no quoted row", '"2021-03-18 03:27:10";;;': "wrong number of fields",
           '"2021-03-18 03:27:10,""1"",""v"",""more""";;;': "wrong number of fields", '"not a time,""447"",""v""";;;': "no time",
           '"2021-03-18 03:27:10,""x"",""v""";;;': "no variable"}
    path = tmp_path / "export.csv"
    path.write_bytes("".join(line + "\r\n" for line in ['"timestamp,""id_var"",""value""";;;', *good, *bad]).encode())
    rows, rejects = L.split_string_export(spark, str(path))
    assert sorted((r["id_var"], r["value"]) for r in rows.collect()) == [(447, '[["PLC00051","Stop, conditional",3,3,50331699]]'), (557, "")]
    assert {r["line"]: r["problem"] for r in rejects.collect()} == bad


def test_envelopes(spark):
    st = spark.createDataFrame([("High Activity", 1.234567), ("True Idle (Off)", None)],
                               "state string, total_hours double")
    env = L.to_envelope(st, "2024-01-01", "2024-01-02").collect()[0]
    doc = json.loads(env["json"])
    assert doc["status"] == "success" and doc["count"] == 2
    assert doc["period"] == {"from": "2024-01-01", "until": "2024-01-02"}
    assert {"state": "High Activity", "total_hours": 1.2346} in doc["data"]
    empty = L.to_envelope(st.limit(0), "a", "b").collect()[0]
    assert empty["status"] == "no_data" and empty["count"] == 0
    three = spark.createDataFrame([("Active", 1.006), ("Idle", 2.0)], "state string, total_hours double")
    t = L.totals_envelope(three, "a", "b").collect()[0]
    assert (t["active"], t["intermediate"], t["idle"]) == (1.01, 0.0, 2.0)


def test_standardise_columns(spark):
    df = spark.createDataFrame([("2024-01-02", "Run", 1.5), ("bad", "Idle", 2.0)],
                               "` Jour ` string, ETAT string, Duree double")
    out = L.standardise_columns(df)
    assert out.columns == ["date", "state", "total_hours"]
    rows = out.collect()
    assert rows[0]["date"].day == 2 and rows[1]["date"] is None


def test_catalogue_csv_roundtrip(spark, tmp_path):
    cat = spark.createDataFrame([("PLC1", "Door; open"), ("PLC2", "Puerta abierta")],
                                "alarm_code string, description string")
    path = str(tmp_path / "cat")
    L.write_catalogue_csv(cat, path)
    back = L.read_catalogue_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == [("PLC1", "Door; open"), ("PLC2", "Puerta abierta")]


def test_threshold_chain_without_collect(spark):
    rows = [(f"2024-01-01 10:{m:02d}:{s:02d}", v, 1) for m in range(3) for s in range(60)
            for v in range(1 + (s % 4))]
    fl = float_log(spark, rows)
    rollup = A.distinct_vars_per_second(fl)
    th = A.multiotsu_thresholds(A.smoothed_signal(rollup))
    t1 = th.select("threshold_1").scalar()
    t2 = th.select("threshold_2").scalar()
    out = A.four_state_totals(fl, low=t1, mid=t2)
    assert abs(sum(r["total_hours"] or 0 for r in out.collect()) - (180 - 14) / 3600) < 1e-9
