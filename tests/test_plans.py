"""The distributed building blocks against their single-task definitions."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from machlog import config as C
from machlog.functions import classify as CL
from machlog.plans.quantiles import exact_quantiles
from machlog.plans.sequence import cut_by_density, ms_bucket, ordered_window, time_bucket
from machlog.sources import adapters as ad
from machlog.sources import logs as L

SF = "/root/testdata/sf0.01"


def test_ordered_window_equals_global_window(spark):
    fl = ad.float_log(ad.events(spark, SF))
    # drop three whole days so buckets are not contiguous
    fl = fl.filter(~F.to_date(F.timestamp_millis("date")).isin("2024-01-05", "2024-01-06", "2024-01-07"))
    fl = fl.withColumn("flag", (F.col("value") > 100).cast("int"))
    for seconds in (3600, 86400):
        got = ordered_window(fl, order=["date", "seq"], bucket=ms_bucket("date", seconds),
                             lags={"prev": ("value", -1.0)}, leads={"nxt": ("date", None)},
                             running_sums={"run": "flag"})
        w = Window.orderBy("date", "seq")
        want = fl.select("*", F.lag("value", 1, -1.0).over(w).alias("prev"),
                         F.lead("date").over(w).alias("nxt"),
                         F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
        cols = ["date", "seq", "prev", "nxt", "run"]
        assert got.select(cols).exceptAll(want.select(cols)).count() == 0
        assert want.select(cols).exceptAll(got.select(cols)).count() == 0


def test_null_order_values_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (1_700_000_000_000, 2), (None, 3), (1_700_000_100_000, 4)],
                               "date bigint, seq int")
    got = ordered_window(df, order=["date", "seq"], bucket=ms_bucket("date", 3600),
                         lags={"prev": ("seq", 0)}, leads={"nxt": ("seq", 9)})
    w = Window.orderBy("date", "seq")
    want = df.select("*", F.lag("seq", 1, 0).over(w).alias("prev"), F.lead("seq", 1, 9).over(w).alias("nxt"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(map(tuple, want.collect()), key=lambda r: r[1])
    assert got.count() == 4


def test_keyed_ordered_window(spark):
    fl = ad.float_log(ad.events(spark, SF)).withColumn("k", F.col("id_var") % 3)
    got = ordered_window(fl, order=["date", "seq"], keys=["k"], bucket=time_bucket(F.timestamp_millis("date"), 7200),
                         lags={"prev": ("date", None)})
    want = fl.withColumn("prev", F.lag("date").over(Window.partitionBy("k").orderBy("date", "seq")))
    cols = ["k", "date", "seq", "prev"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert got.count() == want.count()


def test_exact_quantiles_match_percentile(spark):
    rnd = random.Random(7)
    rows = [(f"g{rnd.randint(0, 2)}", float(rnd.randint(0, 50))) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q1"], r["median"], r["q3"]) for r in
           exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75], names=["q1", "median", "q3"]).collect()}
    want = {r["g"]: tuple(r["p"]) for r in
            df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.75]).alias("p")).collect()}
    assert got.keys() == want.keys()
    for g in got:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[g], want[g]))


EXPORT = (
    '"timestamp,""id_var"",""value""";;;\r\n'
    '"2021-03-18 03:27:10,""447"",""[[""""PLC00051"""",""""Stop, conditional"""",3,3,50331699]]""";;;\r\n'
    '"2021-03-18 05:04:05,""447"",""[]""";;;\r\n'
    '"2021-03-18 05:08:35,""557"",""""";;;\r\n'
    '"2021-03-18 05:11:07,""594"",""TNC:\\nc_prog\\$mdi.h""";;;\r\n'
)


def test_read_string_export_tolerates_bad_lines(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_bytes((EXPORT + '"not a time,""x"",""v""";;;\r\n').encode())
    rows = L.read_string_export(spark, str(p)).collect()
    assert len(rows) == 5
    bad = [r for r in rows if r["value"] == "v"][0]
    assert bad["ts"] is None and bad["id_var"] is None


def test_read_string_export(spark, tmp_path):
    p = tmp_path / "export.csv"
    p.write_bytes(EXPORT.encode())
    rows = L.read_string_export(spark, str(p)).orderBy("ts").collect()
    assert [r["id_var"] for r in rows] == [447, 447, 557, 594]
    assert rows[0]["value"] == '[["PLC00051","Stop, conditional",3,3,50331699]]'
    assert rows[1]["value"] == "[]" and rows[2]["value"] == ""
    assert rows[3]["value"] == "TNC:\\nc_prog\\$mdi.h"
    assert rows[0]["ts"].strftime("%H:%M:%S") == "03:27:10"


def test_bucket_width_does_not_change_results(spark):
    from machlog.operators import alarms as B
    from machlog.operators import energy as E

    ev = ad.events(spark, "/root/testdata/sf0.001")
    sl, load = ad.alarm_log(ev), ad.load_log(ev)
    a = B.alarm_statistics(B.alarm_incidents(sl))
    b = B.alarm_statistics(B.alarm_incidents(sl, rows=7))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    e1 = E.daily_energy(load).select("day", F.round("total_energy_kwh", 9).alias("k"))
    e2 = E.daily_energy(load, rows=5).select("day", F.round("total_energy_kwh", 9).alias("k"))
    assert e1.exceptAll(e2).count() == 0 and e2.exceptAll(e1).count() == 0


def test_buckets_follow_the_density(spark):
    """Sparse, dense and bursting logs: buckets of about the wished size, values as in one window."""
    fl = ad.float_log(ad.events(spark, "/root/testdata/sf0.001")).select("date", "seq", "value")
    copies = fl.select("value", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"), "date", "seq")
    dense = copies.select((F.col("date") + F.col("k") * 977).alias("date"), (F.col("seq") * 100 + F.col("k")).alias("seq"), "value")
    burst = dense.withColumn("date", F.when(F.col("seq") % 3 == 0, F.lit(1_704_500_400_000) + F.col("seq") * 7919 % 600_000).otherwise(F.col("date")))
    for log, wished in ((fl, 100), (dense, 2000), (burst, 2000)):
        cut = cut_by_density(log, F.col("date"), "b", wished).cache()
        assert cut.columns == [*log.columns, "b"]
        per = cut.groupBy("b").agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")).orderBy("b").collect()
        rows = log.count()
        assert max(r["n"] for r in per) < 3 * wished + rows / 20 and len(per) < 3 * rows / wished + 2
        assert all(a["hi"] <= b["lo"] for a, b in zip(per, per[1:]))  # monotone in time
        got = ordered_window(cut, order=["date", "seq"], bucket=F.col("b"), lags={"prev": ("seq", None)}, leads={"nxt": ("seq", None)})
        assert got.filter("prev IS NULL").count() == got.filter("nxt IS NULL").count() == 1
        back = got.select("seq", "nxt").join(got.select(F.col("seq").alias("nxt"), "prev"), "nxt").filter("seq = prev")
        assert back.count() == rows - 1
        cut.unpersist()


def test_cut_keeps_null_times(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (None, 3), (700_000, 4)], "date bigint, seq int")
    got = {r["seq"]: r["b"] for r in cut_by_density(df, F.col("date"), "b", 1).collect()}
    assert got[1] is None and got[3] is None and got[2] < got[4]


def test_window_shares_its_exchange_with_the_edges(spark):
    from machlog.operators import alarms as B

    out = B.time_since_previous(ad.alarm_log(ad.events(spark, "/root/testdata/sf0.001")))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan parquet") == 2, final  # the rows, and their times for the cut


def test_running_sum_over_nulls_and_sparse_buckets(spark):
    rows = [(i * 40_000_000, None if i % 3 else i) for i in range(60)] + [(None, 5)]
    df = spark.createDataFrame(rows, "date bigint, v int")
    got = ordered_window(df, order=["date"], bucket=ms_bucket("date", 10), running_sums={"s": "v"})
    want = df.select("*", F.sum("v").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_exact_quantiles_with_extreme_value(spark):
    df = spark.range(2000).select(F.lit("g").alias("g"), F.when(F.col("id") == 7, 1e300).otherwise(
        F.col("id").cast("double")).alias("v"))
    got = exact_quantiles(df, ["g"], "v", [0.25, 0.5], names=["a", "b"]).first()
    want = df.agg(F.percentile("v", [0.25, 0.5])).first()[0]
    assert [got["a"], got["b"]] == want


def _squared_error(rows, groups):
    total = 0.0
    for g in groups:
        n = sum(rows[v] for v in g)
        if n:
            mean = sum(v * rows[v] for v in g) / n
            total += sum(rows[v] * (v - mean) ** 2 for v in g)
    return total


def test_kmeans_is_optimal(spark):
    """Equal to the best of all cut pairs, and never worse than rounds of assignment from any start."""
    from machlog.operators import activity as A

    schema = "distinct_vars_count bigint, number_of_seconds bigint"
    r = A.kmeans_thresholds(spark.createDataFrame([(1, 10), (2, 10), (10, 5), (11, 5), (30, 2)], schema)).first()
    assert (r["centroid_1"], r["centroid_2"], r["centroid_3"]) == (1.5, 10.5, 30.0)
    assert (r["t1_int"], r["t2_int"]) == (6, 20)
    draw = random.Random(9)
    for _ in range(6):
        rows = {draw.randint(0, 60): draw.randint(1, 40) for _ in range(draw.randint(3, 14))}
        values = sorted(rows)
        if len(values) < 3:
            continue
        r = A.kmeans_thresholds(spark.createDataFrame(list(rows.items()), schema)).first()
        at = lambda t1, t2: [[v for v in values if v <= t1], [v for v in values if t1 < v <= t2], [v for v in values if v > t2]]
        got = _squared_error(rows, at(r["threshold_1"], r["threshold_2"]))
        best = min(_squared_error(rows, [values[:i], values[i:j], values[j:]]) for i in range(1, len(values)) for j in range(i + 1, len(values)))
        assert abs(got - best) < 1e-6 * (1 + best)
        for _ in range(10):
            c = sorted(draw.sample(values, 3))
            for _ in range(30):
                groups = at((c[0] + c[1]) / 2, (c[1] + c[2]) / 2)
                c = [sum(v * rows[v] for v in g) / sum(rows[v] for v in g) if g else old for g, old in zip(groups, c)]
            assert got <= _squared_error(rows, groups) + 1e-6


def test_kmeans_of_few_values(spark):
    from machlog.operators import activity as A

    hist = lambda rows: spark.createDataFrame(rows, "distinct_vars_count bigint, number_of_seconds bigint")
    two = A.kmeans_thresholds(hist([(1, 3), (5, 1)])).first()
    assert (two["centroid_1"], two["centroid_2"], two["centroid_3"]) == (1.0, 2.0, 5.0)
    one = A.kmeans_thresholds(hist([(4, 3)])).first()
    assert (one["centroid_1"], one["threshold_1"], one["t2_int"]) == (4.0, 4.0, 4)
    assert A.kmeans_thresholds(hist([])).first()["threshold_1"] is None


def test_segments_against_a_loop(spark):
    """One pass over buckets of any width: runs that cross buckets, empty buckets, a state before the first row."""
    from machlog.operators import activity as A

    draw = random.Random(2)
    start = 1_704_067_200
    for first in (-1, 0, 1):
        seconds = sorted(draw.sample(range(0, 4000), 300))
        states = [first] * 3 + [draw.choice([0, 0, 0, 1]) for _ in seconds[3:]]
        df = spark.createDataFrame([(start + t, x) for t, x in zip(seconds, states)], "s bigint, state_num int")
        df = df.select(F.timestamp_seconds("s").alias("ts"), "state_num")
        want, last = [], -1
        for t, x in zip(seconds, states):
            if x != last:
                want.append([x, start + t])
            last = x
        ends = [w[1] for w in want[1:]] + [start + seconds[-1] + 1]
        want = [(x == 1, t, e) for (x, t), e in zip(want, ends)]
        for span in (60, 86400):
            got = A.segments(df, span_s=span).select((F.col("state") == "WORKING").alias("on"), F.unix_seconds("period_start").alias("a"),
                                                     F.unix_seconds("period_end").alias("b")).collect()
            assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert A.segments(df.limit(0)).count() == 0


def test_otsu_runs_nothing_before_the_action(spark):
    from machlog.operators import activity as A

    signal = spark.range(1000).select((F.col("id") % 97).cast("double").alias("smoothed_count"))
    spark.sparkContext.setJobGroup("plan-only", "")
    th = A.multiotsu_thresholds(signal)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")
    assert th.count() == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert A.multiotsu_thresholds(signal.limit(0)).count() == 0


def test_patterns_run_once_per_text(spark):
    from machlog.operators import alarms as B

    msgs = spark.createDataFrame([(i % 5, f"ZONE {i % 3} stop" if i % 7 else None, i) for i in range(200)], "id_var int, value string, seq int")
    vars_df = spark.createDataFrame([(i, f"ALARMS_Z{i}") for i in range(5)], "id int, name string")
    out = B.message_locations(msgs, vars_df)
    assert out.count() == 200
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    for line in logical.splitlines():  # patterns stand above an aggregate of the texts or over the variables, never on the rows
        if "regexp_extract(value" in line:
            assert "seq" not in line, line
    direct = msgs.join(vars_df, F.col("id_var") == F.col("id")).select(
        "seq", CL.location(F.col("name"), F.col("value")).alias("location"), CL.location(F.col("name")).alias("name_location"))
    cols = ["seq", "location", "name_location"]
    assert out.select(cols).exceptAll(direct).count() == 0 and direct.exceptAll(out.select(cols)).count() == 0
    classes = B.message_classes(msgs)
    assert classes.exceptAll(msgs.withColumn("alert_type", CL.classify(F.col("value"), C.B23_CLASSES))).count() == 0 and classes.count() == 200


def test_sketches_of_days_merge_within_their_error(spark):
    from machlog.plans.quantiles import day_sketches, merged_quantiles

    df = spark.range(60_000).select((F.col("id") % 3).alias("machine"), (F.col("id") % 20).alias("day"),
                                    (F.pow(F.rand(5), 3) * 1000).alias("v")).cache()
    sketches = day_sketches(df, ["machine"], "day", "v").cache()
    assert sketches.count() == 60
    qs, names = [0.1, 0.5, 0.9], ["a", "b", "c"]
    for days in (range(20), range(5)):
        some = sketches.filter(F.col("day").isin(list(days)))
        rows = df.filter(F.col("day").isin(list(days)))
        exact = {r["machine"]: r for r in exact_quantiles(rows, ["machine"], "v", qs, names=names).collect()}
        got = merged_quantiles(some, ["machine"], qs, names).collect()
        assert {r["machine"] for r in got} == set(exact)
        for r in got:
            values = sorted(x["v"] for x in rows.filter(F.col("machine") == r["machine"]).select("v").collect())
            for q, name in zip(qs, names):
                rank = sum(v <= r[name] for v in values) / len(values)
                true = sum(v <= exact[r["machine"]][name] for v in values) / len(values)
                assert abs(rank - true) < 0.03


def test_sweep_equals_the_interval_join(spark):
    from machlog.operators import alarms as B

    draw = random.Random(11)
    at = lambda d, m: f"2024-01-{d:02d} {m // 60:02d}:{m % 60:02d}:00"
    pieces = []
    for d in (1, 2):
        for _ in range(12):
            a = draw.randint(0, 1300)
            pieces.append((d, a, draw.choice([a, a + 10, a + 120])))
    pieces += [(3, 0, 1439)]  # a day-long piece
    alerts = [(draw.randint(1, 4), draw.choice([p[1] for p in pieces] + [p[2] for p in pieces] + list(range(0, 1400, 40))),
               draw.choice(["X", "Y"]), draw.choice(["L", None])) for _ in range(150)]
    p = spark.createDataFrame([(d, at(d, a), at(d, b)) for d, a, b in pieces], "d int, a string, b string").select(
        F.to_date("a").alias("day"), F.col("a").cast("timestamp").alias("start_ts"), F.col("b").cast("timestamp").alias("end_ts"))
    c = spark.createDataFrame([(at(d, m), t, x) for d, m, t, x in alerts], "a string, alert_type string, location string").select(
        F.to_date("a").alias("day"), F.col("a").cast("timestamp").alias("ts_utc"), "alert_type", "location")
    want = {}
    for d, m, t, x in alerts:
        n = sum(1 for e, a, b in pieces if e == d and a <= m <= b)
        total, during = want.get((d, t, x), (0, 0))
        want[d, t, x] = (total + max(n, 1), during + n)
    for rows in (100_000, 5):
        got = B.alerts_during_runs(c, p, rows=rows)
        assert {(r["day"].day, r["alert_type"], r["location"]): (r["events_total"], r["events_during_program"]) for r in got.collect()} == want


def test_incidents_against_a_loop(spark):
    """Ties within a second, several entries per row, buckets of a few rows: one start wherever an entry's last end is before the row."""
    from machlog.operators import alarms as B

    draw = random.Random(4)
    for span, rows in ((40, 100_000), (40, 3), (300, 7)):
        log = []
        for seq in range(120):
            codes = [draw.choice("ABC") for _ in range(draw.randint(0, 3))]
            log.append((1_704_067_200_000 + draw.randint(0, span * 1000), 447, "[" + ",".join(f'["{c}","t",3,3,1]' for c in codes) + "]", seq))
        log.append((None, 447, '[["A","t",3,3,1]]', 999))  # no time: left out
        got = B.alarm_incidents(spark.createDataFrame(log, "date bigint, id_var int, value string, seq bigint"), rows=rows)
        got = sorted((r["alarm_code"], r["s"]) for r in got.select("alarm_code", F.unix_seconds("start_time").alias("s")).collect())
        timed = sorted((r for r in log if r[0] is not None), key=lambda r: (r[0], r[3]))
        want, ends = [], {}
        for row, after in zip(timed, timed[1:]):
            for c in sorted({c for c in "ABC" if f'"{c}"' in row[2]}):
                if c not in ends or ends[c] < row[0] // 1000:
                    want.append((c, row[0] // 1000))
                ends[c] = after[0] // 1000
        assert got == sorted(want)


def test_incidents_need_one_exchange_of_the_rows(spark):
    from machlog.operators import alarms as B

    out = B.alarm_incidents(ad.alarm_log(ad.events(spark, "/root/testdata/sf0.001")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    # the times' cells, the rows by bucket (once more for the edges, shared at run time), the starts
    assert len({line.split("hashpartitioning(")[1].split("#")[0] for line in rows}) == 3, plan
    assert plan.count("Generate inline") == 1
