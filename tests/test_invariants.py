"""Invariants on the driver data (SURVEY section 5: reconciled totals,
decile shape, ordered thresholds)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from machlog.operators import activity as A
from machlog.operators import energy as E
from machlog.sources import adapters as ad

SF = "/root/testdata/sf0.01"
B = 600


def test_four_state_total_reconciles_with_span(spark):
    fl = ad.float_log(ad.events(spark, SF))
    rollup = A.distinct_vars_per_second(fl, B)
    total_h = sum(r["total_hours"] or 0.0 for r in A.four_state_totals(fl, bucket_s=B, low=2.45, mid=2.7).collect())
    first, last, n = rollup.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    warmup_rows = rollup.groupBy(F.to_date("ts")).count().select(
        F.sum(F.least(F.col("count"), F.lit(14)))).first()[0]
    span_h = ((last - first).total_seconds() + B) / 3600
    assert math.isclose(total_h + warmup_rows * B / 3600, span_h, rel_tol=1e-9)


def test_energy_split_equals_unsplit_hours(spark):
    t = ad.events(spark, SF)
    load, vars_df = ad.load_log(t), ad.variables(t)
    split_h = sum(r["total_duration_h"] for r in E.energy_per_day(load, vars_df).collect())
    s = E.load_samples(load, vars_df=vars_df, name="MANDRINO_CONSUMO_VISUALIZADO")
    first, last = s.agg(F.min("ts"), F.max("ts")).first()
    assert math.isclose(split_h, (last - first).total_seconds() / 3600, rel_tol=1e-9)


def test_decile_shape(spark):
    t = ad.events(spark, SF)
    rows = A.decile_distribution(ad.float_log(t), ad.alarm_log(t)).collect()
    assert [r["decile"] for r in rows] == list(range(1, 11))
    assert sum(r["days_in_bin"] for r in rows) == 30
    assert all(a["max_in_bin"] <= b["min_in_bin"] for a, b in zip(rows, rows[1:]))


def test_thresholds_ordered_and_in_range(spark):
    fl = ad.float_log(ad.events(spark, SF))
    rollup = A.distinct_vars_per_second(fl, B)
    km = A.kmeans_thresholds(A.count_distribution(rollup)).first()
    sm = A.smoothed_signal(rollup)
    lo, hi = sm.agg(F.min("smoothed_count"), F.max("smoothed_count")).first()
    ot = A.multiotsu_thresholds(sm).first()
    c_lo, c_hi = rollup.agg(F.min("distinct_vars_count"), F.max("distinct_vars_count")).first()
    assert c_lo <= km["threshold_1"] <= km["threshold_2"] <= c_hi
    assert lo <= ot["threshold_1"] < ot["threshold_2"] <= hi


def test_segment_durations_cover_the_log(spark):
    fl = ad.float_log(ad.events(spark, SF))
    segs = A.three_state_segments(fl, 2, 3, B)
    total = segs.agg(F.sum("duration_s")).first()[0]
    first, last = A.distinct_vars_per_second(fl, B).agg(F.min("ts"), F.max("ts")).first()
    assert math.isclose(total, (last - first).total_seconds() + B)
