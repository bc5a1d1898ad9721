"""The service facade on driver data, and B19's per-severity ordering."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from machlog import services as S
from machlog.operators import alarms as B
from machlog.sources import adapters as ad

SF = "/root/testdata/sf0.01"
PERIOD = ("2024-01-01", "2024-01-30")


def test_services_agree_with_operators(spark):
    ev = ad.events(spark, SF)
    fl, sl, load = ad.float_log(ev), ad.alarm_log(ev), ad.load_log(ev)
    states = S.state_times(fl, *PERIOD, bucket_s=600, low=2.45, mid=2.7)
    assert {r["state"] for r in states.collect()} == {
        "True Idle (Off)", "Low Activity", "Intermediate Activity", "High Activity"}
    alarms = S.machine_alarms(sl, *PERIOD)
    assert alarms.columns == ["alarm_code", "alarm_text", "occurrence_count", "last_seen"]
    energy = S.energy_consumption(load, *PERIOD)
    kpi = S.dashboard_kpis(fl, sl, *PERIOD, bucket_s=600).collect()[0]
    total_alarms = alarms.agg(F.sum("occurrence_count")).first()[0]
    assert kpi["alarms"] == total_alarms
    assert math.isclose(kpi["energy"], S.energy_consumption(fl, *PERIOD).agg(
        F.coalesce(F.sum("total_energy_kwh"), F.lit(0.0))).first()[0])
    assert energy.count() == 30
    env = S.respond(states, *PERIOD).collect()[0]
    assert env["status"] == "success" and env["count"] == 4


def test_severity_tables_newest_first(spark):
    stats = spark.createDataFrame(
        [("A", "x", 1, "2024-01-02 00:00:00"), ("B", "stop", 3, "2024-01-03 00:00:00"),
         ("C", "y", 2, "2024-01-04 00:00:00")],
        "alarm_code string, alarm_text string, occurrence_count bigint, t string") \
        .select("alarm_code", "alarm_text", "occurrence_count", F.to_timestamp("t").alias("last_seen"))
    sev = B.with_severity(stats)
    info = [r["alarm_code"] for r in B.alarms_by_severity(sev, "INFO").collect()]
    assert info == ["C", "A"]
    assert [r["alarm_code"] for r in B.alarms_by_severity(sev, "CRITIQUE").collect()] == ["B"]
