"""Adapters from the driver tables to the telemetry data model.

The driver ships one log-shaped table, ``events``.  These functions derive the
telemetry inputs of the library from it (narrow float log, alarm string log,
program-state variables, alert messages, variable dictionary, units, energy
log, program runs).  Each definition has a twin DuckDB CTE in
``machlog/oracle.py`` with the same text-level semantics, so the oracle reads
exactly the same derived rows.

Every derived row comes from a row of ``events``: the work of each registered
query grows with the table.  ``seq`` (the event id) is carried as a unique
tiebreak so ordered windows are deterministic when two rows share a
millisecond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from machlog.config import A7_SENSORS

# Variables with a fixed meaning in the derived model (fixed values).
SPECIAL_VARS = [
    (260, "SPINDLE_LOAD_PCT", "Float"),
    (630, "MANDRINO_CONSUMO_VISUALIZADO", "Float"),
    (447, "PLC_ALARM_LIST", "String"),
    (557, "PROGRAM_FILE_STATUS", "String"),
    (828, "PROGRAM_RUNNING", "Float"),
    (575, "PROGRAM_ACTIVE", "Float"),
    (9001, "ALARMS", "String"),
    (9002, "EASY_LOG_MESSAGE", "String"),
]
MSG_VAR_OFFSET = 20000
LOAD_VAR_OFFSET = 10000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def _ms(ts: str = "ts"):
    # epoch milliseconds, floored (unix_micros floors like DuckDB epoch_us)
    return F.expr(f"unix_micros(CAST({ts} AS TIMESTAMP)) div 1000")


def _tick_ms(ts: str = "ts", seconds: int = 600):
    us = seconds * 1_000_000
    return F.expr(f"(unix_micros(CAST({ts} AS TIMESTAMP)) div {us}) * {seconds * 1000}")


def _k():
    # props is '{"k": <n>}': the number between ': ' and '}' (plain string
    # cuts, no regex).
    return F.substring_index(F.substring_index("props", ": ", -1), "}", 1).cast("int")


def float_log(ev: DataFrame) -> DataFrame:
    """``fl``: one reading per event; variable = user."""
    return ev.select(
        _ms().alias("date"),
        F.col("user_id").cast("int").alias("id_var"),
        F.col("value").cast("double").alias("value"),
        F.col("event_id").alias("seq"),
    )


def sensor_log(ev: DataFrame) -> DataFrame:
    """``fl16``: the 16 pivot sensors, variable = sensor ``user_id % 16``."""
    ids = F.array(*[F.lit(i) for i in A7_SENSORS])
    return ev.select(
        _ms().alias("date"),
        F.element_at(ids, (F.col("user_id") % 16 + 1).cast("int")).alias("id_var"),
        F.col("value").cast("double").alias("value"),
        F.col("event_id").alias("seq"),
    )


def alarm_log(ev: DataFrame) -> DataFrame:
    """``sl``: string log of alarm arrays (var 447) and file status (557)."""
    nn = F.lpad(_k().cast("string"), 2, "0")
    entry = F.concat(F.lit('["PLC000'), nn, F.lit('","'), F.col("event_type"),
                     F.lit('",3,3,'), F.col("event_id").cast("string"), F.lit("]"))
    shared = F.when(F.col("event_id") % 2 == 0,
                    F.concat(F.lit(',["PLC00100","shared",3,1,'),
                             F.col("event_id").cast("string"), F.lit("]"))
                    ).otherwise(F.lit(""))
    value = (F.when(F.col("event_type") == "view", F.lit("[]"))
             .when(F.col("event_id") % 97 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("["), entry, shared, F.lit("]"))))
    return ev.select(
        _ms().alias("date"),
        F.when(F.col("event_id") % 3 != 0, F.lit(447)).otherwise(F.lit(557)).alias("id_var"),
        value.alias("value"),
        F.col("event_id").alias("seq"),
    )


def load_log(ev: DataFrame) -> DataFrame:
    """Float log holding the two load-percent variables (630 from ``view``
    events, 260 from ``click`` events) among other variables."""
    vid = (F.when(F.col("event_type") == "view", F.lit(630))
           .when(F.col("event_type") == "click", F.lit(260))
           .otherwise(F.col("user_id").cast("int") + LOAD_VAR_OFFSET))
    return ev.select(
        _ms().alias("date"),
        vid.alias("id_var"),
        F.col("value").cast("double").alias("value"),
        F.col("event_id").alias("seq"),
    )


def program_log(ev: DataFrame) -> DataFrame:
    """``prog``: two 0/1 program-state variables on ten-minute ticks."""
    return ev.filter(F.col("event_type").isin("click", "purchase")).select(
        _tick_ms().alias("date"),
        F.when(F.col("event_type") == "click", F.lit(828)).otherwise(F.lit(575)).alias("id_var"),
        F.when(F.col("value") > 40, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"),
        F.col("event_id").alias("seq"),
    )


def message_log(ev: DataFrame) -> DataFrame:
    """``msgs``: alert messages on ten-minute ticks (same ticks as ``prog``)."""
    ev = ev.withColumn("_k", _k())
    k = F.col("_k")
    msg = (F.when(k % 6 == 0, F.concat(F.lit("Spindle overheat detected ZONE_"), (k % 5).cast("string")))
           .when(k % 6 == 1, F.concat(F.lit("Puerta abierta - seguridad EJE "), F.expr("chr(88 + _k % 3)")))
           .when(k % 6 == 2, F.concat(F.lit("Power supply voltage low CONVEYOR "), (k % 4).cast("string")))
           .when(k % 6 == 3, F.concat(F.lit("Parada de emergencia MANDRINO "), (k % 2).cast("string")))
           .when(k % 6 == 4, F.concat(F.lit("Axis encoder fault AXIS_"), (k % 3).cast("string")))
           .otherwise(F.concat(F.lit("info: zone_"), (k % 9).cast("string"), F.lit(" cycle complete"))))
    vid = (F.when(F.col("event_type") == "error", F.lit(9001))
           .when(F.col("event_type") == "signup", F.lit(9002))
           .otherwise(F.col("user_id").cast("int") + MSG_VAR_OFFSET))
    return ev.select(
        _tick_ms().alias("date"),
        vid.alias("id_var"),
        msg.alias("value"),
        F.col("event_id").alias("seq"),
    )


def variables(ev: DataFrame) -> DataFrame:
    """``vars`` (id, name, datatype): fixed special variables, one float
    variable per user and one message variable per user."""
    spark = ev.sparkSession
    special = spark.createDataFrame(SPECIAL_VARS, "id int, name string, datatype string")
    special_ids = [v[0] for v in SPECIAL_VARS]
    users = ev.select(F.col("user_id").cast("int").alias("u")).distinct()
    u = F.col("u")
    fname = (F.when(u % 4 == 0, F.concat(F.lit("ENERGY_METER_"), u.cast("string")))
             .when(u % 4 == 1, F.concat(F.lit("SPINDLE_POWER_KW_"), u.cast("string")))
             .when(u % 4 == 2, F.concat(F.lit("AXIS_TEMP_"), u.cast("string")))
             .otherwise(F.concat(F.lit("CYCLE_COUNTER_"), u.cast("string"))))
    floats = users.filter(~u.isin(special_ids)).select(
        u.alias("id"), fname.alias("name"), F.lit("Float").alias("datatype"))
    sname = (F.when(u % 6 == 0, F.concat(F.lit("ZONE_"), (u % 10).cast("string"), F.lit("_ALARM")))
             .when(u % 6 == 1, F.concat(F.lit("CONVEYOR "), (u % 7).cast("string"), F.lit(" FAULT")))
             .when(u % 6 == 2, F.concat(F.lit("SPINDLE"), (u % 3).cast("string"), F.lit("_ALERT")))
             .when(u % 6 == 3, F.concat(F.lit("AXIS_"), F.expr("chr(65 + u % 3)"), F.lit("_ERROR_CODE")))
             .when(u % 6 == 4, F.concat(F.lit("OPERATOR_NOTE_"), u.cast("string")))
             .otherwise(F.concat(F.lit("zone_"), (u % 4).cast("string"), F.lit("_alarm"))))
    strings = users.select((u + MSG_VAR_OFFSET).alias("id"), sname.alias("name"),
                           F.lit("String").alias("datatype"))
    return special.unionByName(floats).unionByName(strings)


def units(vars_df: DataFrame) -> DataFrame:
    """``units`` (name, prettyname, units) built from variable names: even ids
    are found by name, odd ids by pretty name, every third id has none."""
    i, n = F.col("id"), F.col("name")
    unit = (F.when(n.contains("KW"), F.lit("kW"))
            .when(n.contains("ENERGY"), F.lit("kWh"))
            .when(n.contains("TEMP"), F.lit("C"))
            .when(n.contains("CONSUMO") | n.contains("PCT"), F.lit("%")))
    return vars_df.filter((i % 3 != 2) & (F.col("datatype") == "Float")).select(
        F.when(i % 2 == 0, n).otherwise(F.concat(F.lit("U_"), i.cast("string"))).alias("name"),
        F.when(i % 2 == 1, F.lower(n)).otherwise(F.concat(F.lit("Pretty "), n)).alias("prettyname"),
        unit.alias("units"),
    )


def energy_log(ev: DataFrame) -> DataFrame:
    """``elog``: (energy_timestamp, kwh_value)."""
    return ev.select(F.col("ts").cast("timestamp").alias("energy_timestamp"),
                     F.col("value").cast("double").alias("kwh_value"))


def program_runs(ev: DataFrame) -> DataFrame:
    """``prog_runs``: (date, machine, program, duration_min)."""
    return ev.select(
        F.to_date(F.col("ts").cast("timestamp")).alias("date"),
        F.concat(F.lit("M"), (F.col("user_id") % 3).cast("string")).alias("machine"),
        F.col("event_type").alias("program"),
        F.col("value").cast("double").alias("duration_min"),
    )


def operating_time(runs: DataFrame) -> DataFrame:
    """(date, machine, Operating, Standby) hours per machine and day."""
    op = F.sum("duration_min") / F.lit(60.0)
    return (runs.groupBy("date", "machine")
            .agg(op.alias("Operating"))
            .withColumn("Standby", F.greatest(F.lit(24.0) - F.col("Operating"), F.lit(0.0))))
