"""Sources and sinks.

Logs are stored as Parquet partitioned by ``day`` (the per-day partition is
the access path that replaces the database index); ``load_logs`` reads them
with fixed schemas, so no inference job runs and column pruning reaches the
scan.  A second layout (``write_variable_log``) stores a log in buckets by
variable, for queries per variable.  A JDBC source with a partitioned read is accepted as well.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog import config as C
from machlog.functions.timefn import day_of, second_ts
from machlog.plans.sequence import ROWS_PER_BUCKET, cut_by_density
from machlog.session import ensure_checkpoint_dir

FLOAT_LOG = T.StructType([T.StructField("date", T.LongType()), T.StructField("id_var", T.IntegerType()),
                          T.StructField("value", T.DoubleType())])
STRING_LOG = T.StructType([T.StructField("date", T.LongType()), T.StructField("id_var", T.IntegerType()),
                           T.StructField("value", T.StringType())])
VARIABLE = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()),
                         T.StructField("datatype", T.StringType())])
UNITS = T.StructType([T.StructField("name", T.StringType()), T.StructField("prettyname", T.StringType()),
                      T.StructField("units", T.StringType())])
ENERGY_LOG = T.StructType([T.StructField("energy_timestamp", T.TimestampType()),
                           T.StructField("kwh_value", T.DoubleType())])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/machlog-tables/{name}-{uuid.uuid4().hex[:12]}"


def write_log(log: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store a log as Parquet partitioned by ``day`` (UTC).  Rows are
    range-partitioned on (day, date): files stay day-aligned and time-sorted,
    and a busy day is written by several tasks instead of one."""
    spark = log.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (log.withColumn("day", day_of(second_ts("date")))
     .repartitionByRange(n, "day", "date")
     .write.mode("overwrite").partitionBy("day").parquet(path))


def _with_schema(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ("day",)) -> DataFrame:
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    cols += [F.col(c) for c in keep if c in df.columns and c not in schema.fieldNames()]
    return df.select(*cols)


def load_logs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``{'fl', 'sl', 'vars', 'units'}`` from ``path/<table>`` (Parquet,
    logs partitioned by day), fixed schemas."""
    def read(name: str, schema: T.StructType, partitioned: bool) -> DataFrame:
        full = schema
        if partitioned:
            full = T.StructType(schema.fields + [T.StructField("day", T.DateType())])
        return _with_schema(spark.read.schema(full).parquet(f"{path}/{name}"), schema)

    return {"fl": read("variable_log_float", FLOAT_LOG, True),
            "sl": read("variable_log_string", STRING_LOG, True),
            "vars": read("variable", VARIABLE, False),
            "units": read("units", UNITS, False)}


def read_log(spark: SparkSession, path: str, schema: T.StructType = FLOAT_LOG) -> DataFrame:
    """I1 for one log table (Parquet partitioned by ``day``)."""
    full = T.StructType(schema.fields + [T.StructField("day", T.DateType())])
    return _with_schema(spark.read.schema(full).parquet(path), schema)


#: Cells in which ``write_variable_log`` counts a variable's rows: days.
DAY_MS = 86_400_000
#: Chunk of the rows without a time or a variable; they sort first.
NO_CHUNK = -1


def write_variable_log(log: DataFrame, path: str, buckets: int | None = None, rows: int = ROWS_PER_BUCKET) -> None:
    """I1, second layout: a log stored once by variable and in time order.

    Every variable's rows are cut in time into chunks of about ``rows`` rows (column
    ``chunk``, from 0, monotone in ``date``), and the table is bucketed on (id_var,
    chunk) and sorted by them and the time: a sparse variable lies in one bucket, one that
    holds a third of the log is spread over all of them.  Windows and sums per (id_var,
    chunk) read it without an exchange; only one edge row per chunk travels.  Rows without a time
    or a variable keep the chunk -1.  Each bucket is one file of one task, so ``buckets``
    (default: the shuffle partitions) should make them 128 to 256 MB.

    ``path`` gets ``rows`` and ``layout`` (the number of buckets and the columns), from
    which another session opens the table again."""
    spark = log.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _variable_table(path)
    cut = cut_by_density(log, F.col("date"), "chunk", rows, DAY_MS, keys=["id_var"])
    cut = cut.withColumn("chunk", F.coalesce("chunk", F.lit(NO_CHUNK).cast("bigint")))
    order = ["id_var", "chunk", "date"] + (["seq"] if "seq" in log.columns else [])
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: only a former entry of the catalogue goes
    (cut.repartition(n, "id_var", "chunk").write.mode("overwrite").format("parquet").option("path", f"{path}/rows")
     .bucketBy(n, "id_var", "chunk").sortBy(*order).saveAsTable(name))
    (spark.createDataFrame([(n, cut.schema.json(), order)], "buckets int, columns string, sorted array<string>")
     .write.mode("overwrite").parquet(f"{path}/layout"))


def open_variable_log(spark: SparkSession, path: str) -> DataFrame:
    """The log that ``write_variable_log`` stored, with its buckets known to the planner
    (the session's catalogue gets an entry for it where it has none).  Filters on ``id_var``
    and ``date`` skip row groups by their ranges; queries that need no buckets are
    read in splits of any size."""
    name = _variable_table(path)
    if not spark.catalog.tableExists(name):
        kept = spark.read.parquet(f"{path}/layout").first()
        fields = T.StructType.fromJson(json.loads(kept["columns"])).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (id_var, chunk) "
                  f"SORTED BY ({', '.join(kept['sorted'])}) INTO {kept['buckets']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


def _variable_table(path: str) -> str:
    return "variable_log_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]


def reading_gaps(stored: DataFrame) -> DataFrame:
    """Per variable of a stored log: timed readings, first and last second, longest gap
    between readings that follow each other (ms; NULL with one reading) and readings
    after a gap of more than a minute.  Chunks are windowed where they lie."""
    timed = stored.filter(F.col("chunk") != NO_CHUNK).select("id_var", "chunk", "date")
    w = Window.partitionBy("id_var", "chunk").orderBy("date")
    inside = F.col("date") - F.lag("date").over(w)
    chunks = (timed.withColumn("gap", inside).groupBy("id_var", "chunk")
              .agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"), F.max("gap").alias("gap"),
                   F.count_if(F.col("gap") > 60_000).alias("pauses")))
    between = F.col("lo") - F.lag("hi").over(Window.partitionBy("id_var").orderBy("chunk"))  # one row per chunk
    joined = chunks.withColumn("between", between)
    return joined.groupBy("id_var").agg(
        F.sum("n").alias("readings"), second_ts(F.min("lo")).alias("first_ts"), second_ts(F.max("hi")).alias("last_ts"),
        F.greatest(F.max("gap"), F.max("between")).alias("longest_gap_ms"),
        (F.sum("pauses") + F.count_if(F.col("between") > 60_000)).alias("pauses"))


def read_jdbc_log(spark: SparkSession, url: str, table: str, lower: int, upper: int,
                  partitions: int, properties: Mapping[str, str] | None = None) -> DataFrame:
    """I1 from a database: a partitioned read on the epoch-ms ``date``
    column (``partitions`` parallel range queries)."""
    return spark.read.jdbc(url, table, column="date", lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=dict(properties or {}))


# ------------------------------------------------------------------ I2

_EXPORT_INNER = "timestamp string, id_var string, value string"


def write_string_export(sl: DataFrame, path: str) -> None:
    """Write a string log in the exported layout: every line one quoted
    field (an inner CSV row whose quotes are doubled again) plus ``;;;``,
    CRLF line ends, header first."""
    q = lambda c: F.regexp_replace(c, '"', '""')
    inner = F.concat(F.date_format(second_ts("date"), "yyyy-MM-dd HH:mm:ss"), F.lit(',"'),
                     F.col("id_var").cast("string"), F.lit('","'),
                     q(F.coalesce(F.col("value"), F.lit(""))), F.lit('"'))
    line = F.concat(F.lit('"'), q(inner), F.lit('";;;'))
    spark = sl.sparkSession
    header = spark.createDataFrame([('"timestamp,""id_var"",""value""";;;',)], "line string")
    (header.unionByName(sl.select(line.alias("line")))
     .write.mode("overwrite").option("lineSep", "\r\n").text(path))


def read_string_export(spark: SparkSession, path: str) -> DataFrame:
    """Parse the exported string log into (ts, id_var, value).  The
    outer CSV (``;`` separated, ``"`` quoted and escaped) yields the inner
    row in ``_c0``; ``from_csv`` splits it.  Empty values stay ``''``."""
    outer = (spark.read.option("sep", ";").option("quote", '"').option("escape", '"')
             .option("lineSep", "\r\n").csv(path))
    inner = F.from_csv(F.col("_c0"), _EXPORT_INNER, {"quote": '"', "escape": '"'}).alias("r")
    rows = outer.select(inner).select("r.*").filter(F.col("timestamp") != "timestamp")
    # external text: malformed fields become NULL instead of failing the job
    # (ANSI casts raise)
    return rows.select(F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
                       F.col("id_var").try_cast("int").alias("id_var"),
                       F.coalesce(F.col("value"), F.lit("")).alias("value"))


def split_string_export(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """I2 with a channel for malformed lines: (rows, rejects).

    ``rows`` are the well-formed lines as ``read_string_export`` gives them;
    ``rejects`` hold every other line whole, with its ``problem``: no quoted inner
    row, a wrong number of fields, no time, no variable.  Header lines are neither;
    each other line of the files is in exactly one of the two.  Empty lines are
    rejects as well."""
    lines = spark.read.option("lineSep", "\r\n").text(path).withColumnRenamed("value", "line")
    outer = F.from_csv(F.col("line"), "inner string, a string, b string, c string, more string", {"sep": ";", "quote": '"', "escape": '"'})
    cut = lines.withColumn("inner", outer["inner"])
    cut = cut.filter(~F.coalesce(F.col("inner").startswith("timestamp,"), F.lit(False)))
    fields = F.from_csv(F.col("inner"), _EXPORT_INNER + ", more string", {"quote": '"', "escape": '"'})
    cut = cut.withColumn("r", fields)
    ts = F.try_to_timestamp(F.col("r.timestamp"), F.lit("yyyy-MM-dd HH:mm:ss"))
    made = cut.select("line", "inner", "r", ts.alias("ts"), F.col("r.id_var").try_cast("int").alias("id_var"))
    quoted = F.col("line").startswith('"') & F.rtrim("line").endswith('";;;')
    problem = (F.when(~quoted | F.col("inner").isNull(), F.lit("no quoted row"))
               .when(F.col("r.id_var").isNull() | F.col("r.more").isNotNull(), F.lit("wrong number of fields"))
               .when(F.col("ts").isNull(), F.lit("no time"))
               .when(F.col("id_var").isNull(), F.lit("no variable")))
    made = made.withColumn("problem", problem)
    rows = made.filter("problem IS NULL").select("ts", "id_var", F.coalesce("r.value", F.lit("")).alias("value"))
    return rows, made.filter("problem IS NOT NULL").select("line", "problem")


# ------------------------------------------------------------------ I5 - I9

def extract_day(sl: DataFrame, day: str | None = None) -> DataFrame:
    """String log as (timestamp text, id_var, value) of one day (all
    days when ``day`` is None), in time order."""
    ts = F.date_format(second_ts("date"), "yyyy-MM-dd HH:mm:ss")
    d = sl
    if day is not None:
        d = d.filter(F.date_format(second_ts("date"), "yyyy-MM-dd") == day)
    # chronological order on the numeric epoch (the text sorts the same way)
    order = ["date"] + (["seq"] if "seq" in d.columns else [])
    if day is not None:  # the whole log is not sorted globally
        d = d.orderBy(*order)
    return d.select(ts.alias("timestamp"), "id_var", "value")


def _typed_for_json(df: DataFrame) -> DataFrame:
    """Hours rounded to 4, durations to 2, timestamps as text, machine identifiers dropped."""
    cols = []
    for f in df.drop(*[c for c in C.I6_DROP if c in df.columns]).schema.fields:
        c = F.col(f.name)
        if f.name == "total_hours":
            c = F.round(c, 4)
        elif f.name in ("duration_sec", "total_duration_sec"):
            c = F.round(c, 2)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _header(d: DataFrame, from_date: str, until_date: str, status: str, *more) -> DataFrame:
    """One row: status (``no_data`` for an empty result), context, period, count and ``more`` aggregates."""
    agg = d.agg(F.count("*").alias("count"), *more)
    st = F.when(F.col("count") == 0, F.lit("no_data" if status == "success" else status)).otherwise(F.lit(status))
    return agg.select(st.alias("status"), F.lit("single_machine").alias("machine_context"),
                      F.struct(F.lit(from_date).alias("from"), F.lit(until_date).alias("until")).alias("period"), *agg.columns)


def to_json_lines(df: DataFrame, from_date: str, until_date: str, status: str = "success") -> DataFrame:
    """I6 for results of any size: column ``json`` with one header line (status,
    machine_context, period, count) and one line per row.  Nothing is collected
    into one row or counted while the plan is built."""
    d = _typed_for_json(df)
    head = _header(d, from_date, until_date, status)
    line = lambda x: x.select(F.to_json(F.struct(*x.columns)).alias("json"))
    return line(head).unionByName(line(d))


def to_envelope(df: DataFrame, from_date: str, until_date: str, status: str = "success") -> DataFrame:
    """I6 as one JSON response (status, machine_context, period, count, data) in
    one row, for results that are small by construction: state totals, KPIs,
    severity counts.  Other results take ``to_json_lines``."""
    d = _typed_for_json(df)
    env = _header(d, from_date, until_date, status, F.collect_list(F.struct(*d.columns)).alias("data"))
    return env.select("status", "count", F.to_json(F.struct(*env.columns)).alias("json"))


def totals_envelope(states: DataFrame, from_date: str, until_date: str,
                    hours: str = "total_hours") -> DataFrame:
    """The older response: ``totals_in_hours`` {active, intermediate,
    idle} from a three-state table, rounded to 2, missing states = 0."""
    p = states.groupBy().pivot("state", ["Active", "Intermediate", "Idle"]).agg(F.sum(hours))
    r = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 2)
    return p.select(F.lit("success").alias("status"), F.lit(from_date).alias("period_from"),
                    F.lit(until_date).alias("period_until"), r("Active").alias("active"),
                    r("Intermediate").alias("intermediate"), r("Idle").alias("idle"))


def standardise_columns(df: DataFrame, synonyms: Mapping[str, str] = C.I8_SYNONYMS,
                        date_col: str = "date") -> DataFrame:
    """I8: lower-case and trim column names, rename synonyms, parse ``date``
    (unparseable values -> NULL)."""
    out = df
    for c in df.columns:
        clean = c.strip().lower()
        clean = synonyms.get(clean, clean)
        if clean != c:
            out = out.withColumnRenamed(c, clean)
    if date_col in out.columns:
        f = out.schema[date_col].dataType
        if isinstance(f, T.StringType):
            out = out.withColumn(date_col, F.try_to_timestamp(F.col(date_col)))
        elif isinstance(f, T.DateType):
            out = out.withColumn(date_col, F.col(date_col).cast("timestamp"))
    return out


def write_catalogue_csv(catalogue: DataFrame, path: str) -> None:
    """Alarm catalogue as ``;``-separated UTF-8 CSV with a header."""
    (catalogue.write.mode("overwrite").option("sep", ";").option("header", True)
     .option("encoding", "UTF-8").csv(path))


def read_catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("sep", ";").option("header", True)
            .schema("alarm_code string, description string").csv(path))
