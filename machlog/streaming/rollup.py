"""The per-second rollup as a materialised, day-partitioned table.

``build_rollup`` writes, per second, the set of variables seen and their number,
partitioned by ``day``, into the shared checkpoint folder
(``spark.checkpoint.dir``) or a given path.  Sets merge: ``refresh_rollup`` adds
new raw rows to the stored sets of the days they touch and replaces those
partitions (dynamic partition overwrite), the counterpart of refreshing the
materialised view after inserts.  It reads the new rows and the touched
partitions, never the log.  ``refresh_stream`` drives the same refresh from a
Structured Streaming source with ``foreachBatch``; a repeated batch changes
nothing, as sets take a row once.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from machlog.functions.timefn import day_of, second_ts
from machlog.session import ensure_checkpoint_dir


def rollup_path(spark: SparkSession, name: str | None = None) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/machlog-tables/{name or 'rollup-' + uuid.uuid4().hex[:12]}"


def _sets(fl: DataFrame, bucket_s: int) -> DataFrame:
    """ts, vars: the distinct variables of every second (of ``bucket_s`` seconds).  A
    set is no longer than the list of variables."""
    return fl.groupBy(second_ts("date", bucket_s).alias("ts")).agg(F.collect_set("id_var").alias("vars"))


def _stored(sets: DataFrame, bucket_s: int) -> DataFrame:
    return sets.select("ts", day_of("ts").alias("day"), F.size("vars").cast("bigint").alias("distinct_vars_count"),
                       F.array_sort("vars").alias("vars"), F.lit(bucket_s).alias("bucket_s"))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("ts", "day", "distinct_vars_count")


def build_rollup(fl: DataFrame, bucket_s: int = 1, path: str | None = None) -> DataFrame:
    """Create the rollup table (replacing it) and return a scan of it.
    Each day partition holds at most ``86400 / bucket_s`` rows, so grouping
    the write by day cannot produce an oversized task.  The bucket width is
    stored with the rows."""
    path = path or rollup_path(fl.sparkSession)
    (_stored(_sets(fl, bucket_s), bucket_s).repartition("day")
     .write.mode("overwrite").partitionBy("day").parquet(path))
    return _scan(fl.sparkSession, path)


def ensure_rollup(fl: DataFrame, path: str, bucket_s: int = 1) -> DataFrame:
    """A25 setup: reuse the rollup table at ``path`` when it exists with this
    bucket width (and with its sets), build it otherwise."""
    spark = fl.sparkSession
    try:
        stored = spark.read.parquet(path).select("bucket_s", "vars").first()
    except AnalysisException:
        stored = None
    if stored is None or stored["bucket_s"] != bucket_s:
        return build_rollup(fl, bucket_s, path)
    return _scan(spark, path)


def touched_days(new_rows: DataFrame) -> list:
    """The days of the new rows: as many as a batch spans, so they are listed."""
    return [r["day"] for r in new_rows.select(day_of(second_ts("date")).alias("day")).distinct().collect() if r["day"] is not None]


def merged_days(new_rows: DataFrame, path: str, bucket_s: int, days: list) -> DataFrame:
    """The stored sets of ``days`` with the new rows in them.  The days are literals
    on the stored partition column, so only their partitions are listed and read."""
    spark = new_rows.sparkSession
    old = spark.read.parquet(path).filter(F.col("day").isin(days)).select("ts", "vars")
    fresh = _sets(new_rows, bucket_s).filter(F.col("ts").isNotNull())
    both = old.unionByName(fresh).groupBy("ts").agg(F.array_distinct(F.flatten(F.collect_list("vars"))).alias("vars"))
    return _stored(both, bucket_s)


def refresh_rollup(new_rows: DataFrame, path: str, bucket_s: int | None = None) -> DataFrame:
    """Merge ``new_rows`` into the rollup at ``path``: read and replace only the day
    partitions they touch.

    The merged days are written to the shared scratch folder first, so that no
    partition is read while it is replaced; if the job dies while replacing them,
    running the same refresh again restores them from there or from their own
    stored sets.  A bucket width other than the stored one is refused."""
    spark = new_rows.sparkSession
    stored = spark.read.parquet(path).select("bucket_s").first()
    width = stored["bucket_s"] if stored else bucket_s or 1
    if bucket_s is not None and bucket_s != width:
        raise ValueError(f"the rollup has buckets of {width} s, not {bucket_s} s")
    days = touched_days(new_rows)
    if days:
        scratch = rollup_path(spark, f"refresh-{uuid.uuid4().hex[:12]}")
        merged_days(new_rows, path, width, days).write.parquet(scratch)
        (spark.read.parquet(scratch).repartition("day")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(path))
    return _scan(spark, path)


def refresh_stream(stream: DataFrame, path: str, checkpoint: str,
                   bucket_s: int | None = None, trigger_once: bool = True):
    """Refresh the rollup for every micro-batch of new raw rows.  The checkpoint
    folder makes the stream restartable after executor or driver loss; a batch
    that runs twice gives the same sets."""
    def per_batch(batch: DataFrame, _batch_id: int) -> None:
        batch.persist()  # read for its days and for its rows
        try:
            refresh_rollup(batch, path, bucket_s)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
