"""Helpers shared by the operators: tables, shared scratch tables, row packing."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from machlog.session import ensure_checkpoint_dir

#: The white space the contracts name, ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\f\r"
#: Bits of the filter that lets candidates through before a join; others that pass are dropped by the join.
FILTER_BITS = 1 << 22
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder named by ``spark.checkpoint.dir`` and
    read it back: cuts the lineage and makes the rows the same for every later
    job, also after an executor is lost.  The files live as long as that folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame, without: Iterable[str] = ()) -> Column:
    """All columns of ``df`` (but ``without``) as one struct, so that helper
    columns of an operator cannot clash with them."""
    cols = [F.col(quoted(c)) for c in df.columns if c not in set(without)]
    return F.struct(*cols) if cols else F.struct(F.lit(None).cast("int").alias("_empty"))


def fields(struct: str, df: DataFrame, without: Iterable[str] = ()) -> list[Column]:
    """The columns packed by ``whole_row`` again."""
    return [F.col(f"{struct}.{quoted(c)}").alias(c) for c in df.columns if c not in set(without)]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)]


def bits_of(keys: DataFrame):
    """A broadcast filter of fixed size over the longs in column ``key``: no false negatives."""
    places = keys.select(F.pmod("key", F.lit(FILTER_BITS)).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)
    bits = np.zeros(FILTER_BITS, np.bool_)
    bits[places] = True
    return keys.sparkSession.sparkContext.broadcast(np.packbits(bits))


def arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)
