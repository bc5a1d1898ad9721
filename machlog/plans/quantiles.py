"""Exact per-group quantiles (``percentile_cont``) without buffering a group.

Spark's exact ``percentile`` keeps every distinct value of a group in one
task.  Here a group holding a third of all rows is still spread out:

1. ``groupBy(keys, value).count()``: distinct values with their counts
   (partial aggregation);
2. the cumulative count per group, in value order, with ``ordered_window``
   over value buckets cut at quantiles of the distinct values, so neither a hot
   group nor a few extreme values leave one bucket with all rows;
3. per group and quantile the two ranks ``floor(p(n-1))`` and
   ``ceil(p(n-1))`` (a few rows per group), joined to the value whose
   cumulative range holds the rank (``salted_join`` on the group keys with a
   range residual), then interpolated linearly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from machlog.plans.sequence import ordered_window

SALTS = 64
CUTS = 256


def salted_join(rows: DataFrame, few: DataFrame, keys: Sequence[str], spread: str, salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with a frame of a few rows per key: each of those
    is repeated per salt, and the rows of a hot key go to ``salts`` tasks by the
    hash of ``spread``."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [*keys, "_salt"], "inner").drop("_salt")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], bucket: Column | None = None,
                    names: Sequence[str] | None = None) -> DataFrame:
    """One row per group: ``keys`` + one column per probability (linear
    interpolation between closest ranks, as ``percentile_cont``)."""
    keys = list(keys)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    v = df.filter(F.col(value).isNotNull())
    distinct = v.groupBy(*keys, value).agg(F.count("*").alias("_cnt"))
    if bucket is None:
        # Equal-depth cuts: how many of them lie below the value (monotone).
        cuts = distinct.agg(F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)]).alias("c")).scalar()
        distinct = distinct.withColumn("_cuts", cuts)
        bucket = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    cum = ordered_window(distinct, order=[value], keys=keys, bucket=bucket,
                         running_sums={"_cum": "_cnt"})
    cum = cum.withColumn("_lo_rank", F.col("_cum") - F.col("_cnt"))  # ranks [_lo_rank, _cum)
    n = v.groupBy(*keys).agg(F.count("*").alias("_n"))
    pos = []
    for p, name in zip(probs, names):
        x = F.lit(float(p)) * (F.col("_n") - 1)
        pos.append(F.struct(F.lit(name).alias("q"), F.floor(x).alias("r0"), F.ceil(x).alias("r1"),
                            (x - F.floor(x)).alias("frac")))
    ranks = n.select(*keys, F.explode(F.array(*pos)).alias("p")).select(
        *keys, "p.q", "p.frac", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("p.r0").alias("r")),
                                                  F.struct(F.lit(1).alias("side"), F.col("p.r1").alias("r"))))
        .alias("s")).select(*keys, "q", "frac", "s.side", "s.r")
    # A few rank rows per group: equi-join on the group keys, range residual.
    hit = salted_join(cum.select(*keys, value, "_lo_rank", "_cum"), ranks, keys, value).filter(
        "r >= _lo_rank AND r < _cum").select(*keys, "q", "frac", "side", F.col(value).alias("_v"))
    piv = hit.groupBy(*keys, "q", "frac").agg(
        F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("v0"),
        F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("v1"))
    qv = piv.select(*keys, "q", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).alias("qv"))
    return qv.groupBy(*keys).pivot("q", names).agg(F.first("qv"))


def day_sketches(df: DataFrame, keys: list[str], day: str, value: str, k: int = 200) -> DataFrame:
    """keys, day, sketch: a mergeable quantile sketch (KLL) of every key's day.  A
    sketch has a few kilobytes whatever the rows; ``k`` sets its error, about
    2.3 / k ** 0.9 of the rank."""
    v = F.col(value).cast("double")
    return (df.filter(v.isNotNull()).groupBy(*keys, day)
            .agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch")))


def merged_quantiles(sketches: DataFrame, keys: list[str], quantiles: list[float], names: list[str], k: int = 200) -> DataFrame:
    """Quantiles over any choice of days from their sketches; ``exact_quantiles`` is
    the exact way over the rows."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("_all"))
    return merged.select(*keys, *[F.kll_sketch_get_quantile_double("_all", F.lit(q)).alias(n) for q, n in zip(quantiles, names)])
