"""Ordered-sequence windows without a single-task global window.

The reference computes ``LAG``/``LEAD``/running ``SUM`` ``OVER (ORDER BY ts)``
over whole logs.  In Spark a window without ``PARTITION BY`` moves every row
into one task.  ``ordered_window`` gives the same values while keeping the
work partitioned:

1. every row gets a bucket that is monotone in the order and the window runs per
   ``keys + bucket``.  Buckets are cut by row density (``cut_by_density``): they
   hold about ``ROWS_PER_BUCKET`` rows each, whether the log is sparse or dense;
2. a small ``edges`` frame holds, per non-empty bucket, the first and last
   row values and the bucket total of each running-sum column.  It is read
   off the windowed rows (row 1 and the last row of each bucket), which are
   already partitioned by ``keys + bucket``: no extra shuffle, and the input
   is computed once (both branches share the window's exchange);
3. ``edges``, one row per key and bucket, is chained by a window per key;
4. the edges are joined back on ``keys + bucket``.  The join side is left to
   AQE: it is broadcast when its runtime size is under
   ``spark.sql.autoBroadcastJoinThreshold`` and sort-merged otherwise, and the
   windowed side is already hash-partitioned on exactly these keys.

So edges are few (one per bucket and key), a log that grows denser in the same
days gets more buckets, and a sparse one is not cut into buckets of one row.

A hot key (one alarm code holding a third of all rows) is therefore split
over its buckets as well.  The order must be total (add a unique tiebreak
column), exactly as a deterministic global window requires; key columns must
not be NULL (callers filter or derive them non-NULL), NULL order values are
kept and sort first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a bucket holds, on average; the memory of a window task follows from it.
ROWS_PER_BUCKET = 100_000
#: Width of the cells whose rows are counted to cut the buckets: 52,560 a year.
CELL_MS = 600_000

_NULL_BUCKET = -(2 ** 63)


def time_bucket(ts: Column | str, seconds: int = 3600) -> Column:
    """Monotone bucket id of a timestamp column (default: hour)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def ms_bucket(ms: Column | str, seconds: int = 3600) -> Column:
    """Monotone bucket id of an epoch-millisecond column."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.floor(ms / F.lit(1000 * seconds))


def cut_by_density(df: DataFrame, at: Column, name: str, rows: int = ROWS_PER_BUCKET, cell_ms: int = CELL_MS,
                   counted: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with a bucket number in column ``name``, monotone in ``at`` (epoch ms)
    and holding about ``rows`` rows; NULL where ``at`` is NULL.

    The rows of every non-empty cell of ``cell_ms`` are counted (only ``at`` is read
    for it; ``counted`` may name rows that include those of ``df`` and are cheaper
    to make) and added up in order; a cell's rows are dealt evenly in time over as
    many buckets as they fill, thin cells share one (a burst that fills only a part
    of a cell is spread over that part of its buckets; ``cell_ms`` can be narrower).  Counts are exact, so the cut
    is the same however often it is computed.  With ``keys`` each key is cut on its
    own, from bucket 0.  The cells are a small table of the
    log's life, not of its rows; it is joined to the rows on the cell (broadcast by
    the planner where its size allows)."""
    cell = F.floor(at / F.lit(cell_ms)).cast("bigint")
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = ((df if counted is None else counted).select(*keys, cell.alias("_cell")).filter(F.col("_cell").isNotNull())
             .groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
             .select(*keys, "_cell", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")))
    within = F.pmod(at, F.lit(cell_ms)) * F.col("_rows") / F.lit(cell_ms * rows)
    bucket = F.floor(F.col("_before") / F.lit(rows)) + F.floor(within)
    return (df.withColumn("_cell", cell).join(cells, [*keys, "_cell"], "left")
            .select(*[F.col(c) for c in df.columns], bucket.cast("bigint").alias(name)))


def ms_of(ts: Column | str) -> Column:
    """Epoch ms of a timestamp column."""
    return F.unix_millis(F.col(ts) if isinstance(ts, str) else ts)


def _default_lit(value):
    return F.lit(value) if not isinstance(value, Column) else value


def _add(a: Column, b: Column) -> Column:
    """Sum of two running sums; NULL (no value yet) counts as nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def ordered_window(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column | str,
    keys: Sequence[str] = (),
    lags: Mapping[str, tuple] | None = None,
    leads: Mapping[str, tuple] | None = None,
    running_sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add global-order ``lag``/``lead``/running-sum columns.

    ``lags``/``leads``: ``{out: (source_col, default)}``; the default applies
    only where there is no previous/next row in the whole ``keys`` group,
    exactly like ``lag(c, 1, default)``.  ``running_sums``: ``{out: col}``,
    cumulative sum with a ROWS frame (unbounded preceding .. current row).

    ``bucket`` as a string names a bigint column of ``df`` without NULLs; it is used as
    it is and kept, so rows that already lie by ``keys`` and that column (a stored log,
    an earlier window) are not exchanged again.
    """
    keys, lags, leads, running_sums = list(keys), dict(lags or {}), dict(leads or {}), dict(running_sums or {})
    sq = "_sq_"
    b, rn, is_last = bucket if isinstance(bucket, str) else sq + "bucket", sq + "rn", sq + "last"

    # A NULL order value gets the smallest bucket: such rows sort first, as
    # NULLs do in an ascending window, and are not lost by the equi-join.
    d = df if isinstance(bucket, str) else df.withColumn(b, F.coalesce(bucket.cast("bigint"), F.lit(_NULL_BUCKET)))
    w = Window.partitionBy(*keys, b).orderBy(*[F.col(c) for c in order])
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {rn: F.row_number().over(w), is_last: F.lead(F.lit(1)).over(w).isNull()}
    inside |= {f"{sq}in_{out}": F.lag(src).over(w) for out, (src, _) in lags.items()}
    inside |= {f"{sq}in_{out}": F.lead(src).over(w) for out, (src, _) in leads.items()}
    inside |= {f"{sq}in_{out}": F.sum(src).over(upto) for out, src in running_sums.items()}
    d = d.withColumns(inside)

    # Edges: first / last row values and totals per bucket, taken from the
    # windowed rows themselves.  They are already hash-partitioned by
    # (keys, bucket), so this aggregate adds no shuffle.  ``whole`` names every
    # column of the first and last rows: with it the edges need the same exchange
    # as the rows, which is then shared, and the input is computed once.
    whole = F.xxhash64(*[F.col(c) for c in df.columns if not c.startswith("_")]).alias(sq + "whole")
    lag_src = sorted({src for src, _ in lags.values()})
    lead_src = sorted({src for src, _ in leads.values()})
    prev, nxt = sq + "prev", sq + "next"
    first, last = F.col(rn) == 1, F.col(is_last)
    aggs = []
    if lag_src:
        aggs.append(F.max(F.when(last, F.struct(*[F.col(c).alias(c) for c in lag_src], whole))).alias(sq + "lastv"))
    if lead_src:
        aggs.append(F.max(F.when(first, F.struct(*[F.col(c).alias(c) for c in lead_src], whole))).alias(sq + "firstv"))
    for out in running_sums:
        aggs.append(F.max(F.when(last, F.col(f"{sq}in_{out}"))).alias(f"{sq}tot_{out}"))
    if not aggs:
        return d.drop(rn, is_last, *([] if isinstance(bucket, str) else [b]))
    edges = d.filter(first | last).groupBy(*keys, b).agg(*aggs)
    we = Window.partitionBy(*keys).orderBy(b)
    links = {}
    if lag_src:
        links[prev] = F.lag(sq + "lastv").over(we)
    if lead_src:
        links[nxt] = F.lead(sq + "firstv").over(we)
    for out in running_sums:
        links[f"{sq}off_{out}"] = F.sum(f"{sq}tot_{out}").over(we.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumns(links)
    edges = edges.select(*keys, b, *([prev] if lag_src else []), *([nxt] if lead_src else []),
                         *[f"{sq}off_{out}" for out in running_sums])

    d = d.join(edges, on=[*keys, b], how="inner")
    out_cols = []
    for out, (src, dflt) in lags.items():
        out_cols.append(
            F.when(F.col(rn) == 1,
                   F.when(F.col(prev).isNull(), _default_lit(dflt)).otherwise(F.col(prev)[src]))
            .otherwise(F.col(f"{sq}in_{out}")).alias(out))
    for out, (src, dflt) in leads.items():
        out_cols.append(
            F.when(F.col(is_last),
                   F.when(F.col(nxt).isNull(), _default_lit(dflt)).otherwise(F.col(nxt)[src]))
            .otherwise(F.col(f"{sq}in_{out}")).alias(out))
    for out in running_sums:
        out_cols.append(_add(F.col(f"{sq}in_{out}"), F.col(f"{sq}off_{out}")).alias(out))
    base = [c for c in df.columns if c not in lags and c not in leads and c not in running_sums]
    return d.select(*[F.col(c) for c in base], *out_cols)
