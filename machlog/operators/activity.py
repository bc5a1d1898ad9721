"""Activity and operating states.

Inputs are narrow float logs ``fl`` (``date`` epoch ms, ``id_var``, ``value``,
optional unique ``seq``).  Every ordered window that the original analytics
ran over the whole log goes through ``plans.sequence.ordered_window`` so no
stage collapses into one task.  Windows that the analytics already
partitioned by day (A22) stay per day: they run over the per-second rollup,
which holds at most ``86400 / bucket_s`` rows per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from machlog import config as C
from machlog.functions.timefn import day_of, day_text, ms_ts, period_filter, second_ts
from machlog.plans.sequence import ordered_window, time_bucket

DAY_S = 86400

# A7 pivot column names, in the order of ``config.A7_SENSORS`` (fixed values).
SENSOR_NAMES = ["spindle_load", "spindle_consumption", "axis_x_util", "axis_y_util",
                "axis_z_util", "axis_5_util", "axis_8_util", "spindle_rpm",
                "feed_rapid_active", "feed_contour", "axis_x_moving", "axis_y_moving",
                "axis_z_moving", "axis_x_in_position", "axis_y_in_position",
                "axis_z_in_position"]


def _secs_between(start: Column | str, end: Column | str) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


# --------------------------------------------------------------- A1 - A6

def variables_with_float_logs(vars_df: DataFrame, fl: DataFrame) -> DataFrame:
    """A1: variables that have at least one float log row (semi join)."""
    # distinct ids first (partial aggregation): the semi join's build side is
    # then as small as the variable dictionary, not the log
    ids = fl.select(F.col("id_var").alias("id")).distinct()
    return vars_df.join(ids, on="id", how="left_semi").select("id", "name").orderBy("name")


def daily_variable_stats(fl: DataFrame, day: str | None = None) -> DataFrame:
    """A2: per (day, id_var): count, sum, avg, min, max.  ``day`` restricts
    to one day (the original single-day report)."""
    d = fl.withColumn("day", day_of(ms_ts("date")))
    if day is not None:
        d = d.filter(F.col("day") == F.lit(day).cast("date"))
    return d.groupBy("day", "id_var").agg(
        F.count("*").alias("n_logs"), F.sum("value").alias("sum_value"),
        F.avg("value").alias("avg_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"))


def log_count_per_day(log: DataFrame) -> DataFrame:
    """A3: number of log rows per day (day as text), busiest first."""
    return (log.groupBy(day_text(second_ts("date")).alias("day"))
            .agg(F.count("*").alias("log_count"))
            .orderBy(F.desc("log_count"), "day"))


def day_relevance(fl: DataFrame, sl: DataFrame) -> DataFrame:
    """A4: float and string counts per day, inner join on day, total."""
    f = fl.groupBy(day_of(second_ts("date")).alias("day")).agg(F.count("*").alias("float_count"))
    s = sl.groupBy(day_of(second_ts("date")).alias("day")).agg(F.count("*").alias("string_count"))
    return (f.join(s, "day", "inner")
            .withColumn("total_count", F.col("float_count") + F.col("string_count"))
            .orderBy(F.desc("total_count"), "day"))


def daily_totals(*logs: DataFrame) -> DataFrame:
    """Rows per day over the union of logs (``UNION ALL`` of the date columns)."""
    u = None
    for log in logs:
        part = log.select("date")
        u = part if u is None else u.unionByName(part)
    return u.groupBy(day_of(ms_ts("date")).alias("day")).agg(F.count("*").alias("total_count"))


def _ranked_days(daily: DataFrame) -> DataFrame:
    # One row per day: a window over days is bounded (365 rows a year).
    w = Window.orderBy("total_count", "day")
    return daily.withColumn("decile", F.ntile(10).over(w))


def decile_distribution(*logs: DataFrame) -> DataFrame:
    """A5: days per decile of daily log volume, with min, max and median."""
    ranked = _ranked_days(daily_totals(*logs))
    return ranked.groupBy("decile").agg(
        F.count("*").alias("days_in_bin"), F.min("total_count").alias("min_in_bin"),
        F.max("total_count").alias("max_in_bin"),
        F.percentile("total_count", 0.5).alias("median_in_bin")).orderBy("decile")


def representative_days(*logs: DataFrame) -> DataFrame:
    """Per decile, the day closest to the decile median (ties: earlier day)."""
    ranked = _ranked_days(daily_totals(*logs))
    stats = ranked.groupBy("decile").agg(F.percentile("total_count", 0.5).alias("median_in_bin"))
    picked = ranked.join(stats, "decile").withColumn(
        "rn", F.row_number().over(Window.partitionBy("decile").orderBy(
            F.abs(F.col("total_count") - F.col("median_in_bin")), "day")))
    return picked.filter("rn = 1").select("decile", "day", "total_count").orderBy("decile")


# --------------------------------------------------------------- A7 - A14

def pivot_sensors(fl: DataFrame, sensors: Sequence[int] = C.A7_SENSORS,
                  names: Sequence[str] = SENSOR_NAMES, bucket_s: int = 1) -> DataFrame:
    """One row per second, one column per sensor (max value that second).
    Explicit pivot values: no extra job to find them."""
    p = (fl.filter(F.col("id_var").isin(list(sensors)))
         .groupBy(second_ts("date", bucket_s).alias("ts"))
         .pivot("id_var", list(sensors)).agg(F.max("value")))
    return p.select("ts", *[F.col(str(s)).alias(n) for s, n in zip(sensors, names)])


def rule_state(pivot: DataFrame, load_min: float = C.A8_LOAD_MIN) -> DataFrame:
    """1 if spindle load > 3 and any axis moving, else 0 (NULL -> 0)."""
    cond = (F.col("spindle_load") > load_min) & (
        (F.col("axis_x_moving") > 0) | (F.col("axis_y_moving") > 0) | (F.col("axis_z_moving") > 0))
    return pivot.withColumn("state_num", F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def change_score(pivot: DataFrame, columns: Sequence[str] = SENSOR_NAMES,
                 span_s: int = DAY_S) -> DataFrame:
    """Number of sensors whose value differs from the previous row."""
    lags = {f"_prev_{c}": (c, None) for c in columns}
    s = ordered_window(pivot, order=["ts"], bucket=time_bucket("ts", span_s), lags=lags)
    score = None
    for c in columns:
        term = F.when(F.col(c) != F.col(f"_prev_{c}"), F.lit(1)).otherwise(F.lit(0))
        score = term if score is None else score + term
    return s.select("ts", score.alias("activity_score"))


def score_distribution(scores: DataFrame) -> DataFrame:
    """A10: seconds per activity score, highest score first."""
    return (scores.groupBy("activity_score").agg(F.count("*").alias("number_of_seconds"))
            .orderBy(F.desc("activity_score")))


def elbow_threshold(hist: DataFrame) -> DataFrame:
    """Score at the most negative difference of consecutive counts
    (sorted by score; first on ties).  The histogram has one row per score."""
    w = Window.orderBy("activity_score")
    g = hist.withColumn("gradient", F.col("number_of_seconds") - F.lag("number_of_seconds").over(w))
    g = g.filter(F.col("gradient").isNotNull())
    return g.orderBy("gradient", "activity_score").limit(1).select(
        F.col("activity_score").alias("threshold"), F.col("gradient"))


def score_state(scores: DataFrame, threshold: int = C.SCORE_THRESHOLD_FINAL) -> DataFrame:
    """1 when the score is above the threshold."""
    return scores.withColumn(
        "state_num", F.when(F.col("activity_score") > threshold, F.lit(1)).otherwise(F.lit(0)))


def segments(states: DataFrame, end: Column | str | None = None, ts: str = "ts",
             state: str = "state_num", label: Column | None = None,
             span_s: int = DAY_S, tail_s: int = 1) -> DataFrame:
    """Change-point segmentation in one pass.

    A period starts where the state differs from the previous row's (-1 before
    the first row) and ends at the next start or at ``end``: a timestamp or
    Column, by default the last timestamp + ``tail_s`` seconds.

    Rows are windowed once, per bucket of ``span_s``: each knows whether it
    starts a run in its bucket and when the bucket's next run starts.  A bucket
    is then summed up in one row (first and last state, first inner change, last
    time); chained in order, these rows tell which buckets begin a new run, and
    where the run open at a bucket's end is closed.  Only starts meet that table.
    """
    if label is None:
        label = F.when(F.col(state) == 1, F.lit("WORKING")).otherwise(F.lit("STOPPED"))
    if isinstance(end, str):
        end = F.lit(end).cast("timestamp")
    at = F.col(ts)
    s = states.select(label.alias("state"), F.col(state).alias("_num"), at.alias("_ts"), time_bucket(ts, span_s).alias("_span"))
    w = Window.partitionBy("_span").orderBy("_ts")
    s = s.withColumns({"_first": F.row_number().over(w) == 1, "_inner": F.coalesce(F.col("_num") != F.lag("_num").over(w), F.lit(False))})
    s = s.withColumn("_next", F.min(F.when(F.col("_inner"), F.col("_ts"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    # One row per bucket (a day of seconds by default), so their window is small.  The label is
    # named with the first state so that this table and the starts share one exchange.
    edge = s.groupBy("_span").agg(
        F.min_by(F.struct(F.col("_num").alias("num"), F.col("state").alias("label")), "_ts").alias("_least"),
        F.max_by("_num", "_ts").alias("_out"), F.min("_ts").alias("_from"),
        F.max("_ts").alias("_to"), F.min(F.when(F.col("_inner"), F.col("_ts"))).alias("_change"))
    edge = edge.withColumn("_in", F.col("_least.num"))
    order = Window.orderBy("_span")
    edge = edge.withColumn("_begins", F.coalesce(F.col("_in") != F.lag("_out").over(order), F.col("_in") != F.lit(-1)))
    start = F.when(F.col("_begins"), F.col("_from")).otherwise(F.col("_change"))
    tail = end if end is not None else F.max("_to").over(Window.partitionBy()) + F.make_interval(secs=F.lit(tail_s))
    edge = edge.select(F.col("_span").alias("_of"), "_begins", F.min(start).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
                       tail.alias("_end"))
    # Null-safe: a filter on the key of one side alone would keep the two from sharing the exchange.
    starts = s.filter(F.col("_inner") | F.col("_first")).join(edge, F.col("_span").eqNullSafe(F.col("_of")))
    starts = starts.filter(F.col("_inner") | F.col("_begins"))
    done = starts.select("state", F.col("_ts").alias("period_start"), F.coalesce("_next", "_later", "_end").alias("period_end"))
    return done.withColumn("duration_s", _secs_between("period_start", "period_end"))


def state_totals(segs: DataFrame) -> DataFrame:
    """Total duration per state (seconds and hours)."""
    return segs.groupBy("state").agg(
        F.sum("duration_s").alias("total_duration_s"),
        (F.sum("duration_s") / F.lit(3600.0)).alias("total_hours"))


# --------------------------------------------------------------- A15 - A24

def distinct_vars_per_second(fl: DataFrame, bucket_s: int = 1, approx: bool = False) -> DataFrame:
    """``COUNT(DISTINCT id_var)`` per second (per ``bucket_s``)."""
    agg = F.approx_count_distinct if approx else F.count_distinct
    return fl.groupBy(second_ts("date", bucket_s).alias("ts")).agg(
        agg("id_var").alias("distinct_vars_count"))


def count_distribution(rollup: DataFrame) -> DataFrame:
    """Seconds per distinct-variable count."""
    return (rollup.groupBy("distinct_vars_count").agg(F.count("*").alias("number_of_seconds"))
            .orderBy(F.desc("distinct_vars_count")))


def kmeans_thresholds(hist: DataFrame, value: str = "distinct_vars_count", weight: str = "number_of_seconds") -> DataFrame:
    """The optimal 1-D k-means (k=3) of the weighted histogram; thresholds are
    the midpoints of the sorted centroids, integer thresholds their floors.

    Fitting on the histogram (one row per distinct value, so at most one per
    variable) equals fitting on every second with the counts as weights.  In one
    dimension the clusters are stretches of the sorted values, and the squared
    error of stretches is least where the sum of (weighted sum)^2 / weight is
    greatest.  Prefix sums give every stretch at once: first the best split in two
    of every prefix, then the best last stretch behind it.  Of equal splits the one
    with the earlier cuts holds.

    With two distinct values the middle centroid is their weighted mean, with one
    all are that value.  An empty histogram gives one row of NULLs."""
    v, n = F.col(value).cast("double"), F.col(weight).cast("double")
    rows = hist.filter(v.isNotNull() & (n > 0)).select(v.alias("v"), n.alias("n")).groupBy("v").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per distinct value
    sums = rows.select("v", F.row_number().over(Window.orderBy("v")).alias("i"), F.sum("n").over(upto).alias("n"),
                       F.sum(F.col("v") * F.col("n")).over(upto).alias("s"))
    whole = sums.agg(F.sort_array(F.collect_list(F.struct("i", "n", "s"))).alias("h"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    h, size = F.col("h"), F.size("h")
    # The second cut j (values up to the j-th lie in the first two stretches), with the best first cut i before it.
    p = lambda k, c: h[k - 1][c]
    part = lambda s, n: s * s / n
    i, j = F.col("i"), F.col("j")
    cuts = whole.select("h", F.explode(F.when(size > 2, F.sequence(F.lit(2), size - 1)).otherwise(F.array().cast("array<int>"))).alias("j"))
    cuts = cuts.select("h", "j", F.explode(F.sequence(F.lit(1), F.col("j") - 1)).alias("i"))
    two = part(p(i, "s"), p(i, "n")) + part(p(j, "s") - p(i, "s"), p(j, "n") - p(i, "n"))
    last = part(p(size, "s") - p(j, "s"), p(size, "n") - p(j, "n"))
    cuts = cuts.select("i", "j", two.alias("two"), last.alias("last"))
    best = cuts.groupBy("j", "last").agg(F.min(F.struct((-F.col("two")).alias("two"), "i")).alias("b"))
    three = -F.col("b.two") + F.col("last")
    cut = best.agg(F.min(F.struct((-three).alias("three"), F.col("b.i").alias("i"), "j")).alias("cut"))
    cut = cut.select(F.struct("cut.i", "cut.j")).scalar()
    ci, cj = cut["i"], cut["j"]
    mean = lambda s, n: F.when(n > 0, s / n)
    middle = F.when(size > 2, mean(p(cj, "s") - p(ci, "s"), p(cj, "n") - p(ci, "n"))).otherwise(mean(p(size, "s"), p(size, "n")))
    c = whole.select(F.when(size > 2, mean(p(ci, "s"), p(ci, "n"))).otherwise(F.col("lo")).alias("centroid_1"),
                     F.when(size > 0, middle).alias("centroid_2"),
                     F.when(size > 2, mean(p(size, "s") - p(cj, "s"), p(size, "n") - p(cj, "n"))).otherwise(F.col("hi")).alias("centroid_3"))
    out = c.select("*", *[((F.col(f"centroid_{k}") + F.col(f"centroid_{k + 1}")) / 2).alias(f"threshold_{k}") for k in (1, 2)])
    return out.select("*", F.floor("threshold_1").cast("int").alias("t1_int"),
                      F.floor("threshold_2").cast("int").alias("t2_int"))


def multiotsu_thresholds(signal: DataFrame, value: str = "smoothed_count",
                         nbins: int = 256) -> DataFrame:
    """Two thresholds for three classes maximising the between-class
    variance of a ``nbins``-bin histogram (bin index as value, classes
    ``[0..t1]``, ``(t1..t2]``, ``(t2..]``, first maximum in (t1, t2) order);
    thresholds are bin centres, integer thresholds their floors.

    The signal is counted per distinct value, once: its range and its bins are
    both read off that aggregate (one shared exchange).  Cumulative bins are a
    second aggregate, each bin added to all bins from it on, and the candidate
    pairs come from one row that holds them: ``nbins**2 / 2`` rows, whatever the
    data.  Nothing runs before the action."""
    values = signal.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    mm = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.struct("lo", "hi")).scalar()
    lo, hi = mm["lo"], mm["hi"]
    width = (hi - lo) / F.lit(float(nbins))
    idx = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - lo) / width), F.lit(nbins - 1))).cast("int")
    bins = values.groupBy(idx.alias("i")).agg(F.sum("n").alias("n"))
    upto = bins.select(F.explode(F.sequence(F.col("i"), F.lit(nbins - 1))).alias("k"), "n", (F.col("n") * F.col("i")).alias("m"))
    upto = upto.groupBy("k").agg(F.sum("n").cast("double").alias("p"), F.sum("m").cast("double").alias("s"))
    # The least value lies in bin 0, so every bin has its cumulative row.
    whole = upto.agg(F.sort_array(F.collect_list(F.struct("k", "p", "s"))).alias("h")).filter(F.size("h") > 0)
    h = F.col("h")
    pairs = whole.select("h", F.explode(F.sequence(F.lit(0), F.lit(nbins - 3))).alias("t1"))
    pairs = pairs.select("h", "t1", F.explode(F.sequence(F.col("t1") + 1, F.lit(nbins - 2))).alias("t2"))
    p1, s1, p2, s2 = (h[F.col(t)][c] for t in ("t1", "t2") for c in ("p", "s"))
    pt, st = h[nbins - 1]["p"], h[nbins - 1]["s"]

    def term(p, s):
        return F.when(p > 0, s * s / p).otherwise(F.lit(0.0))

    sigma = term(p1, s1) + term(p2 - p1, s2 - s1) + term(pt - p2, st - s2)
    best = pairs.select("t1", "t2", sigma.alias("sigma")).orderBy(
        F.desc("sigma"), "t1", "t2").limit(1)
    centre = lambda t: F.lit(lo) + (F.col(t) + F.lit(0.5)) * width
    return best.select(
        F.col("t1").alias("t1_idx"), F.col("t2").alias("t2_idx"),
        centre("t1").alias("threshold_1"), centre("t2").alias("threshold_2"),
        F.floor(centre("t1")).cast("int").alias("t1_int"),
        F.floor(centre("t2")).cast("int").alias("t2_int"))


def _three_state(count: Column, t1: float, t2: float) -> tuple[Column, Column]:
    label = (F.when(count <= t1, F.lit("Idle")).when(count <= t2, F.lit("Intermediate"))
             .otherwise(F.lit("Active")))
    num = F.when(count <= t1, F.lit(0)).when(count <= t2, F.lit(1)).otherwise(F.lit(2))
    return label, num


def three_state_totals_window(fl: DataFrame, start: str, end: str,
                              t1: float = C.THREE_STATE_T1, t2: float = C.THREE_STATE_T2,
                              bucket_s: int = 1) -> DataFrame:
    """Three-state totals inside a fixed window ``[start, end]`` (seconds,
    inclusive of the whole last second); the last period closes at ``end``."""
    secs = F.expr("date div 1000")
    s0 = F.unix_seconds(F.lit(start).cast("timestamp"))
    s1 = F.unix_seconds(F.lit(end).cast("timestamp"))
    log = fl.filter(secs.between(s0, s1))
    rollup = distinct_vars_per_second(log, bucket_s)
    label, num = _three_state(F.col("distinct_vars_count"), t1, t2)
    states = rollup.select("ts", num.alias("state_num"), label.alias("state_label"))
    segs = segments(states, end=F.lit(end).cast("timestamp"), label=F.col("state_label"))
    return state_totals(segs)


def three_state_totals(fl: DataFrame, from_date: str | None = None, until_date: str | None = None,
                       t1: float = C.THREE_STATE_T1, t2: float = C.THREE_STATE_T2,
                       bucket_s: int = 1) -> DataFrame:
    """Three-state totals over the whole log or a period; the last
    period closes one bucket after the last second."""
    log = period_filter(fl, from_date, until_date)
    rollup = distinct_vars_per_second(log, bucket_s)
    label, num = _three_state(F.col("distinct_vars_count"), t1, t2)
    states = rollup.select("ts", num.alias("state_num"), label.alias("state_label"))
    segs = segments(states, label=F.col("state_label"), tail_s=bucket_s)
    return state_totals(segs)


def three_state_segments(fl: DataFrame, t1: float = C.THREE_STATE_T1,
                         t2: float = C.THREE_STATE_T2, bucket_s: int = 1) -> DataFrame:
    """Segments behind A20 (state, period_start, period_end, duration_s)."""
    rollup = distinct_vars_per_second(fl, bucket_s)
    label, num = _three_state(F.col("distinct_vars_count"), t1, t2)
    states = rollup.select("ts", num.alias("state_num"), label.alias("state_label"))
    return segments(states, label=F.col("state_label"), tail_s=bucket_s)


def sample_days(log: DataFrame, days: DataFrame | Sequence[str]) -> DataFrame:
    """Rows of the given days.  A list becomes an ``IN`` predicate
    (partition pruning on a ``day`` column); a DataFrame of days (bounded:
    one row per selected day) becomes a broadcast semi join."""
    if "day" in log.columns:
        d = log
    else:
        d = log.withColumn("day", day_of(second_ts("date")))
    if isinstance(days, DataFrame):
        return d.join(F.broadcast(days.select("day").distinct()), "day", "left_semi")
    return d.filter(F.col("day").isin([F.lit(x).cast("date") for x in days]))


def smoothed_signal(rollup: DataFrame, rows: int = C.SMOOTH_ROWS) -> DataFrame:
    """Trailing mean over ``rows`` rows restarted per day; the first
    ``rows - 1`` rows of each day are dropped."""
    w = Window.partitionBy("day").orderBy("ts")
    r = rollup.withColumn("day", day_of("ts"))
    r = r.select("day", "ts", "distinct_vars_count",
                 F.avg("distinct_vars_count").over(w.rowsBetween(-(rows - 1), 0)).alias("smoothed_count"),
                 F.row_number().over(w).alias("row_num_per_day"))
    return r.filter(F.col("row_num_per_day") > rows - 1)


def _with_previous(rollup: DataFrame, span_s: int = DAY_S) -> DataFrame:
    """``prev_ts``, the rollup's previous second.  The filter keeps every row:
    it only holds on to the count column, so that this branch and the smoothed
    signal have one aggregate in common and the raw log is read once."""
    seconds = rollup.filter(F.col("distinct_vars_count") >= 0).select("ts")
    return ordered_window(seconds, order=["ts"], bucket=time_bucket("ts", span_s), lags={"prev_ts": ("ts", None)})


def idle_gaps(rollup: DataFrame, bucket_s: int = 1, span_s: int = DAY_S) -> DataFrame:
    """One row ``True Idle (Off)`` with the hours of all gaps between
    consecutive seconds (``ts - (prev + bucket)`` where positive); NULL
    when there is no gap."""
    s = _with_previous(rollup, span_s)
    gap = F.unix_seconds("ts") - F.unix_seconds("prev_ts") - F.lit(bucket_s)
    g = s.select(gap.alias("gap_s")).filter(F.col("gap_s") > 0)
    return g.agg((F.sum("gap_s") / F.lit(3600.0)).alias("total_hours")).select(
        F.lit("True Idle (Off)").alias("state"), "total_hours")


def four_state(smoothed: Column, low: float, mid: float) -> Column:
    return (F.when(smoothed <= low, F.lit("Low Activity"))
            .when(smoothed <= mid, F.lit("Intermediate Activity"))
            .otherwise(F.lit("High Activity")))


def four_state_totals(fl: DataFrame, from_date: str | None = None, until_date: str | None = None,
                      bucket_s: int = 1, low: float = C.FOUR_STATE_LOW,
                      mid: float = C.FOUR_STATE_INTERMEDIATE,
                      rows: int = C.SMOOTH_ROWS) -> DataFrame:
    """A24 (final states): idle gaps ``UNION ALL`` smoothed-signal classes,
    in hours.  The rollup's shuffle is shared by both branches (exchange
    reuse), so the raw log is aggregated once."""
    log = period_filter(fl, from_date, until_date)
    rollup = distinct_vars_per_second(log, bucket_s)
    idle = idle_gaps(rollup, bucket_s)
    sm = smoothed_signal(rollup, rows)
    active = sm.groupBy(four_state(F.col("smoothed_count"), low, mid).alias("state")).agg(
        (F.count("*") * F.lit(bucket_s) / F.lit(3600.0)).alias("total_hours"))
    return idle.unionByName(active)


def daily_four_states(fl: DataFrame, bucket_s: int = 1, low: float = C.FOUR_STATE_LOW,
                      mid: float = C.FOUR_STATE_INTERMEDIATE, rows: int = C.SMOOTH_ROWS) -> DataFrame:
    """Per-day form of A24 (date, state, total_hours): gaps are attributed
    to the day in which they end.  Feeds the day x state reports (K6, K7)."""
    rollup = distinct_vars_per_second(fl, bucket_s)
    s = _with_previous(rollup)
    gap = F.unix_seconds("ts") - F.unix_seconds("prev_ts") - F.lit(bucket_s)
    idle = (s.select(day_of("ts").alias("date"), gap.alias("gap_s")).filter(F.col("gap_s") > 0)
            .groupBy("date").agg((F.sum("gap_s") / F.lit(3600.0)).alias("total_hours"))
            .select("date", F.lit("True Idle (Off)").alias("state"), "total_hours"))
    sm = smoothed_signal(rollup, rows)
    active = sm.groupBy(F.col("day").alias("date"),
                        four_state(F.col("smoothed_count"), low, mid).alias("state")).agg(
        (F.count("*") * F.lit(bucket_s) / F.lit(3600.0)).alias("total_hours"))
    return idle.unionByName(active)
