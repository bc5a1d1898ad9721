"""Registered activity queries (A1-A25) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from machlog.catalog import BUCKET_S, LOW, MID, PIVOT_BUCKET_S, T1, T2, Tables, register
from machlog.config import A7_SENSORS
from machlog.operators import activity as A
from machlog.oracle import bucket_ts, ms_ts
from machlog.streaming import rollup as R

B = BUCKET_S
PB = PIVOT_BUCKET_S
#: A19's window; it cuts rows off at both ends of the test log.
WIN_START, WIN_END = "2024-01-04 06:00:00", "2024-01-27 18:00:00"

# ----------------------------------------------------------------- SQL parts

ROLLUP = (f"SELECT {bucket_ts('date', B)} AS ts, COUNT(DISTINCT id_var) AS distinct_vars_count "
          "FROM fl GROUP BY 1")
# The rows of a day by place; each meets itself and the 14 places before it.
SMOOTH = """WITH row_of_day AS (SELECT CAST(ts AS DATE) AS day, ts, distinct_vars_count AS n,
    row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS place FROM rollup),
  reach AS (SELECT day, ts, n, place, unnest(range(place - 14, place + 1)) AS met FROM row_of_day)
SELECT r.day, r.ts, r.n, r.place, SUM(o.n) / COUNT(o.n) AS mean
FROM reach r JOIN row_of_day o ON o.day = r.day AND o.place = r.met GROUP BY r.day, r.ts, r.n, r.place"""
PIVOT = (f"SELECT {bucket_ts('date', PB)} AS ts, "
         + ", ".join(f"MAX(CASE WHEN id_var = {s} THEN value END) AS {n}"
                     for s, n in zip(A7_SENSORS, A.SENSOR_NAMES))
         + f" FROM fl16 WHERE id_var IN ({', '.join(map(str, A7_SENSORS))}) GROUP BY 1")
SCORE = ("SELECT ts, "
         + " + ".join(f"(CASE WHEN {n} <> LAG({n}) OVER (ORDER BY ts) THEN 1 ELSE 0 END)"
                      for n in A.SENSOR_NAMES)
         + " AS activity_score FROM pv")
def numbered(name: str, source: str) -> str:
    """``source`` (ts, label) with places in time order and the time of the next row."""
    return f"""{name}_at AS (SELECT *, row_number() OVER (ORDER BY ts) AS place FROM ({source})),
{name} AS (SELECT here.*, nxt.ts AS next_ts, prv.label AS label_before FROM {name}_at here
  LEFT JOIN {name}_at nxt ON nxt.place = here.place + 1 LEFT JOIN {name}_at prv ON prv.place = here.place - 1)"""


#: Spans of equal labels: a span begins where the row before has another label
#: and lasts until the next such begin.
def spans(name: str, source: str, last: str) -> str:
    return numbered(f"{name}_row", source) + f""",
{name}_begin AS (SELECT ts, label FROM {name}_row WHERE label_before IS DISTINCT FROM label),
{name} AS (SELECT label AS state, ts AS period_start,
    coalesce((SELECT min(later.ts) FROM {name}_begin later WHERE later.ts > b.ts), {last}) AS period_end FROM {name}_begin b)"""


SEGMENTS_A13 = spans("segs", "SELECT ts, CASE WHEN activity_score > 4 THEN 'WORKING' ELSE 'STOPPED' END AS label FROM score",
                     "(SELECT max(ts) + INTERVAL 1 SECOND FROM score)")

LEVEL_ROWS = f"""SELECT ts, CASE WHEN n > {T2} THEN 'Active' WHEN n > {T1} THEN 'Intermediate' ELSE 'Idle' END AS label
  FROM (SELECT {bucket_ts('date', B)} AS ts, COUNT(DISTINCT id_var) AS n FROM fl {{where}} GROUP BY 1)"""


def three_state_sql(log_filter: str, end_expr: str) -> str:
    """A bucket's state lasts until the next bucket: no spans are needed for totals."""
    return f"""{numbered("level", LEVEL_ROWS.format(where=log_filter))},
lasting AS (SELECT label AS state, SUM(epoch(coalesce(next_ts, {end_expr})) - epoch(ts)) AS seconds FROM level GROUP BY label)
SELECT state, round(seconds, 6) AS total_duration_s, round(seconds / 3600.0, 6) AS total_hours FROM lasting"""


# The decile of a day follows from its place: the first n % 10 deciles have one day more.
DAILY = f"""day_rows AS (SELECT CAST({ms_ts('date')} AS DATE) AS day FROM fl UNION ALL SELECT CAST({ms_ts('date')} AS DATE) FROM sl),
day_size AS (SELECT day, COUNT(*) AS total_count FROM day_rows GROUP BY day),
day_place AS (SELECT d.*, (SELECT COUNT(*) FROM day_size o WHERE (o.total_count, o.day) < (d.total_count, d.day)) AS place,
  (SELECT COUNT(*) FROM day_size) // 10 AS least, (SELECT COUNT(*) FROM day_size) % 10 AS extra FROM day_size d),
ranked AS (SELECT day, total_count, CAST(CASE WHEN place < extra * (least + 1) THEN place // (least + 1)
  ELSE extra + (place - extra * (least + 1)) // greatest(least, 1) END + 1 AS INTEGER) AS decile FROM day_place)"""

REP_DAYS = DAILY + """,
middle AS (SELECT decile, median(total_count) AS m FROM ranked GROUP BY decile),
rep AS (SELECT decile, arg_min(day, (abs(total_count - m), day)) AS day,
  arg_min(total_count, (abs(total_count - m), day)) AS total_count FROM ranked JOIN middle USING (decile) GROUP BY decile)"""

# ----------------------------------------------------------------- A1 - A6


@register("A1_variables_with_float_logs",
          "SELECT id, name FROM vars WHERE id IN (SELECT id_var FROM fl)")
def a1(spark, sf):
    t = Tables(spark, sf)
    return A.variables_with_float_logs(t.vars, t.fl)


@register("A2_daily_variable_stats", f"""
SELECT CAST({ms_ts('date')} AS DATE) AS day, id_var, COUNT(*) AS n_logs,
  round(SUM(value), 6) AS sum_value, round(AVG(value), 6) AS avg_value,
  round(MIN(value), 6) AS min_value, round(MAX(value), 6) AS max_value
FROM fl GROUP BY 1, 2""")
def a2(spark, sf):
    return A.daily_variable_stats(Tables(spark, sf).fl)


@register("A3_log_count_per_day", f"""
SELECT strftime({bucket_ts('date')}, '%Y-%m-%d') AS day, COUNT(*) AS log_count FROM fl GROUP BY 1""")
def a3(spark, sf):
    return A.log_count_per_day(Tables(spark, sf).fl)


@register("A3_log_count_per_day_string", f"""
SELECT strftime({bucket_ts('date')}, '%Y-%m-%d') AS day, COUNT(*) AS log_count FROM sl GROUP BY 1""")
def a3s(spark, sf):
    return A.log_count_per_day(Tables(spark, sf).sl)


@register("A4_day_relevance", f"""
WITH f AS (SELECT CAST({bucket_ts('date')} AS DATE) AS day, COUNT(*) AS float_count FROM fl GROUP BY 1),
s AS (SELECT CAST({bucket_ts('date')} AS DATE) AS day, COUNT(*) AS string_count FROM sl GROUP BY 1)
SELECT day, float_count, string_count, float_count + string_count AS total_count
FROM f JOIN s USING (day)""")
def a4(spark, sf):
    t = Tables(spark, sf)
    return A.day_relevance(t.fl, t.sl)


@register("A5_decile_distribution", f"""
WITH {DAILY}
SELECT decile, COUNT(*) AS days_in_bin, MIN(total_count) AS min_in_bin, MAX(total_count) AS max_in_bin,
  round(percentile_cont(0.5) WITHIN GROUP (ORDER BY total_count), 6) AS median_in_bin
FROM ranked GROUP BY decile""")
def a5(spark, sf):
    t = Tables(spark, sf)
    return A.decile_distribution(t.fl, t.sl)


@register("A6_representative_days", f"WITH {REP_DAYS} SELECT decile, day, total_count FROM rep")
def a6(spark, sf):
    t = Tables(spark, sf)
    return A.representative_days(t.fl, t.sl)


# ----------------------------------------------------------------- A7 - A14

def _pivot(t):
    return A.pivot_sensors(t.fl16, bucket_s=PB)


def _scores(t):
    return A.change_score(_pivot(t))


@register("A7_pivot_sensors", f"SELECT * REPLACE ({', '.join(f'round({n}, 6) AS {n}' for n in A.SENSOR_NAMES)}) FROM ({PIVOT})")
def a7(spark, sf):
    return _pivot(Tables(spark, sf))


@register("A8_rule_state", f"""
SELECT ts, spindle_load, axis_x_moving, axis_y_moving, axis_z_moving,
  CASE WHEN spindle_load > 3 AND (axis_x_moving > 0 OR axis_y_moving > 0 OR axis_z_moving > 0)
       THEN 1 ELSE 0 END AS state_num
FROM ({PIVOT})""")
def a8(spark, sf):
    return A.rule_state(_pivot(Tables(spark, sf))).select(
        "ts", "spindle_load", "axis_x_moving", "axis_y_moving", "axis_z_moving", "state_num")


@register("A9_change_score", f"WITH pv AS ({PIVOT}) {SCORE}")
def a9(spark, sf):
    return _scores(Tables(spark, sf))


@register("A10_score_distribution", f"""
WITH pv AS ({PIVOT}), score AS ({SCORE})
SELECT activity_score, COUNT(*) AS number_of_seconds FROM score GROUP BY 1""")
def a10(spark, sf):
    return A.score_distribution(_scores(Tables(spark, sf)))


@register("A11_elbow_threshold", f"""
WITH pv AS ({PIVOT}), score AS ({SCORE}),
h AS (SELECT activity_score, COUNT(*) AS number_of_seconds FROM score GROUP BY 1),
g AS (SELECT activity_score, number_of_seconds - LAG(number_of_seconds) OVER (ORDER BY activity_score) AS gradient FROM h)
SELECT activity_score AS threshold, gradient FROM g WHERE gradient IS NOT NULL
ORDER BY gradient, activity_score LIMIT 1""")
def a11(spark, sf):
    return A.elbow_threshold(A.score_distribution(_scores(Tables(spark, sf))))


@register("A12_score_state", f"""
WITH pv AS ({PIVOT}), score AS ({SCORE})
SELECT ts, activity_score, CASE WHEN activity_score > 4 THEN 1 ELSE 0 END AS state_num FROM score""")
def a12(spark, sf):
    return A.score_state(_scores(Tables(spark, sf)), 4)


@register("A13_segments", f"""
WITH pv AS ({PIVOT}), score AS ({SCORE}), {SEGMENTS_A13}
SELECT state, period_start, period_end, round(epoch(period_end) - epoch(period_start), 6) AS duration_s
FROM segs""")
def a13(spark, sf):
    return A.segments(A.score_state(_scores(Tables(spark, sf)), 4))


@register("A14_state_totals", f"""
WITH pv AS ({PIVOT}), score AS ({SCORE}), {SEGMENTS_A13}
SELECT state, round(SUM(epoch(period_end) - epoch(period_start)), 6) AS total_duration_s,
  round(SUM(epoch(period_end) - epoch(period_start)) / 3600.0, 6) AS total_hours
FROM segs GROUP BY state""")
def a14(spark, sf):
    return A.state_totals(A.segments(A.score_state(_scores(Tables(spark, sf)), 4)))


# ----------------------------------------------------------------- A15 - A25

@register("A15_distinct_vars_per_second", ROLLUP)
def a15(spark, sf):
    return A.distinct_vars_per_second(Tables(spark, sf).fl, B)


@register("A16_count_distribution", f"""
WITH rollup AS ({ROLLUP})
SELECT distinct_vars_count, COUNT(*) AS number_of_seconds FROM rollup GROUP BY 1""")
def a16(spark, sf):
    return A.count_distribution(A.distinct_vars_per_second(Tables(spark, sf).fl, B))


#: Every pair of cuts of the sorted values, scored by the squared sums of its three stretches.
KMEANS_SQL = f"""hist AS MATERIALIZED (SELECT CAST(distinct_vars_count AS DOUBLE) AS v, CAST(COUNT(*) AS DOUBLE) AS n FROM ({ROLLUP}) GROUP BY 1),
place AS (SELECT v, row_number() OVER (ORDER BY v) AS i, sum(n) OVER (ORDER BY v) AS cn, sum(v * n) OVER (ORDER BY v) AS cs FROM hist),
last AS (SELECT max(i) AS i, max(cn) AS cn, max(cs) AS cs FROM place),
pair AS (SELECT a.cn AS an, a.cs AS sa, b.cn AS bn, b.cs AS sb, l.cn AS ln, l.cs AS sl, a.i, b.i AS j
  FROM place a JOIN place b ON a.i < b.i JOIN last l ON b.i < l.i),
best AS (SELECT * FROM pair
  ORDER BY sa * sa / an + (sb - sa) * (sb - sa) / (bn - an) + (sl - sb) * (sl - sb) / (ln - bn) DESC, i, j LIMIT 1),
mid AS (SELECT sa / an AS c1, (sb - sa) / (bn - an) AS c2, (sl - sb) / (ln - bn) AS c3 FROM best
  UNION ALL SELECT min(v), sum(v * n) / sum(n), max(v) FROM hist HAVING count(*) < 3),
cut AS (SELECT c1, c2, c3, (c1 + c2) / 2 AS t1, (c2 + c3) / 2 AS t2 FROM mid)"""


@register("A17_kmeans_thresholds", f"""
WITH {KMEANS_SQL}
SELECT c1 AS centroid_1, c2 AS centroid_2, c3 AS centroid_3, t1 AS threshold_1, t2 AS threshold_2,
  CAST(floor(t1) AS INTEGER) AS t1_int, CAST(floor(t2) AS INTEGER) AS t2_int FROM cut""")
def a17(spark, sf):
    return A.kmeans_thresholds(A.count_distribution(A.distinct_vars_per_second(Tables(spark, sf).fl, B)))


OTSU_SQL = f"""
WITH rollup AS ({ROLLUP}), sm AS ({SMOOTH}),
sig AS (SELECT mean AS v FROM sm WHERE place >= 15),
mm AS (SELECT min(v) AS lo, max(v) AS hi FROM sig),
hist AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((v - lo) / ((hi - lo) / 256.0)) AS BIGINT), 255) END AS i,
         COUNT(*) AS n FROM sig, mm GROUP BY 1),
bins AS (SELECT range AS i FROM range(256)),
cum AS (SELECT b.i, SUM(coalesce(h.n, 0)) OVER (ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
        SUM(coalesce(h.n, 0) * b.i) OVER (ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
        FROM bins b LEFT JOIN hist h ON h.i = b.i),
tot AS (SELECT p AS pt, s AS st FROM cum WHERE i = 255),
pairs AS (SELECT a.i AS t1, b.i AS t2,
   (CASE WHEN a.p > 0 THEN a.s * a.s / a.p ELSE 0 END)
 + (CASE WHEN b.p - a.p > 0 THEN (b.s - a.s) * (b.s - a.s) / (b.p - a.p) ELSE 0 END)
 + (CASE WHEN pt - b.p > 0 THEN (st - b.s) * (st - b.s) / (pt - b.p) ELSE 0 END) AS sigma
 FROM cum a JOIN cum b ON b.i > a.i AND b.i <= 254, tot WHERE a.i <= 253),
best AS (SELECT t1, t2 FROM pairs ORDER BY sigma DESC, t1, t2 LIMIT 1)
SELECT CAST(t1 AS INTEGER) AS t1_idx, CAST(t2 AS INTEGER) AS t2_idx,
  round(lo + (t1 + 0.5) * (hi - lo) / 256.0, 6) AS threshold_1,
  round(lo + (t2 + 0.5) * (hi - lo) / 256.0, 6) AS threshold_2,
  CAST(floor(lo + (t1 + 0.5) * (hi - lo) / 256.0) AS INTEGER) AS t1_int,
  CAST(floor(lo + (t2 + 0.5) * (hi - lo) / 256.0) AS INTEGER) AS t2_int
FROM best, mm"""


@register("A18_multiotsu_thresholds", OTSU_SQL)
def a18(spark, sf):
    rollup = A.distinct_vars_per_second(Tables(spark, sf).fl, B)
    return A.multiotsu_thresholds(A.smoothed_signal(rollup))


@register("A19_three_state_totals_window", "WITH " + three_state_sql(
    f"WHERE date // 1000 BETWEEN epoch(TIMESTAMP '{WIN_START}') AND epoch(TIMESTAMP '{WIN_END}')",
    f"TIMESTAMP '{WIN_END}'"))
def a19(spark, sf):
    return A.three_state_totals_window(Tables(spark, sf).fl, WIN_START, WIN_END, T1, T2, B)


@register("A20_three_state_totals", "WITH " + three_state_sql(
    "", f"(SELECT max(ts) + INTERVAL {B} SECOND FROM level_at)"))
def a20(spark, sf):
    return A.three_state_totals(Tables(spark, sf).fl, t1=T1, t2=T2, bucket_s=B)


@register("A20_with_kmeans_thresholds", f"""
WITH {KMEANS_SQL}, """ + three_state_sql(
        "", f"(SELECT max(ts) + INTERVAL {B} SECOND FROM level_at)")
        .replace(f"n > {T2}", "n > (SELECT floor(t2) FROM cut)").replace(f"n > {T1}", "n > (SELECT floor(t1) FROM cut)"))
def a20_kmeans(spark, sf):
    """A16 -> A17 -> A20: the fitted thresholds enter as scalar subqueries."""
    fl = Tables(spark, sf).fl
    cut = A.kmeans_thresholds(A.count_distribution(A.distinct_vars_per_second(fl, B)))
    return A.three_state_totals(fl, t1=cut.select("t1_int").scalar(), t2=cut.select("t2_int").scalar(), bucket_s=B)


@register("A21_sample_days", f"""
WITH {REP_DAYS}
SELECT date, id_var, value, seq, CAST({bucket_ts('date')} AS DATE) AS day
FROM fl WHERE CAST({bucket_ts('date')} AS DATE) IN (SELECT day FROM rep)""")
def a21(spark, sf):
    t = Tables(spark, sf)
    return A.sample_days(t.fl, A.representative_days(t.fl, t.sl))


@register("A22_smoothed_signal", f"""
WITH rollup AS ({ROLLUP}), sm AS ({SMOOTH})
SELECT day, ts, n AS distinct_vars_count, round(mean, 6) AS smoothed_count, CAST(place AS INTEGER) AS row_num_per_day
FROM sm WHERE place >= 15""")
def a22(spark, sf):
    return A.smoothed_signal(A.distinct_vars_per_second(Tables(spark, sf).fl, B))


IDLE_SQL = f"""seen AS (SELECT ts, row_number() OVER (ORDER BY ts) AS place FROM rollup),
idle AS (SELECT 'True Idle (Off)' AS state, SUM(epoch(b.ts) - epoch(a.ts) - {B}) / 3600.0 AS total_hours
  FROM seen a JOIN seen b ON b.place = a.place + 1 WHERE epoch(b.ts) - epoch(a.ts) > {B})"""


@register("A23_idle_gaps", f"""
WITH rollup AS ({ROLLUP}), {IDLE_SQL}
SELECT state, round(total_hours, 6) AS total_hours FROM idle""")
def a23(spark, sf):
    return A.idle_gaps(A.distinct_vars_per_second(Tables(spark, sf).fl, B), B)


def four_state_sql(low, mid) -> str:
    """states (state, total_hours): each full mean meets the band of levels it lies in."""
    return f"""rollup AS ({ROLLUP}), {IDLE_SQL}, sm AS ({SMOOTH}),
band AS (SELECT 'Low Activity' AS state, -1.0::DOUBLE AS above, {low}::DOUBLE AS upto
  UNION ALL SELECT 'Intermediate Activity', {low}::DOUBLE, {mid}::DOUBLE
  UNION ALL SELECT 'High Activity', {mid}::DOUBLE, 'inf'::DOUBLE),
states AS (FROM idle UNION ALL SELECT state, COUNT(*) * {B} / 3600.0
  FROM band JOIN sm ON mean > above AND mean <= upto WHERE place >= 15 GROUP BY state)"""


FOUR_STATE_SQL = four_state_sql(LOW, MID)


@register("A24_four_state_totals", f"""
WITH {FOUR_STATE_SQL}
SELECT state, round(total_hours, 6) AS total_hours FROM states""")
def a24(spark, sf):
    return A.four_state_totals(Tables(spark, sf).fl, bucket_s=B, low=LOW, mid=MID)


@register("A25_rollup_build", f"""
SELECT ts, CAST(ts AS DATE) AS day, distinct_vars_count FROM ({ROLLUP})""")
def a25(spark, sf):
    return R.build_rollup(Tables(spark, sf).fl, bucket_s=B)


@register("A25_rollup_refresh", f"""
SELECT ts, CAST(ts AS DATE) AS day, distinct_vars_count FROM ({ROLLUP})""")
def a25_refresh(spark, sf):
    """The rollup of the even rows, refreshed with the odd ones: equal to that of all rows."""
    fl = Tables(spark, sf).fl
    path = R.rollup_path(spark)
    R.build_rollup(fl.filter("seq % 2 = 0"), bucket_s=B, path=path)
    return R.refresh_rollup(fl.filter("seq % 2 = 1"), path, bucket_s=B)


@register("A24_with_otsu_thresholds", f"""
WITH otsu AS ({OTSU_SQL.strip()}), {four_state_sql("(SELECT t1_int FROM otsu)", "(SELECT t2_int FROM otsu)")}
SELECT state, round(total_hours, 6) AS total_hours FROM states""")
def a24_chain(spark, sf):
    """A22 -> A18 -> A24: the floored multi-Otsu thresholds of the smoothed
    signal classify it, passed on as scalar subqueries (no driver step)."""
    fl = Tables(spark, sf).fl
    th = A.multiotsu_thresholds(A.smoothed_signal(A.distinct_vars_per_second(fl, B)))
    return A.four_state_totals(fl, bucket_s=B, low=th.select("t1_int").scalar(),
                               mid=th.select("t2_int").scalar())
