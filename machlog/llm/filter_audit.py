"""Filter interaction audit: who removes what, in every order of the filters.

Of k filters a coalition removes the documents that fail at least one of them.
The removals of all 2^k coalitions are tabulated per part of the corpus; what a
filter removes at a step of some order is the difference of two coalitions.

Shapley values are the exact solution of a constrained least squares problem:
the additive game that is nearest to the removals under the Shapley kernel

    (k - 1) / (C(k, s) * s * (k - s))    for coalitions of s filters,

and gives the whole removal to all filters together (efficiency).  Its normal
equations are solved once in rationals with the 2^k removals as unknown right
hand side; times k! the solution is whole numbers, so per part the values are
sums of long columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.llm.common import cut, quoted

#: All orders of the filters are listed, so their number stays small.
MOST_FILTERS = 7
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"


# --- exact least squares ----------------------------------------------------

def kernel(k: int, size: int) -> Fraction:
    """Weight of a coalition of ``size`` of ``k`` filters, 0 < size < k."""
    return Fraction(k - 1, math.comb(k, size) * size * (k - size))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with matrix X = right, by elimination in rationals; the matrix is square and regular."""
    rows = [[*m, *r] for m, r in zip(matrix, right)]
    n = len(rows)
    for c in range(n):
        pivot = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [row[n:] for row in rows]


def shapley_weights(k: int) -> list[list[int]]:
    """weights[f][S]: filter f's Shapley value times k! is the sum over coalitions S (as bit sets) of weights[f][S] * removed(S).

    Minimise sum kernel(S) (removed(S) - sum of phi over S)^2 under sum phi =
    removed(all): normal equations in phi, with one multiplier for the constraint.
    """
    coalitions = range(1 << k)
    inside = [[(s >> f) & 1 for f in range(k)] for s in coalitions]
    inner = {s: kernel(k, sum(inside[s])) for s in coalitions if 0 < sum(inside[s]) < k}
    matrix = [[sum((w for s, w in inner.items() if inside[s][f] and inside[s][g]), Fraction(0)) for g in range(k)] + [Fraction(1)]
              for f in range(k)]
    matrix.append([Fraction(1)] * k + [Fraction(0)])
    right = [[inner.get(s, Fraction(0)) * inside[s][f] for s in coalitions] for f in range(k)]
    right.append([Fraction(int(s == (1 << k) - 1)) for s in coalitions])
    times = math.factorial(k)
    found = [[x * times for x in row] for row in solve(matrix, right)[:k]]
    assert all(x.denominator == 1 for row in found for x in row)
    return [[int(x) for x in row] for row in found]


# --- the five filters of the query -------------------------------------------

def surface_failures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``_mask``: bit 0 few words, 1 repeated words, 2 capitals, 3 symbols
    (see ``surface_mask``), and ``_sha``, the SHA-256 of the text (null as empty)."""
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    kept = [F.col(quoted(c)) for c in docs.columns if c != text]
    rows = docs.select(F.struct(*kept).alias("row"), body.cast("binary").alias("body"))
    row_type = rows.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([surface_mask(x) for x in bodies], pa.int32()),
                                              pa.array([sha256(x).digest() for x in bodies], pa.binary())], ["row", "mask", "sha"])

    schema = T.StructType([T.StructField("row", row_type), T.StructField("mask", T.IntegerType()), T.StructField("sha", T.BinaryType())])
    done = rows.mapInArrow(run, schema)
    return done.select("row.*", F.col("mask").alias("_mask"), F.col("sha").alias("_sha"))


def surface_mask(body: bytes) -> int:
    """Failed conditions of a text in UTF-8 as bits: under 200 words; distinct words
    under half of all; over 2 % of the code points A-Z; any of ``#$%&*|``.
    Words are cut at ASCII white space, as ``bytes.split`` cuts."""
    words = body.split()
    points = len(body) if body.isascii() else len(body.decode("utf-8", "replace"))
    return ((len(words) < 200)
            | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * (len(body) - len(body.translate(None, _UPPER))) > 2 * points) << 2
            | (len(body.translate(None, _SYMBOLS)) != len(body)) << 3)


FAILS_COPY = 1 << 4


def tabulate(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail.

    The first four bits are ``surface_mask``; the fifth is set where a smaller id
    has the same text.  A document is good or toxic if one of its label rows says so.

    * A null text counts as empty, a null part as ''.
    * Rows that repeat an id are counted each; equal ids are not smaller than each
      other.  A null id is after all others and has no labels; rows with null ids
      fail the fifth where an id is known for their text.

    Texts stay where they are read: rows travel as a digest and a mask, summed
    per (part, digest) before digests meet, so a group of copies that holds a
    third of all rows is a few rows per task.
    """
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), F.coalesce(F.col(quoted(part)).cast("string"), F.lit("")).alias("part"),
                       F.col(quoted(text)).alias("text"))
    masked = surface_failures(rows).groupBy("id", "part", "_mask", "_sha").agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("l_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    rows = masked.join(said, F.col("id") == F.col("l_id"), "left")
    counts = [F.col("n"), *((F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic"))]
    rows = rows.select("id", "part", "_mask", "_sha", *counts)
    # Per part and text: all rows, and those of the smallest id, which may be the first of the text.
    first = F.struct(F.col("id").isNull().alias("unknown"), "id", "n", "good", "toxic")
    texts = cut(rows.groupBy("part", "_sha", "_mask").agg(F.min(first).alias("first"), *(F.sum(c).alias(c) for c in ("n", "good", "toxic"))),
                "audit-texts")
    least = texts.groupBy(F.col("_sha").alias("l_sha")).agg(F.min(F.struct("first.unknown", "first.id")).alias("least"))
    met = texts.join(least, F.col("_sha") == F.col("l_sha"))
    is_first = F.struct("first.unknown", "first.id").eqNullSafe(F.col("least"))
    names = ("n", "good", "toxic")
    kept = {c: F.when(is_first, F.col(f"first.{c}")).otherwise(F.lit(0)) for c in names}
    both = F.array(F.struct(F.col("_mask").alias("mask"), *(kept[c].alias(c) for c in names)),
                   F.struct((F.col("_mask") + FAILS_COPY).alias("mask"), *((F.col(c) - kept[c]).alias(c) for c in names)))
    return (met.select("part", F.inline(both)).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in names)))


# --- the audit ---------------------------------------------------------------

def removals(table: DataFrame, k: int) -> DataFrame:
    """part, total, and arrays over the 2^k coalitions: documents (all, good, toxic) that fail at least one of its filters."""
    size = 1 << k
    at = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("coalition")
    fails = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    per = table.select("part", "mask", "n", "good", "toxic", at).groupBy("part", "coalition").agg(
        F.sum("n").alias("total"), *(F.sum(F.when(fails, F.col(c)).otherwise(F.lit(0))).alias(c) for c in ("n", "good", "toxic")))
    ordered = F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic")))  # 2^k entries
    return (per.groupBy("part").agg(F.max("total").alias("total"), ordered.alias("v"))
            .select("part", "total", *(F.col(f"v.{c}").alias(f"v_{c}") for c in ("n", "good", "toxic"))))


def audit(table: DataFrame, filters: str) -> DataFrame:
    """One row per part, ``filter_order`` (every order of the letters of ``filters``) and ``step``
    (from 1): ``kept`` after it, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost``, ``shapley`` (times k!, a whole number).

    ``table`` has part, mask (bit f: fails the f-th filter), n, good, toxic; parts
    with no failures have their rows as well.  No rows give no rows.
    """
    k = len(filters)
    if not 1 < k <= MOST_FILTERS or len(set(filters)) != k:
        raise ValueError(f"2 to {MOST_FILTERS} different letters: {filters!r}")
    weights = shapley_weights(k)
    value = lambda array, coalition: F.element_at(array, (coalition + 1).cast("int"))
    alone = F.array(*(F.col("v_n")[1 << f] for f in range(k)))
    unique = F.array(*(F.col("v_n")[(1 << k) - 1] - F.col("v_n")[(1 << k) - 1 - (1 << f)] for f in range(k)))
    shapley = F.array(*(sum((F.col("v_n")[s] * w for s, w in enumerate(row) if w), F.lit(0).cast("long")) for row in weights))
    orders = F.explode(F.split(F.lit(",".join(map("".join, permutations(filters)))), ",")).alias("filter_order")
    parts = (removals(table, k).withColumns({"alone": alone, "unique": unique, "shapley_of": shapley})
             .select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")))
    at = lambda i: F.instr(F.lit(filters), F.substring("filter_order", i, F.lit(1))) - 1
    bit = lambda i: F.call_function("shiftleft", F.lit(1), at(i))
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0),
                         lambda acc, i: F.when(i == 0, acc).otherwise(acc.bitwiseOR(bit(i))))
    stepped = parts.withColumns({"f": at(F.col("step")), "before": before})
    stepped = stepped.withColumn("after", F.col("before").bitwiseOR(bit(F.col("step"))))
    gain = lambda array: value(array, F.col("after")) - value(array, F.col("before"))
    removed = gain(F.col("v_n"))
    return stepped.select(
        "part", "filter_order", "step", (F.col("total") - value(F.col("v_n"), F.col("after"))).alias("kept"), removed.alias("removed"),
        (value(F.col("alone"), F.col("f")) - removed).alias("redundant"), value(F.col("unique"), F.col("f")).alias("unique_fails"),
        gain(F.col("v_good")).alias("good_lost"), gain(F.col("v_toxic")).alias("toxic_lost"),
        value(F.col("shapley_of"), F.col("f")).alias("shapley"))
