"""Line dedup: drop lines that many documents share.

Lines are exploded as 128-bit hashes of their normalised form, documents are
counted per hash, and lines whose hash reaches the threshold are cut out by
position.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from machlog.llm.common import ASCII_SPACE, ascii_lower, cut, fields, hash128, quoted, whole_row


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay, plus ``n_lines``
    (before dropping) and ``n_dropped``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose all their lines in every document.

    * Null text counts as empty: one empty line, and the result is ''.
    * A document is a row: repeated rows count once each and keep equal results.
      A key counts once per document however often it occurs there.
    * Null ids are allowed; other columns pass through, and input columns called
      ``n_lines`` or ``n_dropped`` are replaced.
    * An empty table gives an empty table.

    Only hashes are shuffled for counting, with partial sums before the
    exchange; a key that all documents share is one row per document and is
    split by the skew join.  Texts move at most once, to meet their positions.
    """
    out = {text, "n_lines", "n_dropped"}
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    lines = F.split(body, "\n", -1)
    base = docs.select(
        whole_row(docs, out).alias("row"),
        F.col(quoted(doc_id)).alias("id"),
        F.struct(*[h.alias(n) for h, n in zip(hash128(body), ("a", "b"))]).alias("version"),
        lines.alias("lines"),
    )
    long_enough = F.col("size") >= min_chars
    marks = (
        base.select("id", "version", F.posexplode("lines").alias("pos", "line"))
        .select("id", "version", "pos", line_key(F.col("line")).alias("key"))
        .select("id", "version", "pos", F.length("key").alias("size"),
                F.struct(*[h.alias(n) for h, n in zip(hash128(F.col("key")), ("a", "b"))]).alias("key"))
        .filter(long_enough)
    )
    in_document = base.select(F.explode(F.array_distinct(F.transform("lines", _key_hash(min_chars)))).alias("key"))
    # Written, so that both sides of the next join are plain exchanges: only then can a hot key be split.
    common = cut(in_document.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                 .filter(F.col("n") >= min_docs).select("key"), "common-lines")
    dropped = (marks.join(common, "key", "left_semi").groupBy("id", "version")
               .agg(F.sort_array(F.collect_set("pos")).alias("cuts")))
    d = dropped.select(F.col("id").alias("d_id"), F.col("version").alias("d_version"), "cuts")
    joined = base.join(d, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("version") == F.col("d_version")), "left")
    # Slices between neighbouring cuts: linear in the lines, however many are cut.
    bounds = F.concat(F.array(F.lit(-1)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("lines")))
    kept = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("bounds") - 2),
        lambda i: F.slice("lines", F.get("bounds", i) + 2, F.get("bounds", i + 1) - F.get("bounds", i) - 1)))
    return (
        joined.select("row", "lines", "cuts", bounds.alias("bounds"))
        .select(*fields("row", docs, out), F.array_join(kept, "\n").alias(text),
                F.size("lines").cast("long").alias("n_lines"),
                F.coalesce(F.size("cuts"), F.lit(0)).cast("long").alias("n_dropped"))
    )


def _key_hash(min_chars: int):
    def of(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= min_chars,
                      F.struct(*[h.alias(n) for h, n in zip(hash128(key), ("a", "b"))]))
    return of
