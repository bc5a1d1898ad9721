"""URL filters: sort-merge range join of URLs with host and path rules.

Every rule and every URL gets a canonical key, the host's labels in reverse
order, ``#``, and the path.  A rule's key is a prefix of the keys it fits, so
rules are nested intervals of the sorted keys.  One sorted sweep over range
blocks carries the stack of the last rule seen (the rule and all rules around
it); a URL's rules are the members of that stack that still contain its key.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from machlog.llm.common import ascii_lower, cut, fields, quoted, whole_row


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as a table; larger rule sets come as DataFrames."""
    made = [F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("host", "path", "verdict")))) for r in rules]
    return spark.range(1).select(F.explode(F.array(*made)).alias("r")).select("r.*")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _key(host: Column, path: Column) -> Column:
    """Neither ``#`` nor ``?`` occurs in a host or path, so the end of the host is unambiguous."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("#"), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """key, stack: each rule's key with all rules whose interval contains it, outermost first.

    Rules are matched on every prefix of their path, which is linear in the
    rules also when one host has most of them.
    """
    r = (rules.filter(F.col("host").isNotNull() & F.col("verdict").isNotNull())
         .select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
         .filter("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    inner = r.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), 1, n))).alias("outer_path"))
    outer = r.select(F.col("host").alias("o_host"), F.col("path").alias("o_path"), "verdict")
    found = inner.join(outer, (F.col("host") == F.col("o_host")) & (F.col("outer_path") == F.col("o_path")))
    member = F.struct(F.length("o_path").alias("depth"), _key(F.col("host"), F.col("o_path")).alias("key"),
                      F.concat("host", "o_path").alias("rule"), "verdict")
    return (found.groupBy("host", "path").agg(F.sort_array(F.collect_list(member)).alias("stack"))
            .select(_key(F.col("host"), F.col("path")).alias("key"), "stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path, else null) and ``verdict``.

    A rule fits its host and all subdomains when the URL's path starts with the
    rule's path; of several the one with the longest host and path wins (a tie
    goes to the longer path).  Without one the verdict is ``default``.

    * A null URL or one without ``://`` has an empty host and path and no rule.
    * Hosts are compared with A-Z lower-cased; ports and user parts belong to the host.
    * Of rules with equal host and path the later verdict in the alphabet counts
      (block before allow); rules without host or verdict are ignored, a null path is empty.
    * Repeated URLs are judged once and every row gets the verdict; input columns
      called like an output are replaced; an empty table gives an empty table.

    A URL has one key per trailing part of its host, no deeper than the deepest
    rule.  Keys are dealt into range blocks (equal keys may share blocks with
    others: the tie-break is the URL), the blocks are written once so that all
    branches see the same cuts, and each block starts with the stack that the
    last rule before it left: one row per block.
    """
    added = {"host", "path", "rule", "verdict"}
    stacks = rule_stacks(rules)
    deepest = stacks.agg(F.max(F.size(F.split(F.substring_index("key", "#", 1), r"\.", -1)))).first()[0] or 0
    urls = pages.select(F.col(quoted(url)).alias("url")).filter("url is not null").distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.reverse(F.split("host", r"\.", -1))
    keys = parts.filter("host <> ''").select("url", "path", labels.alias("labels")).select(
        "url", "path", "labels", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("labels"), F.lit(deepest))))).alias("n"))
    keys = keys.select(F.concat(F.array_join(F.slice("labels", 1, F.col("n")), "."), F.lit("#"), "path").alias("key"),
                       F.lit(1).alias("kind"), "url")
    none = F.lit(None)
    both = keys.withColumn("stack", none.cast(stacks.schema["stack"].dataType)).unionByName(
        stacks.select("key", F.lit(0).alias("kind"), none.cast("string").alias("url"), "stack"))
    swept = cut(both.repartitionByRange("key", "kind", "url").withColumn("block", F.spark_partition_id()), "url-sweep")

    last = swept.groupBy("block").agg(F.max(F.when(F.col("kind") == 0, F.struct("key", "stack"))).alias("last"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    carried = last.select("block", F.last("last.stack", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = (swept.select("block", "key", "kind", "url", F.last("stack", ignorenulls=True).over(so_far).alias("stack"))
              .filter("kind = 1").join(carried, "block")
              .select("url", "key", F.coalesce("stack", "carried").alias("stack")))
    fits = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]))
    best = (active.select("url", F.explode(fits).alias("r"))
            .groupBy("url").agg(F.max(F.struct(F.length("r.rule").alias("size"), F.col("r.depth").alias("depth"),
                                               F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))).alias("best")))
    rows = pages.select(whole_row(pages, added).alias("row"), F.col(quoted(url)).alias("row_url"))
    at = F.col("row_url")
    return rows.join(best, at == F.col("url"), "left").select(
        *fields("row", pages, added),
        F.when(at.isNull(), F.lit("")).otherwise(host_of(at)).alias("host"),
        F.when(at.isNull(), F.lit("")).otherwise(path_of(at)).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
