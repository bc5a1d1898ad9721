"""The registered queries of the operators and, where SQL expresses them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from machlog.llm import (byte_bpe, decontaminate, exact_dedup, filter_audit, html_extract, jaccard_join, language_id, lattice_lm,
                         line_dedup, quality, suffix_dedup, token_align, url_filter)
from machlog.llm.common import id_crc, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: (host, path, verdict): the rules of the URL query.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_URL_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
part AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rhost, rpath, rverdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(rverdict, length(rhost || rpath)) FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM part
"""


@query("op2_url_filters", _URL_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rule set."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.rules_table(spark, URL_RULES), default="allow")
    return judged.select("page_id", "host", "path", "rule", "verdict")


_LINES_SQL = """
WITH line AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.key = common.key
GROUP BY doc_id
"""


@query("op10_line_dedup", _LINES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents leave every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_EXACT_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op7_exact_dedup", _EXACT_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the documents against the snapshot of the earlier half."""
    snapshot, incoming = exact_dedup.halves(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = exact_dedup.dedup(incoming, snapshot)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


QUALITY_CUT = 0.3


def quality_held_out(doc_id: Column) -> Column:
    return F.pmod(id_crc(doc_id), F.lit(5)) == 0


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.BradleyTerry:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.learn(docs, labels, lambda i: ~quality_held_out(i))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labels of four fifths of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), QUALITY_CUT)
    return scored.select("doc_id", quality_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


BYTE_BPE = "byte_bpe_50k.tiktoken"


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count with digests of its ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, keep_ids=False)


def language_held_out(doc_id: Column) -> Column:
    return F.pmod(id_crc(doc_id), F.lit(4)) == 2


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.select("doc_id", "text", "lang"), lambda i: ~language_held_out(i))
    said = language_id.predict(docs.select("doc_id", "text"), model)
    return said.select("doc_id", language_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def lm_held_out(doc_id: Column) -> Column:
    return F.pmod(id_crc(doc_id), F.lit(7)) == 2


PIECES = "piece_bpe_32k.model"


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from six sevenths of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = lattice_lm.Pieces.of_model(public_tokenizers.path(PIECES))
    scored = lattice_lm.score(docs, pieces, ~lm_held_out(F.col("doc_id")))
    return scored.select("doc_id", lm_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_BENCHMARK_SQL = f"""
WITH doc AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
item AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
item_window AS (
  SELECT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM item_window),
doc_window AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, size)),
hit AS (SELECT DISTINCT doc_id, n, s, item_id FROM doc_window JOIN item_window USING (n, phrase)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op4_decontamination", _BENCHMARK_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every window of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join(docs).select("doc_id", "n_shingles", "component_id")


_AUDIT_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
worded AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY body) AS first_id FROM doc),
failed AS (
  SELECT part, w.doc_id, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) AS c,
         regexp_matches(body, '[#$%&*|]') AS d, w.doc_id > first_id AS e,
         coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic
  FROM worded w LEFT JOIN labels ON w.doc_id = labels.doc_id),
letter(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM letter v, letter w, letter x, letter y, letter z
  WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
patterns AS (
  SELECT part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY ALL),
judged AS (
  SELECT part, filter_order, step, n, good, toxic, fails, filter_order[step] AS f,
         least(if(contains(fails, 'A'), instr(filter_order, 'A'), 9), if(contains(fails, 'B'), instr(filter_order, 'B'), 9),
               if(contains(fails, 'C'), instr(filter_order, 'C'), 9), if(contains(fails, 'D'), instr(filter_order, 'D'), 9),
               if(contains(fails, 'E'), instr(filter_order, 'E'), 9)) AS gone_at
  FROM patterns, orders, range(1, 6) steps(step)),
counted AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (gone_at > step), 0) AS kept,
         coalesce(sum(n) FILTER (gone_at = step), 0) AS removed,
         coalesce(sum(n) FILTER (gone_at < step AND contains(fails, f)), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
         coalesce(sum(good) FILTER (gone_at = step), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (gone_at = step), 0) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


@query("op11_filter_audit", _AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all their orders, per source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(filter_audit.tabulate(docs, table(spark, sf_dir, "labels")), "ABCDE")


BYTE_LEVEL = "byte_bpe_50k.json"


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between its tokens in two vocabularies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = token_align.align_documents(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES), keep_groups=False)
    return made.select("doc_id", *token_align.COUNTS, F.col("groups").alias("groups_sha256"))


@query("op13_suffix_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that occur elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = suffix_dedup.drop_repeats(docs)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
