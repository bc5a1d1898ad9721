"""Column expressions for alarm severity, alert class and location tokens
(B14, B15, B22, B23, B24).  All are built-in string functions inside
whole-stage codegen: no UDF."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from machlog import config as C


def _any_contains(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def severity_text(code: Column, description: Column | None) -> Column:
    """Upper-cased ``code + ' ' + description`` (NULL parts skipped)."""
    if description is None:
        return F.upper(code)
    return F.upper(F.concat_ws(" ", code, description))


def severity(code: Column, description: Column | None = None,
             critical: Sequence[str] = C.B14_CRITICAL, warning: Sequence[str] = C.B14_WARNING,
             critical_label: str = "CRITIQUE") -> Column:
    """B14 (default lists) / B15 (``simple_severity``): substring keyword
    match on the upper-cased text, critical before warning, else INFO."""
    text = severity_text(code, description)
    return (F.when(_any_contains(text, critical), F.lit(critical_label))
            .when(_any_contains(text, warning), F.lit("WARNING"))
            .otherwise(F.lit("INFO")))


def simple_severity(code: Column, description: Column | None = None,
                    critical_label: str = "CRITICAL") -> Column:
    """The shorter keyword lists; label CRITICAL or CRITIQUE by version."""
    return severity(code, description, C.B15_CRITICAL, C.B15_WARNING, critical_label)


def classify(msg: Column, classes: Sequence[tuple[str, str]], other: str = "OTHER") -> Column:
    """Ordered case-insensitive regex classes, first match wins."""
    expr = None
    for pattern, label in classes:
        cond = msg.rlike(f"(?i){pattern}")
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(other))


def first_token(texts: Sequence[Column], patterns: Sequence[str]) -> Column:
    """First non-empty capture of the patterns (case-sensitive), tried
    pattern by pattern for each text in turn; NULL when none matches."""
    parts = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for t in texts for p in patterns]
    return F.coalesce(*parts)


def location(var_name: Column, msg: Column | None = None) -> Column:
    """Location token from the message then the variable name (8
    patterns), or from the name only (4 patterns); ``UNK`` when none."""
    if msg is None:
        tok = first_token([var_name], C.B24_NAME_PATTERNS)
    else:
        tok = F.coalesce(first_token([msg], C.B24_MSG_PATTERNS),
                         first_token([var_name], C.B24_MSG_PATTERNS))
    return F.coalesce(tok, F.lit("UNK"))


def by_distinct_text(df: DataFrame, text: str, **made: Column) -> DataFrame:
    """``df`` with columns that depend on ``text`` alone, worked out once per distinct
    text: a dictionary of the texts (NULL among them) is made, classified and
    joined back by its key.  Alert texts repeat, so patterns run over a short table;
    the planner broadcasts it where its size allows."""
    key = F.xxhash64(F.col(text))
    words = df.groupBy(key.alias("_key"), F.col(text).alias("_text")).agg(F.count(F.lit(1)).alias("_n"))
    words = words.select("_key", F.col("_text").alias(text)).select("_key", F.col(text).alias("_text"), *(c.alias(n) for n, c in made.items()))
    met = df.join(words, (key == F.col("_key")) & F.col(text).eqNullSafe(F.col("_text")))
    return met.drop("_key", "_text")


def literal_set_pattern(words: Sequence[str]) -> str:
    """A regex matching any of ``words`` as a substring, with shared
    prefixes factored out (a trie): the same language as ``(w1|w2|...)``
    but far fewer attempts per input position."""
    import re

    trie: dict = {}
    for w in words:
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        alts = ["" if ch == "" else re.escape(ch) + emit(sub) for ch, sub in sorted(node.items())]
        if len(alts) == 1:
            return alts[0]
        opt = "" in alts
        body = "(?:" + "|".join(a for a in alts if a) + ")"
        return body + "?" if opt else body

    return emit(trie)


def like_any(text: Column, patterns: Sequence[str], lower: bool = False) -> Column:
    """``text LIKE ANY (patterns)`` (``ILIKE`` when ``lower``).  When every
    pattern is ``%literal%`` this is one prefix-factored regex over the text
    (the text is read once), otherwise an OR of LIKEs."""
    t = F.lower(text) if lower else text
    lits = [p[1:-1] for p in patterns]
    if all(p.startswith("%") and p.endswith("%") and len(p) > 2 for p in patterns) and \
            not any(("%" in x or "_" in x) for x in lits):
        return t.rlike(literal_set_pattern([x.lower() if lower else x for x in lits]))
    cond = None
    for p in patterns:
        c = t.like(p.lower() if lower else p)
        cond = c if cond is None else cond | c
    return cond
