"""The prefix-factored literal-set regex matches exactly when one of the
words occurs (Python's re and Spark's Java regex agree on this subset)."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from machlog import config as C
from machlog.functions.classify import like_any, literal_set_pattern

ALPHABET = "ab-c.0(1"
words = st.lists(st.text(alphabet=ALPHABET, min_size=1, max_size=5), min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(words, st.text(alphabet=ALPHABET, max_size=30))
def test_literal_set_pattern_is_any_substring(ws, text):
    assert bool(re.search(literal_set_pattern(ws), text)) == any(w in text for w in ws)


def test_spark_agrees_on_fixed_lists(spark):
    texts = ["[[\"PLC00010\",\"Door\",3,3,1]]", "x130-019cy", "PLC0005", "2a8-0003", "plc00052",
             None, "", "ERROR here", "fAuLt", "BROCA rota", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    noise = [r[0] for r in df.select(F.col("v").rlike(literal_set_pattern(C.NOISE_CODES))).collect()]
    assert noise == [None if t is None else any(c in t for c in C.NOISE_CODES) for t in texts]
    kw = [r[0] for r in df.select(like_any(F.col("v"), [f"%{k}%" for k in C.B1_KEYWORDS], lower=True)).collect()]
    assert kw == [None if t is None else any(k.lower() in t.lower() for k in C.B1_KEYWORDS) for t in texts]
    # patterns with inner wildcards fall back to LIKE
    fb = [r[0] for r in df.select(like_any(F.col("v"), ["%E_ROR%", "nothing"])).collect()]
    assert fb == [None if t is None else (bool(re.search("E.ROR", t)) or t == "nothing") for t in texts]


def test_every_branch_of_severities_and_classes(spark):
    """Each keyword alone, and texts without any, against the lists read in order."""
    import re

    from pyspark.sql import functions as F

    from machlog import config as C
    from machlog.functions import classify as CL

    words = [*C.B14_CRITICAL, *C.B14_WARNING, *C.B15_CRITICAL, *C.B15_WARNING]
    texts = [f"{w.lower()} x" for w in words] + ["nothing to see", None, "spindle load", "HUSILLO bloqueado", "ZONA 3 ocupada", "TRANSPORTADOR parado",
                                                 "Door and axis", "overheat", "voltage", "encoder"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    code = F.lit("C-1")
    got = df.select("i", CL.severity(code, F.col("t")).alias("b14"), CL.simple_severity(code, F.col("t")).alias("b15"),
                    CL.classify(F.col("t"), C.B22_CLASSES).alias("b22"), CL.classify(F.col("t"), C.B23_CLASSES).alias("b23")).collect()

    def level(t, critical, warning, top):
        text = "C-1" + (f" {t}" if t is not None else "")
        return top if any(w in text.upper() for w in critical) else "WARNING" if any(w in text.upper() for w in warning) else "INFO"

    def of(t, classes):
        return next((label for p, label in classes if t is not None and re.search(p, t, re.I)), "OTHER")

    for r in got:
        t = texts[r["i"]]
        assert r["b14"] == level(t, C.B14_CRITICAL, C.B14_WARNING, "CRITIQUE") and r["b15"] == level(t, C.B15_CRITICAL, C.B15_WARNING, "CRITICAL"), t
        assert r["b22"] == of(t, C.B22_CLASSES) and r["b23"] == of(t, C.B23_CLASSES), t
    assert {r["b14"] for r in got} == {"CRITIQUE", "WARNING", "INFO"} and {r["b15"] for r in got} == {"CRITICAL", "WARNING", "INFO"}
    assert {label for _, label in C.B22_CLASSES} <= {r["b22"] for r in got}
    assert {label for _, label in C.B23_CLASSES} <= {r["b23"] for r in got}
