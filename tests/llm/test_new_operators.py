"""Filter audit, token alignment and suffix dedup: brute force, round trips, odd input."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from machlog.llm import filter_audit, suffix_dedup, token_align
from machlog.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, source string, row string, n int, good int, mask int"
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "word " * 30_000), (6, "é" * 5000),
       (7, "日本 語"), (8, "Ab#"), (9, "▁x"), (10, "a  b\n c "), (11, "<0x41> <s> <|endoftext|>")]


def documents(spark, texts, sources=("s", None, "")):
    """Rows with extra columns whose names clash with helpers."""
    return spark.createDataFrame([(i, t, sources[k % len(sources)], f"r{i}", k, 7, 9) for k, (i, t) in enumerate(texts)], SCHEMA)


# --- 11 ------------------------------------------------------------------------

@pytest.mark.parametrize("k", [2, 3, 5])
def test_least_squares_gives_shapley_values(k):
    draw = random.Random(k)
    value = [0] + [draw.randint(0, 99) for _ in range((1 << k) - 1)]
    weights = filter_audit.shapley_weights(k)
    for f in range(k):
        want = 0
        for order in permutations(range(k)):
            before = sum(1 << g for g in order[:order.index(f)])
            want += value[before | 1 << f] - value[before]
        assert sum(w * v for w, v in zip(weights[f], value)) == want


def test_solve_is_exact():
    matrix = [[Fraction(0), Fraction(2)], [Fraction(3), Fraction(1)]]
    assert filter_audit.solve(matrix, [[Fraction(1)], [Fraction(2)]]) == [[Fraction(1, 2)], [Fraction(1, 2)]]


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = t.encode().split()
        fails = "".join(letter for letter, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            any(c in "#$%&*|" for c in t), t in first and (i is None or i > first[t]))) if bad)
        docs.append((s or "", fails, *labels.get(i, (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == part]
        times = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                times[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in d[1] for d in here) - len(gone), sum(d[1] == f for d in here),
                                          sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(times[order[step - 1]])
    return out


def test_audit_against_brute_force(spark):
    draw = random.Random(5)
    texts = [t for _, t in ODD] + [" ".join(draw.choice(["a", "B", "c", "d#", "é"]) for _ in range(draw.choice([3, 150, 210]))) for _ in range(30)]
    texts += [" ".join(f"w{i}" for i in range(250))] * 5 + ["x " * 250] * 3
    rows = [(i if i % 11 else i % 3, t) for i, t in enumerate(texts)] + [(None, "a b"), (None, "only here"), (None, "only here")]
    docs = documents(spark, rows)
    sources = [r["source"] for r in docs.collect()]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 1, 1), (20, None, None), (None, 1, 1), (40, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(filter_audit.tabulate(docs, labels), "ABCDE")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got.collect()}
    want = brute_audit([(i, t, s) for (i, t), s in zip(rows, sources)], {1: (1, 1), 5: (1, 1), 40: (0, 1)})
    assert len(got) == 2 * 600 and got == want


def test_audit_of_an_empty_table_and_of_clean_parts(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    empty = filter_audit.audit(filter_audit.tabulate(documents(spark, ODD).limit(0), labels), "ABCDE")
    assert empty.count() == 0
    clean = documents(spark, [(1, " ".join(f"w{i}" for i in range(300)))])
    rows = filter_audit.audit(filter_audit.tabulate(clean, labels), "ABCDE").collect()
    assert len(rows) == 600 and all((r["kept"], r["removed"], r["shapley"]) == (1, 0, 0) for r in rows)
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame([], "part string, mask int, n bigint, good bigint, toxic bigint"), "AA")


# --- 12 ------------------------------------------------------------------------

rising = st.lists(st.integers(1, 4), min_size=1, max_size=80).map(lambda x: np.cumsum(x).tolist())


@settings(max_examples=300, deadline=None)
@given(rising, rising, st.integers(1, 9))
def test_diagonal_skipping_finds_all_common_ends(a, b, tail):
    top = max(a[-1], b[-1]) + tail
    a, b = [*a, top], [*b, top]
    inner_a, inner_b = token_align.align(a, b)
    common = set(a) & set(b)
    assert [x for k, x in enumerate(a) if k not in set(inner_a)] == sorted(common)
    assert [x for k, x in enumerate(b) if k not in set(inner_b)] == sorted(common)


PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_ids_equal_the_named_library():
    made = Tokenizer.from_file(PATHS[0])
    made.encode_special_tokens = True
    texts = [t for _, t in ODD if t] + [f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}." for c in range(0, 0x30000, 37) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in made.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    ours = token_align.byte_level(PATHS[0])
    assert ours.encode(texts) == want
    assert all(b"".join(ours.tokens[i] for i in ids) == b" " + t.encode() for ids, t in zip(want, texts))


def brute_alignment(texts):
    import sentencepiece
    made = Tokenizer.from_file(PATHS[0])
    made.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    bytes_a, bytes_b = token_align.byte_level_tokens(PATHS[0]), token_align.piece_tokens([model.id_to_piece(i) for i in range(32_000)])
    docs, counts = [], Counter()
    for t in texts:
        a = made.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        if not t or any(b"".join(of[i] for i in ids) != b" " + t.encode() for ids, of in ((a, bytes_a), (b, bytes_b))):
            docs.append(None)
            continue
        ends = [np.cumsum([len(of[i]) for i in ids]).tolist() for ids, of in ((a, bytes_a), (b, bytes_b))]
        links = [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in sorted(set(ends[0]) & set(ends[1]))]
        counts.update(links)
        groups, low = [], 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for i, x in zip(ids, of) if low < x <= e) for ids, of in zip((a, b), ends)))
            low = e
        docs.append((len(a), len(b), links, ";".join(groups)))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((d[0], d[1], len(d[2]), len(d[2]), sum(counts[x] == most[x[1]] for x in d[2]), sum(counts[x] for x in d[2]), d[3]))
    return out


def test_alignment_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 5000)
    draw = random.Random(4)
    rows = [(i, t[:4000] if t else t) for i, t in ODD]
    rows += [(100 + k, " ".join("".join(draw.choice("aeinrst éß漢#1") for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(1, 60)))) for k in range(60)]
    docs = documents(spark, rows).withColumn("groups", F.lit("mine"))
    got = token_align.align_documents(docs, *PATHS)
    assert got.columns == ["doc_id", "source", "row", "n", "good", "mask", *token_align.COUNTS, "groups"]
    got = {r["n"]: tuple(r[c] for c in [*token_align.COUNTS, "groups"]) for r in got.collect()}
    assert [got[k] for k in range(len(rows))] == brute_alignment([t for _, t in rows])
    assert {t for (_, t), k in zip(rows, range(len(rows))) if t and got[k][0] == 0} == {"▁x"}
    hashed = token_align.align_documents(docs, *PATHS, keep_groups=False)
    assert all(r["groups"] == (hashlib.sha256(got[r["n"]][-1].encode()).hexdigest() if got[r["n"]][0] else "") for r in hashed.collect())


def test_alignment_of_an_empty_table(spark):
    got = token_align.align_documents(documents(spark, ODD).limit(0), *PATHS)
    assert got.count() == 0 and "groups" in got.columns


# --- 13 ------------------------------------------------------------------------

def brute_repeats(texts, length):
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats_corpus(seed):
    draw = random.Random(seed)
    some = lambda n: "".join(draw.choice("abé ") for _ in range(n))
    base = [some(draw.randint(0, 300)) for _ in range(40)]
    base += [base[3], base[3], "a" * 300, "ab" * 200, "a" * 39 + "b" + "a" * 50, "x", "", "日本語" * 40]
    for _ in range(60):
        x, y = draw.choice(base), draw.choice(base)
        i, j = draw.randrange(len(x) + 1), draw.randrange(len(y) + 1)
        base.append(x[i:i + draw.randint(0, 200)] + some(draw.randint(0, 30)) + y[j:j + draw.randint(0, 120)])
    common = some(37)  # a passage just too short, in many surroundings
    return base + [some(30) + common + some(30) for _ in range(30)]


COLS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("seed, bucket, stretch", [(1, 4000, 1 << 18), (2, 2, 1 << 18), (3, 4000, 64)])
def test_repeats_against_brute_force(spark, monkeypatch, seed, bucket, stretch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_RUNS", bucket)
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 2000)
    texts = repeats_corpus(seed)
    docs = documents(spark, list(enumerate(texts))).withColumn("spans", F.lit("mine"))
    got = suffix_dedup.drop_repeats(docs, length=40)
    assert got.columns == ["doc_id", "source", "row", "n", "good", "mask", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
    rows = {r["doc_id"]: r for r in got.collect()}
    want = brute_repeats([t.encode() for t in texts], 40)
    assert sum(w[1] for w in want) > 0 and [tuple(rows[i][c] for c in COLS) for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        kept, at = b"", 0
        for s in rows[i]["spans"]:
            kept, at = kept + t.encode()[at:s["begin"]], s["stop"]
        assert hashlib.sha256(kept + t.encode()[at:]).hexdigest() == rows[i]["kept_sha256"]


def test_repeats_in_odd_rows(spark):
    rows = ODD + [(12, "q" * 400), (13, "long and single " + "".join(map(str, range(2000))))]
    got = {r["n"]: tuple(r[c] for c in COLS) for r in suffix_dedup.drop_repeats(documents(spark, rows)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0] == got[1] == (0, 0, 0, empty)
    assert got[7] == (150_000, 150_000, 1, empty) and got[8] == (10_000, 10_000, 1, empty)  # periodic
    assert got[len(ODD)][1] == 0 and got[len(ODD) + 1][1] == 0
    assert suffix_dedup.drop_repeats(documents(spark, ODD).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.drop_repeats(documents(spark, ODD), length=8)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=24, max_size=60).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=12))
def test_multikey_sort_sorts_and_marks_twins(bodies):
    length = 24
    data = np.frombuffer(b"".join(bodies), np.uint8)
    starts = np.cumsum([0, *map(len, bodies[:-1])])
    suffixes = np.concatenate([s + np.arange(len(b) - length + 1) for s, b in zip(starts, bodies)])
    groups = suffixes % 2
    order, twin = suffix_dedup.multikey_sort(suffix_dedup.tokens_of(data), suffixes, groups, length)
    seen = [(groups[i], data[suffixes[i]:suffixes[i] + length].tobytes()) for i in order]
    assert seen == sorted(seen)
    times = Counter(seen)
    assert [times[x] > 1 for x in seen] == twin.tolist()


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(3)
    shared = draw.integers(97, 101, 900, np.uint8)
    data = np.concatenate([draw.integers(97, 101, 333, np.uint8), shared, draw.integers(97, 101, 210, np.uint8), shared])
    begin, windows, anchor, _ = suffix_dedup.runs_of(data, np.array([1233, len(data)]), 400)
    place = {int(w): int(a) for b, n, a in zip(begin, windows, anchor) for w in range(b, b + n)}
    assert set(place) == {*range(1233 - 399), *range(1233, len(data) - 399)}
    assert all(place[333 + i] - 333 == place[1443 + i] - 1443 for i in range(501))


def test_registered_queries_of_the_new_operators(spark):
    """Whole smallest tables against brute force (the audit's query has SQL)."""
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in QUERIES["op13_suffix_dedup"](spark, sf).collect()}
    assert [got[i] for i, _ in rows] == brute_repeats([(t or "").encode() for _, t in rows], 400)
    columns = [*token_align.COUNTS, "groups_sha256"]
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in QUERIES["op12_token_alignment"](spark, sf).collect()}
    want = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "") for w in brute_alignment([t or "" for _, t in rows])]
    assert [got[i] for i, _ in rows] == want
    assert math.isclose(sum(w[1] for w in want), sum(got[i][1] for i, _ in rows))
