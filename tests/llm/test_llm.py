"""Small tests of the training-data operators: brute force, round trips, odd input."""

import base64
import gc
import hashlib
import math
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from machlog.llm import (byte_bpe, components, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, lattice_lm,
                         line_dedup, quality, url_filter)

SCHEMA = "doc_id bigint, text string, lang string, row string, n int"


def documents(spark, texts, langs=None):
    """Rows with clashing extra columns."""
    rows = [(i, t, (langs or {}).get(i), f"r{i}", i) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "word " * 30_000), (6, "é" * 5000), (7, "日本 語")]


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# --- 1 ---------------------------------------------------------------------

def labelled(n=200):
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    prose = lambda: " ".join(draw.choice(vocabulary) for _ in range(80)) + "."
    texts, marks = [], []
    for i in range(n):
        good = i % 3 != 0
        texts.append((i, prose() if good else " ".join(w.upper() + "!!" for w in prose().split())))
        marks.append((i, int(good)))
    return texts, marks


def test_quality_threshold_by_counting_rounds(spark, monkeypatch):
    """The exact ranks, however few strengths the driver takes at once."""
    draw = random.Random(8)
    rows = [(int(draw.random() < 0.6), draw.choice([1.5, draw.gauss(0, 1), draw.gauss(0, 1) ** 9])) for _ in range(3000)]
    strengths = spark.createDataFrame(rows, "y int, strength double")
    ordered, bad = sorted(s for _, s in rows), sum(y == 0 for y, _ in rows)
    want = (ordered[bad - 1] + ordered[bad]) / 2
    for near in (5000, 20):
        monkeypatch.setattr(quality, "NEAR", near)
        assert quality._threshold(strengths) == want
    one_kind = spark.createDataFrame([(1, 0.5), (1, 0.25)], "y int, strength double")
    assert quality._threshold(one_kind) == 0.25


def test_quality_separates_and_takes_odd_rows(spark):
    texts, marks = labelled()
    docs = documents(spark, texts + [(i, t) for i, t in ODD if i is None])
    labels = spark.createDataFrame(marks + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.learn(docs, labels, lambda i: i % 5 != 0, sample=100)
    got = dict(rows_of(quality.score(docs, model), "doc_id", "predicted"))
    assert all(got[i] == y for i, y in marks)
    odd = quality.score(documents(spark, ODD), model)
    assert odd.columns == ["doc_id", "text", "lang", "row", "n", "score", "predicted"]
    scores = dict(rows_of(odd.filter("doc_id < 3"), "doc_id", "score"))
    assert len(set(scores.values())) == 1 and all(0 <= s <= 1 for s in scores.values())
    assert odd.count() == len(ODD)


def test_quality_threshold_covers_all_labels(spark):
    texts, marks = labelled()
    draw = random.Random(4)
    marks = [(i, y if draw.random() < 0.8 else 1 - y) for i, y in marks]
    learnable = lambda i: i % 5 != 0
    model = quality.learn(documents(spark, texts), spark.createDataFrame(marks, "doc_id bigint, quality int"), learnable, sample=40)
    of = dict(texts)
    known = [(model.strength(np.array([quality.features(of[i])]))[0], y) for i, y in marks if learnable(i)]
    bad, strengths = sum(y == 0 for _, y in known), sorted(s for s, _ in known)
    assert abs(model.cut - (strengths[bad - 1] + strengths[bad]) / 2) < 1e-9


def test_quality_without_labels(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.learn(docs, none, lambda i: F.lit(True))
    assert len({s for (s,) in rows_of(quality.score(docs, model), "score")}) == 1
    assert quality.score(docs.limit(0), model).count() == 0


# --- 2 ---------------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/x", "allow"), ("b.example.org", "/", "block"),
         ("com", "", "block")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_against_brute_force(spark):
    draw = random.Random(5)
    urls = [None, "", "no scheme", "http://", "x://ORG/", "http://org", "http://a..org/es/", "http://b.example.org/es/x", "http://com?x", "http://telecom/a"]
    for _ in range(150):
        host = ".".join(draw.choice(["a", "b", "Example", "example", "org", "com", "net"]) for _ in range(draw.randint(1, 5)))
        urls.append(f"https://{host}{draw.choice(['', '/', '/es/', '/es/x/y', '/en/1?q', '#f'])}")
    urls += urls[:20]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = url_filter.judge_urls(pages, url_filter.rules_table(spark, RULES))
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: judge(u) for i, u in enumerate(urls)}
    assert got.count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_table(spark, RULES)).count() == 0


# --- 3 ---------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    tiktoken = pytest.importorskip("tiktoken")
    data = open(RANKS, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.coder(data, public_tokenizers.PATTERN), theirs


def test_bpe_equals_the_library(coders):
    ours, theirs = coders
    draw = random.Random(1)
    parts = ["a", "b", " ", " ", "\n", "\t", "'s", "é", "1", "!", "\xa0", "\x1c", "the", "日", "zq"]
    texts = ["", " ", "  ", "x" * 1000, "ab" * 3000, "B" * 64, "B" * 65, " " * 200 + "x", "<|endoftext|>", "🙂🙂 🙂"]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    codes = ours.encode(texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in codes] == [theirs.encode_ordinary(t) for t in texts]
    assert [ours.decode(c).decode() for c in codes] == texts


def test_bpe_known_words_cost_no_call_each(coders):
    ours, _ = coders
    text = " ".join(f"word{i % 50}," for i in range(5000))
    first = ours.encode([text])
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        again = ours.encode([text])
    finally:
        sys.setprofile(None)
    assert again == first and calls["c_call"] < 500


def test_bpe_workers_hold_no_cache_after_their_task(spark):
    docs = documents(spark, [(i, f"aqz{i} zq{i}x bq{i}") for i in range(400)])
    assert byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).agg({"n_tokens": "sum"}).first()[0] > 0

    def held(batches):
        for batch in batches:
            coders = [x for x in gc.get_objects() if type(x).__name__ == "BytePairCoder"]
            yield pa.RecordBatch.from_arrays([pa.array([len(coders)]), pa.array([sum(len(c.matches) + len(c.chunks) for c in coders)])], ["n", "kept"])

    seen = docs.select("doc_id").mapInArrow(held, "n bigint, kept bigint").collect()
    assert sum(r["n"] for r in seen) > 0 and sum(r["kept"] for r in seen) == 0


def test_bpe_rows_and_round_trip(spark):
    docs = documents(spark, ODD)
    made = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(made, RANKS, public_tokenizers.PATTERN)
    assert Counter(rows_of(back, "doc_id", "text")) == Counter((i, t or "") for i, t in ODD)
    empty = hashlib.sha256(b"").hexdigest()
    assert {r for r in rows_of(made.filter("doc_id < 2"), "n_tokens", "ids_sha256", "decoded_sha256")} == {(0, empty, empty)}
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# --- 4 ---------------------------------------------------------------------

def brute_hits(doc, items):
    covered, names = set(), set()
    for name, text in items:
        for w in decontaminate.windows(decontaminate.words(text)):
            for a in range(len(doc) - len(w) + 1):
                if tuple(doc[a:a + len(w)]) == w:
                    covered.update(range(a, a + len(w)))
                    names.add(name)
    return covered, names


def test_suffix_array_is_sorted():
    draw = random.Random(2)
    for _ in range(150):
        ids = np.array([draw.randint(0, draw.choice([1, 3, 9])) for _ in range(draw.randint(0, 40))], np.int64)
        assert decontaminate.suffix_array(ids).tolist() == sorted(range(len(ids)), key=lambda i: ids[i:].tolist())


def test_index_finds_what_brute_force_finds(monkeypatch):
    monkeypatch.setattr(decontaminate, "WINDOW", 3)
    draw = random.Random(4)
    for _ in range(120):
        docs = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 30))] for _ in range(draw.randint(1, 6))]
        items = [(str(i), " ".join(draw.choice("abcd") for _ in range(draw.randint(0, 6)))) for i in range(5)]
        spans, names = decontaminate.Phrases(items).hits(docs)
        for doc, s, n in zip(docs, spans, names):
            assert (set(x for a, b in s for x in range(a, b)), n) == brute_hits(doc, items)


@pytest.mark.parametrize("limit", [4_000_000, 100])
def test_decontamination_rows(spark, monkeypatch, limit):
    """Also in several passes over the benchmark."""
    monkeypatch.setattr(decontaminate, "PASS_BYTES", limit)
    draw = random.Random(6)
    phrase = [" ".join(draw.choice("abcdefghijklm") for _ in range(20)) for _ in range(3)]
    items = [(10, phrase[0]), (9, phrase[1]), (9, phrase[1]), (None, phrase[2]), (3, "Solo"), (4, ""), (5, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = ODD + [(20, f"x {phrase[0].upper()} y"), (21, f"{phrase[1]}|{phrase[0]}"), (22, phrase[2]), (23, "solo " * 3 + "x " * 70), (24, "so lo")]
    got = decontaminate.find(documents(spark, texts), bench)
    assert got.count() == len(texts) and "text" in got.columns
    by_id = {r["doc_id"]: r for r in got.filter("doc_id >= 20").collect()}
    for i, t in texts:
        if i is not None and i >= 20:
            doc = decontaminate.words(t)
            covered, names = brute_hits(doc, [(None if n is None else str(n), x) for n, x in items if x])
            r = by_id[i]
            assert {x for s in r["spans"] for x in range(s["first"], s["last"])} == covered and r["n_hit"] == len(covered)
            assert r["items"] == sorted(n for n in names if n is not None)
            assert r["contaminated"] == (bool(covered) and 20 * len(covered) >= len(doc))
    assert not any(r["contaminated"] for r in got.filter("doc_id < 8").collect())
    none = decontaminate.find(documents(spark, texts), bench.limit(0))
    assert {r["n_hit"] for r in none.collect()} == {0}


# --- 5 ---------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    draw = random.Random(7)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ein", "und", "ge"]}
    texts = [(i, " ".join("".join(draw.choice(parts["xx" if i % 2 else "yy"]) for _ in range(3)) for _ in range(30))) for i in range(120)]
    langs = {i: "xx" if i % 2 else "yy" for i, _ in texts if i % 10}
    docs = documents(spark, texts, langs)
    model = language_id.learn(docs, lambda i: i % 4 != 2)
    assert sorted(model) == ["xx", "yy"]
    got = dict(rows_of(language_id.predict(docs, model), "doc_id", "lang_pred"))
    assert all(got[i] == ("xx" if i % 2 else "yy") for i, _ in texts)
    odd = language_id.predict(documents(spark, [*ODD, (30, "123 !?")]), model)
    assert {r for r in rows_of(odd.filter("doc_id < 3 or doc_id = 30"), "lang_pred", "score")} == {("und", 0.0)}
    assert odd.count() == len(ODD) + 1 and all(0 <= s <= 1 for (s,) in rows_of(odd, "score"))
    assert {p for (p,) in rows_of(language_id.predict(docs, {}), "lang_pred")} == {"und"}


# --- 6 ---------------------------------------------------------------------

def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.Pieces.zipf([lattice_lm.START, "a", "b", "ab", "ba", "▁a", "▁ab", *(f"<0x{b:02X}>" for b in range(256)), lattice_lm.END])

    def brute(s):
        if not s:
            return 1.0
        whole = sum(math.exp(pieces.log_p[s[:n]]) * brute(s[n:]) for n in range(1, len(s) + 1) if s[:n] in pieces.plain)
        if s[0] not in pieces.plain:
            whole += math.exp(sum(pieces.log_p[f"<0x{b:02X}>"] for b in s[0].encode())) * brute(s[1:])
        return whole

    words = ["a", "ab", "aba", "abab", "baab", "aé", "</s>", "a" * 60]
    for w, p in zip(words, pieces.many(words)):
        if len(w) < 10:
            assert math.isclose(math.exp(p), brute("▁" + w), rel_tol=1e-9)
        assert math.isclose(p, pieces.word(w), rel_tol=1e-12)
    one, other = {}, {}
    pieces.many(words, [3] * len(words), one)
    for w in words:
        pieces.expected(w, 3, other)
    assert one == other


def test_lm_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "BLOCK_BYTES", 300)
    texts = [*ODD[:7], (10, "A b c"), (11, "b\x0bb d twice Twice"), (12, "new words"), (13, "a b é")]
    docs = documents(spark, texts)
    pieces = lattice_lm.Pieces.of_model(public_tokenizers.path("piece_bpe_32k.model"))
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2
    got = lattice_lm.score(docs, pieces, learn)
    counts, total = Counter(), 0
    for i, t in texts:
        if (i or 0) % 7 != 2:
            counts.update([*lattice_lm.words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    model = pieces
    for _ in range(lattice_lm.ROUNDS):
        expected = {lattice_lm.END: lattice_lm.MILLION}
        for w in counts:
            if w is not None:
                model.expected(w.decode(), 1, expected)
        model = model.trained(expected)
    seen = [c for w, c in counts.items() if w is not None]
    once, twice = seen.count(1), seen.count(2)
    assert once and twice
    held = once / (once + 2 * twice)

    def probability(w):
        spelt = math.exp(model.log_p[lattice_lm.END] if w is None else model.word(w.decode()))
        return max(counts[w] - held, 0) / total + held * kinds / total * spelt

    assert got.count() == len(texts)
    want = Counter()
    for i, t in texts:
        tokens = [*lattice_lm.words(t), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        score = sum(math.log10(probability(w)) for w in tokens)
        want[(i, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6), round(score, 6))] += 1
    have = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got.collect())
    assert have == want
    untrained = lattice_lm.score(docs, pieces, F.lit(False))
    assert {r["train_tokens"] for r in untrained.collect()} == {0} and {r["n_known"] for r in untrained.collect()} == {0}
    assert lattice_lm.score(docs.limit(0), pieces, learn).count() == 0


def test_lm_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    pieces = lattice_lm.Pieces.of_model(public_tokenizers.path("piece_bpe_32k.model"))
    rate = F.sum("score") / F.sum("n_tokens")

    def held_out(learn):
        return lattice_lm.score(docs, pieces, learn).filter("doc_id % 7 = 2").agg(rate).first()[0]

    assert held_out(F.col("doc_id") % 7 != 2) > held_out(F.lit(False)) + 2


# --- 7 ---------------------------------------------------------------------

def test_fuse_filter_has_no_false_negatives():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 60_000):
        keys = draw.integers(0, 2**63, n).astype(np.uint64)
        made = exact_dedup.FuseFilter.from_bytes(exact_dedup.FuseFilter.build(keys).to_bytes())
        assert made.contains(keys).all()
        others = draw.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert made.contains(others).mean() < 0.02


@pytest.mark.parametrize("share", [0, 5, 11])
def test_exact_dedup_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 3)
    texts = [*ODD, (8, "a  b"), (9, "\na"), (10, "same"), (11, "same"), (None, "same"), (12, "a\tb")]
    snapshot, incoming = documents(spark, texts[:share]), documents(spark, texts[share:])
    got = exact_dedup.dedup(incoming, snapshot)
    import re
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append(i)
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((i, keep[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in texts)
    assert Counter(rows_of(got, "id", "keep_id", "group_size", "sha")) == want
    kept = rows_of(got.filter("kept"), "id", "sha")
    assert len(kept) == len(groups) == len(set(kept))
    rest = exact_dedup.keep_first(documents(spark, texts))
    assert Counter(norm(t) for (t,) in rows_of(rest, "text")) == Counter(groups.keys()) and rest.columns == documents(spark, []).columns


def test_exact_dedup_goes_through_filter_and_byte_check(spark, monkeypatch):
    """A filter that rejects everything, and a byte check that refuses, leave batch and snapshot apart."""
    snapshot, incoming = documents(spark, [(1, "same"), (2, "x")]), documents(spark, [(3, "same"), (4, "same"), (5, "y")])
    whole = Counter([(1, 1, 3, True), (3, 1, 3, False), (4, 1, 3, False), (2, 2, 1, True), (5, 5, 1, True)])
    apart = Counter([(1, 1, 1, True), (3, 3, 2, True), (4, 3, 2, False), (2, 2, 1, True), (5, 5, 1, True)])
    seen = lambda: Counter(rows_of(exact_dedup.dedup(incoming, snapshot), "id", "keep_id", "group_size", "kept"))
    assert seen() == whole
    real = exact_dedup.screen
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "screen", lambda *a: real(*a).withColumn("maybe", F.lit(False)))
        assert seen() == apart
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "_equal_texts", lambda pairs, *a: pairs.select("sha", F.col("old_sha").alias("joined_sha")).limit(0))
        assert seen() == apart


def test_exact_dedup_with_text_ids(spark):
    rows = [(f"id-{i:03d}", t) for i, t in enumerate(["a", "b", "a", None, "", "b  c", "b c"] * 4)] + [(None, "a"), (None, "new")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    kept = {r["text"]: r["doc_id"] for r in exact_dedup.keep_first(docs).collect()}
    assert {(t or ""): i for t, i in kept.items()} == {"a": "id-000", "b": "id-001", "": "id-003", "b  c": "id-005", "new": None}
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0


# --- 8 ---------------------------------------------------------------------

def near_copies():
    draw = random.Random(8)
    base = [f"w{draw.randint(0, 300)}" for _ in range(60)]
    texts = list(ODD)
    for i in range(40):
        copy = list(base)
        for _ in range(draw.randint(0, 2)):
            copy[draw.randrange(60)] = f"x{i}"
        texts.append((100 + i, " ".join(copy)))
    texts += [(200 + i, " ".join(base[:30] + [f"y{i}{k}" for k in range(60)])) for i in range(10)]
    texts += [(300, "one two three"), (301, "ONE two\tthree"), (302, "one two three four")]
    return texts


def brute_sets(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return sets


def brute_components(texts):
    sets = brute_sets(texts)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(texts):
        ids.setdefault(find(k), []).append(i)
    least = {r: min((i for i in g if i is not None), default=None) for r, g in ids.items()}
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(texts))


@pytest.mark.parametrize("salt", [50_000, 4])
def test_jaccard_against_brute_force(spark, monkeypatch, salt):
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", salt)
    texts = near_copies()
    got = jaccard_join.join(documents(spark, texts))
    assert Counter(rows_of(got, "doc_id", "n_shingles", "component_id")) == brute_components(texts)


def test_jaccard_bands_hold_all_linked_sizes(spark):
    """The largest set a set may link with lies in its band or the next one; a band is not everything."""
    n = spark.range(1, 300_000).select(F.col("id").alias("n"), F.expr("id * 100 div 80").alias("largest"))
    step = n.select((jaccard_join._band(F.col("largest")) - jaccard_join._band(F.col("n"))).alias("d"))
    assert {r["d"] for r in step.distinct().collect()} <= {0, 1}
    assert n.select(jaccard_join._band(F.col("n"))).distinct().count() > 40


def test_jaccard_keeps_one(spark):
    texts = [(i, t) for i, t in near_copies() if i is None or i > 4]
    docs = documents(spark, texts)
    kept = jaccard_join.keep_one(docs)
    want = {least for _, n, least in brute_components(texts) if n}
    assert {i for (i,) in rows_of(kept, "doc_id")} == want and kept.columns == docs.columns
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_jaccard_links_inside_a_group(spark, monkeypatch):
    """Few counters: the order is not rare-first, so unlike sets share a whole prefix that no other group has."""
    monkeypatch.setattr(jaccard_join, "COUNTERS", 32)
    draw, texts = random.Random(21), []
    for i in range(100):
        base = [f"v{i}x{k}" for k in range(13)]
        family = [["odd", *base[1:12], "a"], [*base[:12], "b"], [*base[:12], "c"], [*base[:6], "odd", *base[7:]]]
        draw.shuffle(family)
        texts += [(4 * i + k, " ".join(w)) for k, w in enumerate(family)]
    got = jaccard_join.join(documents(spark, texts))
    assert Counter(rows_of(got, "doc_id", "n_shingles", "component_id")) == brute_components(texts)


@pytest.mark.parametrize("salt, counters", [(50_000, 1 << 20), (4, 32)])
def test_jaccard_link_counts_against_brute_force(spark, monkeypatch, salt, counters):
    """Copies, repeated rows, sets of sizes on both sides of a bit and unlike sets of one group."""
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", salt)
    monkeypatch.setattr(jaccard_join, "COUNTERS", counters)
    long = [f"s{k}" for k in range(80)]
    texts = near_copies() + [(400 + n, " ".join(long[:n])) for n in (30, 35, 36, 40, 66, 67, 68, 69, 80)]
    texts += [(400 + 66, " ".join(long[:66]))] * 2
    sets = brute_sets(texts)
    want = Counter((i, len(x), sum(bool(x) and 100 * len(x & y) >= 80 * len(x | y) for b, y in enumerate(sets) if b != a))
                   for a, ((i, _), x) in enumerate(zip(texts, sets)))
    docs = documents(spark, texts)
    got = jaccard_join.link_counts(docs)
    assert Counter(rows_of(got, "doc_id", "n_shingles", "n_links")) == want
    assert jaccard_join.link_counts(docs.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(9)
    pairs = [(f"{a:03}", f"{a + 1:03}") for a in range(0, 60)] + [(f"{draw.randint(100, 160)}", f"{draw.randint(100, 160)}") for _ in range(40)]
    got = dict(rows_of(components.components(spark.createDataFrame(pairs, "a string, b string")), "node", "comp"))
    up = {}
    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {n: find(n) for p in pairs if p[0] != p[1] for n in p}


# --- 9 ---------------------------------------------------------------------

def test_html_main_text():
    body = "<p>One, two, three and a long enough sentence.</p>"
    page = (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><p>menu, a, b</p></nav><div class='ad-box ads'>buy, buy</div>"
            f"<article><h1>Head &amp; line</h1>{body}<p><b>broken<br>line <p>next&nbsp; &lt;x&gt;<script>var t='</p>';</script></p>"
            f"<ul><li>item</ul><div id=comments><p>nice, nice, very nice indeed, so nice</p></div></article>"
            f"<aside>side</aside><form>f</form><footer>&copy; foot, foot, foot")
    assert html_extract.extract_text(page) == (
        "Head & line\nOne, two, three and a long enough sentence.\nbroken line\nnext <x>\nitem")


def test_html_scores_containers_without_semantics():
    text = "This is a sentence, with commas, and it goes on for a while so that it counts."
    links = "".join(f'<a href="/{i}">link, number {i}, here</a> ' for i in range(30))
    page = f"<body><div><div>{links}</div></div><div class=x><p>{text}</p><p>{text}</p></div><p>A closing remark.</p></body>"
    assert html_extract.extract_text(page) == f"{text}\n{text}\nA closing remark."


def test_html_marked_words_take_no_content():
    text = "This is a sentence, with commas, and it goes on for a while so that it counts."
    box = "<div class='sidebar'><p>Box, one, two.</p></div><p>Next line.</p>"
    for wrapper in ("content has-sidebar", "layout no-comments", "page with-sidebar"):
        assert html_extract.extract_text(f'<div class="{wrapper}"><article><p>{text}</p>{box}</article></div>') == f"{text}\nNext line."
    plain = f'<body><div class="layout no-comments"><p>{text}</p><p>{text}</p>{box}</div></body>'
    assert html_extract.extract_text(plain) == f"{text}\n{text}\nNext line."
    parts = "".join(f'<section id="{s}"><h2 id="{s}">{t}</h2><p>{text}</p></section>' for s, t in (
        ("related-work", "Related work"), ("search-algorithms", "Search algorithms"), ("social-history", "Social history")))
    page = f'<article>{parts}<div id="comments"><h2>Comments</h2><p>{text}</p></div></article>'
    assert html_extract.extract_text(page) == f"Related work\n{text}\nSearch algorithms\n{text}\nSocial history\n{text}"


PROSE = "A sentence of the article, with commas, that is long enough to count as a paragraph of prose. " * 2


@pytest.mark.parametrize("name", [
    "article-comments", "comment-body", "comments-body", "post-comments", "main-menu", "page-sidebar", "blog-sidebar",
    "entry-share social", "text-ads", "page-footer", "cookie-text", "mainMenu", "commentList"])
def test_html_compound_names_of_boilerplate_go(name):
    article = f"<p>{PROSE}</p><p>{PROSE}</p>"
    want = "\n".join([PROSE.strip()] * 2)
    box = f'<div class="{name}"><p>Something else, by a reader, of some length. It is not the article.</p></div>'
    for page in (f"<article>{article}{box}</article>", f"<div>{article}{box}</div>", f"<main><article>{article}</article>{box}</main>"):
        assert html_extract.extract_text(page) == want, (name, page)


def test_html_comment_threads_of_any_size_go():
    thread = "".join(f"<p>Comment {i}, by somebody, which is much longer than the article itself, with commas. {PROSE}</p>" for i in range(30))
    for box in (f'<div id="comments">{thread}</div>', f'<section class="comments"><article class="comment">{thread}</article></section>'):
        assert html_extract.extract_text(f"<body><article><h1>Title</h1><p>{PROSE}</p></article>{box}</body>") == f"Title\n{PROSE.strip()}"
        assert html_extract.extract_text(f"<article><h1>Title</h1><p>{PROSE}</p>{box}</article>") == f"Title\n{PROSE.strip()}"


def test_html_hidden_is_an_attribute():
    text = PROSE.strip()
    for tag in ('<article title="the hidden coast">', '<article class="md hidden lg">', "<article data-x='a hidden b'>"):
        assert html_extract.extract_text(f"{tag}<p>{PROSE}</p></article>") == text
    for tag in ("<div hidden>", '<div class=a hidden>', '<div hidden="">', "<div id=x hidden/>"):
        assert html_extract.extract_text(f"<article><p>{PROSE}</p>{tag}<p>Not shown, at all.</p></div></article>") == text


def test_html_page_wide_forms_and_wrappers_stay():
    text = PROSE.strip()
    assert html_extract.extract_text(f'<body><form id="aspnetForm"><input name=x><div><p>{PROSE}</p><p>{PROSE}</p></div></form></body>') == f"{text}\n{text}"
    assert html_extract.extract_text(f"<article><p>{PROSE}</p><form><p>Your name, please.</p><input></form></article>") == text
    for name in ("content has-sidebar", "layout no-comments", "post comments-open category-advertising", "search-results", "entry-header-wrap"):
        assert html_extract.extract_text(f'<body><div class="{name}"><p>{PROSE}</p><p>{PROSE}</p></div></body>') == f"{text}\n{text}", name


def test_html_keeps_all_articles():
    text = PROSE.strip()
    one = lambda t: f"<div><article><h2>{t}</h2><p>{PROSE}</p></article></div>"
    for page in (f"<main>{one('First')}{one('Second')}</main>", f"<body>{one('First')}{one('Second')}</body>"):
        assert html_extract.extract_text(page) == f"First\n{text}\nSecond\n{text}"
    header = f'<article><div class="entry-header"><h1>Title</h1></div><p>{PROSE}</p></article>'
    assert html_extract.extract_text(header) == f"Title\n{text}"


def test_html_against_the_template_of_the_tables(spark):
    """The driver's pages: what stands in the article, block by block, cut out by another way."""
    import html as entities
    import re
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        found = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        body = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->|<aside.*?</aside>|<(nav|form|footer).*?</\1>|<div class=\"ad\">.*?</div>", "",
                      found[1] if found else "", flags=re.S)
        blocks = re.split(r"</?(?:h[1-6]|p|ul|ol|li|div|blockquote|pre|table|tr|td|th|section)\b[^>]*>", body)
        blocks = [" ".join(entities.unescape(re.sub(r"<br\s*/?>", " ", b)).split()) if "<" not in re.sub(r"<br\s*/?>", "", b) else
                  " ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
        assert html_extract.extract_text(r["html"]) == "\n".join(b for b in blocks if b), r["page_id"]


def test_html_empty_table_and_equal_scores(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id int, html string")).count() == 0
    text = PROSE.strip()
    assert html_extract.extract_text(f"<body><div><p>{PROSE}</p></div><div><p>{PROSE}</p></div></body>") == f"{text}\n{text}"


def test_html_keeps_siblings_of_the_best_container():
    text = "This is a sentence, with commas, and it goes on for a while so that it counts."
    code, links = ("code line " * 500).strip(), "<ul>" + "".join(f"<li><a href=/{i}>link, {i}</a></li>" for i in range(9)) + "</ul>"
    page = (f"<body><h1>Title</h1><div>{f'<p>{text}</p>' * 20}</div><h2>Code</h2><pre>{code}</pre><h2>See</h2>{links}"
            "<blockquote>It was said.</blockquote><h3>End</h3><div><p>Two closing sentences. So short.</p></div><h2>Links</h2>" + links + "</body>")
    assert html_extract.extract_text(page).split("\n") == [
        "Title", *[text] * 20, "Code", code, "See", "It was said.", "End", "Two closing sentences. So short."]


def test_html_odd_pages(spark):
    pages = [(None, None), (1, ""), (2, "<p>"), (3, "plain, text"), (3, "plain, text"), (4, "<div>" * 5000 + "deep, text"),
             (5, "<p>" + "long, " * 50_000), (6, "<a href=x>only links</a>"), (7, "<p a='"), (8, "</p></div>x < y & z")]
    got = html_extract.extract(spark.createDataFrame([(i, h, "old") for i, h in pages], "page_id int, html string, text string"))
    texts = dict(rows_of(got, "page_id", "text"))
    assert got.count() == len(pages) and texts[None] == texts[1] == texts[2] == texts[6] == ""
    assert texts[3] == "plain, text" and texts[4] == "deep, text" and len(texts[5]) > 250_000 and texts[8] == "x < y & z"
    assert all(len(t) == n for t, n in rows_of(got, "text", "n_chars"))


# --- 10 --------------------------------------------------------------------

def test_lines_against_brute_force(spark):
    texts = [*ODD, *((20 + i, f"Shared line\n own {i}\n\n  SHARED line\t\nshared\x0b") for i in range(4)), (50, "shared line"), (51, "\n\n"),
             (52, "Éa\néa"), (53, "éa")]
    docs = documents(spark, texts)
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(strip))
    counts = Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")})
    for threshold in (2, 4, 100):
        want = Counter()
        for i, t in texts:
            lines = (t or "").split("\n")
            stay = [x for x in lines if not key(x) or counts[key(x)] < threshold]
            want[(i, "\n".join(stay), len(lines), len(lines) - len(stay))] += 1
        got = line_dedup.drop_common_lines(docs, min_docs=threshold)
        assert Counter(rows_of(got, "doc_id", "text", "n_lines", "n_dropped")) == want
    assert line_dedup.drop_common_lines(docs.limit(0)).count() == 0
