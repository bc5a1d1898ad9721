"""The pipeline's stages against brute force on the smallest driver tables."""

import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from machlog.llm import decontaminate, quality
from machlog.llm.common import cut
from machlog.llm.queries import quality_model

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    made = [docs]
    for name, stage in pipeline.STAGES:
        made.append(cut(stage(spark, made[-1], DIR), f"test-{name}"))
    return made


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    assert len(stages) == 6 and all(df.columns == stages[0].columns for df in stages[1:5])


def test_stages_send_texts_in_small_batches(spark, stages):
    pipeline = pytest.importorskip("corpus_pipeline")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    wide = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    try:
        for _, stage in pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, stages[0].limit(20), DIR)
            assert wide.mapInArrow(sizes, "size bigint").agg({"size": "max"}).first()[0] < 6_000_000
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_each_stage_against_brute_force(spark, stages):
    raw, good, unique, distinct, clean = map(texts, stages[:5])
    model = quality_model(spark, stages[0].select("doc_id", "text"), DIR)
    accepted = {i for i, t in raw.items() if model.score(quality.np.array([quality.features(t)]), 0.3)[0] >= 0.3}
    assert set(good) == accepted and all(good[i] == raw[i] for i in good)

    first = {}
    for i in sorted(good):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", good[i]), i)
    assert set(unique) == set(first.values())

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in unique.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert set(distinct) == {find(i) for i in sets}

    items = [decontaminate.words(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    wanted = {w for item in items for w in decontaminate.windows(item)}
    sizes = {len(w) for w in wanted}
    for i, t in distinct.items():
        w = decontaminate.words(t)
        hit = {p for n in sizes for s in range(len(w) - n + 1) if tuple(w[s:s + n]) in wanted for p in range(s, s + n)}
        assert (i in clean) == (not hit or 20 * len(hit) < len(w))

    final = {r["doc_id"]: r for r in stages[5].collect()}
    assert set(final) == set(clean)
    assert all(final[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items())
    assert all(hashlib.sha256(final[i]["ids"]).hexdigest() == final[i]["ids_sha256"] for i in clean)


def test_stages_keep_foreign_columns_and_take_odd_rows(spark):
    """Columns called like a helper's output stay what they are; nulls, empty texts, repeated rows and text ids run through."""
    pipeline = pytest.importorskip("corpus_pipeline")
    raw = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    extra = {"score": "mine", "predicted": "mine", "n_words": "mine", "row": "mine", "sha": "mine", "kept": "mine", "spans": "mine", "items": "mine"}
    odd = spark.createDataFrame([(100_001, None), (100_002, ""), (100_003, "short"), (100_003, "short"), (None, "no id")], "doc_id bigint, text string")
    docs = raw.unionByName(odd, allowMissingColumns=True).withColumns({c: F.lit(v) for c, v in extra.items()}).withColumn("ids", F.col("doc_id"))
    for name, stage in pipeline.STAGES[:4]:
        out = cut(stage(spark, docs, DIR), f"odd-{name}")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert all(r[c] == v for r in rows for c, v in extra.items()) and all(r["ids"] == r["doc_id"] for r in rows), name
    assert pipeline.STAGES[4][1](spark, docs, DIR).count() == docs.count()
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert pipeline.one_of_equal(spark, named, DIR).count() == pipeline.one_of_equal(spark, docs, DIR).count()
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0, name
