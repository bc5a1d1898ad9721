"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A labelled good document is preferred to a labelled bad one.  With features x
and weights w the model says P(a over b) = sigmoid(w.(x_a - x_b)); w minimises
the logistic loss of those feature differences.  A document's strength is w.x,
and the accept threshold is a quantile of the strengths of all learnable labelled
documents: the share of bad labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.llm.common import FILTER_BITS, bits_of, cut, fields, hash128, quoted, whole_row

_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CAPITALS = _LETTERS[26:]
_PROSE = b".,;:'\"-()?"
_SPACE = b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_DIGITS = b"0123456789"


def features(text: str | None) -> list[float]:
    """Properties of the whole text; null as empty, whose features are all 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    size = len(data)
    solid = max(1, size - _count(data, _SPACE))
    lower = [w.lower() for w in words]
    counts: dict[bytes, int] = {}
    for w in lower:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, lower, lower[1:]))
    pairs = len(set(zip(lower, lower[1:])))
    lines = [x for x in data.split(b"\n") if x.strip()]
    odd = solid - _count(data, _LETTERS) - _count(data, _PROSE) - _count(data, _HIGH) - _count(data, _DIGITS)
    marks = sum(not w[-1:].isalpha() and w[-1] < 128 and w[-1] not in _PROSE for w in words)
    return [
        1.0,
        np.log1p(n),
        len(counts) / n,
        np.log(len(counts)) / np.log(n + 1),
        repeats / n,
        pairs / n,
        max(counts.values()) / n,
        odd / solid,
        float(np.sqrt(odd / solid)),
        marks / n,
        float(np.sqrt(marks / n)),
        _count(data, _CAPITALS) / solid,
        _count(data, _DIGITS) / solid,
        _count(data, _PROSE) / solid,
        _count(data, b".") / n,
        _count(data, b"|") / n,
        min(1.0, size / n / 40),
        len(set(lines)) / len(lines),
        min(1.0, n / len(lines) / 200),
    ]


N_FEATURES = 19


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


@dataclass
class BradleyTerry:
    """Weights over standardised features; ``cut``: strength of the accept threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self._expand((x - self.mean) / self.scale) @ self.weights

    @staticmethod
    def _expand(z: np.ndarray) -> np.ndarray:
        z = np.clip(z, -6, 6)
        return np.hstack([z, np.abs(z), np.maximum(z - 1, 0), np.maximum(-1 - z, 0)])

    def score(self, x: np.ndarray, at_cut: float) -> np.ndarray:
        """0 to 1, increasing in the strength, ``at_cut`` at the threshold."""
        logit = np.log(at_cut / (1 - at_cut))
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut + logit, -500, 500)))

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, pairs: int, seed: int = 1, l2: float = 1e-3) -> BradleyTerry:
        """``pairs`` preference pairs, drawn so that every row takes part equally often."""
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        model = cls(mean, scale, np.zeros(4 * x.shape[1]), 0.0)
        z = cls._expand((x - mean) / scale)
        better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
        if len(better) and len(worse):
            draw = np.random.default_rng(seed)
            deal = lambda rows: np.concatenate([draw.permutation(rows) for _ in range(-(-pairs // len(rows)))])[:pairs]
            d = z[deal(better)] - z[deal(worse)]
            w = model.weights
            for _ in range(25):  # Newton steps of the convex loss
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                slope = -(d * p[:, None]).mean(axis=0) + l2 * w
                curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(len(w))
                step = np.linalg.solve(curve, slope)
                w = w - step
                if np.abs(step).max() < 1e-7:
                    break
            model.weights = w
            # A quantile of the strengths: the share of bad labels, between its neighbours.
            model.cut = float(np.quantile(z @ w, len(worse) / len(good), method="midpoint"))
        return model


def learn(docs: DataFrame, labels: DataFrame, learnable: Callable[[Column], Column], doc_id: str = "doc_id",
          text: str = "text", label: str = "quality", sample: int = 12_000, pairs: int = 40_000) -> BradleyTerry:
    """Fit on at most ``sample`` labelled documents whose id is ``learnable``, those
    with the smallest hashes of their ids (the bound is a parameter; the threshold
    covers every learnable labelled document, scoring every document).

    Several labels of one id count by their mean (0.5 and more is good); null
    labels and ids are ignored; of rows that share an id the text with the smallest
    hash counts.  Without labels of both kinds all strengths are equal.  The driver
    receives one feature row per sampled document and the strengths next to the threshold.
    """
    known = (labels.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(label)).alias("y")).dropna()
             .filter(learnable(F.col("id"))).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # broadcast: two numbers a sampled row
    texts = (docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text"))
             .join(F.broadcast(chosen), "id")
             .groupBy("id", "y").agg(F.min_by("text", F.struct(*hash128(F.col("text")))).alias("text")))
    found = _featured(texts.select(F.struct("id", "y").alias("row"), "text")).select("row.id", "row.y", "x").collect()
    found.sort(key=lambda r: r["id"])
    if not found:
        return BradleyTerry(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(4 * N_FEATURES), 0.0)
    model = BradleyTerry.fit(np.array([r["x"] for r in found]), np.array([r["y"] for r in found]), pairs)
    if model.weights.any():
        model.cut = _threshold(_strengths(docs, known, model, doc_id, text))
    return model


def _strengths(docs: DataFrame, known: DataFrame, model: BradleyTerry, doc_id: str, text: str) -> DataFrame:
    """y, strength of every document of ``known``; numbers only are shuffled."""
    shipped = bits_of(known.select(F.xxhash64(F.col("id").cast(docs.schema[doc_id].dataType)).alias("key")))
    a, b = hash128(F.col(quoted(text)))
    rows = docs.select(F.pmod(F.xxhash64(F.col(quoted(doc_id))), F.lit(FILTER_BITS)).alias("bit"), F.col(quoted(doc_id)).alias("id"),
                       F.struct(a.alias("a"), b.alias("b")).alias("of"), F.col(quoted(text)).alias("text"))
    schema = T.StructType([rows.schema["id"], rows.schema["of"], T.StructField("strength", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(shipped.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(passes[batch.column(0).to_numpy()]))
            x = np.array([features(t) for t in batch.column(3).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(model.strength(x))], ["id", "of", "strength"])

    met = rows.mapInArrow(run, schema).join(known, "id")
    return cut(met.groupBy("id", "y").agg(F.min_by("strength", "of").alias("strength")).select("y", "strength"), "quality-strengths")


def _threshold(strengths: DataFrame) -> float:
    """Between the two strengths that the share of bad labels separates, exactly."""
    n, bad = strengths.agg(F.count(F.lit(1)), F.count_if(F.col("y") == 0)).first()
    return sum(_at_rank(strengths, min(max(rank, 1), n)) for rank in (bad, bad + 1)) / 2


#: Strengths the driver takes at once; counting rounds narrow the search until so few are left.
NEAR = 5000


def _at_rank(strengths: DataFrame, rank: int) -> float:
    """The ``rank``-th least strength: rounds of counts over NEAR equal steps of what is left."""
    left = strengths.select("strength")
    while True:
        low, high, n = left.agg(F.min("strength"), F.max("strength"), F.count(F.lit(1))).first()
        if low == high:
            return low
        if n <= NEAR:
            return sorted(r["strength"] for r in left.collect())[rank - 1]
        step = F.floor((F.col("strength") - low) / ((high - low) / NEAR))
        counted = left.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("strength").alias("low"),
                                                       F.max("strength").alias("high")).orderBy("step").collect()
        for r in counted:
            if rank <= r["n"]:
                break
            rank -= r["n"]
        left = left.filter(F.col("strength").between(r["low"], r["high"]))


def _featured(rows: DataFrame) -> DataFrame:
    """row, x of a table of (row, text)."""
    schema = T.StructType([rows.schema["row"], T.StructField("x", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.field("element", pa.float64(), False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["row", "x"])

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: BradleyTerry, at_cut: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 where the score reaches ``at_cut``).

    Null and empty texts have the features of the empty text and one score.
    Rows are scored on their own, repeated rows alike; input columns called
    ``score`` or ``predicted`` are replaced; an empty table gives an empty
    table.  No shuffle; the model is a few hundred numbers.
    """
    out = {"score", "predicted"}
    rows = docs.select(whole_row(docs, out).alias("row"), F.col(quoted(text)).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x, at_cut))], ["row", "score"])

    return rows.mapInArrow(run, schema).select(*fields("row", docs, out), "score",
                                               (F.col("score") >= at_cut).cast("int").alias("predicted"))
