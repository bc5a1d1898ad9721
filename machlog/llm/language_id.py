"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds its
letters' vectors, each permuted (rotated) by its place, by multiplication; a
document's vector bundles (sums) the vectors of its n-grams and a language's
prototype those of its training documents, each scaled to length 1.  A document
gets the language with the largest cosine.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.llm.common import arrow_rows, fields, quoted, whole_row

DIMENSIONS = 1024
GRAM = 3
#: n-gram vectors a worker keeps (2 KB each); a full table is emptied.
CACHE = 24_000
#: n-grams bundled at once; a longer document takes several rounds.
BLOCK = 16_000
GAP = 32  # what stands for a run of other characters


@functools.lru_cache(maxsize=100_000)
def _letter(code: int) -> int:
    """The lower-cased letter's code point; GAP for what is no letter."""
    c = chr(code)
    if not unicodedata.category(c).startswith("L"):
        return GAP
    low = c.lower()
    return ord(low) if len(low) == 1 else code


@functools.lru_cache(maxsize=100_000)
def letter_vector(code: int) -> np.ndarray:
    """The same for a code point on every machine."""
    return np.random.default_rng([code, DIMENSIONS]).choice(np.array([-1, 1], dtype=np.int16), DIMENSIONS)


_ASCII = np.array([_letter(i) for i in range(256)], dtype=np.uint32)


def letters(text: str | None) -> np.ndarray:
    """Lower-cased letters of the text; other characters as one GAP between and around words."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    small = codes < 256
    low = np.where(small, _ASCII[np.where(small, codes, 0)], codes)
    if not small.all():
        far, back = np.unique(codes[~small], return_inverse=True)
        low[~small] = np.array([_letter(int(c)) for c in far], dtype=np.uint32)[back]
    gap = low == GAP
    low = low[~(gap & np.append(True, gap[:-1]))] if len(low) else low
    if not len(low):
        return low
    return np.concatenate([[GAP], low if low[-1] != GAP else low[:-1], [GAP]]).astype(np.int64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the text's n-grams; none without letters."""
    s = letters(text)
    if len(s) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(len(s) - GRAM + 1, np.int64)
    for k in range(GRAM):
        code = code << 21 | s[k:len(s) - GRAM + 1 + k]
    return np.unique(code, return_counts=True)


class Bundler:
    """Document vectors, with a bounded table of n-gram vectors."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.vectors = np.empty((CACHE, DIMENSIONS), dtype=np.int8)

    def _rows(self, codes: list[int]) -> np.ndarray:
        new = [c for c in codes if c not in self.at]
        if len(self.at) + len(new) > CACHE:
            self.at.clear()
            new = codes
        for c in new:
            v = np.ones(DIMENSIONS, dtype=np.int16)
            for k in range(GRAM):
                v = v * np.roll(letter_vector(c >> 21 * (GRAM - 1 - k) & 0x1FFFFF), k)
            self.vectors[len(self.at)] = v
            self.at[c] = len(self.at)
        return self.vectors[[self.at[c] for c in codes]]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The text's vector; None without a letter."""
        codes, counts = grams(text)
        if not len(codes):
            return None
        total = np.zeros(DIMENSIONS, dtype=np.float32)
        for at in range(0, len(codes), BLOCK):
            total += counts[at:at + BLOCK].astype(np.float32) @ self._rows(codes[at:at + BLOCK].tolist()).astype(np.float32)
        return total


def learn(docs: DataFrame, learnable: Callable[[Column], Column], doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes from all documents with a language whose id is ``learnable``.

    Each task sends one sum vector per language it met; they are added up by
    language and dimension, so the driver receives languages x dimensions numbers.
    Texts without a letter teach nothing.  Vectors are rounded to whole numbers
    before they are added, so the sums do not depend on the order of the rows.
    """
    known = docs.filter(F.col(quoted(lang)).isNotNull() & learnable(F.col(quoted(doc_id)))).select(
        F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, sums = Bundler(), {}
        for name, body in arrow_rows(batches):
            v = use.bundle(body)
            if v is not None and v.any():
                whole = np.round(v * (1e6 / np.linalg.norm(v.astype(np.float64)))).astype(np.int64)
                sums[name] = sums.get(name, 0) + whole
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([v.tolist()], pa.list_(pa.int64()))], ["lang", "v"])

    parts = known.mapInArrow(run, "lang string, v array<bigint>")
    total = (parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
             .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")))
    found = {r["lang"]: np.array([e["x"] for e in r["v"]], dtype=np.float64) for r in total.collect()}
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the cosine, 0 where negative).

    Null text, text without a letter, or no prototype at all: ``und`` and 0.
    Of equal cosines the first language in the alphabet.  Rows are judged on
    their own; input columns called like an output are replaced; an empty table
    gives an empty table.  No shuffle; the prototypes are broadcast, 8 KB a language.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(-1, DIMENSIONS)
    shipped = docs.sparkSession.sparkContext.broadcast((names, matrix))
    out = {"lang_pred", "score"}
    rows = docs.select(whole_row(docs, out).alias("row"), F.col(quoted(text)).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, (labels, against) = Bundler(), shipped.value
        for batch in batches:
            said, scores = [], []
            for body in batch.column(1).to_pylist():
                v = use.bundle(body)
                length = 0.0 if v is None else float(np.linalg.norm(v.astype(np.float64)))
                if v is None or not labels:
                    said.append("und")
                    scores.append(0.0)
                    continue
                cosines = np.round(against @ v.astype(np.float64) / max(length, 1.0), 9)
                best = int(np.argmax(cosines))
                said.append(labels[best])
                scores.append(float(np.clip(cosines[best], 0, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(scores, pa.float64())],
                                             ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, schema).select(*fields("row", docs, out), "lang_pred", "score")
