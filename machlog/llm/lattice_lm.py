"""LM scoring by the likelihood of the subword lattice.

Words are split into pieces of an existing vocabulary in every possible way;
the probability of a word is the sum over all its segmentations of the product
of their piece probabilities, from a forward recursion in log space.  Pieces do
not cross white space, so a document's log probability is the sum over its words
and the end of the text.

The vocabulary's scores are merge ranks.  By Zipf's law they are read as first
probabilities, 1 / (rank + 1); expectation steps over the distinct training words
then give the unigram probabilities that weight the segmentations.

A word of the training texts has one edge more, from its begin to its end: its
corpus-wide count less a discount.  What the discounts hold back goes to the
segmentations into pieces, so words never seen keep their share, and what is
learned grows with the corpus.

Texts are dealt into blocks of bounded size as they are read.  A block is a list
of its distinct words and, per document, places in that list; words meet their
corpus-wide counts and probabilities by a join and go back to their block.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.llm.common import cut, fields, quoted, whole_row

#: Bytes of text a block gathers before it is closed.
BLOCK_BYTES = 14_000_000
START = "▁"
END = "</s>"
#: Weight of the first probabilities, in pieces, against the expected counts.
PRIOR = 1000.0
#: Expectation steps; a third gains 0.01 log10 per held-out token, for one more pass over the words.
ROUNDS = 2
#: Discount where the corpus has no words of one or two occurrences to take it from.
DISCOUNT = 0.5
#: Expected counts are added up as whole millionths: sums do not depend on the order of the rows.
MILLION = 1_000_000


_BYTE = re.compile(r"<0x[0-9A-F]{2}>")
#: Longer words, and words with a character that is no piece, are worked out one by one.
SIDE_BY_SIDE = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """A subword vocabulary: pieces and their probabilities (natural log)."""

    log_p: dict[str, float]

    def __post_init__(self):
        # The end and the spelt bytes are no pieces of a text that contains their names.
        self.plain = {p: w for p, w in self.log_p.items() if p and p != END and not _BYTE.fullmatch(p)}
        self.reach: dict[str, int] = {}
        for p in self.plain:
            self.reach[p[0]] = max(self.reach.get(p[0], 1), len(p))
        self.longest = max(self.reach.values(), default=1)
        self.single = frozenset(p for p in self.plain if len(p) == 1)
        self.names = list(self.plain)
        hashes = np.array([_hash_of(p) for p in self.names], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        assert len(np.unique(hashes)) == len(hashes)
        self.weights = np.append(np.fromiter(self.plain.values(), np.float64, len(self.plain)), -np.inf)
        self.maybe = np.zeros(1 << 20, np.bool_)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def of_model(cls, path: str) -> Pieces:
        """From a sentencepiece file; its order of scores gives the first probabilities."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        normal.sort(key=lambda i: (-model.get_score(i), i))
        names = [*map(model.id_to_piece, normal), *(f"<0x{b:02X}>" for b in range(256)), END]
        return cls.zipf(names)

    @classmethod
    def zipf(cls, names: list[str]) -> Pieces:
        total = math.log(sum(1 / (r + 1) for r in range(len(names))))
        return cls({p: -math.log(r + 1) - total for r, p in enumerate(names)})

    def edges(self, word: str) -> list[list[tuple[int, str | tuple, float]]]:
        """For each place of the marked word the pieces that start there: (end, piece, log p).
        A character that is no piece is spelt in bytes."""
        s = START + word
        found, get = [], self.plain.get
        for i in range(len(s)):
            here = []
            for j in range(i + 1, min(len(s), i + self.reach.get(s[i], 1)) + 1):
                p = s[i:j]
                w = get(p)
                if w is not None:
                    here.append((j, p, w))
            if not here or here[0][0] != i + 1:
                spelt = tuple(f"<0x{b:02X}>" for b in s[i].encode("utf-8", "surrogatepass"))
                here.insert(0, (i + 1, spelt, sum(self.log_p[b] for b in spelt)))
            found.append(here)
        return found

    def forward(self, edges: list) -> list[float]:
        """Log probability of each prefix, summed over its segmentations."""
        out = [-math.inf] * (len(edges) + 1)
        out[0] = 0.0
        for i, here in enumerate(edges):
            a = out[i]
            for j, _, w in here:
                out[j] = _log_add(out[j], a + w)
        return out

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; the last number where there is none."""
        found = np.full(h.shape, len(self.names), np.int64)
        on = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        wanted = h.ravel()[on]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        same = self.hashes[at] == wanted
        found.ravel()[on[same]] = self.order[at[same]]
        return found

    def _by_length(self, words: list[str]) -> dict[int, list[int]]:
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            size = len(w) + 1
            groups.setdefault(size if size <= SIDE_BY_SIDE and START in self.single and self.single.issuperset(w) else 0, []).append(k)
        return groups

    def many(self, words: list[str], times: list[int] | None = None, into: dict[str, int] | None = None) -> np.ndarray:
        """Log probabilities of the words; with ``times`` also their expected pieces, in millionths.

        Words of one length are columns of the same recursions.
        """
        out = np.empty(len(words))
        sums = np.zeros(len(self.names) + 1, np.int64)
        for size, members in self._by_length(words).items():
            if not size:
                for k in members:
                    if times is None:
                        out[k] = self.word(words[k])
                    else:
                        self.expected(words[k], times[k], into)
                continue
            for at in range(0, len(members), 4096):
                chosen = members[at:at + 4096]
                text = "".join(START + words[k] for k in chosen)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, size).astype(np.uint64) + np.uint64(1)
                out[chosen] = self._side_by_side(codes, None if times is None else np.array([times[k] for k in chosen], np.float64), sums)
        if into is not None:
            for k in np.flatnonzero(sums[:-1]).tolist():
                into[self.names[k]] = into.get(self.names[k], 0) + int(sums[k])
        return out

    def _side_by_side(self, codes: np.ndarray, times: np.ndarray | None, sums: np.ndarray) -> np.ndarray:
        size = codes.shape[1]
        spans = range(1, min(size, self.longest) + 1)
        h, pieces, weight = np.zeros_like(codes), {}, {}
        for n in spans:  # pieces of n characters from every place
            h = (h[:, :size - n + 1] * _STEP) + codes[:, n - 1:]
            pieces[n] = self._lookup(h)
            weight[n] = self.weights[pieces[n]]
        ahead = np.full((len(codes), size + 1), -np.inf)
        ahead[:, 0] = 0.0
        for j in range(1, size + 1):
            ahead[:, j] = np.logaddexp.reduce([ahead[:, j - n] + weight[n][:, j - n] for n in spans if n <= j])
        if times is not None:
            back = np.full((len(codes), size + 1), -np.inf)
            back[:, size] = 0.0
            for i in range(size - 1, -1, -1):
                back[:, i] = np.logaddexp.reduce([weight[n][:, i] + back[:, i + n] for n in spans if i + n <= size])
            scale = times[:, None] * MILLION
            for n in spans:
                share = ahead[:, :size - n + 1] + weight[n] + back[:, n:] - ahead[:, size:]
                np.add.at(sums, pieces[n].ravel(), np.rint(np.exp(np.minimum(share, 0.0)) * scale).astype(np.int64).ravel())
        return ahead[:, size]

    def word(self, word: str) -> float:
        return self.forward(self.edges(word))[-1]

    def expected(self, word: str, times: int, into: dict[str, int]) -> None:
        """Add the expected number of each piece in ``times`` occurrences, in millionths."""
        edges = self.edges(word)
        ahead = self.forward(edges)
        back = [-math.inf] * (len(edges) + 1)
        back[-1] = 0.0
        for i in range(len(edges) - 1, -1, -1):
            for j, _, w in edges[i]:
                back[i] = _log_add(back[i], w + back[j])
        scale = times * MILLION
        for i, here in enumerate(edges):
            for j, piece, w in here:
                n = round(math.exp(min(0.0, ahead[i] + w + back[j] - ahead[-1])) * scale)
                if n:
                    for p in piece if isinstance(piece, tuple) else (piece,):
                        into[p] = into.get(p, 0) + n

    def trained(self, counts: dict[str, int]) -> Pieces:
        """Probabilities from expected counts (millionths), smoothed by the ones so far."""
        total = sum(counts.values()) / MILLION + PRIOR
        return Pieces({p: math.log((counts.get(p, 0) / MILLION + PRIOR * math.exp(w)) / total) for p, w in self.log_p.items()})


def discount(once: int, twice: int) -> float:
    """What each seen word gives away, from the number of words seen once and twice."""
    return once / (once + 2 * twice) if once and twice else DISCOUNT


def with_whole_words(spelt: np.ndarray, c: np.ndarray, total: int, kinds: int, less: float) -> np.ndarray:
    """Log probabilities of words of counts ``c`` whose pieces give ``spelt``: the whole
    word (its count less the discount) or its pieces (the share of all discounts)."""
    if not total:
        return spelt
    with np.errstate(divide="ignore"):
        whole = np.log(np.maximum(c - less, 0.0) / total)
    return np.logaddexp(whole, math.log(less * kinds / total) + spelt)


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_STEP) + ord(c) + 1) % 2**64
    return h


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Block:
    """Documents and distinct words of one block."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.places: dict[bytes, int] = {}
        self.learned: list[int] = []
        self.rows: list[pa.Array] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: str | None, learn: bool) -> None:
        found = Counter(words(text))
        at = [self.places.setdefault(w, len(self.places)) for w in found]
        self.learned.extend([0] * (len(self.places) - len(self.learned)))
        times = list(found.values())
        if learn:
            for place, n in zip(at, times):
                self.learned[place] += n
        self.docs.append((np.array(at, np.int32), np.array(times, np.int32)))
        self.bytes += len(text or "") + 100

    def tables(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def made(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        n, k = len(self.docs), len(self.places)
        of = lambda name: schema.field(name).type
        yield made(n, block=pa.array([self.number] * n, pa.int64()), row=pa.concat_arrays(self.rows).cast(of("row")),
                   at=pa.array([a for a, _ in self.docs], of("at")), times=pa.array([t for _, t in self.docs], of("times")))
        yield made(k, block=pa.array([self.number] * k, pa.int64()), place=pa.array(range(k), pa.int32()),
                   word=pa.array(list(self.places), pa.binary()), learned=pa.array(self.learned, pa.int64()))


def blocks(docs: DataFrame, learn: Column, text: str) -> DataFrame:
    """block, and either row, at, times (a document) or place, word, learned (a word of the block)."""
    rows = docs.select(whole_row(docs, {text}).alias("row"), F.col(quoted(text)).alias("text"),
                       F.coalesce(learn, F.lit(False)).alias("learn"))
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("row", rows.schema["row"].dataType),
        T.StructField("at", numbers), T.StructField("times", numbers), T.StructField("place", T.IntegerType()),
        T.StructField("word", T.BinaryType()), T.StructField("learned", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block, kinds = _Block(number), None
        for batch in batches:
            if kinds is None:
                ints = pa.list_(pa.int32())
                kinds = pa.schema([("block", pa.int64()), ("row", batch.column(0).type), ("at", ints), ("times", ints),
                                   ("place", pa.int32()), ("word", pa.binary()), ("learned", pa.int64())])
            begun = 0
            for i, (body, known) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                block.add(body, known)
                if block.bytes >= BLOCK_BYTES:
                    block.rows.append(batch.column(0).slice(begun, i + 1 - begun))
                    begun = i + 1
                    yield from block.tables(kinds)
                    number += 1
                    block = _Block(number)
            if begun < batch.num_rows:
                block.rows.append(batch.column(0).slice(begun))
        if block.docs:
            yield from block.tables(kinds)

    return rows.mapInArrow(run, schema)


def _expected_pieces(seen: DataFrame, model: Pieces) -> dict[str, int]:
    """Expected pieces (millionths) of the distinct words in column ``word``, each once:
    every word leaves the pieces the same discount."""
    shipped = seen.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, into = shipped.value, {}
        for batch in batches:
            found = [w.decode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
            use.many(found, [1] * len(found), into)
        yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.int64())], ["piece", "n"])

    parts = seen.mapInArrow(expect, "piece string, n bigint")
    summed = parts.groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    return {r["piece"]: int(r["n"]) for r in summed.collect()}


def score(docs: DataFrame, vocabulary: Pieces, learn: Column, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, both log10 probabilities.

    Tokens are the words (A-Z lower-cased, split at ASCII white space) and one end.
    ``base_score`` adds log10((c + 1) / (N + V + 1)) over the tokens, with counts
    from the rows for which ``learn`` holds; ``n_known`` counts tokens with c > 0.

    * Null text counts as empty: the end alone.
    ``score`` sums, for each word, the whole word's edge and all segmentations.

    * Without training rows N and V are 0, every count is 0 and the vocabulary's
      first probabilities hold, without whole words.
    * Repeated rows are scored (and learned) each on its own; input columns called
      like an output are replaced; an empty table gives an empty table.
    * A document larger than a block is a block of its own.

    What reaches the driver: five totals and, per step, one number per vocabulary piece.
    """
    spark = docs.sparkSession
    dealt = cut(blocks(docs, learn, text), "lm-blocks")
    place = dealt.filter("word is not null").select("block", "place", "word", "learned")
    counts = cut(place.groupBy("word").agg(F.sum("learned").alias("c")), "lm-counts")
    known = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"),
                       F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.count(F.when(F.col("c") == 2, 1)).alias("twice")).first()
    ends_known = docs.filter(F.coalesce(learn, F.lit(False))).count()
    total, distinct = (known["n"] or 0) + ends_known, known["v"] + (ends_known > 0)

    less = discount(known["once"], known["twice"])
    model = vocabulary
    for _ in range(ROUNDS if ends_known else 0):
        found = _expected_pieces(counts.filter("c > 0").select("word"), model)
        model = model.trained(found | {END: MILLION})
    shipped = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shipped.value
        for batch in batches:
            p = use.many([w.decode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()])
            p = with_whole_words(p, batch.column(1).to_numpy(), total, distinct, less)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], ["word", "c", "log_p"])

    weighed = counts.mapInArrow(weigh, "word binary, c bigint, log_p double")
    back = place.select("block", "place", "word").join(weighed, "word").select(F.col("block").alias("of_block"), "place", "c", "log_p")
    bodies = dealt.filter("word is null").select("block", "row", "at", "times")
    out = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    longs, doubles = T.LongType(), T.DoubleType()
    schema = T.StructType([T.StructField("row", dealt.schema["row"].dataType),
                           *(T.StructField(c, doubles if "score" in c else longs) for c in out)])
    below = math.log10(total + distinct + 1)
    end_p = float(with_whole_words(np.float64(model.log_p[END]), np.float64(ends_known), total, distinct, less))
    end_base = math.log10(ends_known + 1) - below

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("place").to_numpy())
        c = right.column("c").to_numpy()[order]
        log_p = right.column("log_p").to_numpy()[order]
        base = np.log10(c + 1.0) - below
        # All documents of the block as one run of places, added up between their offsets.
        at, times = (left.column(x).combine_chunks() for x in ("at", "times"))
        ends = at.offsets.to_numpy()
        here = at.values.to_numpy()[ends[0]:ends[-1]]
        n = times.values.to_numpy()[times.offsets.to_numpy()[0]:times.offsets.to_numpy()[-1]].astype(np.float64)

        def per_document(x: np.ndarray) -> np.ndarray:
            # Documents without words are left out: reduceat gives no 0 for an empty run.
            sums, full = np.zeros(len(ends) - 1), np.flatnonzero(np.diff(ends))
            if len(full):
                sums[full] = np.add.reduceat(x, ends[:-1][full] - ends[0])
            return sums

        got = (per_document(n) + 1, per_document(n * (c[here] > 0)) + (ends_known > 0), np.full(left.num_rows, total),
               per_document(n * base[here]) + end_base, (per_document(n * log_p[here]) + end_p) / math.log(10))
        cols = [pa.array(x if "score" in name else x.astype(np.int64)) for x, name in zip(got, out)]
        return pa.Table.from_arrays([left.column("row"), *cols], names=["row", *out])

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            return add_up(left, right)
        empty = [pa.array([], pa.float64() if "score" in name else pa.int64()) for name in out]
        return pa.Table.from_arrays([left.column("row"), *empty], names=["row", *out])

    scored = bodies.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(together, schema)
    rest = docs.drop(text, *out)
    return scored.select(*fields("row", rest), *out)
