"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes; their tokens' end offsets are two rising
lists.  Where both lists hold an offset, both cut: these offsets split the text
into groups.  From a common start (i, j) the lists are compared at the current
index shift j - i: slices of doubling length as long as they are equal, so a
stretch of one-to-one tokens is jumped in a few comparisons.  Where they differ
the next common offset is found by stepping in the list that lags behind, which
gives one irregular group and the next shift.

How often an id pair is linked is counted over the whole corpus.  Texts are
dealt into blocks of bounded size as they are read; a block is the list of its
distinct pairs and, per document, places in that list, so pairs meet their
counts by a join of the blocks' short lists and go back to their block.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.llm.common import cut, fields, quoted, whole_row

#: Bytes of text a block gathers before it is closed.
BLOCK_BYTES = 12_000_000
_B_BITS = 32


def align(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int]]:
    """The places of the tokens of either side that end no group.

    ``a`` and ``b`` are rising end offsets with the same last one, so every other
    token ends a group, and both sides have as many of these.
    """
    i = j = 0
    n, m = len(a), len(b)
    inner_a: list[int] = []
    inner_b: list[int] = []
    while i < n:
        if a[i] == b[j]:
            # The diagonal: double the reach while the slices agree, then halve it.
            left = min(n - i, m - j)
            run, step = 1, 2
            while run + step <= left and a[i + run:i + run + step] == b[j + run:j + run + step]:
                run += step
                step *= 2
            step >>= 1
            while step:
                if run + step <= left and a[i + run:i + run + step] == b[j + run:j + run + step]:
                    run += step
                step >>= 1
            i += run
            j += run
            if i == n:
                break
        # An irregular group: step where the end lags, until both end together.
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                inner_a.append(i)
                i += 1
                x = a[i]
            else:
                inner_b.append(j)
                j += 1
                y = b[j]
        i += 1
        j += 1
    return inner_a, inner_b


# --- the two tokenizers -----------------------------------------------------

def byte_of_symbol() -> dict[str, int]:
    """The byte each symbol of a byte-level vocabulary stands for: printable ones
    for themselves, the others for the code points from 256 on, in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    of = byte_of_symbol()
    made = [b""] * (max(vocab.values()) + 1)
    for symbols, i in vocab.items():
        # Special names are not spelt in symbols.
        made[i] = bytes(of[s] for s in symbols) if all(s in of for s in symbols) else symbols.encode()
    return made


_SPELT = re.compile(r"<0x([0-9A-F]{2})>")


def piece_tokens(pieces: Sequence[str]) -> list[bytes]:
    """Bytes of every piece: U+2581 is a space, <0xHH> the byte HH."""
    made = []
    for p in pieces:
        spelt = _SPELT.fullmatch(p)
        made.append(bytes([int(spelt[1], 16)]) if spelt else p.replace("▁", " ").encode())
    return made


@dataclass
class Tokenizer:
    """Ids of a space and a text, for many texts, and the bytes of every id."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]


@functools.cache
def byte_level(path: str) -> Tokenizer:
    """A byte-level vocabulary file.

    Where the merges stand in the order of the ids, the ids are merge ranks and
    the faster library encodes by them; equality is tested on every code point.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer as Fast

    tokens = byte_level_tokens(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    made = Fast.from_file(path)
    special = set(made.get_added_tokens_decoder())
    joined = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if joined == list(range(256, 256 + len(joined))):
        ranks = {t: i for i, t in enumerate(tokens) if i not in special}
        by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Tokenizer(lambda texts: [by_rank.encode_ordinary(" " + t) for t in texts], tokens)
    made.encode_special_tokens = True
    return Tokenizer(lambda texts: [e.ids for e in made.encode_batch([" " + t for t in texts], add_special_tokens=False)], tokens)


@functools.cache
def pieces(path: str) -> Tokenizer:
    """A piece model; it puts the space before a text itself."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path)
    return Tokenizer(lambda texts: made.encode(texts, num_threads=1),
                     piece_tokens([made.id_to_piece(i) for i in range(made.get_piece_size())]))


# --- documents --------------------------------------------------------------

class Writer:
    """``a1,a2|b1;a3|b2,b3``: the groups' ids in order."""

    def __init__(self, size_a: int, size_b: int):
        ids_a, ids_b = ([str(i) for i in range(n)] for n in (size_a, size_b))
        # Every id with what may follow it, in one table.
        self.table = [*(i + "," for i in ids_a), *(i + "|" for i in ids_a), *(i + "," for i in ids_b), *(i + ";" for i in ids_b)]
        self.size_a, self.size_b = size_a, size_b

    def spell(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> str:
        """``to_a``, ``to_b``: the place of every group's last token."""
        entry_a, entry_b = a.copy(), b + 2 * self.size_a
        entry_a[to_a] += self.size_a
        entry_b[to_b] += self.size_b
        # A token stands behind all tokens of the groups before it, B's also behind its own group's A tokens.
        count_a, count_b = np.diff(to_a, prepend=-1), np.diff(to_b, prepend=-1)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(to_b + 1 - count_b, count_a)] = entry_a
        order[np.arange(len(b)) + np.repeat(to_a + 1, count_b)] = entry_b
        return "".join(map(self.table.__getitem__, order.tolist()))[:-1]


@dataclass
class Aligned:
    """One text: its groups' spelling and its links, one per group (tokens are
    never empty, so at most one token of either side ends at an offset)."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: np.ndarray


NOTHING = Aligned(0, 0, 0, "", np.array([], np.int64))


class Aligner:
    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.sides = a, b
        self.sizes = [np.array([len(t) for t in side.tokens]) for side in (a, b)]
        self.writer = Writer(len(a.tokens), len(b.tokens))

    def many(self, bodies: list[bytes | None]) -> list[Aligned]:
        """Texts as UTF-8 bytes; null, empty and malformed ones have no tokens."""
        texts: list[str] = []
        for x in bodies:
            try:
                texts.append((x or b"").decode())
            except UnicodeDecodeError:
                texts.append("")
        both = [side.encode(texts) for side in self.sides]
        return [self.one(x or b"", *ids) if t else NOTHING for x, t, *ids in zip(bodies, texts, *both)]

    def one(self, body: bytes, a: list[int], b: list[int]) -> Aligned:
        want = b" " + body
        for ids, side in zip((a, b), self.sides):
            if b"".join(map(side.tokens.__getitem__, ids)) != want:
                return NOTHING
        ids_a, ids_b = np.array(a), np.array(b)
        ends = [np.cumsum(size[ids]).tolist() for size, ids in zip(self.sizes, (ids_a, ids_b))]
        inner_a, inner_b = align(*ends)
        to_a, to_b = _without(len(a), inner_a), _without(len(b), inner_b)
        links = (ids_a[to_a] << _B_BITS) | ids_b[to_b]
        return Aligned(len(a), len(b), len(to_a), self.writer.spell(ids_a, ids_b, to_a, to_b), links)


def _without(n: int, places: list[int]) -> np.ndarray:
    kept = np.ones(n, np.bool_)
    kept[places] = False
    return np.flatnonzero(kept)


class _Block:
    """Documents and distinct links of one block."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.docs: list[Aligned] = []
        self.rows: list[pa.Array] = []

    def tables(self, schema: pa.Schema, keep_groups: bool) -> Iterator[pa.RecordBatch]:
        def made(rows: int, **columns) -> pa.RecordBatch:
            columns["block"] = pa.array([self.number] * rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

        n = len(self.docs)
        links = np.concatenate([d.links for d in self.docs])
        pairs, at = np.unique(links, return_inverse=True)
        ends = np.cumsum([0, *(d.n_groups for d in self.docs)])
        # Places of a document once each, with how often it holds them.
        where, times = np.unique(np.repeat(np.arange(n), np.diff(ends)) * len(pairs) + at, return_counts=True)
        offsets = np.searchsorted(where, np.arange(n + 1) * max(1, len(pairs))).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32)))
        groups = [d.groups for d in self.docs]
        yield made(n, row=pa.concat_arrays(self.rows), n_a=pa.array([d.n_a for d in self.docs]), n_b=pa.array([d.n_b for d in self.docs]),
                   n_groups=pa.array([d.n_groups for d in self.docs]),
                   groups=pa.array(groups if keep_groups else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
                   at=lists(where % max(1, len(pairs))), times=lists(times))
        for begin in range(0, len(pairs), 100_000):
            here = slice(begin, begin + 100_000)
            yield made(len(pairs[here]), place=pa.array(np.arange(len(pairs))[here].astype(np.int32)), pair=pa.array(pairs[here]),
                       n=pa.array(np.bincount(at, minlength=len(pairs))[here]))


def blocks(docs: DataFrame, path_a: str, path_b: str, text: str, keep_groups: bool) -> DataFrame:
    """block, and either a document (row, n_a, n_b, n_groups, groups, at, times) or
    one of the block's pairs (place, pair, n)."""
    rows = docs.select(whole_row(docs, {text}).alias("row"), F.col(quoted(text)).cast("binary").alias("text"))
    numbers, longs = T.ArrayType(T.IntegerType()), T.LongType()
    schema = T.StructType([T.StructField("block", longs), T.StructField("row", rows.schema["row"].dataType),
                           *(T.StructField(c, longs) for c in ("n_a", "n_b", "n_groups")), T.StructField("groups", T.StringType()),
                           T.StructField("at", numbers), T.StructField("times", numbers), T.StructField("place", T.IntegerType()),
                           T.StructField("pair", longs), T.StructField("n", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, kinds = Aligner(byte_level(path_a), pieces(path_b)), None
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            if kinds is None:
                ints, long = pa.list_(pa.int32()), pa.int64()
                kinds = pa.schema([("block", long), ("row", batch.column(0).type), ("n_a", long), ("n_b", long), ("n_groups", long),
                                   ("groups", pa.string()), ("at", ints), ("times", ints), ("place", pa.int32()), ("pair", long), ("n", long)])
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                bodies = part.column(1).to_pylist()
                block.docs += aligner.many(bodies)
                block.rows.append(part.column(0))
                block.bytes += sum(len(x or b"") + 100 for x in bodies)
                if block.bytes >= BLOCK_BYTES:
                    yield from block.tables(kinds, keep_groups)
                    number += 1
                    block = _Block(number)
        if block.docs:
            yield from block.tables(kinds, keep_groups)

    return rows.mapInArrow(run, schema)


def pair_counts(dealt: DataFrame) -> DataFrame:
    """pair, count, best: how often an id pair is linked corpus-wide, and whether
    that is the most of its B id."""
    counts = cut(dealt.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("count")), "align-counts")
    of_b = F.col("pair").bitwiseAND((1 << _B_BITS) - 1)
    most = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", of_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def links(dealt: DataFrame) -> DataFrame:
    """a, b, count, best of every linked id pair."""
    return pair_counts(dealt).select(F.shiftright("pair", _B_BITS).alias("a"), F.col("pair").bitwiseAND((1 << _B_BITS) - 1).alias("b"),
                                     "count", "best")


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align_documents(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep_groups: bool = True) -> DataFrame:
    """``docs`` without ``text``, with ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best``, ``count_sum`` and ``groups`` (``a1,a2|b1;a3|b2,b3``; with
    ``keep_groups`` false its SHA-256, '' where there are no tokens).

    ``path_a`` names a byte-level vocabulary, ``path_b`` a piece model; both encode
    a space and the text.  Special tokens' names are plain text.

    * Null, empty and malformed texts, and texts whose tokens do not spell a space
      and the text, have no tokens: zeros and ''.
    * Repeated rows count each on its own; ties of a B id's highest count are all best.
    * Input columns called like an output are replaced; an empty table gives an empty one.
    * A very long text is a block of its own.
    """
    dealt = cut(blocks(docs, path_a, path_b, text, keep_groups), "align-blocks")
    back = (dealt.filter("pair is not null").select("block", "place", "pair").join(pair_counts(dealt), "pair")
            .select(F.col("block").alias("of_block"), "place", "count", "best"))
    bodies = dealt.filter("pair is null").drop("place", "pair", "n")
    kept = ["row", "n_a", "n_b", "n_groups", "groups"]
    schema = T.StructType([*(dealt.schema[c] for c in kept), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("place").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy()[order]
        n_best, sums = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        if left.num_rows and len(count):
            at, times = (left.column(c).combine_chunks() for c in ("at", "times"))
            ends = at.offsets.to_numpy()
            here = at.values.to_numpy()[ends[0]:ends[-1]]
            n = times.values.to_numpy()[times.offsets.to_numpy()[0]:times.offsets.to_numpy()[-1]].astype(np.int64)
            full = np.flatnonzero(np.diff(ends))  # reduceat gives no 0 for an empty run
            if len(full):
                begins = ends[:-1][full] - ends[0]
                n_best[full] = np.add.reduceat(n * best[here], begins)
                sums[full] = np.add.reduceat(n * count[here], begins)
        return pa.Table.from_arrays([*(left.column(c) for c in kept), pa.array(n_best), pa.array(sums)], names=[*kept, "n_best", "count_sum"])

    done = bodies.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(together, schema)
    rest = docs.drop(text, *COUNTS, "groups")
    return done.select(*fields("row", rest), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")
