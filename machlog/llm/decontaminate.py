"""Benchmark decontamination with an FM-index per training shard.

A task gathers documents into shards of bounded size and builds, over the
shard's word numbers, a suffix array, its BWT as a wavelet matrix, and suffix
positions sampled at every SAMPLE-th word.  All benchmark windows are searched
backward at once; their occurrences are located by LF steps to the next sampled
position and merged into the spans to remove.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.llm.common import fields, quoted, whole_row

#: Words of a window; a shorter item is one window.
WINDOW = 13
#: Words of a shard (a longer document is a shard of its own).
SHARD_WORDS = 1_000_000
SAMPLE = 16
#: Benchmark text that one pass over the documents searches for; more text takes more passes.
PASS_BYTES = 4_000_000
#: Occurrences located at once.
LOCATE = 500_000

_WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).replace(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of letters a-z, digits and anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows(item: list[bytes]) -> list[tuple[bytes, ...]]:
    n = min(WINDOW, len(item))
    return [tuple(item[i:i + n]) for i in range(len(item) - n + 1)] if n else []


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Prefix doubling over non-negative numbers; only suffixes that still tie are sorted again."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(ids.max() + 1).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        nxt = np.zeros(n, np.int64)
        nxt[:n - k] = ids[k:] + 1 if k < n else 0
        key = key << bits | nxt
    order = np.argsort(key, kind="stable")
    held = key[order]
    new = np.append(True, held[1:] != held[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = width
    while len(tied):
        p = order[tied]
        key = rank[p] << 32 | rank[np.minimum(p + step, n)] + 1
        by = np.argsort(key, kind="stable")
        p, key = p[by], key[by]
        order[tied] = p
        new = np.append(True, key[1:] != key[:-1])
        rank[p] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class WaveletMatrix:
    """Rank and access over a sequence of numbers, one bit vector per binary digit."""

    def __init__(self, values: np.ndarray, top: int):
        self.n, self.depth = len(values), max(1, int(top).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view("<u8")
            self.bits.append(packed)
            self.sums.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.zeros.append(int(self.n - np.count_nonzero(bit)))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        at, within = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << within) - np.uint64(1)
        return self.sums[level][at] + np.bitwise_count(self.bits[level][at] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before place i."""
        low = np.zeros_like(i)
        for level in range(self.depth):
            one = (c >> (self.depth - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, i)
            low = np.where(one, self.zeros[level] + a, low - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at place i and its occurrences before."""
        value, low = np.zeros_like(i), np.zeros_like(i)
        for level in range(self.depth):
            one = (self.bits[level][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = self._ones(level, low), self._ones(level, i)
            value = value << 1 | one
            low = np.where(one, self.zeros[level] + a, low - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return value, i - low


class FMIndex:
    """Count and locate over one shard.  Every document ends with a number of its own."""

    def __init__(self, docs: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        number = self.number.setdefault
        base = len(docs)
        sizes = [len(d) for d in docs]
        ids = np.empty(sum(sizes) + base, np.int64)
        self.starts = np.append(0, np.cumsum([s + 1 for s in sizes]))
        for k, (d, s) in enumerate(zip(docs, sizes)):
            at = self.starts[k]
            ids[at:at + s] = [number(w, base + len(self.number)) for w in d]
            ids[at + s] = k
        self.n = len(ids)
        order = suffix_array(ids)
        bwt = ids[order - 1]  # the first suffix is preceded by the last end
        top = base + len(self.number)
        self.before = np.append(0, np.cumsum(np.bincount(ids, minlength=top + 1)))
        self.tree = WaveletMatrix(bwt, top)
        marked = order % SAMPLE == 0
        self.sampled = order[marked]
        self.marked = marked
        self.samples = np.cumsum(marked) - 1

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern, all searched side by side."""
        size = np.array([len(p) for p in patterns], np.int64)
        grid = np.full((len(patterns), max(size, default=0)), -1, np.int64)
        for row, p in zip(grid, patterns):
            row[:len(p)] = p
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(1, grid.shape[1] + 1):
            on = np.flatnonzero((size >= step) & (high > low))
            if not len(on):
                break
            c = grid[on, size[on] - step]
            low[on] = self.before[c] + self.tree.rank(c, low[on])
            high[on] = self.before[c] + self.tree.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by LF steps to a sampled one."""
        place = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            hit = self.marked[rows]
            place[left[hit]] = self.sampled[self.samples[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            c, rank = self.tree.access(rows)
            rows = self.before[c] + rank
            steps += 1
        return place


class Phrases:
    """The windows of one pass with the items they come from."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            for w in windows(words(text)):
                found.setdefault(w, set()).update(() if name is None else (name,))
        self.windows = list(found)
        self.items = [sorted(found[w]) for w in self.windows]

    def hits(self, docs: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Per document the merged spans of hit words [first, last) and the items that occur."""
        index = FMIndex(docs)
        known = index.number
        chosen = [k for k, w in enumerate(self.windows) if all(x in known for x in w)]
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        names: list[set[str]] = [set() for _ in docs]
        low, high = index.search([np.array([known[x] for x in self.windows[k]], np.int64) for k in chosen])
        change = np.zeros(index.n + 1, np.int64)
        sizes = np.array([len(self.windows[k]) for k in chosen], np.int64)
        for rows, which in _batches(low, high):
            place = index.locate(rows)
            np.add.at(change, place, 1)
            np.add.at(change, place + sizes[which], -1)
            inside = np.searchsorted(index.starts, place, side="right") - 1
            for pair in np.unique(inside * len(chosen) + which).tolist():
                names[pair // len(chosen)].update(self.items[chosen[pair % len(chosen)]])
        covered = np.append(0, np.cumsum(change[:-1]) > 0).astype(np.int8)
        turn = np.diff(np.append(covered, 0))
        for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            d = int(np.searchsorted(index.starts, a, side="right")) - 1
            start = int(index.starts[d])
            spans[d].append((a - start, b - start))
        return spans, names


def _batches(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes in the ranges and the number of each one's range, LOCATE at a time."""
    ends = np.cumsum(high - low)
    for at in range(0, int(ends[-1]) if len(ends) else 0, LOCATE):
        serial = np.arange(at, min(at + LOCATE, int(ends[-1])))
        which = np.searchsorted(ends, serial, side="right")
        yield high[which] - (ends[which] - serial), which


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (merged runs of hit words, [first, last)),
    ``n_hit`` (words in them), ``items`` (sorted ids, as strings, of items with an
    occurring window) and ``contaminated`` (n_hit > 0 and 20 * n_hit >= n_words).

    A window is WINDOW consecutive words of an item, or the whole item if it has fewer.

    * Null and empty texts have no words and are clean; items without words have no window.
    * Items with a null id hit words but are not listed; items that repeat a window are all listed.
    * Repeated documents are judged each on its own; input columns called like an
      output are replaced; empty tables give no rows or no hits.

    No shuffle.  The benchmark is collected in passes of at most about PASS_BYTES
    (its size is asked first); each pass reads the spans of the one before, so
    any benchmark is searched whole.  A task holds one shard.
    """
    out = {"n_words", "spans", "n_hit", "items", "contaminated"} | (set() if keep_text else {text})
    item = benchmark.select(F.col(quoted(item_id)).cast("string").alias("item"), F.col(quoted(item_text)).alias("text")).filter("text is not null")
    size = item.agg(F.sum(F.octet_length("text") + 50)).first()[0] or 0
    passes = max(1, math.ceil(size / PASS_BYTES))
    rows = docs.select(whole_row(docs, out).alias("row"), F.col(quoted(text)).alias("text"), F.lit(0).cast("long").alias("n_words"),
                       F.array().cast("array<struct<first:int,last:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(passes))
    for k in range(passes):
        phrases = Phrases([tuple(r) for r in item.filter(part == k).collect()])
        rows = _search(rows, docs.sparkSession.sparkContext.broadcast(phrases))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    rows = rows.select("row", "n_words", "spans", n_hit.alias("n_hit"), F.array_sort("items").alias("items"))
    return rows.select(*fields("row", docs, out), "n_words", "spans", "n_hit", "items", contaminated().alias("contaminated"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def _search(rows: DataFrame, shipped) -> DataFrame:
    schema = T.StructType([rows.schema[c] for c in ("row", "text", "n_words", "spans", "items")])
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def shard(kept: list[pa.RecordBatch], docs: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        spans, items = shipped.value.hits(docs)
        at = 0
        for batch in kept:
            n = batch.num_rows
            old_spans, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(d) for d in docs[at:at + n]], pa.int64()),
                pa.array([_merged([(x["first"], x["last"]) for x in o], s) for o, s in zip(old_spans, spans[at:at + n])], span),
                pa.array([sorted(s.union(o)) for o, s in zip(old_items, items[at:at + n])], pa.list_(pa.string())),
            ], ["row", "text", "n_words", "spans", "items"])
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, docs, size = [], [], 0
        for batch in batches:
            begun = 0
            for i, body in enumerate(batch.column(1).to_pylist()):
                docs.append(words(body))
                size += len(docs[-1]) + 1
                if size >= SHARD_WORDS:
                    yield from shard([*kept, batch.slice(begun, i + 1 - begun)], docs)
                    kept, docs, size, begun = [], [], 0, i + 1
            if begun < batch.num_rows:
                kept.append(batch.slice(begun))
        if docs:
            yield from shard(kept, docs)

    return rows.mapInArrow(run, schema)


def _merged(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for a, b in sorted(old + new):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"first": a, "last": b} for a, b in out]
