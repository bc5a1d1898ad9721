"""Byte-level BPE encoding and decoding with a given rank file.

Short matches of the split pattern are merged side by side: a column of
(rank, position) numbers for each, whose least is the leftmost pair of least
rank; a merge changes the two numbers beside it.  A long match has a segment
tree of its own over such numbers, in which a merge updates a logarithmic number
of nodes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.llm.common import fields, quoted, whole_row

#: A match of more bytes gets a tree of its own.
WIDE = 64
#: Matches that are merged together.
TOGETHER = 8_000
#: Entries of each cache of a worker; a full cache is emptied, results do not depend on it.
CACHE = 150_000
NO_PAIR = np.int64(1) << 62
_PLACE_BITS, _PLACES = 7, 127


class BytePairCoder:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        by_id = sorted((i, t) for t, i in ranks.items())
        self.token_size = np.zeros(by_id[-1][0] + 1, np.int64)
        self.token_size[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.token_begin = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], NO_PAIR)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        two = np.arange(1 << 16)
        self.byte_pairs = self._pair(self.byte_ids[two >> 8], self.byte_ids[two & 255], 0)
        self.matches: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}  # by what follows a space
        self.loose: set[str] = set()  # chunks that are empty, or begin or end with white space
        self.irregular = regex.compile(r"\s | \s")

    # Ids are kept as little-endian unsigned 32-bit integers.

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        A match never runs over a single space between two other characters:
        the space starts the next match.  So such texts are cut at spaces, and
        what follows a space is split and encoded once.  A text in which a
        space touches other white space is split by the pattern as a whole.
        """
        if max(len(self.chunks), len(self.matches)) > CACHE:
            self.forget()
        cut = [t.split(" ") for t in texts]
        first = [parts.pop(0) for parts in cut]
        fresh = list(set().union(*cut).difference(self.chunks))
        self.loose.update(p for p in fresh if not p or p.strip() != p)
        odd = [(p.strip() != p or not p or not self.loose.isdisjoint(parts)) and bool(self.irregular.search(t))
               for t, p, parts in zip(texts, first, cut)]
        find = self.pattern.findall
        split = [find(" " + p) for p in fresh]
        begun = [find(t if whole else p) for t, p, whole in zip(texts, first, odd)]
        self._learn(set().union(*split, *begun))
        ids = self.matches.__getitem__
        self.chunks.update(zip(fresh, [ids(found[0]) if len(found) == 1 else b"".join(map(ids, found)) for found in split]))
        get = self.chunks.__getitem__
        return [b"".join(map(ids, found)) if whole else b"".join([*map(ids, found), *map(get, parts)])
                for found, parts, whole in zip(begun, cut, odd)]

    def forget(self) -> None:
        """Empty the caches."""
        self.matches.clear()
        self.chunks.clear()
        self.loose.clear()

    def _learn(self, wanted: set[str]) -> None:
        """Encode the matches that are not cached yet."""
        names = list(wanted.difference(self.matches))
        data = [m.encode("utf-8", "surrogatepass") for m in names]
        self.matches.update((m, rank.to_bytes(4, "little")) for m, rank in zip(names, map(self.ranks.get, data)) if rank is not None)
        size = np.fromiter(map(len, data), np.int64, len(data))
        order = np.argsort(size, kind="stable").tolist()
        short = int(np.count_nonzero(size <= WIDE))
        for at in range(0, short, TOGETHER):
            part = [i for i in order[at:min(at + TOGETHER, short)] if names[i] not in self.matches]
            if part:
                self.matches.update(zip([names[i] for i in part], self._merge_many([data[i] for i in part])))
        for i in order[short:]:
            if names[i] not in self.matches:
                self.matches[names[i]] = self._merge_long(data[i])

    def _merge_many(self, words: list[bytes]) -> list[bytes]:
        """Merge short words side by side.

        Arrays have a column for each word and a row for each byte, with an empty row before and after."""
        count = len(words)
        width = max(map(len, words))
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(count, width)
        size = np.fromiter(map(len, words), np.int64, count)
        token = np.full((width + 2, count), -1)
        token[1:-1] = self.byte_ids[raw.T]
        token[1:-1][np.arange(width)[:, None] >= size] = -1
        pair = np.full((width + 2, count), NO_PAIR)
        place = np.arange(width + 2)[:, None]
        pair[1:width] = self.byte_pairs[raw[:, :-1].T.astype(np.int64) << 8 | raw[:, 1:].T] | place[1:width]
        pair[1:width][token[2:width + 1] < 0] = NO_PAIR
        after = np.repeat(np.minimum(place + 1, width + 1), count, axis=1).ravel()
        before = np.repeat(np.maximum(place - 1, 0), count, axis=1).ravel()
        least, token, flat = pair, token.ravel(), pair.ravel()
        while True:
            best = least.min(axis=0)
            word = np.flatnonzero(best < NO_PAIR)
            if not len(word):
                break
            best = best[word]
            place = best & _PLACES
            here = place * count + word
            gone = after[here] * count + word
            following = after[gone]
            beyond = following * count + word
            prior = before[here]
            ahead = prior * count + word
            rank = best >> _PLACE_BITS
            token[here], token[gone], flat[gone] = rank, -1, NO_PAIR
            after[here], before[beyond] = following, place
            flat[here] = self._pair(rank, token[beyond], place)
            flat[ahead] = self._pair(token[ahead], rank, prior)
        token = token.reshape(width + 2, count).T
        stays = token >= 0
        ids = token[stays].astype("<u4").tobytes()
        ends = np.cumsum(stays.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]

    def _pair(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(rank, place) of pairs as one number; NO_PAIR where they do not merge, as with -1 for no token."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at] << _PLACE_BITS | place, NO_PAIR)

    def _merge_long(self, word: bytes) -> bytes:
        """One long match with a tree of Python numbers."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        token = [int(self.byte_ids[b]) for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = int(NO_PAIR)
        pairs, shift = self.pairs, width.bit_length() - 1

        def leaf(a, b):
            rank = pairs.get(token[a] << 32 | token[b]) if a >= 0 and b < n else None
            return none if rank is None else rank << shift | a

        tree = [none] * width + [leaf(i, i + 1) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at, value):
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] != none:
            here, rank = tree[1] & (width - 1), tree[1] >> shift
            gone = after[here]
            following = after[here] = after[gone]
            if following < n:
                before[following] = here
            token[here], token[gone] = rank, -1
            put(gone, none)
            put(here, leaf(here, following))
            if before[here] >= 0:
                put(before[here], leaf(before[here], here))
        return np.array([t for t in token if t >= 0], dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        found = []
        for at in range(0, len(ids), 100_000):
            part = ids[at:at + 100_000]
            if part.max() >= len(self.token_size) or not (size := self.token_size[part]).all():
                raise KeyError("an id without a token")
            ends = np.cumsum(size)
            found.append(self.token_bytes[np.repeat(self.token_begin[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(found)


@functools.lru_cache(maxsize=2)
def coder(rank_file: bytes, pattern: str) -> BytePairCoder:
    """One coder per worker process; ``rank_file``: lines of base64 token and rank."""
    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line.strip())}
    return BytePairCoder(ranks, pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with ``text`` replaced by ``n_tokens``, ``ids`` (binary, little-endian
    unsigned 32-bit; unless ``keep_ids`` is false), ``ids_sha256`` and
    ``decoded_sha256`` (of the bytes that the ids decode to).

    * Null text counts as empty: no ids.
    * No special tokens: their strings are ordinary text.
    * Every row is encoded on its own, repeated rows alike; input columns called
      like an output are replaced; an empty table gives an empty table.

    The rank file is read on the driver and broadcast; its size is that of the
    vocabulary, whatever the corpus.  There is no shuffle; a task holds one
    Arrow batch of texts and caches of bounded size.
    """
    spark = docs.sparkSession
    with open(rank_path, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    made = ["n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256"]
    out = {text, "n_tokens", "ids", "ids_sha256", "decoded_sha256"}
    rows = docs.select(whole_row(docs, out).alias("row"), F.col(quoted(text)).alias("text"))
    types = {"n_tokens": T.LongType(), "ids": T.BinaryType()}
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, types.get(c, T.StringType())) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(shipped.value, pattern)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    codes = use.encode([t or "" for t in part.column(1).to_pylist()])
                    cols = {"n_tokens": pa.array([len(c) // 4 for c in codes], pa.int64()),
                            "ids": pa.array(codes, pa.binary()) if keep_ids else None,
                            "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
                            "decoded_sha256": pa.array([hashlib.sha256(use.decode(c)).hexdigest() for c in codes], pa.string())}
                    yield pa.RecordBatch.from_arrays([part.column(0), *(cols[c] for c in made)], ["row", *made])
        finally:
            use.forget()  # the worker goes on to other stages

    return rows.mapInArrow(run, schema).select(*fields("row", docs, out), *made)


def decode(encoded: DataFrame, rank_path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with ``ids`` replaced by the decoded ``text``; bytes that are not UTF-8
    become U+FFFD, null ids null text."""
    with open(rank_path, "rb") as f:
        shipped = encoded.sparkSession.sparkContext.broadcast(f.read())
    out = {ids, text}
    rows = encoded.select(whole_row(encoded, out).alias("row"), F.col(quoted(ids)).alias("ids"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    kind = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(shipped.value, pattern)
        for batch in batches:
            texts = [None if c is None else use.decode(c).decode("utf-8", "replace") for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, kind)], ["row", "text"])

    return rows.mapInArrow(run, schema).select(*fields("row", encoded, out), F.col("text").alias(text))
