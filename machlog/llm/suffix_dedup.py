"""Suffix-array dedup: bytes covered by a string of fixed length that starts
anywhere else go.

Sorting every suffix of a large corpus by its leading bytes would move each byte
hundreds of times, so suffixes travel in runs.  Each window of ``length`` bytes
has an anchor: its rarest-looking ``k``-gram (least hash, leftmost).  The anchor
depends on the window's bytes alone, so equal windows have equal anchors at
equal places.  Neighbouring windows with one anchor form a run, shipped as one
string of at most ``2 * length - k`` bytes.

1. Runs whose anchor occurs once in the corpus hold no repeated window.
2. Runs with equal bytes repeat as a whole; one of them stands for all.
3. Different runs with a common anchor may share some windows.  They are
   range-partitioned by their leading tokens, the ``k`` bytes from the anchor on,
   at sampled splitters.  In its bucket every run is opened into its suffixes,
   which are sorted by multikey quicksort on 8-byte tokens; neighbours in that
   order that agree on ``length`` bytes are repeats.
4. An anchor with more runs than a bucket holds would straddle buckets.  Its
   suffixes are dealt by a digest of their ``length`` bytes and compared across
   buckets by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from machlog.llm.common import cut, fields, hash128, quoted, whole_row

LENGTH = 400
#: Runs of one anchor that are sorted in one bucket.
BUCKET_RUNS = 4000
#: Bytes of runs that a bucket sorts at a time (whole anchors only).
SORT_BYTES = 3_000_000
#: Windows looked at together.
STRETCH = 1 << 18
_PLACE_BITS = np.uint64(20)
_MULTIPLIER = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1


def anchor_size(length: int) -> int:
    """The greatest power of two up to a third of the length."""
    return 1 << ((length // 3).bit_length() - 1)


# --- anchors and runs ---------------------------------------------------------

def _byte_values() -> np.ndarray:
    """A 64-bit value for every byte (a fixed mixing of its number)."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(_MULTIPLIER)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_VALUES = _byte_values()


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from every place on (``k`` a power of two), by doubling."""
    h, width, power = _VALUES[data], 1, _MULTIPLIER
    while width < k:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power & _U64
        width *= 2
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    n, reach = len(x) - width + 1, 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:n], x[width - reach:width - reach + n])


def runs_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """begin, windows, anchor place and anchor hash of all runs of the documents
    that lie in ``data`` one after another, up to ``ends``."""
    k = anchor_size(length)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= length
    first, beyond = starts[long], ends[long] - length + 1  # places where windows may begin
    found = [[] for _ in range(4)]
    total = len(data) - length + 1
    for at in range(0, max(total, 0), STRETCH):
        stop = min(at + STRETCH, total)
        hashes = gram_hashes(data[at:stop + length - 1], k)
        places = np.arange(len(hashes), dtype=np.uint64)
        least = sliding_least(hashes >> _PLACE_BITS << _PLACE_BITS | places, length - k + 1)
        anchor = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        low, high = np.searchsorted(beyond, at, "right"), np.searchsorted(first, stop, "left")
        breaks = np.unique(np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1,
                                           np.clip(first[low:high] - at, 0, stop - at), np.clip(beyond[low:high] - at, 0, stop - at),
                                           [stop - at]]))
        begin, end = breaks[:-1], breaks[1:]
        doc = np.searchsorted(beyond, begin + at, "right")
        inside = doc < len(first)
        inside[inside] = first[doc[inside]] <= begin[inside] + at
        begin, end = begin[inside], end[inside]
        for into, x in zip(found, (begin + at, end - begin, anchor[begin] + at, hashes[anchor[begin]].view(np.int64))):
            into.append(x)
    return tuple(np.concatenate(x) if x else np.array([], np.int64) for x in found)


_RUN = "k1 bigint, k2 bigint, pos bigint, size int, off int, anchor bigint, s1 bigint, s2 bigint, n bigint"
_RUN_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int64()), ("size", pa.int32()), ("off", pa.int32()),
                        ("anchor", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64())])


def runs(texts: DataFrame, length: int) -> DataFrame:
    """The runs of every text (k1, k2, body): place, size, anchor's offset and
    hash, digest (s1, s2) and the number ``n`` of the text's runs with these bytes.

    Runs that repeat inside their text are listed once; where the others lie is
    given by rows without an anchor (joined stretches), so that a periodic text,
    with a run per byte, stays short.
    """
    def rows(keys: list, body_ends: np.ndarray, buffer: bytes) -> Iterator[tuple]:
        data = np.frombuffer(buffer, np.uint8)
        begin, windows, anchor, hashes = runs_of(data, body_ends, length)
        doc = np.searchsorted(body_ends, begin, "right")
        starts = np.concatenate([[0], body_ends[:-1]])
        digest = lambda b, s: blake2b(buffer[b:b + s], digest_size=16).digest()
        sizes = windows + length - 1
        digests = np.frombuffer(b"".join(map(digest, begin.tolist(), sizes.tolist())), np.int64).reshape(-1, 2)
        # Equal runs of one text next to each other, the first of them first.
        order = np.lexsort((begin, digests[:, 1], digests[:, 0], doc))
        same = np.zeros(len(order), np.bool_)
        if len(order):
            a, b = order[1:], order[:-1]
            same[1:] = (doc[a] == doc[b]) & (digests[a] == digests[b]).all(axis=1)
        firsts = np.flatnonzero(~same)
        times = np.diff(np.append(firsts, len(order)))
        head = order[firsts]
        yield from zip(*(keys[c][doc[head]].tolist() for c in (0, 1)), (begin - starts[doc])[head].tolist(), sizes[head].tolist(),
                       (anchor - begin)[head].tolist(), hashes[head].tolist(), digests[head, 0].tolist(), digests[head, 1].tolist(),
                       times.tolist())
        again = np.sort(order[same])
        left, right = begin[again], begin[again] + sizes[again]
        if len(again):
            # Stretches that touch, in one text, are one.
            new = np.ones(len(again), np.bool_)
            new[1:] = (left[1:] > right[:-1]) | (doc[again][1:] != doc[again][:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(again)) - 1
            d = doc[again][at]
            for k1, k2, b, e in zip(keys[0][d].tolist(), keys[1][d].tolist(), (left[at] - starts[d]).tolist(), (right[last] - starts[d]).tolist()):
                for cut_at in range(b, e, 1 << 30):
                    yield k1, k2, cut_at, min(e - cut_at, 1 << 30), None, None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            keys = [batch.column(c).to_numpy() for c in (0, 1)]
            # A few documents together; a long one alone.
            begin = gathered = 0
            for i, body in enumerate(bodies):
                gathered += len(body)
                if gathered >= 4 * STRETCH or i + 1 == len(bodies):
                    part = bodies[begin:i + 1]
                    made = list(rows([k[begin:i + 1] for k in keys], np.cumsum([len(x) for x in part]), b"".join(part)))
                    for at in range(0, len(made), 50_000):
                        cols = zip(*made[at:at + 50_000])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _RUN_ARROW.types)], schema=_RUN_ARROW)
                    begin, gathered = i + 1, 0

    return texts.mapInArrow(run, _RUN)


# --- sorting suffixes -----------------------------------------------------------

def tokens_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a big-endian number (zeros beyond the end)."""
    x = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] << np.uint64(8 * width) | x[width:]
    return x


def multikey_sort(tokens: np.ndarray, suffixes: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes within their groups by ``length`` leading bytes.

    Three-way quicksort on one token at a time: a range is split at its pivot's
    token; the equal part goes on with the next token, the others with the same.
    All ranges take their step together, as numpy arrays.  Returns the order and,
    for every place in it, whether a neighbour in its group agrees on all bytes.
    """
    depths = np.array([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])])
    order = np.argsort(groups, kind="stable")
    twin = np.zeros(len(order), np.bool_)
    # Unsettled ranges: their first place, size and depth.
    ids = groups[order]
    begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(order) else np.array([], np.int64)
    size = np.diff(np.append(begin, len(order)))
    depth = np.zeros(len(begin), np.int64)
    while True:
        live = size > 1
        begin, size, depth = begin[live], size[live], depth[live]
        done = depth == len(depths)
        if done.any():
            twin[_spread(begin[done], size[done])] = True
            begin, size, depth = begin[~done], size[~done], depth[~done]
        if not len(begin):
            return order, twin
        places = _spread(begin, size)
        of = np.repeat(np.arange(len(begin)), size)
        here = order[places]
        token = tokens[suffixes[here] + depths[depth][of]]
        pivot = token[np.cumsum(size) - size + size // 2]
        side = np.where(token < pivot[of], 0, np.where(token == pivot[of], 1, 2))
        order[places] = here[np.argsort(of * 3 + side, kind="stable")]
        count = np.bincount(of * 3 + side, minlength=3 * len(begin)).reshape(-1, 3)
        offsets = np.cumsum(count, axis=1) - count
        begin = (begin[:, None] + offsets).ravel()
        size = count.ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _joined(rows: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(k1, k2, begin, end) sorted by key and begin, those that touch as one."""
    last = None
    for k1, k2, b, e in rows:
        if last and last[:2] == (k1, k2) and b <= last[3]:
            last = (k1, k2, last[2], max(e, last[3]))
        else:
            if last:
                yield last
            last = (k1, k2, b, e)
    if last:
        yield last


_SPAN = "k1 bigint, k2 bigint, begin bigint, stop bigint"


def _span_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "begin", "stop")])
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)


def sorted_repeats(shipped: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows in the judged runs, for anchors that fit a bucket.

    Rows with one anchor have the same ``head``, so none of them straddles the
    sampled splitters of the range partitioning."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield from _span_batches(list(_joined(repeats(held))))
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        yield from _span_batches(list(_joined(repeats(held))))

    def repeats(held: list[tuple]) -> list[tuple[int, int, int, int]]:
        if not held:
            return []
        data = np.frombuffer(b"".join(r[1] for r in held), np.uint8)
        heads = {h: i for i, h in enumerate(dict.fromkeys(r[0] for r in held))}
        head = np.array([heads[r[0]] for r in held])
        sizes, off = np.array([len(r[1]) for r in held]), np.array([r[2] for r in held])
        starts = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        suffixes = _spread(starts, windows)
        row = np.repeat(np.arange(len(held)), windows)
        nth = suffixes - starts[row]
        # Equal windows have their anchor at one place.
        groups = head[row] * (2 * length) + off[row] - nth
        order, twin = multikey_sort(tokens_of(data), suffixes, groups, length)
        hit = order[twin]
        hit = hit[np.array([r[6] for r in held])[row[hit]]]
        hit.sort()
        at = [held[i] for i in row[hit].tolist()]
        found = [(r[3], r[4], r[5] + n, r[5] + n + length) for r, n in zip(at, nth[hit].tolist())]
        found.sort()
        return found

    ranged = shipped.select("head", "body", "off", "k1", "k2", "pos", "judged").repartitionByRange("head").sortWithinPartitions("head")
    return ranged.mapInArrow(run, _SPAN)


def straddling_repeats(shipped: DataFrame, length: int) -> DataFrame:
    """The same for anchors with more runs than a bucket holds: suffixes are dealt
    by the digest of their bytes, counted, and the judged ones that repeat come back."""
    schema = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "k1", "k2", "begin")] + [("judged", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, k1, k2, pos, judged in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(body) - length + 1
                w = np.frombuffer(b"".join(blake2b(body[i:i + length], digest_size=16).digest() for i in range(n)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[:, 0]), pa.array(w[:, 1]), *(pa.array(np.full(n, k, np.int64)) for k in (k1, k2)),
                     pa.array(pos + np.arange(n)), pa.array(np.full(n, judged))], schema=schema)

    windows = cut(shipped.select("body", "k1", "k2", "pos", "judged")
                  .mapInArrow(run, "w1 bigint, w2 bigint, k1 bigint, k2 bigint, begin bigint, judged boolean"), "suffix-windows")
    twice = cut(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "suffix-twice")
    return windows.filter("judged").join(twice, ["w1", "w2"]).select("k1", "k2", "begin", (F.col("begin") + length).alias("stop"))


# --- the operator ----------------------------------------------------------------

def drop_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` without ``text``, with ``n_bytes``, ``n_removed``, ``n_spans`` (joined
    removed stretches), ``spans`` (begin, stop of each) and ``kept_sha256``, the
    SHA-256 of the remaining bytes.

    Texts are UTF-8 bytes.  Every byte covered by a string of ``length`` bytes that
    starts anywhere else as well, in another row or the same one, goes; strings are
    judged on the input and never cross rows.

    * A null text has no bytes; texts shorter than ``length`` stay as they are.
    * Rows with equal texts of ``length`` bytes or more lose everything, all of them.
    * Repeated rows count each; no id is read; input columns called like an output
      are replaced; an empty table gives an empty one.
    * Long texts are read in stretches; a periodic text is short after its own repeats.

    Rows travel by the digest of their text.  Copies are counted before they are
    shuffled, so a group that holds a third of all rows is one text per task.
    """
    if length < 24:
        raise ValueError("length must be 24 or more")
    body = F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b""))
    out = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
    rest = docs.drop(text, *out)
    keyed = docs.select(whole_row(rest).alias("row"), F.sha2(body, 256).alias("sha"), body.alias("body"))
    keyed = keyed.withColumns(dict(zip(("k1", "k2"), hash128(F.col("sha")))))
    long = keyed.filter(F.octet_length("body") >= length).select("k1", "k2", "body")

    all_runs = cut(runs(long, length), "suffix-runs")
    found = all_runs.filter("anchor is not null")
    common = found.groupBy("anchor").agg(F.sum("n").alias("all")).filter("all > 1").select("anchor")
    met = cut(found.join(common, "anchor", "left_semi"), "suffix-met")
    shape = ["anchor", "s1", "s2"]
    classes = cut(met.groupBy(*shape).agg(F.sum("n").alias("copies"), F.min(F.struct("k1", "k2", "pos")).alias("first")), "suffix-classes")
    # Written, so that both sides of the join are plain exchanges: only then can a common anchor be split.
    anchors = cut(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("copies") == 1, 1)).alias("single"))
                  .filter("kinds > 1"), "suffix-anchors")
    classes = classes.join(anchors, "anchor", "left").filter("copies > 1 or kinds > 1")
    classes = cut(classes.select(*shape, "copies", "first", F.when(F.col("single") > 0, F.col("kinds")).otherwise(F.lit(1)).alias("kinds")),
                  "suffix-shared")
    # What a text needs to be known for: whole runs that go, and runs to be sorted (of equal ones the first).
    known = met.join(classes, shape).select(
        "k1", "k2", "pos", "size", "off", (F.col("copies") > 1).alias("gone"),
        F.when(F.col("first") == F.struct("k1", "k2", "pos"), F.col("kinds")).otherwise(F.lit(1).cast("long")).alias("kinds"))
    known = known.unionByName(all_runs.filter("anchor is null").select("k1", "k2", "pos", "size", F.lit(0).alias("off"),
                                                                       F.lit(True).alias("gone"), F.lit(1).cast("long").alias("kinds")))
    needs = known.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "size", "off", "gone", "kinds")).alias("runs"))
    texts = long.groupBy("k1", "k2").agg(F.first("body").alias("body"))
    held = cut(texts.join(needs, ["k1", "k2"]), "suffix-texts")

    shipped = held.select("k1", "k2", "body", F.explode(F.filter("runs", lambda r: r["kinds"] > 1)).alias("r"))
    piece = lambda at, n: F.substring("body", at + 1, n)
    shipped = cut(shipped.select("k1", "k2", F.col("r.pos").alias("pos"), F.col("r.off").alias("off"), F.col("r.kinds").alias("kinds"),
                                 (~F.col("r.gone")).alias("judged"), piece(F.col("r.pos").cast("int"), F.col("r.size")).alias("body"),
                                 piece((F.col("r.pos") + F.col("r.off")).cast("int"), F.lit(anchor_size(length))).alias("head")),
                  "suffix-shipped")
    spans = (sorted_repeats(shipped.filter(F.col("kinds") <= BUCKET_RUNS), length)
             .unionByName(straddling_repeats(shipped.filter(F.col("kinds") > BUCKET_RUNS), length)))
    per = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "stop")).alias("parts"))
    whole = F.transform(F.filter("runs", lambda r: r["gone"]), lambda r: F.struct(r["pos"].alias("begin"), (r["pos"] + r["size"]).alias("stop")))
    parts = F.concat(whole, F.coalesce("parts", F.expr("cast(array() as array<struct<begin:bigint,stop:bigint>>)")))
    cleaned = _without(held.join(per, ["k1", "k2"], "left").select("k1", "k2", "body", parts.alias("parts")))
    rows = keyed.select("row", "sha", F.octet_length("body").cast("long").alias("n_bytes"), "k1", "k2")
    done = rows.join(cut(cleaned, "suffix-cleaned"), ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    return done.select(*fields("row", rest), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
                       F.coalesce(F.size("spans").cast("long"), zero).alias("n_spans"),
                       F.coalesce("spans", F.expr("cast(array() as array<struct<begin:bigint,stop:bigint>>)")).alias("spans"),
                       F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def _without(texts: DataFrame) -> DataFrame:
    """k1, k2, n_removed, spans and the digest of what is left of each text."""
    span = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                k1, k2, bodies, lists = (c.to_pylist() for c in part.columns)
                removed, spans, shas = [], [], []
                for body, parts in zip(bodies, lists):
                    merged = [(b, e) for _, _, b, e in _joined(sorted((0, 0, p["begin"], p["stop"]) for p in parts))]
                    kept, at = sha256(), 0
                    for b, e in merged:
                        kept.update(body[at:b])
                        at = e
                    kept.update(body[at:])
                    removed.append(sum(e - b for b, e in merged))
                    spans.append([{"begin": b, "stop": e} for b, e in merged])
                    shas.append(kept.hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(spans, span), pa.array(shas, pa.string())],
                                                 ["k1", "k2", "n_removed", "spans", "kept_sha"])

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, n_removed bigint, spans array<struct<begin:bigint,stop:bigint>>, kept_sha string")
