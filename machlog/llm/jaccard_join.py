"""N-gram Jaccard join by grouped prefixes.

A document is its set of word shingles.  Sets are ordered by one global order,
rare shingles first; two sets with a Jaccard similarity of t share a shingle in
their prefixes of n - ceil(t n) + 1.  Documents with equal sets form a class,
classes with equal prefix and size a group; group pairs that share a prefix
shingle and pass the length and position filters are expanded to classes and
verified on the whole sets.

What counts is which documents hang together, so pairs are verified in two
rounds.  First every group meets one pivot per shingle.  Then, with the
components known so far, only pairs from different components are left: for
each shingle the classes outside its most frequent component against all.  No
link between components is missed, and a large group of near copies costs a
pair per member instead of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.llm.common import FILTER_BITS, bits_of, cut, fields, hash128, quoted, whole_row
from machlog.llm.components import components

SHINGLE = 5
#: Similarity in percent.
PERCENT = 80
#: Counters that estimate how frequent a shingle is; 4 MB on every machine.  They
#: only order the shingles: any order gives the same result.
COUNTERS = 1 << 20
#: Counters that travel in one row.
LANES = 32
#: Rows of one shingle that meet at one pivot; a more frequent shingle has several.
SALT_ROWS = 50_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_hash = xxhash.xxh3_64_intdigest


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _rolled(word_hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of SHINGLE words."""
    n = len(word_hashes) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s = (s ^ word_hashes[k:n + k]) * _MIX[k]
        s ^= s >> np.uint64(29)
    return s


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of shingle hashes; the whole sequence of fewer words; nothing without words."""
    w = words(text)
    if len(w) < SHINGLE:
        return np.array([_hash(b" ".join(w), seed=len(w))] if w else [], np.uint64)
    return np.unique(_rolled(np.fromiter(map(_hash, w), np.uint64, len(w))))


def needed(n: int) -> int:
    """Shingles that a set of n must share with a similar one."""
    return -(-PERCENT * n // 100)


def frequencies(texts: DataFrame) -> np.ndarray:
    """Estimated number of occurrences of the shingles of each counter, over all texts (one column)."""
    names = [f"c{i}" for i in range(LANES)]
    schema = T.StructType([T.StructField("lane", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                w = words(text)
                if len(w) >= SHINGLE:
                    s = _rolled(np.fromiter(map(_hash, w), np.uint64, len(w)))
                    held.append((s & np.uint64(COUNTERS - 1)).astype(np.int64))
                    size += len(s)
                    if size > 1_000_000:
                        total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        grid = total.reshape(-1, LANES)
        lanes = np.flatnonzero(grid.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(lanes, pa.int32()), *(pa.array(grid[lanes, i]) for i in range(LANES))], ["lane", *names])

    summed = texts.mapInArrow(run, schema).groupBy("lane").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    out = np.zeros((COUNTERS // LANES, LANES), np.int64)
    out[summed["lane"].to_numpy(np.int64)] = summed[names].to_numpy(np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def _features(docs: DataFrame, doc_id: str, text: str, counts) -> DataFrame:
    """row, id, key (a hash of id and text), n, digest (of the set), head (of size and prefix), prefix, salts."""
    rows = docs.select(whole_row(docs, {text}).alias("row"), F.col(quoted(doc_id)).alias("id"), _row_key(doc_id, text).alias("key"),
                       F.col(quoted(text)).alias("text"))
    schema = T.StructType([*(rows.schema[c] for c in ("row", "id", "key")), T.StructField("n", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("head", T.BinaryType()),
                           T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("salts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [_prefix(shingles(t), frequent) for t in part.column(3).to_pylist()]
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *(pa.array(c, k) for c, k in zip(zip(*made), kinds))],
                    ["row", "id", "key", "n", "digest", "head", "prefix", "salts"])

    return rows.mapInArrow(run, schema)


def _row_key(doc_id: str, text: str) -> Column:
    a, b = hash128(F.col(quoted(doc_id)), F.col(quoted(text)))
    return F.struct(a.alias("a"), b.alias("b"))


def _prefix(s: np.ndarray, frequent: np.ndarray) -> tuple:
    n = len(s)
    if not n:
        return 0, None, None, [], []
    digest = xxhash.xxh3_128_digest(s.tobytes())
    count = frequent[(s & np.uint64(len(frequent) - 1)).astype(np.int64)]
    first = np.lexsort((s, count))[:n - needed(n) + 1]
    prefix = s[first]
    head = xxhash.xxh3_128_digest(n.to_bytes(8, "little") + prefix.tobytes())
    parts = 1 + count[first].astype(np.int64) // SALT_ROWS
    salts = np.where(parts > 1, 1 + int.from_bytes(digest[:4], "little") % parts, 0)
    return n, digest, head, prefix.view(np.int64), salts.astype(np.int32)


def _could_link(a: str, b: str) -> Column:
    """Length and position filters for two rows that share a prefix shingle."""
    na, nb, pa_, pb = (F.col(c) for c in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT)
            & (F.least(na - pa_, nb - pb) * (100 + PERCENT) >= (na + nb) * PERCENT))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_shingles``, ``component_id`` (smallest id reachable
    by links, its own included) and ``row_key`` (a hash of id and text).

    A document's set are its distinct runs of SHINGLE words (A-Z lower-cased,
    split at ASCII white space); with fewer words the whole sequence.  Two
    documents link when 100 * intersection >= PERCENT * union.

    * Null, empty and blank texts have an empty set and link with nothing.
    * Null ids take part; ``component_id`` is null only if every id of the component is.
    * Repeated rows and equal sets are one class and cost one row; every row comes back.
    * Input columns called like an output are replaced; an empty table gives an empty table.

    What reaches the driver has a fixed size: the counters and the filter's bits.
    """
    return _joined(docs, doc_id, text).select(
        *fields("row", docs, {text, "n_shingles", "component_id", "row_key"}), "n_shingles", "component_id", "row_key")


def _joined(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(frequencies(docs.select(F.col(quoted(text)).alias("text"))))
    rows = cut(_features(docs, doc_id, text, counts), "shingle-prefixes")
    classes = cut(rows.filter("n > 0").groupBy("digest", "head", "n")
                  .agg(F.min("key").alias("key"), F.min("id").alias("first_id")), "shingle-classes")
    members = cut(_members(classes), "shingle-groups")
    index = cut(_index(rows.filter("n > 0")), "shingle-index")

    pairs = cut(_plausible(_star_pairs(index, members), rows), "star-pairs")
    links = cut(_verified(pairs, classes, docs, doc_id, text), "star-links")
    known = cut(components(links), "star-components")

    pairs = cut(_plausible(_cross_pairs(index, members, known).join(pairs, ["a", "b"], "left_anti"), rows), "cross-pairs")
    more = _verified(pairs, classes, docs, doc_id, text)
    final = components(known.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))

    placed = cut(classes.select("digest", "first_id").join(final, F.col("digest") == F.col("node"), "left").select(
        "digest", "first_id", F.coalesce("comp", "digest").alias("comp")), "component-classes")
    # Written, so that the next two joins can split a component of very many classes and a class of very many copies.
    smallest = cut(placed.groupBy("comp").agg(F.min("first_id").alias("component_id")), "component-least")
    ids = cut(placed.join(smallest, "comp").select("digest", "component_id"), "component-ids")
    return rows.select("row", "id", F.col("key").alias("row_key"), F.col("n").alias("n_shingles"), F.col("digest").alias("of")).join(
        ids, F.col("of") == F.col("digest"), "left").select(
        "row", "id", "row_key", "n_shingles",
        F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _members(classes: DataFrame) -> DataFrame:
    """lead, digest: every class with the number of its group, a hash of size and prefix.
    Groups that share a number would only add pairs to verify."""
    return classes.select(_lead().alias("lead"), "digest")


def _lead() -> Column:
    return F.xxhash64("head")


def _index(rows: DataFrame) -> DataFrame:
    """token, salt, lead, n, pos and the pivot of the token (and salt): prefix
    shingles of groups, those of one class alone left out.  A group of several
    classes keeps its first shingle, at which they meet each other."""
    groups = rows.groupBy("head", "n").agg(F.first("prefix").alias("prefix"), F.first("salts").alias("salts"),
                                           (F.min("digest") != F.max("digest")).alias("several")).withColumn("lead", _lead())
    each = groups.select("lead", "n", "several", F.posexplode(F.arrays_zip("prefix", "salts")).alias("pos", "x")).select(
        F.col("x.prefix").alias("token"), F.col("x.salts").alias("salt"), "lead", F.col("n").cast("int").alias("n"), "pos",
        (F.col("several") & (F.col("pos") == 0)).alias("meets"))
    one = Window.partitionBy("token", "salt")
    return (each.withColumn("rows", F.count(F.lit(1)).over(one))
            .withColumn("pivot", F.min(F.struct("pos", "lead", "n")).over(one))
            .filter("rows > 1 or salt > 0 or meets").drop("rows", "meets"))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _star_pairs(index: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with their pivots, pivots of the parts of one token, classes with the least of their group."""
    flat = index.select("lead", F.col("pivot.lead").alias("other"), F.col("n").alias("l_n"), F.col("pos").alias("l_pos"),
                        F.col("pivot.n").alias("p_n"), F.col("pivot.pos").alias("p_pos"))
    near = flat.filter("lead <> other").filter(_could_link("l_", "p_")).select(*_pair(F.col("lead"), F.col("other")))
    parts = index.filter("salt > 0").select("token", "pivot").distinct()
    centre = parts.groupBy("token").agg(F.min("pivot").alias("centre"))
    between = (parts.join(centre, "token").filter("pivot.lead <> centre.lead")
               .select(*_pair(F.col("pivot.lead"), F.col("centre.lead"))))
    least = members.groupBy("lead").agg(F.min("digest").alias("least"), F.count(F.lit(1)).alias("classes"))
    one_a, one_b = (least.select(F.col("lead").alias(c), F.col("least").alias(f"{c}_least")) for c in ("a", "b"))
    groups = near.unionByName(between).distinct().join(one_a, "a").join(one_b, "b").select(*_pair(F.col("a_least"), F.col("b_least")))
    several = least.filter("classes > 1").select(F.col("lead").alias("of"), "least")
    inside = (members.join(several, F.col("lead") == F.col("of")).filter("least <> digest")
              .select(*_pair(F.col("least"), F.col("digest"))))
    return groups.unionByName(inside)


def _cross_pairs(index: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """Classes that share a prefix shingle and lie in different components."""
    m = members.select(F.col("lead").alias("m_lead"), F.col("digest").alias("m_digest"))
    own = m.join(known, F.col("m_digest") == F.col("node"), "left").select("m_lead", "m_digest", F.coalesce("comp", "m_digest").alias("comp"))
    expanded = index.select("token", "lead", "n", "pos").join(own, F.col("lead") == F.col("m_lead"))
    placed = cut(expanded.select("token", F.col("m_digest").alias("digest"), "n", "pos", "comp"), "shingle-components")
    most = (placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("rows", "comp")).alias("most"))
            .filter("comps > 1").select("token", F.col("most.comp").alias("main")))
    most = cut(most, "shingle-main")
    # Only shingles of several components go on; both sides of their join are split by size before the shuffle.
    shared = cut(placed.join(most, "token").withColumn("band", _band(F.col("n"))), "shingle-shared")
    outside = shared.filter("comp <> main").select("token", "band", F.col("digest").alias("o_digest"), F.col("n").alias("o_n"),
                                                   F.col("pos").alias("o_pos"), F.col("comp").alias("o_comp"))
    around = shared.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
                           "digest", F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), "comp")
    met = outside.join(around, ["token", "band"]).filter(F.col("o_comp") != F.col("comp"))
    return met.filter(_could_link("o_", "a_")).select(*_pair(F.col("o_digest"), F.col("digest"))).distinct()


def _band(n: Column) -> Column:
    """Band of a set's size: sizes that may link lie in one band or in neighbours, as a band's
    ends differ by more than 100 / PERCENT (the margin outweighs rounding)."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(1.01 * 100 / PERCENT))).cast("int")


def _plausible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose whole prefixes allow the similarity.

    Shared shingles up to the earlier end of the two prefixes lie in both; beyond
    it one set has needed(n) - 1 left.  So the overlap is at most the shared part
    of the prefixes and the larger of those rests.
    """
    pairs = cut(pairs, "pairs")
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "wanted")
    shipped = bits_of(wanted.select(F.xxhash64("digest").alias("key")))

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(shipped.value).astype(bool)
        for batch in batches:
            yield batch.select([1, 2, 3]).filter(pa.array(passes[batch.column(0).to_numpy()]))

    kept = (rows.filter("n > 0").select(F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS)).alias("bit"), "digest", "n", "prefix")
            .mapInArrow(let_through, "digest binary, n bigint, prefix array<bigint>"))
    prefixes = cut(kept.join(wanted, "digest", "left_semi").groupBy("digest", "n").agg(F.first("prefix").alias("prefix")), "prefixes")
    a, b = (prefixes.select(F.col("digest").alias(c), F.col("n").alias(f"{c}_n"), F.col("prefix").alias(f"{c}_prefix")) for c in "ab")
    shared = F.size(F.array_intersect("a_prefix", "b_prefix"))
    rest = F.ceil(F.greatest("a_n", "b_n") * PERCENT / 100) - 1
    fits = (shared + rest) * (100 + PERCENT) >= (F.col("a_n") + F.col("b_n")) * PERCENT
    close = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * PERCENT
    return pairs.join(a, "a").join(b, "b").filter(close & fits).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(classes.select("digest", "key"), "digest")
    shipped = bits_of(wanted.select(F.col("key.a").alias("key")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(shipped.value).astype(bool)
        for batch in batches:
            on = np.flatnonzero(passes[batch.column(0).to_numpy()])
            for at in range(0, len(on), 500):
                sets = [shingles(t) for t in batch.column(1).take(pa.array(on[at:at + 500])).to_pylist()]
                sets = [s.tobytes() for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["digest", "set"])

    keyed = docs.select(F.pmod(_row_key(doc_id, text)["a"], F.lit(FILTER_BITS)).alias("bit"), F.col(quoted(text)).alias("text"))
    found = keyed.mapInArrow(read, "digest binary, set binary").join(wanted.select("digest"), "digest", "left_semi")
    sets = cut(found.groupBy("digest").agg(F.first("set").alias("set")), "shingle-sets")
    left = sets.select(F.col("digest").alias("a"), F.col("set").alias("a_set"))
    right = sets.select(F.col("digest").alias("b"), F.col("set").alias("b_set"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set")
            .mapInArrow(check, "a binary, b binary"))


def _similar(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def link_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_shingles``, ``class_key`` (equal for equal sets)
    and ``n_links``, the number of other rows that link with the row.

    The whole join: every pair of classes that share a prefix shingle and pass the
    filters is verified, also within a component, so a group of m unlike near copies
    costs m * (m - 1) / 2 pairs; ``join`` needs about m.  Copies are not expanded: a
    row links with the rest of its class and with the whole of each linked class.

    * Null, empty and blank texts have an empty set, no class and no links.
    * Repeated rows link with one another.  Input columns called like an output are
      replaced; an empty table gives an empty table.
    """
    out = ["n_shingles", "class_key", "n_links"]
    counts = docs.sparkSession.sparkContext.broadcast(frequencies(docs.select(F.col(quoted(text)).alias("text"))))
    rows = cut(_features(docs, doc_id, text, counts), "shingle-prefixes")
    classes = cut(rows.filter("n > 0").groupBy("digest", "head", "n")
                  .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")), "shingle-classes")
    pairs = cut(class_pairs(rows, classes, docs, doc_id, text), "class-pairs")
    # A class and the classes it links with, its own copies but one first.
    size = classes.select(F.col("digest").alias("other"), "copies")
    ends = pairs.select(F.col("a").alias("digest"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("digest"), F.col("a").alias("other")))
    met = classes.select("digest", (F.col("copies") - 1).alias("copies")).unionByName(
        ends.join(size, "other").select("digest", "copies"))
    linked = cut(met.groupBy("digest").agg(F.sum("copies").alias("n_links")), "class-links")
    found = rows.select("row", "n", F.col("digest").alias("of")).join(linked, F.col("of") == F.col("digest"), "left")
    return found.select(*fields("row", docs, {text, *out}), F.col("n").alias("n_shingles"), F.col("of").alias("class_key"),
                        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def class_pairs(rows: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every verified pair (a, b), a < b, of classes of different sets.

    Groups meet at (shingle, bits of the size): sizes that may link differ by at
    most one bit, so a common shingle is split by size before the shuffle.
    """
    members = cut(_members(classes), "shingle-groups")
    each = _index(rows.filter("n > 0")).select("token", "lead", "n", "pos", F.length(F.bin("n")).alias("bits"))
    each = cut(each, "shingle-index")
    left = each.select("token", "bits", *(F.col(c).alias(f"l_{c}") for c in ("lead", "n", "pos", "bits")))
    right = each.select("token", F.explode(F.array("bits", F.col("bits") + 1)).alias("bits"),
                        *(F.col(c).alias(f"r_{c}") for c in ("lead", "n", "pos", "bits")))
    once = (F.col("l_lead") < F.col("r_lead")) | (F.col("l_bits") != F.col("r_bits"))
    groups = (left.join(right, ["token", "bits"]).filter(once & _could_link("l_", "r_"))
              .select(*_pair(F.col("l_lead"), F.col("r_lead"))).distinct())
    a, b = (members.select(F.col("lead").alias(c), F.col("digest").alias(f"{c}_digest")) for c in "ab")
    between = groups.join(a, "a").join(b, "b").select(*_pair(F.col("a_digest"), F.col("b_digest")))
    inside = a.join(b, (F.col("a") == F.col("b")) & (F.col("a_digest") < F.col("b_digest"))).select(
        F.col("a_digest").alias("a"), F.col("b_digest").alias("b"))
    close = cut(_plausible(between.unionByName(inside), rows), "plausible-pairs")
    return _verified(close, classes, docs, doc_id, text)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, all columns as they
    are.  Rows without words, or whose component has no id, all stay; of rows that share
    the smallest id the one with the least hash of id and text stays (rows that repeat
    both stay together: exact dedup comes first)."""
    found = _joined(docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text")), "id", "text")
    first = found.filter(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = first.filter("n_shingles > 0 and id is not null").groupBy("id").agg(F.min("row_key").alias("row_key")).select("row_key")
    loose = first.filter("n_shingles = 0 or id is null").select("row_key")
    keys = chosen.unionByName(loose).select(F.col("row_key.a").alias("ka"), F.col("row_key.b").alias("kb"))
    own = (c.alias(n) for c, n in zip(hash128(F.col(quoted(doc_id)), F.col(quoted(text))), ("a", "b")))
    rows = docs.select(whole_row(docs).alias("row"), *own)
    kept = rows.join(keys, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left_semi")
    return kept.select(*fields("row", docs))
