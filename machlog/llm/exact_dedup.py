"""Exact dedup of an incoming batch against an immutable snapshot.

The snapshot's digests are dealt into buckets and each bucket gets a static
3-wise binary-fuse filter (built once, a few bits over a byte per digest).
Incoming digests are screened by their bucket's filter: what it rejects is
certainly new, what it passes meets the snapshot's exact bucket by digest and
the texts are compared.  Duplicates inside the batch are grouped on their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from machlog.llm.common import FILTER_BITS, bits_of, cut, fields, hash128, quoted, whole_row

#: Distinct digests a bucket holds on average; the memory of a task depends on nothing else.
BUCKET_KEYS = 50_000


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


# --- the filter -------------------------------------------------------------

def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class FuseFilter:
    """Static 3-wise binary-fuse filter over distinct 64-bit keys with one-byte fingerprints.

    A key's three slots lie in three neighbouring segments of the table; its
    fingerprint is the XOR of the three bytes.  No false negatives, about
    1/256 false positives.
    """

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def _slots(h: np.ndarray, segment: int, count: int) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = max(len(keys), 2)
        segment = 1 << min(18, max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
        slots = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n)) * n
        count = max(1, math.ceil(slots / segment) - 2)
        seed = 1
        while True:
            h = _mixed(keys, seed)
            at = cls._slots(h, segment, count)
            peeled = cls._peel(at, (count + 2) * segment)
            if peeled is not None:
                break
            seed += 1
            if seed % 8 == 0:  # unlucky sizes: a little more room
                count += 1 + count // 8
        table = np.zeros((count + 2) * segment, dtype=np.uint8)
        prints = cls._prints(h)
        for key, slot in reversed(peeled):  # rounds in reverse: a round's own slots are still empty
            value = prints[key] ^ table[at[0, key]] ^ table[at[1, key]] ^ table[at[2, key]]
            table[slot] = value
        return cls(seed, segment, count, table)

    @staticmethod
    def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, slots): every key that is alone in a slot goes, all of a round at once."""
        n = at.shape[1]
        degree = np.bincount(at.ravel(), minlength=size)
        # XOR of the key numbers in a slot; the remaining one where the degree is 1.
        inside = np.zeros(size, dtype=np.int64)
        numbers = np.arange(n)
        for row in at:
            np.bitwise_xor.at(inside, row, numbers)
        rounds, left = [], n
        slots = np.flatnonzero(degree == 1)
        while len(slots):
            keys, first = np.unique(inside[slots], return_index=True)
            slots = slots[first]
            # A key must not read a slot that a key of the same round fills.
            rounds.append((keys, slots))
            left -= len(keys)
            touched = at[:, keys].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(inside, touched, np.tile(keys, 3))
            touched = np.unique(touched)
            slots = touched[degree[touched] == 1]
        return rounds if left == 0 else None

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], dtype=np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(np.asarray(keys, dtype=np.uint64), self.seed)
        a, b, c = self._slots(h, self.segment, self.count)
        return self._prints(h) == (self.table[a] ^ self.table[b] ^ self.table[c])

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], dtype="<u4").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        seed, segment, count = (int(x) for x in np.frombuffer(data, "<u4", 3))
        return cls(seed, segment, count, np.frombuffer(data, np.uint8, offset=12))


# --- the operator -----------------------------------------------------------

def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, sha (of the normalised text), key (64 bits of it), n: repeated rows are counted, not kept apart."""
    sha = F.sha2(normalised(F.col(quoted(text))), 256)
    d = docs.select(F.col(quoted(doc_id)).alias("id"), sha.alias("sha"))
    return d.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")).select("id", "sha", _key(F.col("sha")).alias("key"), "n")


def _key(sha: Column) -> Column:
    return F.xxhash64(F.unhex(sha))


def groups_of(digest: DataFrame) -> DataFrame:
    """One row per text of a batch: its smallest id (null only if all are) and its rows."""
    return digest.groupBy("key", "sha").agg(F.min("id").alias("first_id"), F.sum("n").alias("rows"))


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """bucket, filter: one serialised filter per bucket of the snapshot's texts."""
    def build(keys: pd.DataFrame) -> pd.DataFrame:
        made = FuseFilter.build(keys["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"bucket": [keys["bucket"].iloc[0]], "filter": [made.to_bytes()]})
    return (snapshot.select(_bucket(buckets), "key").groupBy("bucket")
            .applyInPandas(build, "bucket int, filter binary"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``incoming`` groups with ``maybe``: whether the snapshot's filter passes the digest."""
    kept = incoming.schema
    schema = T.StructType([*kept.fields, T.StructField("maybe", T.BooleanType())])

    def look(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        keys = rows["key"].to_numpy().view(np.uint64)
        hit = FuseFilter.from_bytes(found["filter"].iloc[0]).contains(keys) if len(found) else np.zeros(len(keys), bool)
        return rows[kept.fieldNames()].assign(maybe=hit)

    return (incoming.select("*", _bucket(buckets)).groupBy("bucket")
            .cogroup(filters.groupBy("bucket")).applyInPandas(look, schema))


def dedup(incoming: DataFrame, snapshot: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of both tables: id, sha (SHA-256 of the normalised text),
    ``keep_id`` (smallest id of the equal texts), ``group_size``, ``kept``.

    Texts are equal when identical after each run of ASCII white space became one space.

    * Null text counts as empty, so null, empty and no text at all are one group.
    * A null id counts as larger than any other; ``keep_id`` is null only if
      every id of the group is.
    * Of rows that repeat both id and text exactly one is kept.
    * Either table may be empty; other columns are not read.

    Rows travel as digests, summed before each exchange, so a group that holds
    a third of all rows is a few rows per task.  Only the texts of one row per
    matching pair of groups move for the byte check.
    """
    old_rows, new_rows = cut(digests(snapshot, doc_id, text), "snapshot"), cut(digests(incoming, doc_id, text), "incoming")
    old, new = cut(groups_of(old_rows), "snapshot-groups"), cut(groups_of(new_rows), "incoming-groups")
    buckets = max(1, math.ceil(max(old.count(), new.count()) / BUCKET_KEYS))
    filters = cut(snapshot_filters(old, buckets), "filters")  # immutable: built once for a snapshot
    screened = screen(new, filters, buckets)

    positive = screened.filter("maybe").drop("maybe")
    o = old.select("key", F.col("sha").alias("old_sha"), F.col("first_id").alias("old_id"), F.col("rows").alias("old_n"))
    pairs = cut(positive.join(o, "key"), "pairs")
    checked = _equal_texts(pairs, incoming, snapshot, doc_id, text)
    # A group of the batch and one of the snapshot are one class only where a pair was
    # confirmed: what the filter rejects or the byte check refuses stays apart.
    side = ["old", "sha"]
    classes = (old.select(F.lit(True).alias("old"), "sha", F.col("first_id").alias("id"), "rows",
                          F.struct(F.lit(True).alias("old"), F.col("sha").alias("sha")).alias("class"))
               .unionByName(new.join(checked, "sha", "left").select(
                   F.lit(False).alias("old"), "sha", F.col("first_id").alias("id"), "rows",
                   F.struct(F.col("joined_sha").isNotNull().alias("old"), F.coalesce("joined_sha", "sha").alias("sha")).alias("class"))))
    first = F.struct(F.col("id").isNull(), F.col("id").alias("id"), (~F.col("old")).alias("new"))
    final = classes.groupBy("class").agg(F.min(first).alias("first"), F.sum("rows").alias("group_size"),
                                         F.collect_set(F.struct("old", "sha")).alias("members"))
    # Written, so that both sides of the last join are plain exchanges: only then can a large group be split.
    final = cut(final.select(F.inline("members"), F.col("first.id").alias("keep_id"), F.col("first.new").alias("keep_new"), "group_size"), "groups")
    rows = (old_rows.withColumn("old", F.lit(True)).unionByName(new_rows.withColumn("old", F.lit(False)))
            .groupBy("id", *side).agg(F.sum("n").alias("n")))
    return (rows.join(final, side)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .select("id", "sha", "keep_id", "group_size",
                    (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1) & (F.col("old") != F.col("keep_new"))).alias("kept")))


def _equal_texts(pairs: DataFrame, incoming: DataFrame, snapshot: DataFrame, doc_id: str, text: str) -> DataFrame:
    """sha, joined_sha of the pairs whose normalised texts are the same bytes."""
    def texts(docs: DataFrame, sha: str, first: str, side: str) -> DataFrame:
        body = normalised(F.col(quoted(text)))
        d = docs.select(F.col(quoted(doc_id)).alias("id"), F.sha2(body, 256).alias("d_sha"), body.alias("body"))
        p = pairs.select(F.col(sha).alias("p_sha"), F.col(first).alias("p_id"), F.col("sha").alias("pair"),
                         F.col("old_sha").alias("old_pair"))
        # Only texts that a pair may ask for reach the exchange.
        shipped = bits_of(p.select(F.xxhash64("p_sha", "p_id").alias("key")))

        @F.pandas_udf("boolean")
        def asked(at: pd.Series) -> pd.Series:
            at = at.to_numpy()
            return pd.Series((shipped.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

        d = d.filter(asked(F.pmod(F.xxhash64("d_sha", "id"), F.lit(FILTER_BITS))))
        met = d.join(p, (F.col("d_sha") == F.col("p_sha")) & F.col("id").eqNullSafe(F.col("p_id")))
        return met.select("pair", "old_pair", F.col("body").alias(side))
    new = texts(incoming, "sha", "first_id", "new_body")
    old = texts(snapshot, "old_sha", "old_id", "old_body")
    same = new.join(old, ["pair", "old_pair"]).filter(F.col("new_body") == F.col("old_body"))
    return same.select(F.col("pair").alias("sha"), F.col("old_pair").alias("joined_sha")).distinct()


def halves(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A table without a history of batches: the rows up to the median id are the
    snapshot, later ones (and null ids) the incoming batch.  Ids without a middle
    (texts) are dealt by their hash."""
    name = F.col(quoted(doc_id))
    if isinstance(docs.schema[doc_id].dataType, (T.NumericType, T.DateType, T.TimestampType)):
        middle = docs.agg(F.expr(f"approx_percentile({quoted(doc_id)}, 0.5)").alias("m")).first()["m"]
        early = F.coalesce(name <= F.lit(middle), F.lit(False))
    else:
        early = name.isNotNull() & (F.pmod(F.xxhash64(name), F.lit(2)) == 0)
    return docs.filter(early), docs.filter(~early)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``dedup`` keeps, all columns as they are."""
    snapshot, incoming = halves(docs, doc_id)
    verdict = dedup(incoming, snapshot, doc_id, text).filter("kept").select(F.col("id").alias("k_id"), F.col("sha").alias("k_sha"))
    rows = docs.select(whole_row(docs).alias("row"), F.col(quoted(doc_id)).alias("r_id"),
                       F.sha2(normalised(F.col(quoted(text))), 256).alias("r_sha"))
    met = rows.join(verdict, (F.col("r_sha") == F.col("k_sha")) & F.col("r_id").eqNullSafe(F.col("k_id")))
    # Rows that repeat id and text: the first of them by the hash of the whole row.
    once = met.select("row", "r_id", "r_sha", F.struct(*hash128(F.col("row"))).alias("h"))
    spare = once.groupBy("r_id", "r_sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if spare.isEmpty():
        return once.select(*fields("row", docs))
    return once.groupBy("r_id", "r_sha").agg(F.min_by("row", "h").alias("row")).select(*fields("row", docs))
