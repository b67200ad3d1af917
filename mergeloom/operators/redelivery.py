"""Messages delivered more than once: keep exactly one delivery of each change.

Time is cut into buckets of about equally many deliveries. Every bucket has a Bloom filter
over the identifiers that came in during it; the filters are built once, in shards of the
identifiers' hashes, and kept. A delivery asks them before any row is moved: an identifier
that no other bucket's filter knows, and that came once in its own, is definitely new and
is done with. Only the others are put into storage that is divided by bucket, and verified
there by whole identifiers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bare_key, clean_hash, digest
from ..storage import Workspace
from .prefix import looked_up

BITS_PER_KEY = 24  # a filter must stay quiet although all buckets are asked
PROBES = 8
BUCKETS = 30  # of time; deliveries without a time are one more, and one bit tells what came again within its own bucket
AGAIN = 31
SHARD_KEYS = 1_000_000  # identifiers whose filters one task builds
FILTER_MB = 64  # up to which every task gets all filters; beyond, the hashes go to where their filters are


def deliveries(feed: DataFrame, *more: str) -> DataFrame:
    """``delivery_id, received_at, doc_id, actor, seq, hash`` with keys in their bare form, and the columns ``more`` as they are."""
    return feed.select("delivery_id", "received_at", "doc_id", bare_key(F.col("actor")).alias("actor"), "seq", clean_hash(F.col("hash")).alias("hash"), *more)


def change_hashes(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deliveries that carry a hash, which no join touches, and the few that do not, with the hash another gives.

    A delivery without a hash gets the one that another delivery of the same document, actor and sequence number has. If several
    hashes claim the number, the one delivered first (then the smaller delivery id) counts. Deliveries that nothing
    names keep a null hash. Adds ``slot``, the digest of the three.
    """
    d = d.withColumn("slot", digest(F.col("doc_id"), F.col("actor"), F.col("seq")))
    named, bare = d.filter("hash is not null"), d.filter("hash is null")
    wanted = bare.select("slot").distinct()
    first = F.struct(F.col("received_at").isNull(), "received_at", "delivery_id")
    donor = named.join(wanted, "slot", "left_semi").groupBy("slot").agg(F.min_by("hash", first).alias("given"))
    filled = bare.join(donor, "slot", "left").withColumn("hash", F.col("given")).drop("given")
    return named, filled.select(named.columns)


def _places(key: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Where each identifier's bits are, one array for each probe."""
    step = ((key >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for j in range(PROBES):
        yield ((key + np.uint64(j) * step) % np.uint64(size)).astype(np.int64)


def _seal(pdf: pd.DataFrame) -> pd.DataFrame:
    """The filters of one shard. They lie side by side: a word holds, for one position, that bit of every bucket's filter, so a single look-up asks all buckets."""
    key, bucket, n = pdf["id64"].to_numpy(np.int64).view(np.uint64), pdf["bucket"].to_numpy(np.int64), pdf["n"].to_numpy()
    # A bucket far larger than the others (many deliveries of one instant) gets a fuller filter, not all of them longer ones.
    size = 64 + BITS_PER_KEY * int(min(np.bincount(bucket).max(), 4 * -(-len(key) // BUCKETS)))
    words = np.zeros(size, np.uint32)
    bit = np.left_shift(np.uint32(1), bucket.astype(np.uint32)) | np.where(n > 1, np.uint32(1 << AGAIN), np.uint32(0))
    for at in _places(key, size):
        np.bitwise_or.at(words, at, bit)
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "words": words.tobytes()}])


def _ask(words: bytes, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether each identifier may have come in another bucket, or again in its own."""
    table = np.frombuffer(words, np.uint32)
    seen = np.full(len(key), 0xFFFFFFFF, np.uint32)
    for at in _places(key.view(np.uint64), len(table)):
        seen &= table[at]
    return (seen & ~np.left_shift(np.uint32(1), bucket.astype(np.uint32))) != 0


def _bucket(t: Column, cuts: list) -> Column:
    """Number of the time bucket, of those that ``cuts`` divide; a null time has its own."""
    return F.coalesce(sum((t > F.lit(c)).cast("int") for c in cuts) if cuts else F.when(t.isNotNull(), 0), F.lit(BUCKETS))


class Screen:
    """The kept filters of a feed, and what they say of its deliveries.

    ``rows`` has ``ident`` (the whole identifier), ``id64``, ``bucket``, ``shard``, ``received_at``, ``delivery_id`` and, if ``whole``, all of the feed's columns in ``_row``.
    """

    def __init__(self, feed: DataFrame, work: Workspace, whole: bool = False, shard_keys: int = SHARD_KEYS):
        packed = [F.struct("*").alias("_row")] if whole else []
        named, filled = change_hashes(deliveries(feed.select("delivery_id", "received_at", "doc_id", "actor", "seq", "hash", *packed), *(["_row"] if whole else [])))
        d = named.unionByName(work.put(filled, "filled"))
        cuts, n = d.select(F.percentile_approx("received_at", [k / BUCKETS for k in range(1, BUCKETS)], 1000), F.count(F.lit(1))).first()
        self.shards = max(1, -(-n // shard_keys))
        d = d.withColumn("ident", F.coalesce(F.unhex("hash"), F.unhex(F.sha2(F.col("slot"), 256)))).withColumn("id64", F.xxhash64("ident"))
        self.rows = d.withColumns({"bucket": _bucket(F.col("received_at"), sorted(set(cuts or []))), "shard": F.pmod("id64", F.lit(self.shards)).cast("int")}).select(
            "ident", "id64", "bucket", "shard", "received_at", "delivery_id", *(["_row"] if whole else [])
        )
        # Counted before anything is shuffled: however often a change came, it is one row a bucket and task.
        self.keys = self.rows.groupBy("shard", "id64", "bucket").agg(F.count(F.lit(1)).alias("n"))
        self.filters = work.put(self.keys.groupBy("shard").applyInPandas(_seal, "shard int, words binary"), "filters")

    def rows_asked(self, filter_mb: float = FILTER_MB) -> DataFrame:
        """``rows`` with ``maybe``, whether a delivery's identifier possibly came more than once."""
        size = self.filters.agg(F.sum(F.octet_length("words"))).first()[0] or 0
        if size > filter_mb * 1e6:
            asked = self.keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(lambda k, f: k.loc[_ask(f["words"].iloc[0], k["id64"].to_numpy(np.int64), k["bucket"].to_numpy()), ["id64", "bucket"]], "id64 long, bucket int")
            return self.rows.join(asked.withColumn("yes", F.lit(True)), ["id64", "bucket"], "left").withColumn("maybe", F.coalesce("yes", F.lit(False))).drop("yes")
        spark = self.rows.sparkSession
        kept = spark.sparkContext.broadcast({r["shard"]: bytes(r["words"]) for r in self.filters.collect()})

        @F.pandas_udf("boolean")
        def maybe(id64: pd.Series, bucket: pd.Series, shard: pd.Series) -> pd.Series:
            key, at, out = id64.to_numpy(np.int64), bucket.to_numpy(), np.zeros(len(id64), bool)
            for s, own in shard.groupby(shard).indices.items():
                out[own] = _ask(kept.value[s], key[own], at[own])
            return pd.Series(out)

        return self.rows.withColumn("maybe", maybe("id64", "bucket", "shard"))


def _first() -> Column:
    """What is kept comes first: the earliest arrival (null comes last), then the smallest delivery id (null comes last)."""
    return F.struct(F.col("received_at").isNull(), "received_at", F.col("delivery_id").isNull(), "delivery_id")


def repeats(feed: DataFrame, work: Workspace | None = None, shard_keys: int = SHARD_KEYS, filter_mb: float = FILTER_MB) -> DataFrame:
    """Every delivery of ``feed`` that is to be dropped, with what is kept instead.

    Columns: ``delivery_id, kept_id, bucket``. Kept is the earliest ``received_at``
    (null comes last), then the smallest ``delivery_id``. Deliveries carry the same
    change as ``change_hashes`` says; without any hash, those equal in document,
    actor and sequence number do, null being equal to null. A row without
    ``delivery_id``, or with that of the kept one, cannot be named and is not in the result: ``deduplicated`` drops it all
    the same. Other columns of ``feed`` are ignored; an empty feed gives an empty result.
    """
    work = work or Workspace(feed.sparkSession, "redelivery")
    asked = Screen(feed, work, shard_keys=shard_keys).rows_asked(filter_mb)
    stored = work.put(asked.filter("maybe").select("ident", "bucket", "received_at", "delivery_id"), "possible", by=("bucket",))
    kept = work.put(stored.groupBy("ident").agg(F.min_by("delivery_id", _first()).alias("kept_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "kept")
    found = looked_up(stored, kept, ["ident"], stored.count())
    return found.filter("delivery_id is not null and not (delivery_id <=> kept_id)").select("delivery_id", "kept_id", "bucket")


def deduplicated(feed: DataFrame, work: Workspace | None = None, shard_keys: int = SHARD_KEYS, filter_mb: float = FILTER_MB) -> DataFrame:
    """``feed`` with exactly one row of each change, all its columns, also where delivery ids are null or repeated.

    Rows that are definitely new pass as they are; of possible repeats the first of each identifier is taken whole.
    """
    work = work or Workspace(feed.sparkSession, "deduplicated")
    asked = Screen(feed, work, whole=True, shard_keys=shard_keys).rows_asked(filter_mb)
    once = asked.filter("maybe").groupBy("ident").agg(F.min_by("_row", _first()).alias("_row"))
    return asked.filter("not maybe").select("_row.*").unionByName(once.select("_row.*"))
