"""References to records that do not exist, listed per table and day.

Distinct foreign keys are anti-joined with the distinct keys that are there; only
what is left is joined back to the rows that named it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bare_key, clean_hash, digest, object_id, opid
from ..storage import Workspace
from .redelivery import change_hashes, deliveries

COLUMNS = ["src_table", "seen_day", "doc_id", "src_key", "ref_key"]


def orphans(links: DataFrame, parents: DataFrame, key: str, work: Workspace, name: str) -> DataFrame:
    """Rows of ``links`` whose ``key`` is not null and not among ``parents``' keys.

    Both sides are made distinct before the anti-join, so a key that many rows name
    moves once; an empty parent table makes every link an orphan. What is missing is
    written, as table ``name``: it is far less than the links, and the plan that joins it back stays short.
    """
    wanted = links.select(key).filter(F.col(key).isNotNull()).distinct()
    missing = work.put(wanted.join(parents.select(key).distinct(), key, "left_anti"), name)
    return links.join(missing, key, "left_semi")


def _day(first: Column) -> Column:
    return F.date_format(first, "yyyy-MM-dd")


def dangling_deps(feed: DataFrame, purged: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Dependencies of changes that no delivery of the document has, or that were withdrawn.

    One row per (document, change, reference). A delivery without a hash counts for
    the change another delivery names for it; without one it gives no case. Null and
    blank references are none. ``seen_day`` is null if no arrival of the source has a time.
    """
    work = work or Workspace(feed.sparkSession, "dangling-deps")
    part = ["doc_id", "received_at", "hash", "deps"]
    named, filled = change_hashes(deliveries(feed, "deps"))
    source = named.select(part).unionByName(work.put(filled.filter("hash is not null").select(part), "filled"))
    links = source.select("doc_id", F.col("hash").alias("src_key"), F.explode("deps").alias("ref")).withColumn("ref_key", bare_key(F.col("ref"))).filter("ref_key <> ''").drop("ref")
    links = links.withColumn("fk", digest(F.col("doc_id"), F.col("ref_key")))
    there = source.select(digest(F.col("doc_id"), F.col("hash")).alias("fk")).distinct()
    gone = purged.select(digest(F.col("doc_id"), clean_hash(F.col("hash"))).alias("fk")).distinct()
    bad = orphans(links, there.join(gone, "fk", "left_anti"), "fk", work, "missing-deps").select("doc_id", "src_key", "ref_key").distinct()
    bad = work.put(bad.withColumn("pk", digest(F.col("doc_id"), F.col("src_key"))), "bad-deps")
    seen = source.select("received_at", digest(F.col("doc_id"), F.col("hash")).alias("pk")).join(bad.select("pk"), "pk", "left_semi").groupBy("pk").agg(F.min("received_at").alias("first"))
    return bad.join(seen, "pk", "left").select(F.lit("change_feed").alias("src_table"), _day(F.col("first")).alias("seen_day"), "doc_id", "src_key", "ref_key")


def dangling_preds(ops: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Predecessors that name no operation, other than a deletion, of the same document, object and key.

    One row per (document, operation, reference). Null equals null in keys; a missing
    object is the root. Operations without a whole id, and references without one, give no case.
    """
    work = work or Workspace(ops.sparkSession, "dangling-preds")
    o = ops.filter("ctr is not null and actor is not null")
    cell = [F.col("doc_id"), object_id(F.col("obj")), F.col("key")]
    there = o.filter("action is null or action <> 'del'").select(digest(*cell, F.col("ctr"), bare_key(F.col("actor"))).alias("fk"))
    links = o.select("arrived_at", "doc_id", "ctr", "actor", "obj", "key", F.explode("pred").alias("p")).filter("p.ctr is not null and p.actor is not null")
    links = links.withColumn("fk", digest(*cell, F.col("p.ctr"), bare_key(F.col("p.actor")))).drop("obj", "key")
    bad = orphans(links, there, "fk", work, "missing-preds")
    name = lambda ctr, actor: opid(F.col(ctr), bare_key(F.col(actor)))
    # All rows of an operation list the same predecessors, so its first arrival is among these.
    keyed = bad.groupBy("doc_id", name("ctr", "actor").alias("src_key"), name("p.ctr", "p.actor").alias("ref_key")).agg(F.min("arrived_at").alias("first"))
    return keyed.select(F.lit("op_log").alias("src_table"), _day(F.col("first")).alias("seen_day"), "doc_id", "src_key", "ref_key")


def dangling(feed: DataFrame, ops: DataFrame, purged: DataFrame, work: Workspace | None = None) -> DataFrame:
    """All dangling references of both tables; columns as in ``COLUMNS``."""
    work = work or Workspace(feed.sparkSession, "dangling")
    return dangling_deps(feed, purged, work).unionByName(dangling_preds(ops, work)).select(*COLUMNS)


def report(found: DataFrame) -> DataFrame:
    """Counts per table and day: ``src_table, seen_day, n_refs, n_missing, n_sources``."""
    return found.groupBy("src_table", "seen_day").agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.countDistinct("doc_id", "ref_key").alias("n_missing"),
        F.countDistinct("doc_id", "src_key").alias("n_sources"),
    )
