"""The graph of changes: heads, ancestors, readiness, differences and snapshots.

Change tables have ``doc_id, hash, deps`` and, where named, ``actor, seq, arrival, start_op,
max_op``. Each change is there once. Null ``deps`` are none. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace
from .prefix import even_parts
from .visibility import join_pred_succ

KEY = ["doc_id", "hash"]


def edges(changes: DataFrame) -> DataFrame:
    """``doc_id, hash, dep``: one row per dependency."""
    return changes.select("doc_id", "hash", F.explode("deps").alias("dep")).filter("dep is not null").distinct()


def anti_heads(changes: DataFrame) -> DataFrame:
    """Changes that no other depends on."""
    named = edges(changes).select("doc_id", F.col("dep").alias("hash"))
    return changes.select(*KEY).join(named, KEY, "left_anti")


def srt_heads(changes: DataFrame) -> DataFrame:
    """Heads of every document as a sorted array. A document has as many as replicas wrote at once."""
    return anti_heads(changes).groupBy("doc_id").agg(F.sort_array(F.collect_list("hash")).alias("heads"))


def anti_missing_deps(changes: DataFrame) -> DataFrame:
    """Dependencies that are not there: ``doc_id, dep``."""
    there = changes.select("doc_id", F.col("hash").alias("dep"))
    return edges(changes).select("doc_id", "dep").distinct().join(there, ["doc_id", "dep"], "left_anti")


BLOCK_LINKS = 250_000


def _walk(front: pd.DataFrame, links: pd.DataFrame, by: tuple[str, ...]) -> pd.DataFrame:
    """Within one block: all that ``front`` reaches, and, with ``block`` where it goes on, what lies in other blocks."""
    nodes, place = np.unique(np.concatenate([links["hash"].to_numpy(object), links["nxt"].to_numpy(object), front["hash"].to_numpy(object)]), return_inverse=True)
    n = len(links)
    src, dst = place[:n], place[n : 2 * n]
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    first = np.searchsorted(src, np.arange(len(nodes) + 1))
    leaves = np.full(len(nodes), None, object)  # of nodes elsewhere, their block
    away = (links["nxt_block"] != links["block"]).to_numpy(bool)
    leaves[place[n : 2 * n][away]] = links["nxt_block"].to_numpy(object)[away]
    outside = np.zeros(len(nodes), bool)
    outside[place[n : 2 * n][away]] = True
    parts = []
    start = front.assign(_at=place[2 * n :])
    for key, own in start.groupby(list(by), dropna=False) if by else [((), start)]:
        seen = np.zeros(len(nodes), bool)
        now = np.unique(own["_at"].to_numpy())
        while len(now):
            seen[now] = True
            now = now[~outside[now]]
            count = first[now + 1] - first[now]
            reached = dst[np.repeat(first[now] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())] if len(now) else now
            now = np.unique(reached[~seen[reached]])
        at = np.flatnonzero(seen)
        parts.append(pd.DataFrame({**dict(zip(by, key, strict=True)), "hash": pd.Series(nodes[at], dtype=object), "goes_on": pd.Series(leaves[at], dtype=object)}))
    return pd.concat(parts, ignore_index=True)


def reach(start: DataFrame, links: DataFrame, work: Workspace | None = None, by: tuple[str, ...] = (), order: str | None = None, block_links: int = BLOCK_LINKS) -> DataFrame:
    """All ``(doc_id, hash)`` that can be reached from ``start`` over ``links (doc_id, hash, nxt)``, the start included.

    With ``by``, columns of ``start``, for each of their values by itself, all in the same rounds.

    Links are put into blocks: those of one document, or ranges of ``order`` (a column of ``links``; else of a hash) where
    it has more than ``block_links``. A round walks all blocks that the last one came to, each to its end, so there are as many
    rounds as a path changes blocks, not as it has steps: one for documents of one block.
    """
    work = work or Workspace(start.sparkSession, "reach")
    keys = ", ".join(f"`{c}` {start.schema[c].dataType.simpleString()}" for c in [*by, "doc_id", "hash"])
    walk = lambda f, e: f.groupBy("block").cogroup(e.groupBy("block")).applyInPandas(lambda f, e: _walked(f, e, by), f"{keys}, goes_on string")
    links = work.put(links.select(*KEY, "nxt", *([F.col(order).alias("_order")] if order else [])), "given")
    if not links.groupBy("doc_id").count().filter(F.col("count") > block_links).limit(1).count():
        whole = F.hex(F.xxhash64("doc_id"))
        inside = links.select(*KEY, "nxt", whole.alias("block"), whole.alias("nxt_block"))
        return work.put(walk(start.select(*by, *KEY).distinct().withColumn("block", whole), inside).select(*by, *KEY), "found")
    cut = links.select(*KEY, "nxt", (F.col("_order") if order else F.xxhash64("hash")).alias("_order"))
    cut = work.put(even_parts(cut, "doc_id", "_order", block_links).select(*KEY, "nxt", F.hex(F.xxhash64("doc_id", "part")).alias("block")), "cut")
    of = work.put(cut.groupBy(*KEY).agg(F.min("block").alias("block")), "blocks")
    links = work.put(cut.select(*KEY, "nxt").join(of, KEY).join(of.select("doc_id", F.col("hash").alias("nxt"), F.col("block").alias("nxt_block")), ["doc_id", "nxt"], "left"), "links")
    begun = start.select(*by, *KEY).distinct()
    front = work.put(begun.join(of, KEY), "round0")
    found = work.put(begun.join(of, KEY, "left_anti"), "alone")  # nothing follows these
    k = 0
    while front.limit(1).count():
        k += 1
        asked = links.join(F.broadcast(front.select("block").distinct()), "block", "left_semi") if k > 1 else links
        walked = work.put(walk(front, asked), f"walked{k}")
        found = work.put(found.unionByName(walked.select(*by, *KEY)).distinct(), f"found{k}")
        nxt = walked.filter("goes_on is not null").withColumnRenamed("goes_on", "block").distinct()
        # What lies in another block is new unless that block was walked from it before.
        old = front.select(*by, *KEY) if k == 1 else old.unionByName(front.select(*by, *KEY))
        front = work.put(nxt.join(old, [*by, *KEY], "left_anti"), f"round{k}")
    return found


def _walked(front: pd.DataFrame, links: pd.DataFrame, by: tuple[str, ...]) -> pd.DataFrame:
    columns = [*by, "doc_id", "hash", "goes_on"]
    if not len(front):
        return front.assign(goes_on=front["hash"])[columns]  # empty, but typed: Arrow does not make texts of empty numbers
    found = _walk(front, links, by)
    return found.assign(doc_id=pd.Series([front["doc_id"].iloc[0]] * len(found), dtype=object))[columns]


def dag_ancestors(changes: DataFrame, of: DataFrame) -> DataFrame:
    """The changes ``of`` names and all they depend on, as far as they are there."""
    up = edges(changes).withColumnRenamed("dep", "nxt")
    return reach(of, up).join(changes.select(*KEY), KEY, "left_semi")


def dag_descendants(changes: DataFrame, of: DataFrame) -> DataFrame:
    """The changes ``of`` names and all that depend on them."""
    down = edges(changes).select("doc_id", F.col("dep").alias("hash"), F.col("hash").alias("nxt"))
    return reach(of, down).join(changes.select(*KEY), KEY, "left_semi")


def set_changes_since(changes: DataFrame, have: DataFrame) -> DataFrame:
    """Changes that are neither in ``have`` nor depended on by it."""
    return changes.select(*KEY).join(dag_ancestors(changes, have), KEY, "left_anti")


def dag_blocked(changes: DataFrame) -> DataFrame:
    """Changes that cannot be applied: something they depend on, at any distance, is not there."""
    there = changes.select("doc_id", F.col("hash").alias("dep"))
    first = edges(changes).join(there, ["doc_id", "dep"], "left_anti").select(*KEY).distinct()
    return dag_descendants(changes, first)


def dag_apply(changes: DataFrame) -> DataFrame:
    """Changes that can be applied, whatever order they came in."""
    return changes.join(dag_blocked(changes), KEY, "left_anti")


def flt_causal_ready(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New changes whose dependencies are all stored: what one round of applying would take."""
    new = incoming.join(stored.select(*KEY), KEY, "left_anti")
    lacking = edges(new).join(stored.select("doc_id", F.col("hash").alias("dep")), ["doc_id", "dep"], "left_anti").select(*KEY)
    return new.join(lacking, KEY, "left_anti")


def agg_pending(changes: DataFrame) -> DataFrame:
    """How many changes of each document wait for something."""
    return dag_blocked(changes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pending"))


def agg_clock(changes: DataFrame) -> DataFrame:
    """Greatest sequence number of every actor in every document."""
    return changes.groupBy("doc_id", "actor").agg(F.max("seq").alias("seq"))


def win_seq_check(changes: DataFrame) -> DataFrame:
    """Actors whose sequence numbers are not 1, 2, 3, ...: ``doc_id, actor, n, max_seq, reused, skipped``."""
    per = changes.groupBy("doc_id", "actor", "seq").agg(F.count(F.lit(1)).alias("k"))
    got = per.groupBy("doc_id", "actor").agg(F.sum("k").alias("n"), F.max("seq").alias("max_seq"), F.sum(F.col("k") - 1).alias("reused"), (F.max("seq") - F.count(F.lit(1))).alias("skipped"))
    return got.filter("reused > 0 or skipped > 0")


def win_op_numbering(changes: DataFrame) -> DataFrame:
    """Whether each actor's changes number their operations without overlap: offending changes with the end before."""
    w = Window.partitionBy("doc_id", "actor").orderBy("seq", "hash")
    return changes.withColumn("ended", F.lag("max_op").over(w)).filter("start_op <= ended").select("doc_id", "hash", "start_op", "ended")


def set_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two replicas' changes, each once."""
    return left.unionByName(right).dropDuplicates(KEY)


def anti_changes_added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of ``new`` that ``old`` lacks."""
    return new.join(old.select(*KEY), KEY, "left_anti")


def lim_history(changes: DataFrame, upto: int) -> DataFrame:
    """The first ``upto`` changes of every document in order of arrival."""
    return changes.filter(F.col("arrival") <= upto)


def dag_snapshot(changes: DataFrame, ops: DataFrame, heads: DataFrame) -> DataFrame:
    """Operations of the document as it was at ``heads``. ``ops`` has ``change_hash``."""
    past = dag_ancestors(changes, heads).withColumnRenamed("hash", "change_hash")
    return ops.join(past, ["doc_id", "change_hash"], "left_semi")


def dag_history(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations seen at every entry of the history, one for each change: ``entry``, the change's arrival, and the columns of ``ops``.

    ``ops`` has ``change_hash``. What an operation of its own change hides is seen at no entry; else an
    operation is seen where its change is in the entry's past and none that hides it is. Increments hide nothing.
    """
    work = Workspace(ops.sparkSession, "history")
    up = edges(changes).withColumnRenamed("dep", "nxt")
    past = reach(changes.select("doc_id", "hash", F.col("arrival").alias("entry")), up, work, by=("entry",))
    past = work.put(past.join(changes.select(*KEY), KEY, "left_semi").withColumnRenamed("hash", "change_hash"), "past")
    own = ["doc_id", "ctr", "actor"]
    by_change = ops.select(*own, "change_hash")
    hides = join_pred_succ(ops).filter("action <> 'inc'").join(by_change, own).select("doc_id", F.col("pctr").alias("ctr"), F.col("pactor").alias("actor"), F.col("change_hash").alias("hider")).distinct()
    hides = work.put(hides.join(by_change, own), "hides")
    seen = ops.filter("action not in ('del', 'inc')").join(hides.filter("hider = change_hash"), own, "left_anti")
    later = hides.filter("hider <> change_hash").join(seen.select(*own), own, "left_semi").drop("change_hash").withColumnRenamed("hider", "change_hash")
    hidden = later.join(past, ["doc_id", "change_hash"]).select("entry", *own).distinct()
    return seen.join(past, ["doc_id", "change_hash"]).join(hidden, ["entry", *own], "left_anti")


def op_regroup(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """The change that covers each operation: same actor, counter between its first and last.

    Joined by document, actor and blocks of 1,000 counters, so that ranges meet only near ones.
    """
    block = lambda c: F.floor(c / 1000)
    spans = changes.select("doc_id", "actor", "hash", "start_op", "max_op", F.explode(F.sequence(block(F.col("start_op")), block(F.greatest("start_op", "max_op")))).alias("block"))
    return ops.withColumn("block", block(F.col("ctr"))).join(spans, ["doc_id", "actor", "block"]).filter("ctr between start_op and max_op").drop("block", "start_op", "max_op")


def set_advance_heads(old: DataFrame, new: DataFrame, shared: DataFrame) -> DataFrame:
    """Heads both sides have after a batch: those new to us, and shared ones still heads."""
    return new.join(old, KEY, "left_anti").unionByName(shared.join(new, KEY, "left_semi")).distinct()


def semi_known_heads(heads: DataFrame, changes: DataFrame) -> DataFrame:
    """A peer's heads that we have."""
    return heads.join(changes.select(*KEY), KEY, "left_semi")


def local_deps(deps: DataFrame, last_own: DataFrame) -> DataFrame:
    """Dependencies of a local change: the given ones and the author's own last change, sorted."""
    both = deps.join(last_own, "doc_id", "left")
    own = F.when(F.col("last").isNull(), F.array().cast("array<string>")).otherwise(F.array("last"))
    return both.select("doc_id", F.sort_array(F.array_union("deps", own)).alias("deps"))
