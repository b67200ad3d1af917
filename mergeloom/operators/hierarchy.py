"""Parent-child links to full hierarchies: path, depth, root and descendants of every object.

The nodes are put into blocks: the objects of one document, or a part of them where a
document has more than ``block_nodes``. Within a block, leaves are peeled off until
only loops (and ancestors of nodes of other blocks) are left. The trees' Euler tours
are then linked lists of an entry and an exit per node, ranked by pointer jumping:
inside a block at once, and between blocks over the few elements at which a list
enters a block, in rounds that each double the stride. Ranks of entry and exit give
depth, root and number of descendants; a node lies below another exactly if its
interval lies within the other's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import bare_key, digest, object_id, opid
from ..storage import Workspace
from .prefix import even_parts

BLOCK_NODES = 250_000
_UNIT_ROWS = 100_000  # blocks are worked on together until there are this many rows


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block, in pieces that end where a block does."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        if not len(pdf):
            continue
        if n >= _UNIT_ROWS:
            last = held[-1]["block"].iloc[-1]
            same = int((pdf["block"] == last).sum())
            if same < len(pdf):
                yield pd.concat([*held, pdf.iloc[:same]], ignore_index=True)
                held, n, pdf = [], 0, pdf.iloc[same:]
        held.append(pdf)
        n += len(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted id in ``ids``, -1 where it is not there."""
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids, wanted, sorter=order), len(ids) - 1)
    at = order[at]
    return np.where(ids[at] == wanted, at, -1)


def _longs(s: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and where they are not null."""
    there = s.notna().to_numpy()
    return s.fillna(0).to_numpy(np.int64), there


def _jump(nxt: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Last element reached, elements passed, weight passed, and whether a list has no end."""
    n = len(nxt)
    ptr, last, dist, total = nxt.copy(), np.arange(n), np.ones(n, np.int64), weight.astype(np.int64)
    for _ in range(int(n).bit_length() + 1):
        a = np.flatnonzero(ptr >= 0)
        if not len(a):
            break
        p = ptr[a]
        dist[a] += dist[p]
        total[a] += total[p]
        last[a] = last[p]
        ptr[a] = ptr[p]
    return last, dist, total, ptr >= 0


def _peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which nodes are in or below a loop of their block; ``nxt`` is where the way up leaves it."""
    for pdf in _units(batches):
        nid = pdf["nid"].to_numpy(np.int64)
        pid, has = _longs(pdf["pid"])
        up = np.where(has, _places(nid, pid), -1)
        left = np.bincount(up[up >= 0], minlength=len(nid)) + pdf["outer"].to_numpy(np.int64)
        layers: list[np.ndarray] = []
        front = np.flatnonzero(left == 0)
        core = np.ones(len(nid), bool)
        while len(front):
            layers.append(front)
            core[front] = False
            above = up[front]
            above = above[above >= 0]
            np.subtract.at(left, above, 1)
            above = np.unique(above)
            front = above[left[above] == 0]
        loop, out, leaves = np.zeros(len(nid), bool), np.zeros(len(nid), np.int64), np.zeros(len(nid), bool)
        kept = np.flatnonzero(core)
        if len(kept):
            inner = np.full(len(nid), -1)
            inner[kept] = np.arange(len(kept))
            way = np.where(up[kept] >= 0, inner[up[kept]], -1)
            last, _, _, endless = _jump(way, np.zeros(len(kept)))
            top = kept[last]
            loop[kept] = endless
            leaves[kept] = has[top] & ~endless
            out[kept] = pid[top]
        for layer in reversed(layers):
            above, inside = up[layer], up[layer] >= 0
            loop[layer] = inside & loop[above]
            leaves[layer] = np.where(inside, leaves[above], has[layer])
            out[layer] = np.where(inside, out[above], pid[layer])
        yield pd.DataFrame({"nid": nid, "loop": loop, "nxt": pd.Series(out, dtype="Int64").where(leaves)})


_TOUR = "nid long, doc_id string, object_id string, root_id string, in_nxt long, in_len long, in_sum long, out_nxt long, out_len long, out_sum long, up long, path string"


def _tour(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranks of entry and exit, and the path, as far as a block knows them."""
    for pdf in _units(batches):
        n = len(pdf)
        nid = pdf["nid"].to_numpy(np.int64)
        pid, has = _longs(pdf["pid"])
        head, has_head = _longs(pdf["head"])  # first child, if children are in several blocks
        beyond, has_beyond = _longs(pdf["beyond"])  # next sibling, if it is in another block
        block = pdf["block"].to_numpy(np.int64)
        order = np.lexsort((nid, block, pid, ~has))
        p, h, b = pid[order], has[order], block[order]
        first = np.r_[True, (p[1:] != p[:-1]) | (h[1:] != h[:-1]) | (b[1:] != b[:-1])]
        final = np.r_[first[1:], True]
        # Elements are numbered 2 * node for the entry and one more for the exit.
        after_exit = np.empty(n, np.int64)
        after_exit[order] = np.where(final, 2 * p + 1, 2 * np.r_[nid[order][1:], 0])
        after_exit = np.where(has_beyond, 2 * beyond, after_exit)
        after_entry = 2 * nid + 1
        heads = order[first & h]
        at = _places(nid, pid[heads])
        after_entry[at[at >= 0]] = 2 * nid[heads[at >= 0]]
        after_entry = np.where(has_head, 2 * head, after_entry)
        element = np.r_[2 * nid, 2 * nid + 1]
        follows = np.r_[after_entry, after_exit]
        ends = np.r_[np.zeros(n, bool), ~has]
        nxt = np.where(ends, -1, _places(element, follows))
        last, length, total, _ = _jump(nxt, np.r_[np.ones(n), -np.ones(n)])
        outside = ~ends[last]
        gone = np.where(outside, follows[last], 0)
        up = np.where(has, _places(nid, pid), -1)
        depth = 1 - total[:n]
        label, ids = pdf["label"].to_numpy(object), pdf["object_id"].to_numpy(object)
        path = np.empty(n, object)
        named = pdf["label"].notna().any()
        for v in (np.argsort(depth, kind="stable") if not outside[:n].any() else _downwards(up)) if named else ():
            path[v] = label[v] if up[v] < 0 else f"{path[up[v]]}/{label[v]}"
        top, _, _, _ = _jump(up, np.zeros(n))
        out = pd.DataFrame({"nid": nid, "doc_id": pdf["doc_id"], "object_id": ids, "root_id": np.where(outside[:n], None, ids[last[:n] % n])})
        for name, part in (("in", slice(0, n)), ("out", slice(n, 2 * n))):
            out[f"{name}_nxt"] = pd.Series(gone[part], dtype="Int64").where(outside[part])
            out[f"{name}_len"], out[f"{name}_sum"] = length[part], total[part]
        out["up"] = pd.Series(pid[top], dtype="Int64").where(has[top])
        out["path"] = path
        yield out


def _downwards(up: np.ndarray) -> np.ndarray:
    """Nodes so that each comes after its parent."""
    _, dist, _, _ = _jump(up, np.zeros(len(up)))
    return np.argsort(dist, kind="stable")


def follow(work: Workspace, name: str, links: DataFrame, folds: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Follow ``x -> nxt`` until it is null, folding columns; what never ends keeps a ``nxt``.

    A round joins the links with themselves and so doubles what each covers; the
    number of rounds is the logarithm of the longest chain. Each round is a written table.
    """
    rounds = 0
    now = work.put(links, f"{name}0")
    size = now.count()
    while rounds <= size.bit_length() and now.filter("nxt is not null").limit(1).count():
        there = now.select(F.col("x").alias("y"), F.col("nxt").alias("nxt2"), *[F.col(c).alias(f"{c}2") for c in folds])
        open_ = now.filter("nxt is not null").join(there, F.col("nxt") == F.col("y"))
        step = open_.select("x", F.col("nxt2").alias("nxt"), *[f(F.col(c), F.col(f"{c}2")).alias(c) for c, f in folds.items()])
        rounds += 1
        nxt = work.put(step.unionByName(now.filter("nxt is null").select("x", "nxt", *folds)), f"{name}{rounds}")
        work.drop(f"{name}{rounds - 1}")
        work.free_shuffles()
        now = nxt
    return now


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _forest(nodes: DataFrame, work: Workspace, block_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Tours of all trees among ``nodes``, and the nodes that are in or below a loop.

    ``nodes`` is a written table of ``nid, doc_id, ctr, object_id, obj, label``: ``nid`` is unique, siblings are visited in its
    order, ``obj`` names the parent by ``object_id`` and ``label`` goes into the path (all null: no paths).
    """
    split = _any(nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_nodes))
    placed = (even_parts(nodes, "doc_id", "ctr", block_nodes) if split else nodes.withColumn("part", F.lit(0))).withColumn("block", F.xxhash64("doc_id", "part"))
    parents = placed.select(digest(F.col("doc_id"), F.col("object_id")).alias("k"), F.col("nid").alias("pid"), F.col("block").alias("pblock"))
    linked = placed.withColumn("k", digest(F.col("doc_id"), F.col("obj"))).join(parents, "k", "left")
    links = work.put(linked.select("nid", "pid", "block", "pblock", "doc_id", "object_id", "label"), "links")
    work.drop("nodes")

    outer = links.filter("pblock <> block").select(F.col("pid").alias("nid")).distinct().withColumn("outer", F.lit(1))
    graph = links.select("nid", "pid", "block")
    graph = graph.join(outer, "nid", "left").fillna(0, ["outer"]) if split else graph.withColumn("outer", F.lit(0))
    state = graph.repartition("block").sortWithinPartitions("block").mapInPandas(_peel, "nid long, loop boolean, nxt long")
    state = work.put(state, "state")
    if split:
        ways = state.join(state.filter("nxt is not null").select(F.col("nxt").alias("nid")).distinct(), "nid", "left_semi")
        ended = follow(work, "ways", ways.select(F.col("nid").alias("x"), "nxt", "loop"), {"loop": lambda a, b: a | b})
        ended = ended.select(F.col("x").alias("y"), (F.col("loop") | F.col("nxt").isNotNull()).alias("far"))
        state = state.join(ended, F.col("nxt") == F.col("y"), "left").select("nid", (F.col("loop") | F.coalesce("far", F.lit(False))).alias("loop"))
    looped = state.filter("loop").select("nid")

    good = links.join(looped, "nid", "left_anti")
    if split:
        by = F.col("pid").isNotNull()
        runs = good.filter(by).groupBy("pid", "block").agg(F.min("nid").alias("head"), F.max("nid").alias("tail"), F.max(F.col("pblock") != F.col("block")).alias("away"))
        w = Window.partitionBy("pid").orderBy("head")
        runs = runs.withColumns({"beyond": F.lead("head").over(w), "k": F.row_number().over(w)})
        firsts = runs.filter("k = 1").select(F.col("pid").alias("nid"), "head")
        good = good.join(firsts, "nid", "left").join(runs.filter("beyond is not null").select(F.col("tail").alias("nid"), "beyond"), "nid", "left")
    else:
        good = good.withColumns({"head": F.lit(None).cast("long"), "beyond": F.lit(None).cast("long")})
    toured = good.select("nid", "pid", "head", "beyond", "block", "doc_id", "object_id", "label").repartition("block").sortWithinPartitions("block").mapInPandas(_tour, _TOUR)
    if split:
        toured = _between_blocks(work.put(toured, "toured"), links, work)
    return toured, links.join(looped, "nid", "left_semi").select("doc_id", "object_id")


def tours(nodes: DataFrame, work: Workspace, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``doc_id, object_id, root_id, in_len, out_len, in_sum, path`` of every node that is not in or below a loop."""
    return _forest(nodes, work, block_nodes)[0].select("doc_id", "object_id", "root_id", "in_len", "out_len", "in_sum", "path")


def tree_of_objects(ops: DataFrame, block_nodes: int = BLOCK_NODES, work: Workspace | None = None, ordered: bool = False) -> DataFrame:
    """One row per operation of ``ops`` that makes an object, visible or not.

    Columns ``doc_id, object_id, root_id, tree_depth, key_path, entry_rank, exit_rank, n_descendants``. Its
    container is the object named by ``obj``; without one in the document the object
    is topmost, of depth 1 and its own root. Without ``key`` an object contributes its id to the path.
    In or below a loop the depth is -1, root and path are empty, ranks are null and ``n_descendants`` is -1. Ranks count
    from the end of the tour: entries are greater than the exits they enclose. If rows of one operation contradict one
    another, the smallest (object, key) counts; rows without a whole operation id give nothing. Siblings are visited in any
    order, or, at the price of a sort, ``ordered`` by (``ctr``, ``actor``).
    """
    work = work or Workspace(ops.sparkSession, "hierarchy")
    made = ops.filter("action like 'make%' and ctr is not null and actor is not null").select(
        "doc_id", "ctr", bare_key(F.col("actor")).alias("actor"), object_id(F.col("obj")).alias("obj"), "key"
    )
    made = made.groupBy("doc_id", "ctr", "actor").agg(F.min(F.struct("obj", "key")).alias("at"))
    made = made.orderBy("doc_id", "ctr", "actor") if ordered else made
    nodes = work.put(
        made.select(F.monotonically_increasing_id().alias("nid"), "doc_id", "ctr", opid(F.col("ctr"), F.col("actor")).alias("object_id"), "at.obj", "at.key").withColumn("label", F.coalesce("key", "object_id")), "nodes"
    )
    toured, looped = _forest(nodes, work, block_nodes)
    done = toured.select(
        "doc_id", "object_id", "root_id", (1 - F.col("in_sum")).alias("tree_depth"), F.col("path").alias("key_path"), F.col("in_len").alias("entry_rank"), F.col("out_len").alias("exit_rank"),
        ((F.col("in_len") - F.col("out_len") - 1) / 2).cast("long").alias("n_descendants"),
    )
    none = F.lit(None).cast("long")
    bad = looped.select(
        "doc_id", "object_id", F.lit("").alias("root_id"), F.lit(-1).cast("long").alias("tree_depth"), F.lit("").alias("key_path"), none.alias("entry_rank"), none.alias("exit_rank"), F.lit(-1).cast("long").alias("n_descendants")
    )
    return done.unionByName(bad)


def _between_blocks(toured: DataFrame, links: DataFrame, work: Workspace) -> DataFrame:
    """Carry ranks, roots and paths on over the borders of blocks."""
    t = toured
    entry = t.select((2 * F.col("nid")).alias("x"), F.col("in_nxt").alias("nxt"), F.col("in_len").alias("len"), F.col("in_sum").alias("sum"), F.col("root_id").alias("root"))
    leave = t.select((2 * F.col("nid") + 1).alias("x"), F.col("out_nxt").alias("nxt"), F.col("out_len").alias("len"), F.col("out_sum").alias("sum"), F.lit(None).cast("string").alias("root"))
    # An exit's list ends where the entry of the same node ends; its root is found on the way.
    leave = leave.join(t.filter("in_nxt is null").select((2 * F.col("nid") + 1).alias("x"), F.col("root_id").alias("own")), "x", "left").withColumn("root", F.col("own")).drop("own")
    ends = t.filter("up is null").select((2 * F.col("nid") + 1).alias("x"), F.col("object_id").alias("top"))
    leave = leave.join(ends, "x", "left").withColumn("root", F.coalesce("root", "top")).drop("top")
    wanted = t.select(F.explode(F.array("in_nxt", "out_nxt")).alias("x")).filter("x is not null").distinct()
    plus = lambda a, b: a + b
    ranks = follow(work, "ranks", entry.unionByName(leave).join(wanted, "x", "left_semi"), {"len": plus, "sum": plus, "root": lambda a, b: F.coalesce(b, a)})
    a = ranks.select(F.col("x").alias("in_nxt"), F.col("len").alias("l1"), F.col("sum").alias("s1"), F.col("root").alias("r1"))
    b = ranks.select(F.col("x").alias("out_nxt"), F.col("len").alias("l2"))
    tops = t.select("up").filter("up is not null").distinct()
    paths = t.select(F.col("nid").alias("x"), F.col("up").alias("nxt"), "path").join(tops.withColumnRenamed("up", "x"), "x", "left_semi")
    paths = follow(work, "paths", paths, {"path": lambda a, b: F.concat(b, F.lit("/"), a)})
    c = paths.select(F.col("x").alias("up"), F.col("path").alias("above"))
    t = t.join(a, "in_nxt", "left").join(b, "out_nxt", "left").join(c, "up", "left")
    zero = F.lit(0)
    return t.select(
        "doc_id", "object_id", F.coalesce("root_id", "r1").alias("root_id"), (F.col("in_len") + F.coalesce("l1", zero)).alias("in_len"), (F.col("in_sum") + F.coalesce("s1", zero)).alias("in_sum"),
        (F.col("out_len") + F.coalesce("l2", zero)).alias("out_len"), F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", F.lit("/"), "path")).alias("path"),
    )


def descendants(tree: DataFrame, doc_id: str, object_id: str) -> DataFrame:
    """The rows of ``tree`` below an object: those whose interval lies within its own."""
    top = tree.filter((F.col("doc_id") == doc_id) & (F.col("object_id") == object_id) & F.col("entry_rank").isNotNull())
    top = top.select("doc_id", "root_id", F.col("entry_rank").alias("from"), F.col("exit_rank").alias("to"))
    return tree.join(F.broadcast(top), ["doc_id", "root_id"]).filter("entry_rank < from and exit_rank > to").drop("from", "to")
