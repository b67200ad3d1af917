"""Operations, their successors, and what is visible of them.

All functions take an operation table with ``doc_id, ctr, actor, obj, key, elem, action,
vtype, i, pred``: ``obj`` and ``elem`` are ids as text (``_root``, ``_head``), ``pred`` is an
array of ``(ctr, actor)``, ``vtype`` and ``i`` are the value's type and integer. Each operation
is there once. Cells are named by ``(doc_id, obj, cell)``, where ``cell`` is a map's key or a
list's element. Empty tables give empty results; nulls in ``pred`` are no predecessors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import opid
from .prefix import running_total

ID = ["doc_id", "ctr", "actor"]
CELL = ["doc_id", "obj", "cell"]


def cells(ops: DataFrame) -> DataFrame:
    """Adds ``cell``: the key, else the element an operation refers to, which for an insertion is itself."""
    own = opid(F.col("ctr"), F.col("actor"))
    return ops.withColumn("cell", F.when(F.col("key").isNotNull(), F.col("key")).when(F.col("insert"), own).otherwise(F.col("elem")))


def pred_edges(ops: DataFrame) -> DataFrame:
    """One row per reference: the operation, its cell, and ``pctr, pactor``."""
    e = cells(ops).select(*ID, "obj", "cell", "action", "vtype", "i", F.explode("pred").alias("p"))
    return e.select("*", F.col("p.ctr").alias("pctr"), F.col("p.actor").alias("pactor")).drop("p").filter("pctr is not null and pactor is not null")


def join_pred_succ(ops: DataFrame) -> DataFrame:
    """Predecessor and successor of each reference that names an operation, other than ``del``, of its own cell."""
    there = cells(ops).filter("action <> 'del'").select("doc_id", "obj", "cell", F.col("ctr").alias("pctr"), F.col("actor").alias("pactor"))
    return pred_edges(ops).join(there, [*CELL, "pctr", "pactor"]).select("doc_id", "obj", "cell", "pctr", "pactor", "ctr", "actor", "action")


def unmatched_preds(ops: DataFrame) -> DataFrame:
    """References that name nothing in their own cell: an error in a well-formed log."""
    there = cells(ops).filter("action <> 'del'").select("doc_id", "obj", "cell", F.col("ctr").alias("pctr"), F.col("actor").alias("pactor"))
    return pred_edges(ops).join(there, [*CELL, "pctr", "pactor"], "left_anti").select(*ID, "obj", "cell", "pctr", "pactor")


def agg_succ(ops: DataFrame) -> DataFrame:
    """Successors of every operation that has any, ascending: ``doc_id, ctr, actor, succ``."""
    got = join_pred_succ(ops).groupBy("doc_id", "pctr", "pactor").agg(F.sort_array(F.collect_list(F.struct("ctr", "actor"))).alias("succ"))
    return got.select("doc_id", F.col("pctr").alias("ctr"), F.col("pactor").alias("actor"), "succ")


def pred_from_succ(succ: DataFrame) -> DataFrame:
    """Predecessors again, from successors: ``doc_id, ctr, actor, pred``."""
    e = succ.select("doc_id", F.struct("ctr", "actor").alias("p"), F.explode("succ").alias("s"))
    return e.groupBy("doc_id", F.col("s.ctr").alias("ctr"), F.col("s.actor").alias("actor")).agg(F.sort_array(F.collect_list("p")).alias("pred"))


def deletes_from_succ(doc_ops: DataFrame, succ: DataFrame) -> DataFrame:
    """Deletions of a stored document: successors that have no row of their own."""
    e = succ.select("doc_id", F.explode("succ").alias("s")).select("doc_id", "s.ctr", "s.actor").distinct()
    return e.join(doc_ops.select(*ID), ID, "left_anti")


def flt_not_del(ops: DataFrame) -> DataFrame:
    """Rows of a stored document: deletions leave none."""
    return ops.filter("action <> 'del'")


def _hiding(ops: DataFrame) -> DataFrame:
    """Of every operation that is named: how often by an increment, by anything else, and the sum of increments.

    An increment with several predecessors counts for the greatest of the counters among them only (and hides the others).
    """
    counter = F.expr("action = 'set' and vtype <=> 'counter'")
    there = cells(ops).filter("action <> 'del'").select(*CELL, F.col("ctr").alias("pctr"), F.col("actor").alias("pactor"), counter.alias("counter"))
    edges = pred_edges(ops).join(there, [*CELL, "pctr", "pactor"]).select("doc_id", "ctr", "actor", "action", "i", "pctr", "pactor", "counter")
    best = edges.filter("action = 'inc' and counter").groupBy(*ID).agg(F.max(F.struct("pctr", "pactor")).alias("best"))
    edges = edges.join(best, ID, "left").withColumn("folds", F.coalesce((F.col("action") == "inc") & (F.struct("pctr", "pactor") == F.col("best")), F.lit(False)))
    return edges.groupBy("doc_id", F.col("pctr").alias("ctr"), F.col("pactor").alias("actor")).agg(
        F.count_if("folds").alias("n_inc"), F.count_if(~F.col("folds")).alias("n_other"), F.sum(F.when(F.col("folds"), F.col("i"))).alias("added")
    )


def visible(ops: DataFrame) -> DataFrame:
    """Operations that are seen, with ``value_i``: a counter's value with its increments folded in."""
    named = _hiding(ops)
    out = cells(ops).filter("action not in ('del', 'inc')").join(named, ID, "left")
    counter = F.expr("action = 'set' and vtype <=> 'counter'")
    out = out.filter(F.col("n_other").isNull() | (counter & (F.col("n_other") == 0)))
    return out.withColumn("value_i", F.when(counter, F.col("i") + F.coalesce("added", F.lit(0))).otherwise(F.col("i"))).drop("n_inc", "n_other", "added")


def agg_lww(seen: DataFrame, *values: str) -> DataFrame:
    """The winner of every cell, the greatest id, with the columns named, and how many values are there."""
    got = seen.groupBy(*CELL).agg(F.max(F.struct("ctr", "actor", *values)).alias("w"), F.count(F.lit(1)).alias("n_values"))  # ids are unique in a cell
    return got.select(*CELL, *[F.col(f"w.{c}").alias(c) for c in ("ctr", "actor", *values)], "n_values")


def agg_conflicts(seen: DataFrame) -> DataFrame:
    """All values of cells that have more than one, the winner among them: one row per value."""
    many = seen.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_values")).filter("n_values > 1")
    return seen.join(many, CELL).select(*CELL, "ctr", "actor", "n_values")


def agg_counter(ops: DataFrame) -> DataFrame:
    """Counters that are seen, with their value: the start and all increments."""
    seen = visible(ops).filter("action = 'set' and vtype = 'counter'")
    return seen.select(*CELL, "ctr", "actor", F.col("value_i").alias("value"))


def agg_max_op(ops: DataFrame) -> DataFrame:
    """The greatest counter of every document, deletions and predecessors included."""
    both = ops.select("doc_id", F.greatest(F.col("ctr"), F.array_max(F.transform("pred", lambda p: p["ctr"]))).alias("m"))
    return both.groupBy("doc_id").agg(F.max("m").alias("max_op"))


def reachable_objects(ops: DataFrame, tree: DataFrame) -> DataFrame:
    """Objects that are shown: the root, and those made by a seen operation in a container that is shown.

    ``tree`` is the hierarchy of all objects; an object is shown if no object above it, nor itself,
    was made by a hidden operation and the topmost one hangs at the root.
    """
    seen = visible(ops).filter("action like 'make%'").select("doc_id", opid(F.col("ctr"), F.col("actor")).alias("object_id"), "obj", F.lit(True).alias("seen"))
    t = tree.join(seen, ["doc_id", "object_id"], "left")
    top = t.filter("object_id = root_id and seen and obj = '_root'").select("doc_id", "root_id")
    under = t.filter("root_id <> ''").join(top, ["doc_id", "root_id"], "left_semi").select("doc_id", "root_id", "object_id", "entry_rank", "exit_rank", F.when(F.col("seen").isNull(), F.col("exit_rank")).alias("gone_to"))
    return uncovered(under, "gone_to").select("doc_id", "object_id")


_CHUNK = 50_000  # tour ranks that one task goes through


def uncovered(tree: DataFrame, gone_to: str) -> DataFrame:
    """Nodes that are not, nor below, ones with ``gone_to`` (their exit's rank; null for the others).

    In the order of entries, a node's ancestors are those before it that have not ended: exits of all others before it have greater ranks than its own.
    So it is below a marked one exactly if the least exit of the marked ones up to it is not above its own. One running minimum, however they are nested.
    """
    least = running_total(tree, ["doc_id", "root_id"], gone_to, F.floor(-F.col("entry_rank") / _CHUNK), [F.col("entry_rank").desc()], "_least", least=True)
    return least.filter("_least is null or _least > exit_rank").drop("_least")


def covering(tree: DataFrame, marked: str) -> DataFrame:
    """Nodes that are ``marked`` (1, else 0) or have such a node below them, by a running count of the marked ones in the tour."""
    element = F.explode(F.array(F.struct(F.col("entry_rank").alias("rank"), F.col(marked).alias("one"), F.lit(True).alias("enters")), F.struct(F.col("exit_rank").alias("rank"), F.lit(0).alias("one"), F.lit(False).alias("enters"))))
    tour = tree.select("doc_id", "root_id", "object_id", F.col(marked).alias("own"), element.alias("e")).select("doc_id", "root_id", "object_id", "own", "e.*")
    n = running_total(tour, ["doc_id", "root_id"], "one", F.floor(-F.col("rank") / _CHUNK), [F.col("rank").desc()], "_n")
    ends = n.groupBy("doc_id", "root_id", "object_id").agg((F.max("_n") - F.min("_n") + F.max("own")).alias("inside"))
    return ends.filter("inside > 0").drop("inside")
