"""Lists and texts: the order of elements, what is seen of them, runs and spans.

An element inserted after another is its child; the head of the list is the root. The
order is the tree's pre-order with siblings in descending order of their ids, so it is
the order of entries in the tree's Euler tour. That needs no recursion however long a
text is, and no task has a whole long text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import opid
from ..functions.values import parse_opid
from ..storage import Workspace
from .hierarchy import BLOCK_NODES, tours
from .prefix import chunk, numbered, running_total, runs
from .visibility import visible

LIST = ["doc_id", "obj"]
_CHUNK = 50_000  # tour ranks whose elements one task counts


def crdt_list_order(ops: DataFrame, block_nodes: int = BLOCK_NODES, work: Workspace | None = None) -> DataFrame:
    """``doc_id, obj, elem, entry_rank`` of every inserted element; greater ranks come first.

    Elements in or below a loop, or whose reference is not in the list, have no place and
    are left out. Same conditions on ``ops`` as in ``visibility``.
    """
    work = work or Workspace(ops.sparkSession, "list-order")
    made = ops.filter("insert and key is null").select(*LIST, "ctr", "actor", opid(F.col("ctr"), F.col("actor")).alias("id"), F.col("elem").alias("up"))
    heads = made.select(*LIST).distinct().select(*LIST, F.lit(0).cast("long").alias("ctr"), F.lit("").alias("actor"), F.lit("_head").alias("id"), F.lit(None).cast("string").alias("up"))
    # Ids grow in the order of siblings, so tours visit them in it.
    both = made.unionByName(heads).orderBy(*LIST, F.col("ctr").desc(), F.col("actor").desc())
    nodes = work.put(both.select(F.monotonically_increasing_id().alias("nid"), F.concat_ws("\x1f", *LIST).alias("doc_id"), "ctr", F.col("id").alias("object_id"), F.col("up").alias("obj"), F.lit(None).cast("string").alias("label")), "nodes")
    t = tours(nodes, work, block_nodes).filter("root_id = '_head' and object_id <> '_head'")
    part = F.split("doc_id", "\x1f")
    return t.select(part[0].alias("doc_id"), part[1].alias("obj"), F.col("object_id").alias("elem"), F.col("in_len").alias("entry_rank"))


def crdt_list_state(ops: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Elements that are seen, with index from 0 and the winning operation: ``doc_id, obj, elem, idx, ctr, actor, value_i, vtype, s``.

    An element is seen if any operation on it is; the greatest id gives its value.
    """
    work = work or Workspace(ops.sparkSession, "list-state")
    seen = visible(ops).filter("key is null")
    order = F.struct("ctr", "actor")
    top = seen.groupBy("doc_id", "obj", F.col("cell").alias("elem")).agg(F.max_by(F.struct("ctr", "actor", "value_i", "vtype", "s"), order).alias("w"))
    placed = work.put(crdt_list_order(ops, work=work).join(top, [*LIST, "elem"]).select(*LIST, "elem", "entry_rank", "w.*", F.lit(1).alias("one")), "placed")
    ranked = running_total(placed, LIST, "one", F.floor(-F.col("entry_rank") / _CHUNK), [F.col("entry_rank").desc()], "n")
    return ranked.select(*LIST, "elem", (F.col("n") - 1).alias("idx"), "ctr", "actor", "value_i", "vtype", "s")


def agg_list_len(state: DataFrame) -> DataFrame:
    """Number of elements seen."""
    return state.groupBy(*LIST).agg(F.count(F.lit(1)).alias("length"))


def lim_index(state: DataFrame, idx: int) -> DataFrame:
    """The element at an index of every list that is long enough."""
    return state.filter(F.col("idx") == idx)


def lim_pop_shift(state: DataFrame) -> DataFrame:
    """First and last element of every list."""
    return state.groupBy(*LIST).agg(F.min_by("elem", "idx").alias("first_elem"), F.max_by("elem", "idx").alias("last_elem"))


def agg_text(state: DataFrame) -> DataFrame:
    """Text of every list: its strings joined, whatever else is in it left out. A list without strings has an empty text."""
    strings = F.expr("listagg(CASE WHEN vtype = 'str' THEN s END, '') WITHIN GROUP (ORDER BY idx)")
    return state.groupBy(*LIST).agg(F.coalesce(strings, F.lit("")).alias("text"))


def win_spans(state: DataFrame) -> DataFrame:
    """Runs of characters between other values: ``doc_id, obj, span, text`` (null for a value that is no string)."""
    cut = runs(state.withColumn("is_text", F.coalesce(F.col("vtype") == "str", F.lit(False))), LIST, ["is_text"], lambda b: b["is_text"] & F.col("is_text"), "idx")
    return cut.groupBy(*LIST, F.col("run").alias("span")).agg(F.expr("listagg(CASE WHEN vtype = 'str' THEN s END, '') WITHIN GROUP (ORDER BY idx)").alias("text"))


def win_coalesce_edits(state: DataFrame) -> DataFrame:
    """Runs of elements that one multi-insert would make: neighbours of one actor and type with counters that follow each other."""
    islands = state.withColumn("own", parse_opid(F.col("elem"))).select(*LIST, "idx", F.col("own.ctr").alias("c"), F.col("own.actor").alias("by"), "vtype")
    same = lambda b: (b["by"] == F.col("by")) & b["vtype"].eqNullSafe(F.col("vtype")) & (b["c"] == F.col("c") - 1)
    return runs(islands, LIST, ["c", "by", "vtype"], same, "idx").groupBy(*LIST, "run").agg(F.min("idx").alias("start_idx"), F.count(F.lit(1)).alias("length")).select(*LIST, "start_idx", "length")


def _runs_of_actor(ops: DataFrame, columns: list[str], same) -> DataFrame:
    by = [*LIST, "actor"]
    return runs(ops, by, columns, same, "ctr").groupBy(*by, "run").agg(F.min("ctr").alias("first_ctr"), F.count(F.lit(1)).alias("n")).drop("run")


def win_multi_del(ops: DataFrame) -> DataFrame:
    """Runs of deletions that one multiple deletion would make: of one actor, operations and elements both one after the other."""
    d = ops.filter("action = 'del' and key is null and elem is not null").withColumn("e", parse_opid(F.col("elem")))
    d = d.select(*LIST, "ctr", "actor", F.col("e.ctr").alias("ec"), F.col("e.actor").alias("ea"))
    return _runs_of_actor(d, ["ctr", "ec", "ea"], lambda b: (b["ctr"] == F.col("ctr") - 1) & (b["ea"] == F.col("ea")) & (b["ec"] == F.col("ec") - 1))


def win_multi_ins(ops: DataFrame) -> DataFrame:
    """Runs of insertions that one ``set`` of several values would make: each after the one before, of one actor and type."""
    d = ops.filter("action = 'set' and insert").withColumn("e", parse_opid(F.col("elem"))).select(*LIST, "ctr", "actor", "vtype", F.col("e.ctr").alias("ec"), F.col("e.actor").alias("ea"))
    follows = (F.col("ec") == F.col("ctr") - 1) & (F.col("ea") == F.col("actor"))
    return _runs_of_actor(d, ["ctr", "vtype"], lambda b: (b["ctr"] == F.col("ctr") - 1) & follows & b["vtype"].eqNullSafe(F.col("vtype")))


def places(order: DataFrame) -> DataFrame:
    """``place`` from 1 of every element of ``crdt_list_order``."""
    return numbered(order.withColumn("_at", -F.col("entry_rank")), LIST, "_at", "place").drop("_at")


def by_id(ops: DataFrame, by: list[str]) -> DataFrame:
    """``place`` from 1 of every operation within ``by``, in the order of ids; a key of any size is split by counters."""
    return running_total(ops.withColumn("_one", F.lit(1).cast("long")), by, "_one", chunk("ctr"), [F.col("ctr"), F.col("actor")], "place").drop("_one")


BLOCK_OPS = 480  # of a stored document at most in a block


def win_block_split(ops: DataFrame, most: int = BLOCK_OPS) -> DataFrame:
    """``block`` of every operation: a document's operations in the order of their ids, in as few blocks of nearly equal size as none has more than ``most``."""
    sizes = ops.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    placed = by_id(ops, ["doc_id"]).join(sizes, "doc_id")
    return placed.withColumn("block", F.floor((F.col("place") - 1) * F.ceil(F.col("_n") / most) / F.col("_n"))).drop("_n", "place")


def agg_block_meta(blocks: DataFrame) -> DataFrame:
    """What is kept of a block so that it need not be read: ``doc_id, block, n_ops, first_ctr, last_ctr, n_actors, n_inserts``."""
    return blocks.groupBy("doc_id", "block").agg(
        F.count(F.lit(1)).alias("n_ops"), F.min("ctr").alias("first_ctr"), F.max("ctr").alias("last_ctr"), F.countDistinct("actor").alias("n_actors"), F.count_if("insert").alias("n_inserts")
    )
