"""Edits of many documents at once: from what is to be changed to the operations of a change.

An edit of a map's key names everything that is visible there as its predecessors. Operations are numbered
on from the greatest counter of the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import chunk, running_total
from .visibility import CELL, agg_max_op, visible

VALUES = ["vtype", "i", "d", "s", "b"]


def edit_maps(ops: DataFrame, edits: DataFrame, actor: str) -> DataFrame:
    """Operations that ``edits`` make in the documents of ``ops``: ``doc_id, ctr, actor, obj, key, elem, insert, action``, VALUES, ``pred``.

    ``edits`` has ``doc_id, at, obj, key, action`` and VALUES, one row for each key of an object: ``action`` is ``set``, ``del`` or ``inc`` (by ``i``; null is 1), ``at`` is a whole number by which the edits of
    a document are ordered, then by object and key. ``ops`` are as ``visibility`` takes them, with ``d`` and ``b``. As in a session, edits that change nothing make no operation: assigning the only value
    again, deleting what is not there. Counters are not overwritten, and only counters are incremented: such edits make none either (``refused`` lists them).
    """
    both = _judged(ops, edits).filter("verdict = 'done'")
    numbered = running_total(both.withColumn("_one", F.lit(1).cast("long")), ["doc_id"], "_one", chunk("at"), [F.col("at"), F.col("obj"), F.col("key")], "_n")
    greatest = agg_max_op(ops)
    out = numbered.join(greatest, "doc_id", "left").withColumn("ctr", F.coalesce("max_op", F.lit(0)) + F.col("_n"))
    return out.select("doc_id", "ctr", F.lit(actor).alias("actor"), "obj", "key", F.lit(None).cast("string").alias("elem"), F.lit(False).alias("insert"), "action", *VALUES, F.coalesce("ids", F.array().cast("array<struct<ctr:bigint,actor:string>>")).alias("pred"))


def refused(ops: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that are errors: ``doc_id, obj, key, action``."""
    return _judged(ops, edits).filter("verdict = 'refused'").select("doc_id", "obj", "key", "action")


def _judged(ops: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with ``ids``, what they name, and whether each is ``done``, ``idle`` or ``refused``."""
    order = F.struct("ctr", "actor")
    seen = visible(ops).filter("key is not null").withColumn("is_counter", F.expr("action = 'set' and vtype <=> 'counter'"))
    # As many ids as there are values in conflict.
    there = seen.groupBy(*CELL).agg(
        F.sort_array(F.collect_list(order)).alias("ids"), F.max("is_counter").alias("counted"), F.max_by(F.struct("action", *VALUES), order).alias("now"), F.count(F.lit(1)).alias("n_values")
    ).withColumnRenamed("cell", "key")
    both = edits.select("doc_id", "at", "obj", "key", "action", *VALUES).join(there, ["doc_id", "obj", "key"], "left")
    same = (F.col("n_values") == 1) & (F.col("now.action") == "set") & F.struct(*VALUES).eqNullSafe(F.struct(*[F.col(f"now.{v}").alias(v) for v in VALUES]))
    counted = F.coalesce("counted", F.lit(False))
    verdict = F.when(F.col("action") == "inc", F.when(counted, "done").otherwise("refused")).when(F.col("action") == "del", F.when(F.col("n_values").isNull(), "idle").otherwise("done")).when(F.col("action") == "set", F.when(counted, "refused").when(same, "idle").otherwise("done")).otherwise("refused")
    return both.withColumn("verdict", verdict).withColumn("i", F.when(F.col("action") == "inc", F.coalesce("i", F.lit(1))).otherwise(F.col("i")))
