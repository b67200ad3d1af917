"""Applying a stream of inserts, updates and deletes, the newest first.

The log is cut into batches by operation counter. Counters order the operations of a
document whatever order they arrived in, so going backwards through the batches the
first visible operation seen of a cell is its present value: the cell is resolved,
and older batches anti-join it away before anything else is done with them. What an
operation hides is a tombstone, recorded in the batch of the operation that it names, so a batch
has all that is to be known of it, whichever side of it the tombstone's own operation is on. The oldest batch
is the base: what no later batch resolved is appended as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bare_key, object_id, opid
from ..storage import Workspace
from .prefix import MANY

SHARES = (0.25, 0.5, 0.75)  # of the operations, where one batch ends and the next begins
CELL = ["doc", "obj", "key"]


def _batch(ctr: Column, cuts: list[int]) -> Column:
    return sum((ctr > c).cast("int") for c in cuts) if cuts else F.lit(0)


def images_and_tombstones(log: DataFrame, cuts: list[int]) -> DataFrame:
    """Two kinds of rows, by ``batch``: operations that may be seen, and references that hide one.

    Columns ``batch, doc, obj, key, ctr, actor`` (the operation itself or the one that is named), ``image``
    (1, or 2 for a counter; 0 for a tombstone) and ``hides`` (2 for a tombstone that hides counters too, else 1; 0 for an image). ``doc`` is
    the document's id behind a sign, and empty where it is null, so that nulls equal each other.
    """
    doc = F.coalesce(F.concat(F.lit("="), "doc_id"), F.lit("")).alias("doc")
    counter = F.expr("action = 'set' and vtype <=> 'counter'")
    shown = F.when(F.expr("action not in ('del', 'inc') and ctr is not null and actor is not null"), F.when(counter, 2).otherwise(1)).otherwise(0)
    hides = F.when(F.expr("action <=> 'inc'"), 1).otherwise(2)
    own = F.struct("ctr", "actor", shown.alias("image"), F.lit(0).alias("hides"))
    named = F.transform("pred", lambda p: F.struct(p["ctr"].alias("ctr"), p["actor"].alias("actor"), F.lit(0).alias("image"), hides.alias("hides")))
    each = log.select(doc, object_id(F.col("obj")).alias("obj"), "key", F.explode(F.concat(F.array(own), F.coalesce(named, F.array().cast("array<struct<ctr:bigint,actor:string,image:int,hides:int>>")))).alias("e"))
    each = each.select(*CELL, "e.ctr", bare_key(F.col("e.actor")).alias("actor"), "e.image", "e.hides")
    return each.filter("ctr is not null and actor is not null and image + hides > 0").withColumn("batch", _batch(F.col("ctr"), cuts).cast("int"))


def present_values(ops: DataFrame, work: Workspace | None = None, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """The winning operation of every key of every map and table: ``doc_id, obj, key, op_id``.

    Visible are operations other than ``del`` and ``inc`` that no operation of the same
    document, object and key names in ``pred``; an ``inc`` does not hide a ``set`` of a
    counter. The greatest (``ctr``, ``actor``) wins. Order and repetition of rows do not
    matter. Rows without ``key``, ``action`` or a whole operation id give nothing; null documents
    equal each other; a missing object is the root; an empty log gives an empty result.
    """
    work = work or Workspace(ops.sparkSession, "present-values")
    log = ops.select("doc_id", "obj", "key", "ctr", "actor", "action", "pred", F.col("val.vtype").alias("vtype")).filter("key is not null")
    cuts, n = log.select(F.percentile_approx("ctr", list(shares) or [0.5], 1000), F.count(F.lit(1))).first()
    cuts = sorted(set(cuts or [])) if shares else []
    # The one time the log is read; a folder for each batch.
    stored = work.put(images_and_tombstones(log, cuts), "log", by=("batch",))
    done: list[DataFrame] = []
    for k in range(len(cuts), -1, -1):
        rows = stored.filter(F.col("batch") == k)
        if done:
            resolved = done[0]
            for d in done[1:]:
                resolved = resolved.unionByName(d)
            # Cells with more than a share of 1 / MANY of the log are fewer than MANY: their older rows go before any shuffle.
            rows = rows.join(F.broadcast(resolved.filter(F.col("n") > F.lit(n / MANY)).select(*CELL)), CELL, "left_anti")
            rows = rows.join(resolved.select(*CELL), CELL, "left_anti")
        # Grouped by the cell as one value: what many rows name is put together before it is shuffled, by operation and not by cell, of which one may have most rows.
        per_op = rows.select(F.struct(*CELL).alias("cell"), "ctr", "actor", "image", "hides").groupBy("cell", "ctr", "actor").agg(F.max("image").alias("image"), F.max("hides").alias("hides"))
        seen = F.expr("hides = 0 or image = 2 and hides = 1")
        best = per_op.filter("image > 0").groupBy("cell").agg(F.max(F.when(seen, F.struct("ctr", "actor"))).alias("w"), F.count(F.lit(1)).alias("n")).filter("w is not null")
        done.append(work.put(best.select("cell.*", "w", "n"), f"batch{k}"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    doc_id = F.when(F.col("doc") != "", F.expr("substring(doc, 2)"))
    return out.select(doc_id.alias("doc_id"), "obj", "key", opid(F.col("w.ctr"), F.col("w.actor")).alias("op_id"))
