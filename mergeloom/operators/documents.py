"""Whole documents: everything that is shown, nested and typed, as JSON.

What is shown hangs under one another: the root of a document, its values, the values of the objects among them. The
Euler tour of that tree is the document as it is written: an opening mark at the entry of an object, a closing
one at its exit, plain values between. Tours are ranked in blocks, so depth does not matter, and no task has a whole
document; it comes out in parts that follow one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ROOT, opid
from ..storage import Workspace
from .hierarchy import BLOCK_NODES, tours
from .sequences import crdt_list_order
from .tables import winners

PART = 20_000  # ranks of the tour in a part


def _shown(ops: DataFrame, work: Workspace) -> DataFrame:
    """Winners with ``id``, ``place`` in their container and the container's kind, those of lists in order."""
    top = work.put(winners(ops).withColumn("id", opid(F.col("ctr"), F.col("actor"))), "winners")
    kinds = top.filter("action like 'make%'").select("doc_id", F.col("id").alias("obj"), F.col("action").alias("kind"))
    kinds = kinds.unionByName(top.select("doc_id").distinct().select("doc_id", F.lit(ROOT).alias("obj"), F.lit("makeMap").alias("kind")))
    order = crdt_list_order(ops, work=work).select("doc_id", "obj", F.col("elem").alias("cell"), "entry_rank")
    # What is in a container that is not shown hangs nowhere, and the tour of the root does not come by.
    return work.put(top.join(kinds, ["doc_id", "obj"]).join(order, ["doc_id", "obj", "cell"], "left").filter("kind in ('makeMap', 'makeTable') or entry_rank is not null"), "shown")


def whole_documents(ops: DataFrame, block_nodes: int = BLOCK_NODES, part: int = PART, work: Workspace | None = None) -> DataFrame:
    """``doc_id, part, json``: the parts of a document, joined in their order, are its JSON.

    ``ops`` as ``tables`` takes them. Keys of maps and rows of tables are in the order of their text (rows get their ``id``), elements of lists in theirs; a text is a
    string of its characters, other values in it left out. Counters are their sums, times their milliseconds. A document without anything shown has no row.
    """
    work = work or Workspace(ops.sparkSession, "whole-documents")
    shown = _shown(ops, work)
    roots = shown.select("doc_id").distinct().select(F.col("doc_id"), F.lit(None).cast("string").alias("obj"), F.lit(ROOT).alias("id"), F.lit("").alias("cell"), F.lit(None).cast("long").alias("entry_rank"))
    both = shown.select("doc_id", "obj", "id", "cell", "entry_rank").unionByName(roots).orderBy("doc_id", "obj", F.col("entry_rank").desc(), "cell")
    nodes = work.put(both.select(F.monotonically_increasing_id().alias("nid"), "doc_id", F.monotonically_increasing_id().alias("ctr"), F.col("id").alias("object_id"), "obj", F.lit(None).cast("string").alias("label")), "nodes")
    t = tours(nodes, work, block_nodes).filter(F.col("root_id") == ROOT).select("doc_id", F.col("object_id").alias("id"), F.col("in_len").alias("enter"), F.col("out_len").alias("leave"))
    cells = shown.select("doc_id", "id", "cell", "kind", "action", "vtype", "s", "value_i", "d", "b")
    v = t.join(cells, ["doc_id", "id"], "left")
    text = lambda c: F.expr(f"substring(to_json(named_struct('x', {c})), 6, length(to_json(named_struct('x', {c}))) - 6)")
    plain = F.when(F.col("vtype") == "str", text("s")).when(F.col("vtype") == "bool", F.col("b").cast("string")).when(F.col("vtype") == "float64", F.coalesce(text("d"), F.lit("null"))).when(F.col("vtype") == "null", "null").otherwise(F.coalesce(F.col("value_i").cast("string"), F.lit("null")))
    inside = F.expr("substring(to_json(named_struct('x', s)), 7, length(to_json(named_struct('x', s))) - 8)")  # without its quotes
    named = F.when(F.col("kind").isin("makeMap", "makeTable"), F.concat(text("cell"), F.lit(":"))).otherwise("")
    opens = F.when(F.col("id") == ROOT, "{").when(F.col("action") == "makeTable", "{").when((F.col("action") == "makeMap") & (F.col("kind") == "makeTable"), F.concat(F.lit('{"id":'), text("cell"))).when(F.col("action") == "makeMap", "{").when(F.col("action") == "makeList", "[").when(F.col("action") == "makeText", '"')
    shuts = F.when(F.col("id") == ROOT, "}").when(F.col("action").isin("makeMap", "makeTable"), "}").when(F.col("action") == "makeList", "]").when(F.col("action") == "makeText", '"')
    in_text = F.coalesce(F.col("kind") == "makeText", F.lit(False))
    enter = F.when(in_text, F.when(F.col("vtype") == "str", inside).otherwise("")).otherwise(F.concat(F.when(F.col("id") == ROOT, "").otherwise(named), F.coalesce(opens, plain)))
    leave = F.when(in_text, "").otherwise(F.coalesce(shuts, F.lit("")))
    # A comma goes before what another value ended before; that is known from the mark before it.
    ends = F.when(in_text, 2).otherwise(F.when(opens.isNotNull(), F.when((F.col("action") == "makeMap") & (F.col("kind") == "makeTable"), 1).otherwise(0)).otherwise(1))
    marks = v.select("doc_id", F.explode(F.array(F.struct(F.col("enter").alias("rank"), enter.alias("mark"), ends.alias("ends"), (~in_text & (F.col("id") != ROOT)).alias("value")), F.struct(F.col("leave").alias("rank"), leave.alias("mark"), F.when(in_text, 2).otherwise(1).alias("ends"), F.lit(False).alias("value")))).alias("m")).select("doc_id", "m.*")
    marks = work.put(marks, "marks")
    before = marks.select("doc_id", (F.col("rank") - 1).alias("rank"), F.col("ends").alias("ended"))
    joined = marks.join(before, ["doc_id", "rank"], "left").withColumn("mark", F.when(F.col("value") & (F.col("ended") == 1), F.concat(F.lit(","), "mark")).otherwise(F.col("mark")))
    longest = marks.groupBy("doc_id").agg(F.max("rank").alias("top"))
    placed = joined.join(longest, "doc_id").withColumn("part", F.floor((F.col("top") - F.col("rank")) / part).cast("int"))
    return placed.groupBy("doc_id", "part").agg(F.expr("listagg(mark, '') WITHIN GROUP (ORDER BY rank DESC)").alias("json"))
