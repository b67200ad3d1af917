"""Tables inside documents, and changes of what is shown.

A table is an object made by ``makeTable``; its rows are maps made under the row's id, and
the cells of a row are the winners of its keys. Functions that make rows take operations
as ``visibility`` does, with ``d`` and ``b`` for floating-point and boolean values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import opid
from .prefix import running_total, runs
from .sequences import LIST, crdt_list_order
from .visibility import agg_lww, visible

VALUES = ("action", "vtype", "s", "value_i", "d", "b")
_FIELD = {"string": "s", "bigint": "value_i", "int": "value_i", "double": "d", "float": "d", "boolean": "b"}


def winners(ops: DataFrame) -> DataFrame:
    """The value of every cell: ``doc_id, obj, cell, ctr, actor``, those named in VALUES, and ``n_values``."""
    return agg_lww(visible(ops), *VALUES)


def table_cells(top: DataFrame) -> DataFrame:
    """Cells of the rows of all tables, from ``winners``: ``doc_id, table_id, row_id, column, op_id``, the values, and ``n_values``.

    A row whose own cell is not won by a map is no row. Whether the table itself is reachable does not matter. A row without cells has none here.
    """
    made = top.filter("action in ('makeTable', 'makeMap')").select("doc_id", "obj", "cell", "action", opid(F.col("ctr"), F.col("actor")).alias("object_id"))
    held = made.filter("action = 'makeTable'").select("doc_id", F.col("object_id").alias("table_id"))
    rows = made.filter("action = 'makeMap'").select("doc_id", F.col("obj").alias("table_id"), F.col("cell").alias("row_id"), F.col("object_id").alias("obj")).join(held, ["doc_id", "table_id"], "left_semi")
    cells = top.join(rows, ["doc_id", "obj"]).withColumn("op_id", opid(F.col("ctr"), F.col("actor")))
    return cells.select("doc_id", "table_id", "row_id", F.col("cell").alias("column"), "op_id", *VALUES, "n_values")


def crdt_table_state(ops: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of all tables: ``doc_id, table_id, id`` and the named columns, each read as its type; null where a row has no such cell or one of another type."""
    value = {c: F.max(F.when(F.col("column") == c, F.col(_FIELD[t]))).cast(t).alias(c) for c, t in columns.items()}
    return table_cells(winners(ops)).groupBy("doc_id", "table_id", F.col("row_id").alias("id")).agg(*value.values())


def flt_table_filter(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.filter(condition)


def flt_table_find(rows: DataFrame, condition: Column) -> DataFrame:
    """The first row that meets a condition, by id."""
    return rows.filter(condition).orderBy("id").limit(1)


def flt_table_by_id(rows: DataFrame, row_id: str) -> DataFrame:
    return rows.filter(F.col("id") == row_id)


def prj_table_map(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select("id", *[c.alias(k) for k, c in columns.items()])


def _sort_keys(rows: DataFrame, by: list[str]) -> list[Column]:
    """Numbers by value, everything else as text; what is missing as ``undefined``."""
    numeric = {c for c, t in rows.dtypes if t in ("int", "bigint", "double", "float")}
    return [F.col(c) if c in numeric else F.coalesce(F.col(c).cast("string"), F.lit("undefined")) for c in by]


def srt_table(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows in order of the columns, then of their ids; of the ids if none is given."""
    return rows.orderBy(*_sort_keys(rows, by or []), F.col("id"))


def srt_table_places(rows: DataFrame, part: str, by: list[str]) -> DataFrame:
    """``place`` of each row, from 1, in the order of ``srt_table`` within ``part``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(part).orderBy(*_sort_keys(rows, by), F.col("id"))))


def agg_table_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"))


def flt_equals(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side; none if both are equal."""
    a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def crdt_inc_patch(before: DataFrame, after: DataFrame, cell: list[str]) -> DataFrame:
    """What changed between two states of cells: ``*cell, edit, before_id, after_id``.

    States have ``*cell, op_id, n_values``; ``edit`` is ``insert``, ``remove``, ``update`` (another winner) or
    ``conflict`` (the winner stays, the number of values changes). Unchanged cells are left out.
    """
    b = before.select(*[F.col(c).alias(f"_{c}") for c in cell], F.col("op_id").alias("before_id"), F.col("n_values").alias("bn"))
    a = after.select(*cell, F.col("op_id").alias("after_id"), F.col("n_values").alias("an"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cell]
    edit = (
        F.when(F.col("before_id").isNull(), "insert").when(F.col("after_id").isNull(), "remove").when(F.col("before_id") != F.col("after_id"), "update").when(F.col("bn") != F.col("an"), "conflict")
    )
    both = a.join(b, on, "full").withColumn("edit", edit).filter("edit is not null")
    return both.select(*[F.coalesce(c, f"_{c}").alias(c) for c in cell], "edit", "before_id", "after_id")


def crdt_apply_patch(before: DataFrame, patch: DataFrame, cell: list[str]) -> DataFrame:
    """The state after a ``crdt_inc_patch``: ``*cell, op_id``. What the patch does not name stays."""
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cell]
    touched = patch.select(*[F.col(c).alias(f"_{c}") for c in cell])
    kept = before.select(*cell, "op_id").join(touched, on, "left_anti")
    return kept.unionByName(patch.filter("edit <> 'remove'").select(*cell, F.col("after_id").alias("op_id")))


_CHUNK = 50_000  # tour ranks whose elements one task counts


def _elements(ops: DataFrame) -> DataFrame:
    order = F.struct("ctr", "actor")
    seen = visible(ops).filter("key is null")
    top = seen.groupBy(*LIST, F.col("cell").alias("elem")).agg(F.max(order).alias("w"), F.max_by("vtype", order).alias("vtype"), F.max_by("action", order).alias("action"), F.count(F.lit(1)).alias("n_values"))
    return top.select(*LIST, "elem", opid(F.col("w.ctr"), F.col("w.actor")).alias("op_id"), "vtype", "action", "n_values")


def list_patch(before: DataFrame, after: DataFrame) -> DataFrame:
    """What makes the lists of the operations ``before`` those of ``after``, which has all of them and more.

    ``doc_id, obj, elem, idx, edit, before_idx, before_id, after_id, vtype, action``, with ``edit`` one of ``insert``, ``remove``, ``update`` (another winner, or
    ``conflict``: other values beside it) and ``keep``. Done in the order of ``place``, from the front of a list to its end, each edit is at ``idx`` of the list as it
    then is; ``before_idx`` is where an element was. So an element that is kept moved from ``before_idx`` to ``idx``.
    """
    b = _elements(before).select(*LIST, "elem", F.col("op_id").alias("before_id"), F.col("n_values").alias("bn"))
    both = _elements(after).withColumnRenamed("op_id", "after_id").join(b, [*LIST, "elem"], "full").join(crdt_list_order(after), [*LIST, "elem"])
    both = both.withColumns({"new": F.col("after_id").isNotNull().cast("long"), "old": F.col("before_id").isNotNull().cast("long")})
    by, order = F.floor(-F.col("entry_rank") / _CHUNK), [F.col("entry_rank").desc()]
    both = running_total(running_total(both, LIST, "new", by, order, "n_new"), LIST, "old", by, order, "n_old")
    edit = F.when(F.col("old") == 0, "insert").when(F.col("new") == 0, "remove").when(F.col("before_id") != F.col("after_id"), "update").when(F.col("bn") != F.col("n_values"), "conflict").otherwise("keep")
    return both.select(*LIST, "elem", (F.col("n_new") - F.col("new")).alias("idx"), edit.alias("edit"), F.when(F.col("old") == 1, F.col("n_old") - 1).alias("before_idx"), "before_id", "after_id", "vtype", "action", F.col("entry_rank").alias("place"))


def multi_inserts(patch: DataFrame) -> DataFrame:
    """Runs of insertions of a ``list_patch`` that one edit of several values can say: ``doc_id, obj, idx, elem, n``.

    In a run, each is next to the one before, of the same actor and type of value, with the following counter, and each element still has the value that it was inserted with.
    """
    part = F.split("elem", "@")
    new = patch.filter("edit = 'insert'").withColumns({"c": part[0].cast("long"), "by": part[1], "plain": F.expr("action = 'set' and after_id = elem")})
    # Such neighbours have one difference of index and counter in common; nothing else has.
    by = [*LIST, "by", "line"]
    same = lambda b: (b["idx"] == F.col("idx") - 1) & b["vtype"].eqNullSafe(F.col("vtype")) & b["plain"] & F.col("plain")
    found = runs(new.withColumn("line", F.col("idx") - F.col("c")), by, ["idx", "vtype", "plain"], same, "idx")
    return found.groupBy(*LIST, "by", "line", "run").agg(F.min("idx").alias("idx"), F.min_by("elem", "idx").alias("elem"), F.count(F.lit(1)).alias("n")).select(*LIST, "idx", "elem", "n")


def apply_list_patch(patch: DataFrame) -> DataFrame:
    """The lists after a ``list_patch``, which names what is kept too: ``doc_id, obj, elem, idx, op_id``."""
    return patch.filter("edit <> 'remove'").select(*LIST, "elem", "idx", F.col("after_id").alias("op_id"))
