"""Column encodings as window queries: runs, differences, alternating counts, dictionaries.

``part`` names what a column is encoded within; order is by ``order``, a whole number that must be unique there. Each part
may be of any size: it is split into buckets of the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import before, chunk, running_total, runs


def enc_rle(rows: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbours (nulls equal nulls): ``*part, run, start, value, n``."""
    found = runs(rows, part, [value], lambda b: b[value].eqNullSafe(F.col(value)), order)
    return found.groupBy(*part, "run").agg(F.min(order).alias("start"), F.first(value).alias("value"), F.count(F.lit(1)).alias("n"))


def dec_rle(found: DataFrame, part: list[str]) -> DataFrame:
    """The values again, in order: ``*part, place, value`` with ``place`` from 1."""
    ended = running_total(found, part, "n", chunk("run"), [F.col("run")], "ended")
    return ended.select(*part, "value", F.explode(F.sequence(F.col("ended") - F.col("n") + 1, F.col("ended"))).alias("place"))


def enc_delta(rows: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """Difference to the last value that is not null, of the first to 0; null stays null and moves nothing."""
    seen = before(rows, part, F.col(value), chunk(order), [F.col(order)], "_last")
    return seen.withColumn("delta", F.col(value) - F.coalesce("_last", F.lit(0))).drop("_last")


def dec_delta(rows: DataFrame, part: list[str], order: str) -> DataFrame:
    """Values again from ``delta``."""
    total = running_total(rows, part, "delta", chunk(order), [F.col(order)], "_total")
    return total.withColumn("value", F.when(F.col("delta").isNotNull(), F.col("_total"))).drop("_total")


def enc_bool(rows: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """Counts of alternating runs beginning with false (0 if the first is true); null counts as false: ``*part, run, n``."""
    flags = rows.withColumn("_v", F.coalesce(value, F.lit(False)))
    found = enc_rle(flags, part, order, "_v")
    first = found.filter("run = 1 and value").select(*part, F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("n"))
    starts = found.filter("run = 1").select(*part, F.col("value").cast("long").alias("shift"))
    shifted = found.join(starts, part).select(*part, (F.col("run") - 1 + F.col("shift")).alias("run"), "n")
    return shifted.unionByName(first)


def enc_actor_dict(rows: DataFrame, part: list[str], actor: str) -> DataFrame:
    """Place of every actor, from 0, among the sorted actors: ``*part, actor, num``."""
    distinct = rows.select(*part, actor).distinct()
    return distinct.withColumn("num", (F.row_number().over(Window.partitionBy(*part).orderBy(actor)) - 1).cast("long"))


def enc_multi_op(rows: DataFrame, start: str, width: str) -> DataFrame:
    """One row per operation that a multiple one stands for: ``ctr`` counts on from ``start``. Widths below 1 give none."""
    return rows.filter(F.col(width) >= 1).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(width) - 1))).withColumn("ctr", F.col(start) + F.col("k")).drop("k")


def unsorted_preds(ops: DataFrame) -> DataFrame:
    """Rows whose predecessors are not ascending and distinct."""
    ok = F.array_sort(F.array_distinct("pred")) == F.col("pred")
    return ops.filter("pred is not null").filter(~ok)
