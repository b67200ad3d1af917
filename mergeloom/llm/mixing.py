"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in shuffled order, gets a virtual finish time: the tokens
of its source up to and with it, divided by the source's weight. In the order of finish
times every source has its share at any point, so the mixture is that order up to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import hash_range, running_total
from ..storage import Workspace

BUCKET_ROWS = 100_000


def source_name(c: Column) -> Column:
    """A source's name: letter case and white space don't count."""
    return F.regexp_replace(F.lower(c), r"\s+", "")


def targets_of(targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats`` with clean names; a source named twice has the sum of its shares and its least repeats."""
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    return t.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, work: Workspace | None = None) -> DataFrame:
    """The mixture of ``sizes`` (``doc_id, source, n_tokens``), in order.

    ``targets`` has ``source, target_share, max_repeats``, a list of settings read by the driver. Result:
    ``place, doc_id, source, pass_no, n_tokens, finish``. ``budget`` is the total of
    tokens; without one it is the greatest at which every source that has documents
    reaches its share, repeating no document more than ``max_repeats`` times. With a
    greater budget, a source that runs out stays below its share. The shares of sources
    without any document fall to the others in proportion. Documents without
    tokens, without source or of a source without target are not used.
    """
    work = work or Workspace(sizes.sparkSession, "mixing")
    docs = sizes.select("doc_id", source_name(F.col("source")).alias("source"), "n_tokens").filter("n_tokens > 0 and source is not null")
    docs = docs.join(targets_of(targets), "source")
    stats = docs.groupBy("source", "target_share", "max_repeats").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("n")).collect()
    weight = {r["source"]: r["target_share"] / sum(x["target_share"] for x in stats) for r in stats}
    if budget is None:
        budget = int(min((r["total"] * r["max_repeats"] / weight[r["source"]] for r in stats), default=0))
    table = sizes.sparkSession.createDataFrame(
        [(r["source"], weight[r["source"]], r["total"], min(r["max_repeats"], int(weight[r["source"]] * budget // r["total"]) + 1)) for r in stats], "source string, weight double, total long, passes int"
    )
    buckets = max(1, -(-sum(r["n"] * r["max_repeats"] for r in stats) // BUCKET_ROWS))
    used = docs.select("source", "doc_id", "n_tokens").join(table, "source").withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    used = used.withColumn("shuffled", F.xxhash64(F.lit(seed), "pass_no", "doc_id", "source"))
    by = ["source", "pass_no"]
    queued = running_total(used, by, "n_tokens", hash_range(F.col("shuffled"), buckets), [F.col("shuffled"), F.col("doc_id")], "upto")
    finish = ((F.col("pass_no") - 1) * F.col("total") + F.col("upto")) / F.col("weight")
    kept = queued.withColumn("finish", finish).filter(F.col("finish") <= float(budget))
    kept = work.put(kept.select("doc_id", "source", "pass_no", "n_tokens", "finish", F.lit(1).alias("one"), F.lit(0).alias("all")), "kept")
    # Finish times are spread evenly over the budget, so equal ranges of them are equal work.
    piece = F.floor(F.col("finish") / F.lit(max(budget, 1) / buckets)).cast("int")
    order = [F.col("finish"), F.col("source"), F.col("pass_no"), F.col("doc_id")]
    return running_total(kept, ["all"], "one", piece, order, "place").select("place", "doc_id", "source", "pass_no", "n_tokens", "finish")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share and the actual one, tokens, rows, distinct documents and how often one was used at most."""
    per_doc = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum("n_tokens").alias("t"))
    per = per_doc.groupBy("source").agg(F.sum("t").alias("n_tokens"), F.sum("times").alias("n_rows"), F.count(F.lit(1)).alias("n_docs"), F.max("times").alias("most_used"))
    out = targets_of(targets).join(per, "source", "left").fillna(0, ["n_tokens", "n_rows", "n_docs", "most_used"])
    out = out.withColumn("everything", F.sum("n_tokens").over(Window.partitionBy(F.lit(1))))  # as many rows as targets
    return out.select("source", "target_share", F.coalesce(F.round(F.try_divide("n_tokens", "everything"), 6), F.lit(0.0)).alias("actual_share"), "n_tokens", "n_rows", "n_docs", "most_used", "max_repeats")


def broken(mixture: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source that has documents: how many of them were used more often than allowed, whether its share is off, and how many of its rows are other than its own documents.

    A source is at its share of the budget but for less than its longest document, and so is the total but for the sum of these; a share is off if its tokens differ by more than both allow.
    """
    per_doc = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum("n_tokens").alias("t"))
    has = sizes.select("doc_id", source_name(F.col("source")).alias("source"), "n_tokens").filter("n_tokens > 0")
    real = has.join(targets_of(targets), "source")
    there = real.groupBy("source", "target_share", "max_repeats").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_tokens").alias("longest"))
    strange = per_doc.join(real.select("source", "doc_id"), ["source", "doc_id"], "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("strange"))
    limits = targets_of(targets).select("source", "max_repeats")
    used = per_doc.join(F.broadcast(limits), "source").groupBy("source").agg(F.count_if(F.expr("times > max_repeats")).alias("over_used"), F.sum("t").alias("t"))
    out = there.join(used, "source", "left").join(strange, "source", "left")
    every = Window.partitionBy(F.lit(1))  # as many rows as targets
    weight = F.col("target_share") / F.sum("target_share").over(every)
    off = F.abs(F.coalesce("t", F.lit(0)) - weight * F.sum("t").over(every)) > F.col("longest") + weight * F.sum("longest").over(every)
    return out.select("source", "n_docs", F.coalesce("over_used", F.lit(0)).alias("over_used"), F.coalesce("strange", F.lit(0)).alias("strange"), off.alias("share_off"))
