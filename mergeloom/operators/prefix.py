"""Running totals, numbering and look-ups within keys that may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, by: list[str], value: str, bucket: Column, order: list[Column], name: str, least: bool = False) -> DataFrame:
    """Sum (the least, if ``least``) of ``value`` within ``by`` up to and with each row, in the order of (``bucket``, ``order``).

    ``bucket`` splits a key that has many rows: sums of whole buckets are added up
    first, then the rows within each. Nulls in ``by`` make a key of their own; null values count for nothing.
    """
    fold = F.min if least else F.sum
    cut = rows.withColumn("_b", bucket)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "_b").agg(fold(value).alias("_s")).withColumn("_start", fold("_s").over(before)).drop("_s")
    inside = fold(value).over(Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = F.least("_start", inside) if least else F.coalesce("_start", F.lit(0)) + F.coalesce(inside, F.lit(0))
    return _with_start(cut, sums, [*by, "_b"]).withColumn(name, both).drop("_start", "_b")


def _with_start(cut: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the ``_start`` of their bucket; nulls equal nulls."""
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return cut.join(starts, on).drop(*[f"_k{i}" for i in range(len(keys))])


CHUNK = 50_000  # numbers of an order that make a bucket


def chunk(order: str) -> Column:
    """Buckets of a whole number that rows are ordered by."""
    return F.floor(F.col(order) / CHUNK)


def before(rows: DataFrame, by: list[str], value: Column, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """``name``: the last ``value`` that is not null of the rows before each one within ``by``, in the order of (``bucket``, ``order``); null if there is none.

    Wrap values in a struct to get that of the very last row. Split by buckets as in ``running_total``.
    """
    cut = rows.withColumn("_b", bucket).withColumn("_carried", value)
    last = cut.groupBy(*by, "_b").agg(F.max_by("_carried", F.when(F.col("_carried").isNotNull(), F.struct(*order))).alias("_last"))
    upto = lambda *k: Window.partitionBy(*k[0]).orderBy(*k[1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = last.withColumn("_start", F.last("_last", ignorenulls=True).over(upto(by, ["_b"])))
    inside = F.last("_carried", ignorenulls=True).over(upto([*by, "_b"], order))
    return _with_start(cut, starts, [*by, "_b"]).withColumn(name, F.coalesce(inside, "_start")).drop("_start", "_b", "_carried")


def runs(rows: DataFrame, by: list[str], columns: list[str], same: Callable[[Column], Column], order: str, bucket: Column | None = None) -> DataFrame:
    """``run``, from 1, of every row within ``by``: a row begins a new one unless ``same`` (of the struct of ``columns`` in the row before) is true.

    ``order`` is a whole number, unique within ``by``; no task has more of a key than a bucket of it.
    """
    bucket = chunk(order) if bucket is None else bucket
    seen = before(rows, by, F.struct(*columns), bucket, [F.col(order)], "_before")
    new = seen.withColumn("_new", F.when(F.col("_before").isNotNull() & F.coalesce(same(F.col("_before")), F.lit(False)), 0).otherwise(1)).drop("_before")
    return running_total(new, by, "_new", bucket, [F.col(order)], "run").drop("_new")


def numbered(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``name``: place from 1 within ``by`` in the order of a whole number that is unique there."""
    return running_total(rows.withColumn("_one", F.lit(1).cast("long")), by, "_one", chunk(order), [F.col(order)], name).drop("_one")


SLICES = 1024  # of equally many rows, from which parts of a large key are put together


def even_parts(rows: DataFrame, by: str, value: str, size: int) -> DataFrame:
    """``part`` of every row: 0 for keys ``by`` of at most ``size`` rows, else ranges of ``value`` with about ``size`` rows each.

    Cut by quantiles, so it does not matter how values are spread; rows of one value stay together. A key of more than SLICES times
    ``size`` rows has SLICES parts.
    """
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size)
    # Quantiles only of those: fewer keys than one for every ``size`` rows.
    large = rows.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).groupBy("_by", "_n").agg(F.percentile_approx(value, [k / SLICES for k in range(1, SLICES)], 10_000).alias("_q"))
    large = large.withColumn("_parts", F.least(F.ceil(F.col("_n") / size), F.lit(SLICES)).cast("int"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda k: F.element_at("_q", (k * SLICES / F.col("_parts")).cast("int")))
    large = large.select("_by", cuts.alias("_cuts"))  # one row for every ``size`` rows of the table at most
    placed = rows.join(large, F.col(by).eqNullSafe(F.col("_by")), "left")
    return placed.withColumn("part", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value))))).drop("_by", "_cuts")


def hash_range(h: Column, ranges: int) -> Column:
    """Which of ``ranges`` equally wide ranges a 64-bit hash is in: to order by range and hash is to order by the hash, however many there are."""
    return F.shiftright((F.shiftright(h, 33) + F.lit(1 << 30)) * F.lit(ranges), 31).cast("int")


MANY = 1024  # keys that may each hold more than a share of 1 / MANY of the rows: fewer than that, so they can be broadcast


def looked_up(rows: DataFrame, found: DataFrame, by: list[str], n_rows: int, n: str = "n") -> DataFrame:
    """``rows`` joined with ``found``, which has one row per key ``by`` and in ``n`` how many of the ``n_rows`` rows have it.

    Keys with more than a share of 1 / MANY are fewer than MANY, whatever the data, and are broadcast, so their rows stay
    where they are; only the rest is shuffled. ``found`` should be a written table. ``n`` is dropped.
    """
    hot = found.filter(F.col(n) > F.lit(n_rows / MANY))
    cold = found.filter(F.col(n) <= F.lit(n_rows / MANY)).drop(n)
    there = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(cold, by)
    return rows.join(F.broadcast(hot.drop(n)), by).unionByName(there)
