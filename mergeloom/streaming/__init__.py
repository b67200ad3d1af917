"""Changes as a stream: each batch is deduplicated, applied as far as possible, and reported as a patch.

What is stored are tables in a folder: applied changes and their operations, and changes
that wait for others. A change may come at any time and in any order; none is dropped
for being late, so no watermark is used. Tables are divided by buckets of documents: a batch
reads those of its documents only, and only cells that it touches are computed anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import opid
from ..operators import dag, tables, visibility

CHANGES = "doc_id string, hash string, actor string, seq long, deps array<string>"
OPS = "doc_id string, change_hash string, ctr long, actor string, obj string, key string, elem string, insert boolean, action string, vtype string, i long, s string, pred array<struct<ctr:bigint,actor:string>>"
#: Floating-point and boolean values, kept if a batch has them.
STORED_OPS = OPS + ", d double, b boolean"
BUCKETS = 64


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))


class Store:
    """Tables of a replica under ``path``, in generations: a batch writes a new one and then names it, so a batch that fails leaves no trace."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs.Path

    def generation(self) -> int:
        """The last generation that is complete, -1 if there is none."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return -1
        done = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return max((int(n[5:]) for n in done if n.startswith("done-")), default=-1)

    def read(self, table: str, schema: str, buckets: list[int] | None = None, only: int | None = None) -> DataFrame:
        """Rows of a table, of some buckets if given: of all complete generations, or of ``only`` one. Folders that are not asked for are not read."""
        g = self.generation()
        if g < 0 and only is None:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema + ", gen int, bucket int").parquet(f"{self.path}/{table}")
        rows = rows.filter(F.col("gen") <= g) if only is None else rows.filter(F.col("gen") == only)
        return (rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).drop("gen", "bucket")

    def applied(self, buckets: list[int] | None = None) -> DataFrame:
        return self.read("applied", CHANGES, buckets)

    def ops(self, buckets: list[int] | None = None) -> DataFrame:
        return self.read("ops", STORED_OPS, buckets)

    def waiting(self) -> DataFrame:
        """Changes that wait, as the last generation has them."""
        return self._last("waiting", CHANGES)

    def _last(self, table: str, schema: str) -> DataFrame:
        g = self.generation()
        return self.read(table, schema, only=g if g >= 0 else None)

    def apply(self, changes: DataFrame, ops: DataFrame) -> DataFrame:
        """Take in a batch; returns the patch: ``doc_id, obj, cell, edit, before_id, after_id``."""
        g = self.generation() + 1
        ops = ops.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("d", "double"), ("b", "boolean")) if c not in ops.columns])
        mine = [r[0] for r in _bucketed(changes.select("doc_id").unionByName(self.waiting().select("doc_id"))).select("bucket").distinct().collect()]  # at most BUCKETS
        old, old_ops = self.applied(mine), self.ops(mine)
        new = changes.unionByName(self.waiting()).dropDuplicates(dag.KEY).join(old.select(*dag.KEY), dag.KEY, "left_anti")
        new_ops = ops.unionByName(self._last("waiting_ops", STORED_OPS)).dropDuplicates(["doc_id", "ctr", "actor"])
        known = old.select("doc_id", F.col("hash").alias("dep"))
        # What is stored is closed, so a change is blocked by what the batch lacks alone.
        inner = new.withColumn("dep", F.explode_outer("deps")).join(known, ["doc_id", "dep"], "left_anti")
        open_deps = inner.filter("dep is not null").groupBy(*dag.KEY).agg(F.collect_list("dep").alias("deps"))
        reduced = new.select(*dag.KEY).join(open_deps, dag.KEY, "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
        blocked = dag.dag_blocked(reduced)
        ready = new.join(blocked, dag.KEY, "left_anti")
        by = ["doc_id", "change_hash"]
        ready_keys = ready.select("doc_id", F.col("hash").alias("change_hash"))
        names = {"applied": (ready, CHANGES), "ops": (new_ops.join(ready_keys, by, "left_semi"), STORED_OPS), "waiting": (new.join(blocked, dag.KEY, "left_semi"), CHANGES), "waiting_ops": (new_ops.join(blocked.withColumnRenamed("hash", "change_hash"), by, "left_semi"), STORED_OPS)}
        for name, (df, schema) in names.items():
            cols = [c.split()[0] for c in schema.split(", ")]
            _bucketed(df.select(*cols)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/gen={g}")
        fs, path = self._fs()
        fs.create(path(f"{self.path}/done-{g}"), True).close()
        added = self.read("ops", STORED_OPS, mine, only=g)
        touched = visibility.cells(added).select(*visibility.CELL).distinct()
        return tables.crdt_inc_patch(_winners(old_ops, touched), _winners(old_ops.unionByName(added), touched), visibility.CELL)


def _winners(ops: DataFrame, touched: DataFrame) -> DataFrame:
    """Present values of the touched cells only."""
    mine = visibility.cells(ops).join(touched, visibility.CELL, "left_semi").drop("cell")
    return visibility.agg_lww(visibility.visible(mine)).select(*visibility.CELL, opid(F.col("ctr"), F.col("actor")).alias("op_id"), "n_values")


def run(stream: DataFrame, store: Store, checkpoint: str, on_patch: Callable[[DataFrame, int], None] | None = None):
    """Start applying a stream of changes with ``ops`` inside (an array of structs). ``on_patch`` gets each batch's patch.

    A batch that is delivered again after a failure changes nothing: its changes are known.
    """

    def take(batch: DataFrame, n: int) -> None:
        changes = batch.select("doc_id", "hash", "actor", "seq", "deps")
        ops = batch.select("doc_id", F.col("hash").alias("change_hash"), F.explode("ops").alias("o")).select("doc_id", "change_hash", "o.*")
        patch = store.apply(changes, ops)
        if on_patch:
            on_patch(patch, n)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
