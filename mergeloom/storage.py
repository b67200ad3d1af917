"""Intermediate tables in the folder that all executors share.

A job that goes on in rounds cuts its lineage by writing a table and reading it
again. The folder is the one the cluster names in ``spark.checkpoint.dir``; only
where that is unset (tests, a single machine) is a local one made.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a slash at the end."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="mergeloom-")
    return _own[app]


class Workspace:
    """Tables of one run. ``drop`` removes one early; leaving ``with`` removes all, and what is left then goes when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self._clear()

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def put(self, df: DataFrame, table: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` and return what reads it back, with the same schema; a folder for each value of ``by``, so that readers skip the others."""
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(self.path(table))
        return self.spark.read.schema(schema).parquet(self.path(table))

    def append(self, df: DataFrame, table: str, by: tuple[str, ...] = ()) -> DataFrame:
        schema = df.schema
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(self.path(table))
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for t in tables:
            self._delete(self.path(t))

    def free_shuffles(self) -> None:
        """Let Spark delete shuffle files of earlier rounds: it does so when its driver has collected garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, uri: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def _clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended before Python did
            if self.root.startswith("file:"):
                import shutil

                shutil.rmtree(self.root.removeprefix("file://"), ignore_errors=True)
