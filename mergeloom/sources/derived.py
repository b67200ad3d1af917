"""Operation and change tables: cleaned from the log, and derived from ordinary tables.

The derived ones are SQL that Spark and DuckDB both run, so that a query and what it is
compared with start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bare_key, clean_hash, object_id, opid
from ..operators.redelivery import change_hashes, deduplicated, deliveries
from ..storage import Workspace


def logged_ops(log: DataFrame) -> DataFrame:
    """Operations of ``op_log``, each once, in the form the operators take.

    Repeats are one operation if they are equal once keys are bare and ``pred`` is sorted and distinct.
    """
    actor = bare_key(F.col("actor"))
    pred = F.transform("pred", lambda p: F.struct(p["ctr"].alias("ctr"), bare_key(p["actor"]).alias("actor")))
    elem = F.when(F.col("elem").isNotNull(), F.when(F.col("elem.ctr") == 0, F.lit("_head")).otherwise(opid(F.col("elem.ctr"), bare_key(F.col("elem.actor")))))
    return log.select(
        "doc_id", "ctr", actor.alias("actor"), object_id(F.col("obj")).alias("obj"), "key", elem.alias("elem"), F.coalesce("is_insert", F.lit(False)).alias("insert"), "action", F.col("val.vtype").alias("vtype"),
        F.col("val.i").alias("i"), F.col("val.d").alias("d"), F.col("val.s").alias("s"), F.col("val.b").alias("b"), F.array_sort(F.array_distinct(F.coalesce(pred, F.array().cast("array<struct<ctr:bigint,actor:string>>")))).alias("pred"),
        clean_hash(F.col("change_hash")).alias("change_hash"),
    ).filter("ctr is not null and actor is not null").dropDuplicates(["doc_id", "ctr", "actor"])


def logged_changes(feed: DataFrame) -> DataFrame:
    """Changes of ``change_feed`` that have a hash, each once: ``doc_id, hash, actor, seq, start_op, max_op, deps, received_at``.

    They are as their first delivery has them; if that has no hash, it is the one another delivery gives.
    """
    deps = F.filter(F.transform("deps", bare_key), lambda d: d != "")
    kept = deduplicated(feed).select(
        "delivery_id", "doc_id", clean_hash(F.col("hash")).alias("hash"), bare_key(F.col("actor")).alias("actor"), "seq", "start_op", (F.col("start_op") + F.col("n_ops") - 1).alias("max_op"),
        F.array_sort(F.array_distinct(F.coalesce(deps, F.array().cast("array<string>")))).alias("deps"), "received_at",
    )
    kept = Workspace(feed.sparkSession, "kept").put(kept, "kept")
    given = change_hashes(deliveries(feed))[1].filter("hash is not null").select("delivery_id", F.col("hash").alias("given"))
    bare = kept.filter("hash is null").join(given, "delivery_id").withColumn("hash", F.col("given")).select(kept.columns)
    return kept.filter("hash is not null").unionByName(bare).drop("delivery_id")


#: Eight actors edit 25 keys of a map; within a day each on its own, at midnight all merge.
EVENT_OPS = """ev AS (
  SELECT event_id, value, lpad(CAST(user_id % 8 AS {S}), 8, '0') AS actor, {DAY} AS epoch,
         concat('k', CAST(event_id % 25 AS {S})) AS key, CASE WHEN event_type = 'error' THEN 'del' ELSE 'set' END AS action FROM events),
rn AS (SELECT *, row_number() OVER (PARTITION BY actor, epoch ORDER BY event_id) AS rn FROM ev),
mx AS (SELECT epoch, max(rn) AS mx FROM rn GROUP BY epoch),
base AS (SELECT epoch, coalesce(sum(mx) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM mx),
op AS (SELECT rn.event_id, rn.actor, rn.epoch, rn.key, rn.action, rn.value, CAST(base.base + rn.rn AS BIGINT) AS ctr FROM rn JOIN base ON rn.epoch = base.epoch),
tail AS (SELECT key, epoch, actor, max(ctr) AS ctr FROM op GROUP BY key, epoch, actor),
ke AS (SELECT key, epoch, lag(epoch) OVER (PARTITION BY key ORDER BY epoch) AS prev FROM (SELECT DISTINCT key, epoch FROM op) x),
own AS (SELECT *, lag(ctr) OVER (PARTITION BY key, epoch, actor ORDER BY ctr) AS p FROM op),
cand AS (
  SELECT ctr, actor, p AS pctr, actor AS pactor FROM own WHERE p IS NOT NULL
  UNION ALL
  SELECT o.ctr, o.actor, t.ctr, t.actor FROM own o JOIN ke ON ke.key = o.key AND ke.epoch = o.epoch JOIN tail t ON t.key = o.key AND t.epoch = ke.prev WHERE o.p IS NULL),
pred AS (SELECT c.* FROM cand c JOIN op t ON t.ctr = c.pctr AND t.actor = c.pactor WHERE t.action <> 'del')"""

#: A change per actor and day; it depends on all changes of the day before that has any.
EVENT_CHANGES = """ch AS (SELECT actor, epoch, min(ctr) AS start_op, max(ctr) AS max_op, count(*) AS n_ops FROM op GROUP BY actor, epoch),
days AS (SELECT epoch, lag(epoch) OVER (ORDER BY epoch) AS prev FROM (SELECT DISTINCT epoch FROM ch) x),
chg AS (SELECT ch.*, CAST(row_number() OVER (PARTITION BY actor ORDER BY ch.epoch) AS BIGINT) AS seq, CAST(row_number() OVER (ORDER BY ch.epoch, actor) AS BIGINT) AS arrival,
  {HASH} AS hash FROM ch),
dep AS (SELECT c.hash, p.hash AS dep FROM chg c JOIN days d ON d.epoch = c.epoch JOIN chg p ON p.epoch = d.prev)"""

_SPARK = {"S": "STRING", "DAY": "datediff(ts, DATE'2024-01-01')", "HASH": "sha2(concat_ws('|', actor, CAST(ch.epoch AS STRING)), 256)"}
_DUCK = {"S": "VARCHAR", "DAY": "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))", "HASH": "sha256(concat_ws('|', actor, CAST(ch.epoch AS VARCHAR)))"}


def _filled(sql: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def spark_sql(*parts: str) -> str:
    return "WITH " + _filled(",\n".join(parts), _SPARK)


def duck_sql(*parts: str) -> str:
    return "WITH " + _filled(",\n".join(parts), _DUCK)


def _run(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(query.replace("FROM events)", "FROM {events})"), events=events)


_derived: dict[tuple[str, str, str], DataFrame] = {}


def _once(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A derived log is written once for each folder of tables and session."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        if key not in _derived:
            _derived[key] = make(spark, sf_dir)
        return _derived[key]

    get.__doc__ = make.__doc__
    return get


@_once
def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map log: operations in the form the operators take, with ``value`` and ``change_hash``."""
    op = _run(spark, sf_dir, spark_sql(EVENT_OPS) + " SELECT op.*, sha2(concat_ws('|', actor, CAST(epoch AS STRING)), 256) AS change_hash FROM op")
    pred = _run(spark, sf_dir, spark_sql(EVENT_OPS) + " SELECT * FROM pred").groupBy("ctr", "actor").agg(F.sort_array(F.collect_list(F.struct(F.col("pctr").alias("ctr"), F.col("pactor").alias("actor")))).alias("pred"))
    none = F.lit(None)
    ops = op.join(pred, ["ctr", "actor"], "left").select(
        F.lit("map").alias("doc_id"), "ctr", "actor", F.lit("_root").alias("obj"), "key", none.cast("string").alias("elem"), F.lit(False).alias("insert"), "action", F.lit("float64").alias("vtype"), none.cast("long").alias("i"),
        F.coalesce("pred", F.array().cast("array<struct<ctr:bigint,actor:string>>")).alias("pred"), "value", "change_hash", "event_id",
    )
    return Workspace(spark, "event-ops").put(ops, "ops")  # operators read it more than once


@_once
def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of the map log: ``doc_id, hash, actor, epoch, seq, start_op, max_op, n_ops, arrival, deps``."""
    chg = _run(spark, sf_dir, spark_sql(EVENT_OPS, EVENT_CHANGES) + " SELECT * FROM chg")
    dep = _run(spark, sf_dir, spark_sql(EVENT_OPS, EVENT_CHANGES) + " SELECT * FROM dep").groupBy("hash").agg(F.sort_array(F.collect_list("dep")).alias("deps"))
    changes = chg.join(dep, "hash", "left").select(F.lit("map").alias("doc_id"), "hash", "actor", "epoch", "seq", "start_op", "max_op", "n_ops", "arrival", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))
    return Workspace(spark, "event-changes").put(changes, "changes")


_OP = "array<struct<ctr:bigint,actor:string>>"


def table_ops(rows: DataFrame, table: str, key: str, columns: dict[str, str]) -> DataFrame:
    """Operations that make a table of a document: ``table`` under the root, a map for each row, a value for each column that is not null.

    The row's id is cut from the hash of table and primary key. Counters follow the key, a whole number from 0 on, so the log needs no window. Every second column
    was first set to null, and set again by another actor who had seen it; every row has a value beside that of ``key`` which loses against it.
    """
    row_id = F.substring(F.sha2(F.concat_ws("|", F.lit(table), F.col(key).cast("string")), 256), 1, 32)
    k = len(columns)
    base = F.col(key).cast("long") * (2 * k + 2) + 2  # of the row's own operation
    none = F.array().cast(_OP)
    field = {"string": "s", "double": "d", "float": "d", "int": "i", "bigint": "i", "boolean": "b"}
    kind = {"s": "str", "d": "float64", "i": "int", "b": "bool"}

    def op(ctr: Column, actor: str, obj: Column, at: Column, action: str, vtype: str | None = None, value: Column | None = None, pred: Column | None = None) -> Column:
        values = {f: (value.cast(t) if value is not None and f == {v: u for u, v in kind.items()}.get(vtype) else F.lit(None).cast(t)) for f, t in (("i", "long"), ("d", "double"), ("s", "string"), ("b", "boolean"))}
        return F.struct(ctr.alias("ctr"), F.lit(actor).alias("actor"), obj.alias("obj"), at.alias("key"), F.lit(action).alias("action"), F.lit(vtype).cast("string").alias("vtype"), *[c.alias(f) for f, c in values.items()], (none if pred is None else pred).alias("pred"))

    made = opid(base, F.lit("aa"))
    each = [op(base, "aa", F.lit("1@aa"), row_id, "makeMap")]
    for n, (c, t) in enumerate(columns.items()):
        f = field[t]
        ctr = base + 1 + 2 * n
        there = F.col(c).isNotNull()
        if n % 2:
            each.append(F.when(there, op(ctr, "aa", made, F.lit(c), "set", "null")))
            each.append(F.when(there, op(ctr + 1, "bb", made, F.lit(c), "set", kind[f], F.col(c), F.array(F.struct(ctr.alias("ctr"), F.lit("aa").alias("actor"))))))
        else:
            each.append(F.when(there, op(ctr, "aa", made, F.lit(c), "set", kind[f], F.col(c))))
        if c == key:
            each.append(op(base, "bb", made, F.lit(c), "set", kind[f], -F.col(c)))
    ops = rows.select(F.explode(F.array_compact(F.array(*each))).alias("o")).select("o.*")
    first = rows.sparkSession.range(1).select(op(F.lit(1).cast("long"), "aa", F.lit("_root"), F.lit(table), "makeTable").alias("o")).select("o.*")
    return ops.unionByName(first).select(F.lit("doc").alias("doc_id"), "*", F.lit(None).cast("string").alias("elem"), F.lit(False).alias("insert"))
