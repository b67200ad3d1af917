"""Queries of the general training-data problems, with SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes_applied, hierarchy, redelivery, references

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivery.repeats(table(spark, sf_dir, "change_feed")).select("delivery_id")


def p1_kept_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries left per day of arrival."""
    kept = redelivery.deduplicated(table(spark, sf_dir, "change_feed"))
    return kept.groupBy(F.to_date("received_at").alias("day")).agg(F.count(F.lit(1)).alias("n_kept"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_applied.present_values(table(spark, sf_dir, "op_log"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.tree_of_objects(table(spark, sf_dir, "op_log")).select("doc_id", "object_id", "root_id", "tree_depth", "key_path")


def p4_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry and exit in the tour of the topmost object, as ranks from its end, and how many objects lie between.

    Descendants of an object are those of the same ``doc_id`` and ``root_id`` with a lower entry and a higher exit.
    """
    return hierarchy.tree_of_objects(table(spark, sf_dir, "op_log"), ordered=True).select("doc_id", "object_id", "root_id", "entry_rank", "exit_rank", "n_descendants")


def _found5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.dangling(table(spark, sf_dir, "change_feed"), table(spark, sf_dir, "op_log"), table(spark, sf_dir, "purged_changes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found5(spark, sf_dir)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.report(_found5(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_kept_per_day, p3_found, p4_found, p4_intervals, p5_found, p5_report)}


def _bare(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({c}), '\s', '', 'g'), '^(.*:)?(0x)?', '')"


def _hash(c: str) -> str:
    return f"CASE WHEN regexp_matches({_bare(c)}, '^[0-9a-f]{{64}}$') THEN {_bare(c)} END"


_FEED = f"""d AS (SELECT delivery_id, received_at, doc_id, {_bare("actor")} AS actor, seq, deps, {_hash("hash")} AS own FROM change_feed),
slot AS (SELECT doc_id, actor, seq, min_by(own, (received_at, delivery_id)) AS given FROM d WHERE own IS NOT NULL GROUP BY ALL),
f AS (SELECT d.*, coalesce(own, given) AS h FROM d LEFT JOIN slot USING (doc_id, actor, seq))"""
_DROP = f"""{_FEED},
i AS (SELECT *, coalesce(h, concat_ws('|', doc_id, actor, seq)) AS ident FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY received_at, delivery_id) AS rn FROM i)"""
_OPS = f"""o AS (SELECT arrived_at, doc_id, ctr, {_bare("actor")} AS actor, action, coalesce(obj.ctr || '@' || {_bare("obj.actor")}, '_root') AS obj, key, val.vtype AS vtype, pred FROM op_log),
e AS (SELECT *, unnest(pred) AS p FROM o),
x AS (SELECT *, p.ctr AS pctr, {_bare("p.actor")} AS pactor FROM e)"""
_FOUND5 = f"""{_FEED}, {_OPS},
first AS (SELECT doc_id, h, min(received_at) AS t FROM f WHERE h IS NOT NULL GROUP BY ALL),
dep AS (SELECT DISTINCT doc_id, h, {_bare("ref")} AS ref FROM (SELECT doc_id, h, unnest(deps) AS ref FROM f WHERE h IS NOT NULL) WHERE ref IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, {_hash("hash")} AS h FROM purged_changes),
bad AS (
  SELECT 'change_feed' AS src_table, strftime(first.t, '%Y-%m-%d') AS seen_day, dep.doc_id, dep.h AS src_key, ref AS ref_key FROM dep JOIN first USING (doc_id, h)
  WHERE ref <> '' AND (NOT EXISTS (SELECT 1 FROM first AS t WHERE t.doc_id = dep.doc_id AND t.h = ref) OR EXISTS (SELECT 1 FROM gone AS g WHERE g.doc_id = dep.doc_id AND g.h = ref))
  UNION ALL
  SELECT 'op_log', strftime(min(arrived_at), '%Y-%m-%d'), doc_id, concat(ctr, '@', actor), concat(pctr, '@', pactor) FROM x
  WHERE NOT EXISTS (SELECT 1 FROM o AS t WHERE t.doc_id = x.doc_id AND t.obj = x.obj AND t.key IS NOT DISTINCT FROM x.key AND t.ctr = x.pctr AND t.actor = x.pactor AND t.action <> 'del')
  GROUP BY doc_id, ctr, actor, pctr, pactor)"""
_TREE = f"""{_OPS},
n AS (SELECT DISTINCT doc_id, concat(ctr, '@', actor) AS id, obj, key FROM o WHERE action LIKE 'make%'),
top AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n AS p WHERE p.doc_id = n.doc_id AND p.id = n.obj)),
t AS (SELECT doc_id, id, id AS root, CAST(1 AS BIGINT) AS depth, coalesce(key, id) AS path, [id] AS above FROM top
  UNION ALL SELECT n.doc_id, n.id, t.root, t.depth + 1, concat(t.path, '/', coalesce(n.key, n.id)), list_append(t.above, n.id) FROM t JOIN n ON n.doc_id = t.doc_id AND n.obj = t.id)"""

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_DROP} SELECT delivery_id FROM r WHERE rn > 1",
    "p1_kept_per_day": f"WITH {_DROP} SELECT CAST(received_at AS DATE) AS day, count(*) AS n_kept FROM r WHERE rn = 1 GROUP BY 1",
    "p3_found": f"""WITH {_OPS},
v AS (SELECT * FROM o WHERE key IS NOT NULL AND action NOT IN ('del', 'inc') AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = o.doc_id AND x.obj = o.obj
  AND x.key = o.key AND x.pctr = o.ctr AND x.pactor = o.actor AND NOT (x.action = 'inc' AND o.action = 'set' AND coalesce(o.vtype, '') = 'counter')))
SELECT doc_id, obj, key, max_by(concat(ctr, '@', actor), (ctr, actor)) AS op_id FROM v GROUP BY doc_id, obj, key""",
    "p4_found": f"""WITH RECURSIVE {_TREE}
SELECT n.doc_id, n.id AS object_id, coalesce(t.root, '') AS root_id, coalesce(t.depth, -1) AS tree_depth, coalesce(t.path, '') AS key_path FROM n LEFT JOIN t ON t.doc_id = n.doc_id AND t.id = n.id""",
    "p4_intervals": f"""WITH RECURSIVE {_OPS},
n AS (SELECT doc_id, id, obj, row_number() OVER (PARTITION BY doc_id, obj ORDER BY ctr, actor) AS rk FROM (SELECT DISTINCT doc_id, ctr, actor, concat(ctr, '@', actor) AS id, obj FROM o WHERE action LIKE 'make%')),
t AS (SELECT doc_id, id, id AS root, CAST(1 AS BIGINT) AS depth, CAST([0] AS BIGINT[]) AS place, [id] AS above FROM n WHERE NOT EXISTS (SELECT 1 FROM n AS p WHERE p.doc_id = n.doc_id AND p.id = n.obj)
  UNION ALL SELECT n.doc_id, n.id, t.root, t.depth + 1, list_append(t.place, n.rk), list_append(t.above, n.id) FROM t JOIN n ON n.doc_id = t.doc_id AND n.obj = t.id),
k AS (SELECT doc_id, id, CAST(count(*) - 1 AS BIGINT) AS below FROM (SELECT doc_id, unnest(above) AS id FROM t) GROUP BY ALL),
p AS (SELECT t.doc_id, t.id, t.root, below, 2 * count(*) OVER (PARTITION BY t.doc_id, t.root) - 2 * (row_number() OVER (PARTITION BY t.doc_id, t.root ORDER BY place) - 1) + depth - 1 AS entry FROM t JOIN k ON k.doc_id = t.doc_id AND k.id = t.id)
SELECT n.doc_id, n.id AS object_id, coalesce(p.root, '') AS root_id, CAST(p.entry AS BIGINT) AS entry_rank, CAST(p.entry - 2 * p.below - 1 AS BIGINT) AS exit_rank, coalesce(p.below, -1) AS n_descendants FROM n LEFT JOIN p ON p.doc_id = n.doc_id AND p.id = n.id""",
    "p5_found": f"WITH {_FOUND5} SELECT src_table, seen_day, doc_id, src_key, ref_key FROM bad",
    "p5_report": f"""WITH {_FOUND5} SELECT src_table, seen_day, count(*) AS n_refs, count(DISTINCT (doc_id, ref_key)) AS n_missing, count(DISTINCT (doc_id, src_key)) AS n_sources FROM bad GROUP BY ALL""",
}
