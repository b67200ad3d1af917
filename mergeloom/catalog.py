"""Queries of the engine's own operators, by their ids in the inventory, with SQL that must give the same.

``E`` queries run over the map log derived from ``events``, ``L`` queries over ``op_log`` and
``change_feed`` once cleaned, ``T`` queries over ordinary tables kept as rows inside a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import values as V
from .functions.keys import clean_hash, opid
from .operators import dag, documents, edits, encodings, hierarchy, reconcile, sequences, tables, visibility
from .problems import _DROP, _bare, _hash, table
from .sources import binary
from .sources.derived import EVENT_CHANGES, EVENT_OPS, duck_sql, event_changes, event_ops, logged_changes, logged_ops, table_ops
from .storage import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

E = duck_sql(EVENT_OPS)
EC = duck_sql(EVENT_OPS, EVENT_CHANGES)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _ids(c: str) -> F.Column:
    """An array of ids as one text."""
    return F.array_join(F.transform(c, lambda x: opid(x["ctr"], x["actor"])), ",")


# --- E: the map log ---------------------------------------------------------------------

_VIS = "vis AS (SELECT o.* FROM op o WHERE action <> 'del' AND NOT EXISTS (SELECT 1 FROM pred p WHERE p.pctr = o.ctr AND p.pactor = o.actor))"


@query("join_pred_succ", f"{E} SELECT o.key, p.pctr, p.pactor, p.ctr, p.actor, o.action FROM pred p JOIN op o ON o.ctr = p.ctr AND o.actor = p.actor")
def _(s, d):
    return visibility.join_pred_succ(event_ops(s, d)).select(F.col("cell").alias("key"), "pctr", "pactor", "ctr", "actor", "action")


@query("agg_succ", f"{E} SELECT pctr AS ctr, pactor AS actor, string_agg(ctr || '@' || actor, ',' ORDER BY ctr, actor) AS succ FROM pred GROUP BY 1, 2")
def _(s, d):
    return visibility.agg_succ(event_ops(s, d)).select("ctr", "actor", _ids("succ").alias("succ"))


@query("agg_pred_rebuild", f"{E} SELECT ctr, actor, string_agg(pctr || '@' || pactor, ',' ORDER BY pctr, pactor) AS pred FROM pred GROUP BY 1, 2")
def _(s, d):
    return visibility.pred_from_succ(visibility.agg_succ(event_ops(s, d))).select("ctr", "actor", _ids("pred").alias("pred"))


@query("join_succ_to_del", f"{E} SELECT DISTINCT p.ctr, p.actor FROM pred p JOIN op o ON o.ctr = p.ctr AND o.actor = p.actor WHERE o.action = 'del'")
def _(s, d):
    ops = event_ops(s, d)
    return visibility.deletes_from_succ(visibility.flt_not_del(ops), visibility.agg_succ(ops)).select("ctr", "actor")


@query("flt_not_del", f"{E} SELECT key, ctr, actor FROM op WHERE action <> 'del'")
def _(s, d):
    return visibility.flt_not_del(event_ops(s, d)).select("key", "ctr", "actor")


@query("flt_visible", f"{E}, {_VIS} SELECT key, ctr, actor, value FROM vis")
def _(s, d):
    return visibility.visible(event_ops(s, d)).select("key", "ctr", "actor", "value")


@query("agg_lww", f"{E}, {_VIS} SELECT key, max(ctr) AS ctr, max_by(actor, (ctr, actor)) AS actor, max_by(value, (ctr, actor)) AS value, count(*) AS n_values FROM vis GROUP BY key")
def _(s, d):
    return visibility.agg_lww(visibility.visible(event_ops(s, d)), "value").select(F.col("cell").alias("key"), "ctr", "actor", "value", "n_values")


@query("agg_conflicts", f"{E}, {_VIS} SELECT key, ctr, actor, count(*) OVER (PARTITION BY key) AS n_values FROM vis QUALIFY count(*) OVER (PARTITION BY key) > 1")
def _(s, d):
    return visibility.agg_conflicts(visibility.visible(event_ops(s, d))).select(F.col("cell").alias("key"), "ctr", "actor", "n_values")


@query("crdt_map_state", f"{E}, {_VIS} SELECT key, max_by(ctr || '@' || actor, (ctr, actor)) AS op_id, string_agg(ctr || '@' || actor, ',' ORDER BY ctr || '@' || actor) AS all_ids FROM vis GROUP BY key")
def _(s, d):
    seen = visibility.visible(event_ops(s, d)).withColumn("op_id", opid(F.col("ctr"), F.col("actor")))
    return seen.groupBy("key").agg(F.max_by("op_id", F.struct("ctr", "actor")).alias("op_id"), F.array_join(F.array_sort(F.collect_list("op_id")), ",").alias("all_ids"))


@query("agg_clock", f"{EC} SELECT actor, max(seq) AS seq FROM chg GROUP BY actor")
def _(s, d):
    return dag.agg_clock(event_changes(s, d)).select("actor", "seq")


@query("agg_max_op", f"{E} SELECT max(ctr) AS max_op FROM op")
def _(s, d):
    return visibility.agg_max_op(event_ops(s, d)).select("max_op")


@query("win_seq_check", f"{EC}, k AS (SELECT * FROM chg WHERE epoch % 7 <> 3) SELECT actor, count(*) AS n, max(seq) AS max_seq, CAST(0 AS BIGINT) AS reused, max(seq) - count(*) AS skipped FROM k GROUP BY actor HAVING max(seq) > count(*)")
def _(s, d):
    return dag.win_seq_check(event_changes(s, d).filter("epoch % 7 <> 3")).drop("doc_id")


@query("dag_errors", f"{EC}, k AS (SELECT actor, seq FROM chg UNION ALL SELECT actor, seq FROM chg WHERE epoch % 10 = 1) SELECT actor, count(*) AS n, max(seq) AS max_seq, count(*) - count(DISTINCT seq) AS reused, max(seq) - count(DISTINCT seq) AS skipped FROM k GROUP BY actor HAVING count(*) > count(DISTINCT seq)")
def _(s, d):
    c = event_changes(s, d)
    return dag.win_seq_check(c.unionByName(c.filter("epoch % 10 = 1"))).drop("doc_id")


@query("win_op_numbering", f"{EC}, k AS (SELECT actor, seq, hash, CASE WHEN epoch % 5 = 0 THEN 1 ELSE start_op END AS start_op, max_op FROM chg) SELECT hash, start_op, ended FROM (SELECT *, lag(max_op) OVER (PARTITION BY actor ORDER BY seq) AS ended FROM k) WHERE start_op <= ended")
def _(s, d):
    return dag.win_op_numbering(event_changes(s, d).withColumn("start_op", F.when(F.col("epoch") % 5 == 0, 1).otherwise(F.col("start_op")).cast("long"))).drop("doc_id")


@query("op_regroup", f"{EC} SELECT op.ctr, op.actor, chg.hash FROM op JOIN chg ON chg.actor = op.actor AND chg.epoch = op.epoch")
def _(s, d):
    return dag.op_regroup(event_ops(s, d), event_changes(s, d).drop("n_ops", "deps", "epoch", "seq", "arrival")).select("ctr", "actor", "hash")


@query("srt_opid", f"{E} SELECT key, ctr, actor, row_number() OVER (PARTITION BY key ORDER BY ctr, actor) AS place FROM op")
def _(s, d):
    return sequences.by_id(event_ops(s, d), ["key"]).select("key", "ctr", "actor", "place")


@query("lim_history", f"{EC}, past AS (SELECT op.* FROM op JOIN chg ON chg.actor = op.actor AND chg.epoch = op.epoch WHERE chg.arrival <= 100), vis AS (SELECT * FROM past o WHERE action <> 'del' AND NOT EXISTS (SELECT 1 FROM pred p JOIN past q ON q.ctr = p.ctr AND q.actor = p.actor WHERE p.pctr = o.ctr AND p.pactor = o.actor)) SELECT key, max_by(ctr || '@' || actor, (ctr, actor)) AS op_id, count(*) AS n_values FROM vis GROUP BY key")
def _(s, d):
    past = dag.lim_history(event_changes(s, d), 100).select(F.col("hash").alias("change_hash"))
    return _winners(event_ops(s, d).join(past, "change_hash", "left_semi"))


def _winners(ops: DataFrame) -> DataFrame:
    got = visibility.agg_lww(visibility.visible(ops))
    return got.select(F.col("cell").alias("key"), opid(F.col("ctr"), F.col("actor")).alias("op_id"), "n_values")


def _state_sql(upto: int) -> str:
    return f"past{upto} AS (SELECT * FROM op WHERE epoch <= {upto}), vis{upto} AS (SELECT * FROM past{upto} o WHERE action <> 'del' AND NOT EXISTS (SELECT 1 FROM pred p JOIN past{upto} q ON q.ctr = p.ctr AND q.actor = p.actor WHERE p.pctr = o.ctr AND p.pactor = o.actor)), st{upto} AS (SELECT key, max_by(ctr || '@' || actor, (ctr, actor)) AS op_id, count(*) AS n_values FROM vis{upto} GROUP BY key)"


def _at(s, d, epoch: int) -> DataFrame:
    c = event_changes(s, d)
    return _winners(dag.dag_snapshot(c, event_ops(s, d), c.filter(F.col("epoch") == epoch)))


@query("dag_snapshot", f"{E}, {_state_sql(12)} SELECT * FROM st12")
def _(s, d):
    return _at(s, d, 12)


@query("dag_history", f"{EC}, vis AS (SELECT c.arrival, o.key, o.ctr, o.actor FROM chg c JOIN op o ON o.epoch < c.epoch OR (o.epoch = c.epoch AND o.actor = c.actor) WHERE o.action <> 'del' AND NOT EXISTS (SELECT 1 FROM pred p JOIN op q ON q.ctr = p.ctr AND q.actor = p.actor WHERE p.pctr = o.ctr AND p.pactor = o.actor AND (q.epoch < c.epoch OR (q.epoch = c.epoch AND q.actor = c.actor)))) SELECT arrival, key, max_by(ctr || '@' || actor, (ctr, actor)) AS op_id, count(*) AS n_values FROM vis GROUP BY ALL")
def _(s, d):
    """All entries of the history in one plan."""
    order = F.struct("ctr", "actor")
    seen = visibility.cells(dag.dag_history(event_changes(s, d), event_ops(s, d))).groupBy("doc_id", "obj", "entry", "cell").agg(F.max(order).alias("w"), F.count(F.lit(1)).alias("n_values"))
    return seen.select(F.col("entry").alias("arrival"), F.col("cell").alias("key"), opid(F.col("w.ctr"), F.col("w.actor")).alias("op_id"), "n_values")


_PATCH = "SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'insert' WHEN a.key IS NULL THEN 'remove' WHEN a.op_id <> b.op_id THEN 'update' WHEN a.n_values <> b.n_values THEN 'conflict' END AS edit, b.op_id AS before_id, a.op_id AS after_id FROM st14 a FULL JOIN st9 b ON a.key = b.key WHERE b.key IS NULL OR a.key IS NULL OR a.op_id <> b.op_id OR a.n_values <> b.n_values"


@query("crdt_inc_patch", f"{E}, {_state_sql(9)}, {_state_sql(14)} {_PATCH}")
def _(s, d):
    return tables.crdt_inc_patch(_at(s, d, 9), _at(s, d, 14), ["key"])


@query("crdt_apply_patch", f"{E}, {_state_sql(14)} SELECT key, op_id FROM st14")
def _(s, d):
    """A patch applied to the state before it."""
    before, after = _at(s, d, 9), _at(s, d, 14)
    return tables.crdt_apply_patch(before, tables.crdt_inc_patch(before, after, ["key"]), ["key"])


@query("flt_dup_change", f"{EC} SELECT hash FROM chg WHERE arrival > 50")
def _(s, d):
    c = event_changes(s, d)
    return dag.anti_changes_added(dag.lim_history(c, 50), c.unionByName(c).dropDuplicates(["doc_id", "hash"])).select("hash")


@query("set_merge", f"{EC} SELECT hash, arrival FROM chg")
def _(s, d):
    c = event_changes(s, d)
    return dag.set_merge(c.filter("arrival <= 150"), c.filter("arrival >= 100")).select("hash", "arrival")


@query("set_all_changes", f"{EC} SELECT hash, actor, seq, start_op, max_op, arrival FROM chg")
def _(s, d):
    return event_changes(s, d).select("hash", "actor", "seq", "start_op", "max_op", "arrival")


@query("src_change_meta", f"{EC} SELECT actor, seq, start_op, n_ops FROM chg")
def _(s, d):
    return event_changes(s, d).select("actor", "seq", "start_op", "n_ops")


@query("enc_rle", f"{E}, f AS (SELECT *, CASE WHEN action = lag(action) OVER (PARTITION BY actor ORDER BY ctr) THEN 0 ELSE 1 END AS new FROM op), g AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY ctr) AS run FROM f) SELECT actor, CAST(run AS BIGINT) AS run, min(ctr) AS start, min(action) AS value, count(*) AS n FROM g GROUP BY actor, run")
def _(s, d):
    return encodings.enc_rle(event_ops(s, d), ["actor"], "ctr", "action")


@query("dec_rle", f"{E} SELECT actor, row_number() OVER (PARTITION BY actor ORDER BY ctr) AS place, action AS value FROM op")
def _(s, d):
    return encodings.dec_rle(encodings.enc_rle(event_ops(s, d), ["actor"], "ctr", "action"), ["actor"]).select("actor", "place", "value")


@query("enc_delta", f"{E} SELECT actor, ctr, event_id - coalesce(lag(event_id) OVER (PARTITION BY actor ORDER BY ctr), 0) AS delta FROM op")
def _(s, d):
    return encodings.enc_delta(event_ops(s, d), ["actor"], "ctr", "event_id").select("actor", "ctr", "delta")


@query("dec_delta", f"{E} SELECT actor, ctr, event_id AS value FROM op")
def _(s, d):
    return encodings.dec_delta(encodings.enc_delta(event_ops(s, d), ["actor"], "ctr", "event_id"), ["actor"], "ctr").select("actor", "ctr", "value")


@query("enc_bool", f"{E}, f AS (SELECT *, action = 'del' AS v FROM op), h AS (SELECT *, CASE WHEN v = lag(v, 1, FALSE) OVER (PARTITION BY actor ORDER BY ctr) THEN 0 ELSE 1 END AS new FROM f), g AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY ctr) AS run FROM h), c AS (SELECT actor, CAST(run AS BIGINT) AS run, count(*) AS n FROM g GROUP BY actor, run) SELECT * FROM c UNION ALL SELECT actor, 0, 0 FROM c GROUP BY actor HAVING min(run) = 1")
def _(s, d):
    return encodings.enc_bool(event_ops(s, d).withColumn("v", F.col("action") == "del"), ["actor"], "ctr", "v")


@query("enc_actor_dict", f"{E} SELECT actor, row_number() OVER (ORDER BY actor) - 1 AS num FROM (SELECT DISTINCT actor FROM op)")
def _(s, d):
    return encodings.enc_actor_dict(event_ops(s, d), ["doc_id"], "actor").drop("doc_id")


@query("srt_actor", f"{EC}, a AS (SELECT c.hash, c.actor AS author, p.pactor AS actor FROM pred p JOIN op o ON o.ctr = p.ctr AND o.actor = p.actor JOIN chg c ON c.actor = o.actor AND c.epoch = o.epoch UNION SELECT hash, actor, actor FROM chg) SELECT hash, actor, row_number() OVER (PARTITION BY hash ORDER BY actor <> author, actor) AS place FROM a")
def _(s, d):
    """The actors that each change names, its author first."""
    named = event_ops(s, d).select(F.col("change_hash").alias("hash"), F.col("actor").alias("author"), F.explode("pred.actor").alias("actor"))
    authors = event_changes(s, d).select("hash", F.col("actor").alias("author"), "actor")
    w = Window.partitionBy("hash").orderBy(F.col("actor") != F.col("author"), "actor")  # as many rows as a change has actors
    return named.unionByName(authors).distinct().select("hash", "actor", F.row_number().over(w).cast("long").alias("place"))


@query("enc_multi_op", f"{E} SELECT actor, ctr FROM op")
def _(s, d):
    return encodings.enc_multi_op(event_changes(s, d), "start_op", "n_ops").select("actor", "ctr")


@query("src_last_local", f"{EC} SELECT actor, max_by(hash, seq) AS hash FROM chg GROUP BY actor")
def _(s, d):
    return event_changes(s, d).groupBy("actor").agg(F.max_by("hash", "seq").alias("hash"))


@query("prj_infer_type", f"{E} SELECT event_id, CASE WHEN value = floor(value) THEN 'int' ELSE 'float64' END AS vtype FROM op")
def _(s, d):
    return event_ops(s, d).select("event_id", V.infer_type(F.col("value")).alias("vtype"))


# --- E: the graph of changes -------------------------------------------------------------


@query("anti_heads", f"{EC} SELECT hash FROM chg WHERE hash NOT IN (SELECT dep FROM dep)")
def _(s, d):
    return dag.anti_heads(event_changes(s, d)).select("hash")


@query("srt_heads", f"{EC} SELECT string_agg(hash, ',' ORDER BY hash) AS heads FROM chg WHERE hash NOT IN (SELECT dep FROM dep)")
def _(s, d):
    return dag.srt_heads(event_changes(s, d)).select(F.array_join("heads", ",").alias("heads"))


@query("anti_missing_deps", f"{EC}, k AS (SELECT * FROM chg WHERE epoch % 7 <> 3) SELECT DISTINCT dep FROM dep WHERE hash IN (SELECT hash FROM k) AND dep NOT IN (SELECT hash FROM k)")
def _(s, d):
    return dag.anti_missing_deps(event_changes(s, d).filter("epoch % 7 <> 3")).select("dep")


@query("anti_changes_added", f"{EC} SELECT hash FROM chg WHERE epoch > 20")
def _(s, d):
    c = event_changes(s, d)
    return dag.anti_changes_added(c.filter("epoch <= 20"), c).select("hash")


@query("dag_ancestors", f"{EC} SELECT hash FROM chg WHERE epoch < 15 OR (epoch = 15 AND actor = '00000003')")
def _(s, d):
    c = event_changes(s, d)
    return dag.dag_ancestors(c, c.filter("epoch = 15 and actor = '00000003'")).select("hash")


@query("dag_descendants", f"{EC} SELECT hash FROM chg WHERE epoch > 15 OR (epoch = 15 AND actor = '00000003')")
def _(s, d):
    c = event_changes(s, d)
    return dag.dag_descendants(c, c.filter("epoch = 15 and actor = '00000003'")).select("hash")


@query("set_changes_since", f"{EC} SELECT hash FROM chg WHERE epoch > 15 OR (epoch = 15 AND actor <> '00000003')")
def _(s, d):
    c = event_changes(s, d)
    return dag.set_changes_since(c, c.filter("epoch = 15 and actor = '00000003'")).select("hash")


@query("dag_apply", f"{EC} SELECT hash FROM chg WHERE epoch < 3")
def _(s, d):
    return dag.dag_apply(event_changes(s, d).filter("epoch % 7 <> 3")).select("hash")


@query("agg_pending", f"{EC} SELECT count(*) AS pending FROM chg WHERE epoch > 3 AND epoch % 7 <> 3")
def _(s, d):
    return dag.agg_pending(event_changes(s, d).filter("epoch % 7 <> 3")).select("pending")


@query("flt_causal_ready", f"{EC} SELECT hash FROM chg WHERE epoch = 11")
def _(s, d):
    c = event_changes(s, d)
    return dag.flt_causal_ready(c.filter("epoch <= 10"), c.filter("epoch between 9 and 14")).select("hash")


@query("lookup_change", f"{EC} SELECT hash, actor, seq FROM chg WHERE epoch = 5 AND actor = '00000002'")
def _(s, d):
    c = event_changes(s, d)
    wanted = c.filter("epoch = 5 and actor = '00000002'").select("hash")
    return c.join(wanted, "hash", "left_semi").select("hash", "actor", "seq")


@query("set_advance_heads", f"{EC} SELECT hash FROM chg WHERE epoch = 21 OR (epoch = 20 AND actor = '00000001')")
def _(s, d):
    c = event_changes(s, d).select("doc_id", "hash", "epoch", "actor")
    k = ["doc_id", "hash"]
    new = c.filter("epoch = 21 or (epoch = 20 and actor = '00000001')").select(*k)
    return dag.set_advance_heads(c.filter("epoch = 20").select(*k), new, c.filter("epoch = 20").select(*k)).select("hash")


@query("semi_known_heads", f"{EC} SELECT hash FROM chg WHERE epoch = 8")
def _(s, d):
    c = event_changes(s, d)
    return dag.semi_known_heads(c.filter("epoch in (8, 25)").select("doc_id", "hash"), c.filter("epoch <= 10")).select("hash")


@query("dag_hash_graph", f"{EC} SELECT hash, dep FROM dep")
def _(s, d):
    return dag.edges(event_changes(s, d)).select("hash", "dep")


@query("dag_dep_index", f"{EC} SELECT c.arrival, p.arrival AS dep_arrival FROM dep JOIN chg c ON c.hash = dep.hash JOIN chg p ON p.hash = dep.dep")
def _(s, d):
    c = event_changes(s, d)
    at = c.select(F.col("hash").alias("dep"), F.col("arrival").alias("dep_arrival"))
    return dag.edges(c).join(at, "dep").join(c.select("hash", "arrival"), "hash").select("arrival", "dep_arrival")


@query("dag_local", f"{EC}, h AS (SELECT hash FROM chg WHERE epoch = 12), u AS (SELECT hash FROM h UNION SELECT hash FROM chg WHERE epoch = 13 AND actor = '00000004') SELECT string_agg(hash, ',' ORDER BY hash) AS deps FROM u")
def _(s, d):
    c = event_changes(s, d)
    deps = c.filter("epoch = 12").groupBy("doc_id").agg(F.collect_list("hash").alias("deps"))
    last = c.filter("epoch = 13 and actor = '00000004'").select("doc_id", F.col("hash").alias("last"))
    return dag.local_deps(deps, last).select(F.array_join("deps", ",").alias("deps"))


@query("dag_empty", f"{EC} SELECT actor, max(seq) + 1 AS seq, (SELECT max(max_op) FROM chg) + 1 AS start_op, (SELECT max(max_op) FROM chg) AS max_op FROM chg GROUP BY actor")
def _(s, d):
    c = event_changes(s, d)
    top = c.groupBy("doc_id").agg(F.max("max_op").alias("max_op"))
    return dag.agg_clock(c).join(top, "doc_id").select("actor", (F.col("seq") + 1).alias("seq"), (F.col("max_op") + 1).alias("start_op"), "max_op")


# --- E: reconciliation -------------------------------------------------------------------


def _word(k: int) -> str:
    return "CAST('0x' || " + " || ".join(f"substr(hash, {8 * k + 2 * i + 1}, 2)" for i in (3, 2, 1, 0)) + " AS BIGINT)"


_PLACES = f"""n AS (SELECT count(*) AS n, CAST(ceil(count(*) * 10 / 8) * 8 AS BIGINT) AS m FROM have),
w AS (SELECT chg.hash, m, {_word(0)} % m AS x, {_word(1)} % m AS y, {_word(2)} % m AS z FROM chg, n),
p AS (SELECT hash, unnest([x, (x + y) % m, (x + 2 * y + z) % m, (x + 3 * y + 3 * z) % m, (x + 4 * y + 6 * z) % m, (x + 5 * y + 10 * z) % m, (x + 6 * y + 15 * z) % m]) AS pos FROM w),
bits AS (SELECT DISTINCT pos FROM p WHERE hash IN (SELECT hash FROM have)),
maybe AS (SELECT hash FROM p GROUP BY hash HAVING bool_and(pos IN (SELECT pos FROM bits)))"""
_BLOOM = f"{EC}, have AS (SELECT hash FROM chg WHERE epoch <= 20), {_PLACES}"


@query("syn_bloom_build", f"{_BLOOM} SELECT (SELECT n FROM n) AS n_entries, (SELECT m FROM n) AS size, string_agg(pos, ',' ORDER BY pos) AS bits FROM bits")
def _(s, d):
    return reconcile.syn_bloom_build(event_changes(s, d).filter("epoch <= 20"), ["doc_id"]).select("n_entries", "size", F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"))


@query("syn_bloom_probe", f"{_BLOOM} SELECT hash FROM maybe")
def _(s, d):
    c = event_changes(s, d)
    return reconcile.syn_bloom_probe(c, reconcile.bloom_bits(c.filter("epoch <= 20"), ["doc_id"]), ["doc_id"]).select("hash")


@query("bloom_semi", f"{_BLOOM} SELECT hash FROM chg WHERE hash NOT IN (SELECT hash FROM maybe)")
def _(s, d):
    c = event_changes(s, d)
    known = reconcile.syn_bloom_probe(c, reconcile.bloom_bits(c.filter("epoch <= 20"), ["doc_id"]), ["doc_id"])
    return c.join(known, ["doc_id", "hash"], "left_anti").select("hash")


@query("syn_to_send", f"{_BLOOM}, f AS (SELECT min(epoch) AS e FROM chg WHERE hash NOT IN (SELECT hash FROM maybe)) SELECT hash FROM chg WHERE hash NOT IN (SELECT hash FROM maybe) OR epoch > (SELECT e FROM f) OR (epoch = 3 AND actor = '00000005')")
def _(s, d):
    c = event_changes(s, d)
    bits = reconcile.bloom_bits(c.filter("epoch <= 20"), ["doc_id"])
    return reconcile.syn_to_send(c, bits, c.filter("epoch = 3 and actor = '00000005'")).select("hash")


@query("set_sent_filter", f"{EC} SELECT hash FROM chg WHERE epoch BETWEEN 11 AND 20")
def _(s, d):
    c = event_changes(s, d)
    return reconcile.set_sent_filter(c.filter("epoch <= 20"), c.filter("epoch <= 10")).select("hash")


@query("set_known_union", "SELECT message_id, array_to_string(list_sort(list_distinct(list_concat(heads, need))), ',') AS known FROM sync_messages")
def _(s, d):
    none = F.array().cast("array<string>")
    return table(s, d, "sync_messages").select("message_id", F.array_join(reconcile.set_known_union(F.coalesce("heads", none), F.coalesce("need", none)), ",").alias("known"))


@query("syn_codec", "SELECT message_id, ('0x' || substr(hex(b), 1, 2))::BIGINT AS low, octet_length(b) AS n_bytes FROM (SELECT message_id, unnest(have).bloom AS b FROM sync_messages) WHERE octet_length(b) > 0")
def _(s, d):
    b = table(s, d, "sync_messages").select("message_id", F.explode("have").alias("h")).select("message_id", F.col("h.bloom").alias("b")).filter("octet_length(b) > 0")
    f = reconcile.wire_fields(F.col("b"))
    low = F.when(f["first_byte"] == 3, f["n_entries"]).otherwise(f["n_entries"] % 128 + 128)
    return b.select("message_id", low.alias("low"), F.octet_length("b").cast("long").alias("n_bytes"))


@query("syn_wire_have", f"SELECT message_id, count(*) AS n_have, count(*) AS n_hit FROM (SELECT DISTINCT message_id, {_hash('hash')} AS h FROM sync_have) WHERE h IS NOT NULL GROUP BY message_id")
def _(s, d):
    """Filters as sent contain every hash they stand for."""
    blooms = table(s, d, "sync_messages").select("message_id", F.explode("have").alias("h")).select("message_id", F.col("h.bloom").alias("bloom"))
    have = table(s, d, "sync_have").select("message_id", clean_hash(F.col("hash")).alias("h")).filter("h is not null").distinct()
    hit = have.join(blooms, "message_id").groupBy("message_id", "h").agg(F.max(reconcile.wire_contains(F.col("bloom"), F.col("h"))).alias("hit"))
    return hit.groupBy("message_id").agg(F.count(F.lit(1)).alias("n_have"), F.count_if("hit").alias("n_hit"))


# --- L: the change log -------------------------------------------------------------------

_CHANGES = f"""{_DROP}, c AS (SELECT doc_id, h AS hash, deps FROM r WHERE rn = 1 AND h IS NOT NULL),
ld AS (SELECT DISTINCT doc_id, hash, {_bare("x")} AS dep FROM (SELECT doc_id, hash, unnest(deps) AS x FROM c) WHERE x IS NOT NULL),
lm AS (SELECT DISTINCT doc_id, dep FROM ld WHERE dep <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = ld.doc_id AND c.hash = ld.dep))"""
_MESSAGES = f"""mh AS (SELECT DISTINCT message_id, doc_id, h AS hash FROM (SELECT message_id, doc_id, unnest(heads) AS h FROM sync_messages) WHERE h IS NOT NULL)"""


def _logged(s, d) -> DataFrame:
    return Workspace(s, "logged-changes").put(logged_changes(table(s, d, "change_feed")), "changes")


@query("log_heads", f"WITH {_CHANGES} SELECT doc_id, hash FROM c WHERE NOT EXISTS (SELECT 1 FROM ld WHERE ld.doc_id = c.doc_id AND ld.dep = c.hash)")
def _(s, d):
    """Changes of the feed that no other depends on."""
    return dag.anti_heads(_logged(s, d))


@query("log_missing_deps", f"WITH {_CHANGES} SELECT doc_id, dep FROM lm")
def _(s, d):
    return dag.anti_missing_deps(_logged(s, d))


@query("log_apply", f"WITH RECURSIVE {_CHANGES}, bl AS (SELECT ld.doc_id, ld.hash FROM ld JOIN lm USING (doc_id, dep) UNION SELECT ld.doc_id, ld.hash FROM bl JOIN ld ON ld.doc_id = bl.doc_id AND ld.dep = bl.hash) SELECT doc_id, hash FROM c WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.doc_id = c.doc_id AND bl.hash = c.hash)")
def _(s, d):
    """Changes of the feed that can be applied: nothing that they depend on, at any distance, is missing."""
    return dag.dag_apply(_logged(s, d)).select("doc_id", "hash")


@query("syn_receive_log", f"WITH {_CHANGES}, {_MESSAGES}, k AS (SELECT message_id, count(*) AS n, count(c.hash) AS n_known, coalesce(string_agg(c.hash, ',' ORDER BY c.hash), '') AS shared FROM mh LEFT JOIN c USING (doc_id, hash) GROUP BY message_id) SELECT message_id, coalesce(shared, '') AS shared, coalesce(n = n_known, TRUE) AS all_known, n IS NULL AS starts_over FROM sync_messages LEFT JOIN k USING (message_id)")
def _(s, d):
    """What a replica with the changes of the feed notes of every message."""
    return reconcile.syn_receive(table(s, d, "sync_messages"), _logged(s, d)).withColumn("shared", F.array_join("shared", ","))


@query("syn_generate_log", f"WITH {_CHANGES}, {_MESSAGES}, nm AS (SELECT doc_id, count(*) AS n FROM lm GROUP BY doc_id), k AS (SELECT message_id, count(*) FILTER (c.hash IS NULL AND lm.dep IS NULL) AS n_new, count(lm.dep) AS n_named FROM mh LEFT JOIN c USING (doc_id, hash) LEFT JOIN lm ON lm.doc_id = mh.doc_id AND lm.dep = mh.hash GROUP BY message_id), ls AS (SELECT DISTINCT message_id FROM (SELECT message_id, doc_id, unnest(l) AS h FROM (SELECT message_id, doc_id, unnest(have).last_sync AS l FROM sync_messages)) x WHERE h IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND c.hash = x.h)) SELECT m.message_id, coalesce(nm.n, 0) + coalesce(k.n_new, 0) AS n_need, coalesce(k.n_named, 0) = coalesce(nm.n, 0) AS sends_filter, ls.message_id IS NOT NULL AS asks_anew FROM sync_messages m LEFT JOIN nm USING (doc_id) LEFT JOIN k ON k.message_id = m.message_id LEFT JOIN ls ON ls.message_id = m.message_id")
def _(s, d):
    """What that replica answers to every message."""
    return reconcile.syn_generate(table(s, d, "sync_messages"), _logged(s, d))


# --- L: the operation log ----------------------------------------------------------------

def _log_sql(x: str = "", where: str = "TRUE") -> str:
    """Operations ``u`` and what is visible of them, ``v``, of the part of the log that meets a condition; names get ``x`` behind them."""
    return f"""q{x} AS (SELECT DISTINCT doc_id, ctr, {_bare("actor")} AS actor, action, coalesce(obj.ctr || '@' || {_bare("obj.actor")}, '_root') AS obj, key, val.vtype AS vtype, val.i AS i, val.s AS s, val.d AS d, val.b AS b, coalesce(is_insert, FALSE) AS ins,
  CASE WHEN elem.ctr = 0 THEN '_head' ELSE elem.ctr || '@' || {_bare("elem.actor")} END AS elem FROM op_log WHERE {where}),
u{x} AS (SELECT *, ctr || '@' || actor AS id, coalesce(key, CASE WHEN ins THEN ctr || '@' || actor ELSE elem END) AS cell FROM q{x}),
ed{x} AS (SELECT DISTINCT doc_id, ctr, {_bare("actor")} AS actor, p.ctr AS pctr, {_bare("p.actor")} AS pactor FROM (SELECT doc_id, ctr, actor, unnest(pred) AS p FROM op_log WHERE {where})),
pr{x} AS (SELECT x.doc_id, x.obj, x.cell, x.action, x.i, x.ctr, x.actor, t.ctr AS pctr, t.actor AS pactor, t.action = 'set' AND coalesce(t.vtype, '') = 'counter' AS counter
  FROM ed{x} ed JOIN u{x} x USING (doc_id, ctr, actor) JOIN u{x} t ON t.doc_id = ed.doc_id AND t.ctr = ed.pctr AND t.actor = ed.pactor AND t.obj = x.obj AND t.cell = x.cell AND t.action <> 'del'),
bst{x} AS (SELECT doc_id, ctr, actor, max((pctr, pactor)) AS b FROM pr{x} WHERE action = 'inc' AND counter GROUP BY ALL),
fo{x} AS (SELECT pr.*, coalesce((pctr, pactor) = b, FALSE) AS folds FROM pr{x} pr LEFT JOIN bst{x} USING (doc_id, ctr, actor)),
hid{x} AS (SELECT doc_id, pctr AS ctr, pactor AS actor, count(*) FILTER (NOT folds) AS n_other, sum(CASE WHEN folds THEN i END) AS added FROM fo{x} GROUP BY ALL),
v{x} AS (SELECT u.*, CASE WHEN action = 'set' AND vtype = 'counter' THEN CAST(i + coalesce(added, 0) AS BIGINT) ELSE i END AS value_i FROM u{x} u LEFT JOIN hid{x} USING (doc_id, ctr, actor)
  WHERE action NOT IN ('del', 'inc') AND (n_other IS NULL OR (action = 'set' AND coalesce(vtype, '') = 'counter' AND n_other = 0)))"""


_LOG = _log_sql()
_SEQ = f"""{_LOG},
sib AS (SELECT doc_id, obj, id, elem, row_number() OVER (PARTITION BY doc_id, obj, elem ORDER BY ctr DESC, actor DESC) AS rk FROM u WHERE ins AND key IS NULL),
tr AS (SELECT doc_id, obj, id, [rk] AS path FROM sib WHERE elem = '_head' UNION ALL SELECT c.doc_id, c.obj, c.id, list_append(tr.path, c.rk) FROM tr JOIN sib c ON c.doc_id = tr.doc_id AND c.obj = tr.obj AND c.elem = tr.id),
el AS (SELECT doc_id, obj, cell AS elem, max_by(struct_pack(ctr := ctr, actor := actor, vtype := vtype, s := s), (ctr, actor)) AS w FROM v WHERE key IS NULL GROUP BY ALL),
st AS (SELECT el.doc_id, el.obj, el.elem, row_number() OVER (PARTITION BY el.doc_id, el.obj ORDER BY path) - 1 AS idx, w.vtype AS vtype, w.s AS s, w.ctr AS ctr, w.actor AS actor FROM el JOIN tr ON tr.doc_id = el.doc_id AND tr.obj = el.obj AND tr.id = el.elem)"""


def _log(s, d) -> DataFrame:
    return Workspace(s, "logged-ops").put(logged_ops(table(s, d, "op_log")), "ops")  # operators read it more than once


def _list(s, d) -> DataFrame:
    return sequences.crdt_list_state(_log(s, d))


@query("log_visible", f"WITH {_LOG} SELECT doc_id, obj, cell, id AS op_id FROM v")
def _(s, d):
    return visibility.visible(_log(s, d)).select("doc_id", "obj", "cell", opid(F.col("ctr"), F.col("actor")).alias("op_id"))


@query("log_unmatched_preds", f"WITH {_LOG} SELECT doc_id, ctr, actor, pctr, pactor FROM ed WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.doc_id = ed.doc_id AND pr.ctr = ed.ctr AND pr.actor = ed.actor AND pr.pctr = ed.pctr AND pr.pactor = ed.pactor)")
def _(s, d):
    return visibility.unmatched_preds(_log(s, d)).select("doc_id", "ctr", "actor", "pctr", "pactor")


@query("agg_count_ops", f"WITH {_LOG} SELECT doc_id, count(*) AS n_ops FROM u GROUP BY doc_id")
def _(s, d):
    """Operations of a document, counted by the widths of those that insert or delete several at once."""
    ops = _log(s, d)
    many = F.expr("coalesce(action = 'set' and insert or action = 'del' and key is null and elem is not null, false)")
    wide = sequences.win_multi_ins(ops).unionByName(sequences.win_multi_del(ops)).select("doc_id", "n")
    single = ops.filter(~many).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return wide.unionByName(single).groupBy("doc_id").agg(F.sum("n").alias("n_ops"))


@query("join_counter_inc", f"WITH {_LOG} SELECT doc_id, pctr, pactor, ctr, actor, i FROM pr WHERE action = 'inc' AND counter")
def _(s, d):
    ops = _log(s, d)
    counters = ops.filter("action = 'set' and vtype = 'counter'").select("doc_id", F.col("ctr").alias("pctr"), F.col("actor").alias("pactor"))
    inc = visibility.join_pred_succ(ops).filter("action = 'inc'").join(counters, ["doc_id", "pctr", "pactor"])
    return inc.join(ops.select("doc_id", "ctr", "actor", "i"), ["doc_id", "ctr", "actor"]).select("doc_id", "pctr", "pactor", "ctr", "actor", "i")


@query("agg_counter", f"WITH {_LOG} SELECT doc_id, obj, cell, ctr, actor, value_i AS value FROM v WHERE action = 'set' AND vtype = 'counter'")
def _(s, d):
    return visibility.agg_counter(_log(s, d))


@query("crdt_counter", f"WITH {_LOG} SELECT doc_id, obj, cell, max_by(value_i, (ctr, actor)) AS value FROM v WHERE action = 'set' AND vtype = 'counter' GROUP BY ALL")
def _(s, d):
    return visibility.agg_counter(_log(s, d)).groupBy("doc_id", "obj", "cell").agg(F.max_by("value", F.struct("ctr", "actor")).alias("value"))


@query("prj_object_type", f"WITH {_LOG} SELECT doc_id, id AS object_id, lower(substr(action, 5)) AS object_type FROM u WHERE action LIKE 'make%'")
def _(s, d):
    return _log(s, d).filter("action like 'make%'").select("doc_id", opid(F.col("ctr"), F.col("actor")).alias("object_id"), F.lower(F.substring("action", 5, 20)).alias("object_type"))


@query("prj_obj_by_id", f"WITH {_LOG}, first AS (SELECT doc_id, obj FROM v WHERE obj <> '_root' AND key IS NOT NULL ORDER BY doc_id, obj LIMIT 1) SELECT v.key, v.id AS op_id FROM v JOIN first USING (doc_id, obj) WHERE key IS NOT NULL")
def _(s, d):
    """The first object that has anything under a key."""
    seen = visibility.visible(_log(s, d)).filter("key is not null")
    one = seen.filter("obj <> '_root'").select("doc_id", "obj").orderBy("doc_id", "obj").limit(1)
    return seen.join(one, ["doc_id", "obj"]).select("key", opid(F.col("ctr"), F.col("actor")).alias("op_id"))


@query("join_parent_child", f"WITH {_LOG} SELECT c.doc_id, c.id AS op_id, p.id AS object_id, p.key AS parent_key FROM u c JOIN u p ON p.doc_id = c.doc_id AND p.id = c.obj AND p.action LIKE 'make%'")
def _(s, d):
    ops = _log(s, d).withColumn("op_id", opid(F.col("ctr"), F.col("actor")))
    made = ops.filter("action like 'make%'").select("doc_id", F.col("op_id").alias("obj"), F.col("key").alias("parent_key"))
    return ops.select("doc_id", "obj", "op_id").join(made, ["doc_id", "obj"]).select("doc_id", "op_id", F.col("obj").alias("object_id"), "parent_key")


@query("flt_reachable", f"WITH RECURSIVE {_LOG}, mk AS (SELECT doc_id, id, obj FROM v WHERE action LIKE 'make%'), r AS (SELECT doc_id, id FROM mk WHERE obj = '_root' UNION ALL SELECT mk.doc_id, mk.id FROM r JOIN mk ON mk.doc_id = r.doc_id AND mk.obj = r.id) SELECT doc_id, id AS object_id FROM r")
def _(s, d):
    tree = Workspace(s, "tree").put(hierarchy.tree_of_objects(table(s, d, "op_log")), "tree")
    return visibility.reachable_objects(_log(s, d), tree)


@query("enc_sorted_check", "SELECT row_id FROM op_log WHERE pred IS NOT NULL AND list_sort(list_distinct(pred)) <> pred")
def _(s, d):
    return encodings.unsorted_preds(table(s, d, "op_log")).select("row_id")


@query("crdt_list_order", f"WITH RECURSIVE {_SEQ} SELECT doc_id, obj, id AS elem, row_number() OVER (PARTITION BY doc_id, obj ORDER BY path) AS place FROM tr")
def _(s, d):
    return sequences.places(sequences.crdt_list_order(_log(s, d))).select("doc_id", "obj", "elem", "place")


@query("crdt_list_state", f"WITH RECURSIVE {_SEQ} SELECT doc_id, obj, elem, idx, vtype, s FROM st")
def _(s, d):
    return _list(s, d).select("doc_id", "obj", "elem", "idx", "vtype", "s")


@query("win_list_index", f"WITH RECURSIVE {_SEQ} SELECT doc_id, obj, elem, idx FROM st")
def _(s, d):
    return _list(s, d).select("doc_id", "obj", "elem", "idx")


@query("prj_elem_ids", f"WITH RECURSIVE {_SEQ} SELECT doc_id, obj, string_agg(elem, ',' ORDER BY idx) AS elems FROM st GROUP BY ALL")
def _(s, d):
    st = _list(s, d).groupBy("doc_id", "obj").agg(F.sort_array(F.collect_list(F.struct("idx", "elem"))).alias("e"))
    return st.select("doc_id", "obj", F.array_join(F.col("e.elem"), ",").alias("elems"))


@query("agg_list_len", f"WITH RECURSIVE {_SEQ} SELECT doc_id, obj, count(*) AS length FROM st GROUP BY ALL")
def _(s, d):
    return sequences.agg_list_len(_list(s, d))


@query("lim_index", f"WITH RECURSIVE {_SEQ} SELECT doc_id, obj, elem FROM st WHERE idx = 2")
def _(s, d):
    return sequences.lim_index(_list(s, d), 2).select("doc_id", "obj", "elem")


@query("lim_pop_shift", f"WITH RECURSIVE {_SEQ} SELECT doc_id, obj, min_by(elem, idx) AS first_elem, max_by(elem, idx) AS last_elem FROM st GROUP BY ALL")
def _(s, d):
    return sequences.lim_pop_shift(_list(s, d))


@query("agg_text", f"WITH RECURSIVE {_SEQ} SELECT doc_id, obj, coalesce(string_agg(CASE WHEN vtype = 'str' THEN s END, '' ORDER BY idx), '') AS text FROM st GROUP BY ALL")
def _(s, d):
    return sequences.agg_text(_list(s, d))


@query("crdt_text_state", f"WITH RECURSIVE {_SEQ} SELECT st.doc_id, st.obj, idx, st.vtype, st.s FROM st JOIN u m ON m.doc_id = st.doc_id AND m.id = st.obj AND m.action = 'makeText'")
def _(s, d):
    ops = _log(s, d)
    made = ops.filter("action = 'makeText'").select("doc_id", opid(F.col("ctr"), F.col("actor")).alias("obj"))
    return sequences.crdt_list_state(ops).join(made, ["doc_id", "obj"], "left_semi").select("doc_id", "obj", "idx", "vtype", "s")


@query("win_spans", f"WITH RECURSIVE {_SEQ}, a AS (SELECT *, coalesce(vtype = 'str', FALSE) AS t FROM st), b AS (SELECT *, CASE WHEN t AND coalesce(lag(t) OVER (PARTITION BY doc_id, obj ORDER BY idx), FALSE) THEN 0 ELSE 1 END AS new FROM a), c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, obj ORDER BY idx) AS span FROM b) SELECT doc_id, obj, CAST(span AS BIGINT) AS span, string_agg(CASE WHEN vtype = 'str' THEN s END, '' ORDER BY idx) AS text FROM c GROUP BY ALL")
def _(s, d):
    return sequences.win_spans(_list(s, d))


@query("win_coalesce_edits", f"WITH RECURSIVE {_SEQ}, a AS (SELECT *, CAST(split_part(elem, '@', 1) AS BIGINT) AS c, split_part(elem, '@', 2) AS k FROM st), b AS (SELECT *, CASE WHEN lag(k) OVER w = k AND lag(c) OVER w = c - 1 AND lag(vtype) OVER w IS NOT DISTINCT FROM vtype THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY doc_id, obj ORDER BY idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, obj ORDER BY idx) AS run FROM b) SELECT doc_id, obj, min(idx) AS start_idx, count(*) AS length FROM r GROUP BY doc_id, obj, run")
def _(s, d):
    return sequences.win_coalesce_edits(_list(s, d))


_RUNS = "WINDOW w AS (PARTITION BY doc_id, obj, actor ORDER BY ctr)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, obj, actor ORDER BY ctr) AS run FROM b) SELECT doc_id, obj, actor, min(ctr) AS first_ctr, count(*) AS n FROM r GROUP BY doc_id, obj, actor, run"


@query("win_multi_del", f"WITH {_LOG}, a AS (SELECT *, CAST(split_part(elem, '@', 1) AS BIGINT) AS ec, split_part(elem, '@', 2) AS ea FROM u WHERE action = 'del' AND key IS NULL AND elem <> '_head'), b AS (SELECT *, CASE WHEN lag(ctr) OVER w = ctr - 1 AND lag(ea) OVER w = ea AND lag(ec) OVER w = ec - 1 THEN 0 ELSE 1 END AS new FROM a {_RUNS}")
def _(s, d):
    return sequences.win_multi_del(_log(s, d))


@query("win_multi_ins", f"WITH {_LOG}, a AS (SELECT * FROM u WHERE action = 'set' AND ins), b AS (SELECT *, CASE WHEN lag(ctr) OVER w = ctr - 1 AND elem = (ctr - 1) || '@' || actor AND lag(vtype) OVER w IS NOT DISTINCT FROM vtype THEN 0 ELSE 1 END AS new FROM a {_RUNS}")
def _(s, d):
    return sequences.win_multi_ins(_log(s, d))


@query("win_first_last", f"WITH RECURSIVE {_SEQ}, c AS (SELECT tr.doc_id, tr.obj, CAST(floor((row_number() OVER (PARTITION BY tr.doc_id, tr.obj ORDER BY path) - 1) / 5) AS BIGINT) AS block, tr.id, path, st.idx FROM tr LEFT JOIN st ON st.doc_id = tr.doc_id AND st.obj = tr.obj AND st.elem = tr.id) SELECT doc_id, obj, block, min_by(id, path) FILTER (idx IS NOT NULL) AS first_seen, max_by(id, path) FILTER (idx IS NOT NULL) AS last_seen FROM c GROUP BY ALL")
def _(s, d):
    ops = _log(s, d)
    placed = sequences.places(sequences.crdt_list_order(ops)).withColumn("block", F.floor((F.col("place") - 1) / 5))
    seen = sequences.crdt_list_state(ops).select("doc_id", "obj", "elem", "idx")
    both = placed.join(seen, ["doc_id", "obj", "elem"], "left").withColumn("e", F.when(F.col("idx").isNotNull(), F.col("elem")))
    return both.groupBy("doc_id", "obj", "block").agg(F.min_by("e", "idx").alias("first_seen"), F.max_by("e", "idx").alias("last_seen"))


# --- T: tables inside a document ---------------------------------------------------------

_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
_TID = "substr(sha256('customer|' || c_custkey), 1, 32)"


def _customers(s, d) -> DataFrame:
    """Customers as a table of a document, from the operations that made it, overwrote and contested its cells."""
    ops = Workspace(s, "table-ops").put(table_ops(table(s, d, "customer").select(*_CUSTOMER), "customer", "c_custkey", _CUSTOMER), "ops")
    return tables.crdt_table_state(ops, _CUSTOMER).drop("doc_id", "table_id")


_TOP = """top AS (SELECT doc_id, obj, cell, max_by(struct_pack(id := id, action := action, vtype := vtype, s := s, value_i := value_i, d := d, b := b), (ctr, actor)) AS w, count(*) AS n_values FROM v GROUP BY ALL)"""


def _told(values: DataFrame) -> DataFrame:
    """Texts and truth values in one column."""
    return values.withColumn("text", F.coalesce("s", F.col("b").cast("string"))).drop("s", "b")


@query("crdt_table_cells", f"""WITH {_LOG}, {_TOP}, tb AS (SELECT doc_id, w.id AS id FROM top WHERE w.action = 'makeTable'),
rw AS (SELECT top.doc_id, top.obj AS table_id, top.cell AS row_id, top.w.id AS obj FROM top JOIN tb ON tb.doc_id = top.doc_id AND tb.id = top.obj WHERE top.w.action = 'makeMap')
SELECT rw.doc_id, rw.table_id, rw.row_id, t.cell AS "column", t.w.id AS op_id, t.w.vtype AS vtype, coalesce(t.w.s, CAST(t.w.b AS VARCHAR)) AS text, t.w.value_i AS value_i, t.w.d AS d, t.n_values FROM top t JOIN rw ON rw.doc_id = t.doc_id AND rw.obj = t.obj""")
def _(s, d):
    """Rows and cells of all tables in the log, with conflicts counted."""
    return _told(tables.table_cells(tables.winners(_log(s, d)))).drop("action")


_EDITED = f"""{_LOG}, {_TOP}, pd AS (SELECT doc_id, obj, cell, string_agg(id, ',' ORDER BY ctr, actor) AS pred, bool_or(action = 'set' AND vtype = 'counter') AS counted FROM v WHERE key IS NOT NULL GROUP BY ALL),
mx AS (SELECT doc_id, max(m) AS m FROM (SELECT doc_id, ctr AS m FROM u UNION ALL SELECT doc_id, pctr FROM ed) GROUP BY doc_id),
ed1 AS (SELECT top.doc_id, CAST(split_part(w.id, '@', 1) AS BIGINT) AS pos, obj, cell AS key, CASE w.vtype WHEN 'counter' THEN 'inc' WHEN 'null' THEN 'del' ELSE 'set' END AS action, CASE WHEN w.vtype = 'counter' THEN 2 END AS i,
  CASE WHEN w.vtype = 'str' THEN CASE WHEN length(w.s) % 2 = 0 THEN w.s ELSE w.s || '!' END END AS s, w.s AS now, n_values, pred, counted FROM top JOIN pd USING (doc_id, obj, cell) WHERE w.action = 'set' AND w.vtype IN ('counter', 'null', 'str')),
ed2 AS (SELECT * FROM ed1 WHERE CASE action WHEN 'set' THEN NOT counted AND NOT (n_values = 1 AND s = now) ELSE TRUE END)"""


def _edits(s, d) -> tuple[DataFrame, DataFrame]:
    """The log, and for every key whose value is a counter, null or text: count on by 2, delete, or add a sign if the length is odd."""
    ops = _log(s, d)
    top = tables.winners(ops.filter("key is not null")).filter("action = 'set' and vtype in ('counter', 'null', 'str')")
    action = F.when(F.col("vtype") == "counter", "inc").when(F.col("vtype") == "null", "del").otherwise("set")
    text = F.when(F.col("vtype") == "str", F.when(F.length("s") % 2 == 0, F.col("s")).otherwise(F.concat("s", F.lit("!"))))
    made = top.select(
        "doc_id", F.col("ctr").alias("at"), "obj", F.col("cell").alias("key"), action.alias("action"), F.when(F.col("vtype") == "str", "str").alias("vtype"), F.when(F.col("vtype") == "counter", 2).cast("long").alias("i"),
        F.lit(None).cast("double").alias("d"), text.alias("s"), F.lit(None).cast("boolean").alias("b"),
    )
    return ops, Workspace(s, "edits").put(made, "edits")


@query("mut_many", f"WITH {_EDITED} SELECT ed2.doc_id, m + row_number() OVER (PARTITION BY ed2.doc_id ORDER BY pos, obj, key) AS ctr, obj, key, action, s, CAST(i AS BIGINT) AS i, pred FROM ed2 JOIN mx USING (doc_id)")
def _(s, d):
    """Operations that edit many keys of all documents at once."""
    return edits.edit_maps(*_edits(s, d), "ffff").select("doc_id", "ctr", "obj", "key", "action", "s", "i", _ids("pred").alias("pred"))


@query("mut_many_seen", f"WITH {_EDITED} SELECT doc_id, obj, key, s, CASE WHEN action = 'inc' THEN CAST((SELECT max_by(value_i, (ctr, actor)) FROM v WHERE v.doc_id = ed2.doc_id AND v.obj = ed2.obj AND v.cell = ed2.key AND vtype = 'counter') + 2 AS BIGINT) END AS value_i FROM ed2 WHERE action <> 'del' AND strpos(pred, ',') = 0")
def _(s, d):
    """What the edited keys show afterwards, of those that had one value before."""
    ops, made = _edits(s, d)
    new = Workspace(s, "edited").put(edits.edit_maps(ops, made, "ffff"), "ops")
    after = tables.winners(ops.select(new.columns).unionByName(new))
    single = new.filter("size(pred) = 1").select("doc_id", "obj", F.col("key").alias("cell"))
    return after.join(single, ["doc_id", "obj", "cell"], "left_semi").select("doc_id", "obj", F.col("cell").alias("key"), F.when(F.col("vtype") == "str", F.col("s")).alias("s"), F.when(F.col("vtype") == "counter", F.col("value_i")).alias("value_i"))


@query("agg_table_rows", f"""WITH {_LOG}, {_TOP}, tb AS (SELECT doc_id, w.id AS id FROM top WHERE w.action = 'makeTable')
SELECT top.doc_id, top.obj AS table_id, count(*) AS n_rows FROM top JOIN tb ON tb.doc_id = top.doc_id AND tb.id = top.obj WHERE top.w.action = 'makeMap' AND EXISTS (SELECT 1 FROM top c WHERE c.doc_id = top.doc_id AND c.obj = top.w.id) GROUP BY ALL""")
def _(s, d):
    """Rows of every table in the log that have any cell."""
    return tables.table_cells(tables.winners(_log(s, d))).groupBy("doc_id", "table_id").agg(F.countDistinct("row_id").alias("n_rows"))


@query("crdt_table_state", f"SELECT {_TID} AS id, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(s, d):
    return _customers(s, d)


@query("prj_table_rows", f"SELECT {_TID} AS id FROM customer")
def _(s, d):
    return _customers(s, d).select("id")


@query("flt_table_filter", f"SELECT {_TID} AS id, c_name FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'")
def _(s, d):
    return tables.flt_table_filter(_customers(s, d), F.expr("c_acctbal < 0 and c_mktsegment = 'BUILDING'")).select("id", "c_name")


@query("flt_table_find", f"SELECT {_TID} AS id, c_custkey FROM customer WHERE c_nationkey = 7 ORDER BY 1 LIMIT 1")
def _(s, d):
    return tables.flt_table_find(_customers(s, d), F.col("c_nationkey") == 7).select("id", "c_custkey")


@query("flt_table_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 17")
def _(s, d):
    import hashlib

    return tables.flt_table_by_id(_customers(s, d), hashlib.sha256(b"customer|17").hexdigest()[:32]).select("c_custkey", "c_name")


@query("prj_table_map", f"SELECT {_TID} AS id, upper(c_mktsegment) AS segment, c_custkey * 2 AS twice FROM customer")
def _(s, d):
    return tables.prj_table_map(_customers(s, d), segment=F.upper("c_mktsegment"), twice=F.col("c_custkey") * 2)


@query("srt_table", f"SELECT {_TID} AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_acctbal, {_TID}) AS place FROM customer")
def _(s, d):
    return tables.srt_table_places(_customers(s, d), "c_nationkey", ["c_mktsegment", "c_acctbal"]).select("id", F.col("place").cast("long").alias("place"))


@query("agg_table_count", "SELECT count(*) AS n FROM customer")
def _(s, d):
    return tables.agg_table_count(_customers(s, d))


@query("flt_equals", "SELECT c_custkey, 'right' AS side FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'left' FROM customer WHERE c_custkey % 10 = 0")
def _(s, d):
    a = _customers(s, d).select("c_custkey", "c_acctbal")
    b = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return tables.flt_equals(a, b).select("c_custkey", "side")


@query("snk_json", "SELECT c_custkey, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS json FROM customer")
def _(s, d):
    return _customers(s, d).select("c_custkey", F.to_json(F.struct("c_custkey", "c_name")).alias("json"))


# --- scalar functions --------------------------------------------------------------------


@query("fn_parse_opid", f"{E} SELECT event_id, ctr, actor FROM op")
def _(s, d):
    p = V.parse_opid(opid(F.col("ctr"), F.col("actor")))
    return event_ops(s, d).select("event_id", p["ctr"].alias("ctr"), p["actor"].alias("actor"))


@query("fn_format_opid", f"{E} SELECT event_id, ctr || '@' || actor AS op_id FROM op")
def _(s, d):
    return event_ops(s, d).select("event_id", opid(F.col("ctr"), F.col("actor")).alias("op_id"))


@query("fn_opid_delta", f"{E} SELECT event_id, coalesce(lag(ctr) OVER (PARTITION BY actor ORDER BY ctr) + 1 = ctr, FALSE) AS follows FROM op")
def _(s, d):
    me = opid(F.col("ctr"), F.col("actor"))
    return event_ops(s, d).select("event_id", F.coalesce(V.opid_delta(F.lag(me).over(Window.partitionBy("actor").orderBy("ctr")), me, 1), F.lit(False)).alias("follows"))


@query("fn_check_actor", "SELECT delivery_id, regexp_full_match(actor, '([0-9a-f]{2})+') AS ok FROM change_feed")
def _(s, d):
    return table(s, d, "change_feed").select("delivery_id", V.is_actor(F.col("actor")).alias("ok"))


@query("fn_sha256", "SELECT event_id, sha256(props) AS h FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.sha2("props", 256).alias("h"))


@query("fn_int", "SELECT event_id, CASE WHEN value * 4 = floor(value * 4) THEN CAST(value * 4 AS BIGINT) END AS n FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", V.as_int(F.col("value") * 4).alias("n"))


@query("fn_uint", "SELECT event_id, CASE WHEN event_id % 5 >= 2 THEN event_id % 5 - 2 END AS n FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", V.as_uint(F.col("event_id") % 5 - 2).alias("n"))


@query("fn_counter_ops", "SELECT user_id, sum(event_id % 7 - 3) AS value FROM events GROUP BY user_id")
def _(s, d):
    per = table(s, d, "events").groupBy("user_id").agg(F.collect_list(F.col("event_id") % 7 - 3).alias("deltas"))
    return per.select("user_id", V.counter_after(F.lit(0), F.col("deltas")).alias("value"))


@query("fn_timestamp", "SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS t FROM events")
def _(s, d):
    ms = V.to_millis(F.col("ts").cast("timestamp"))
    return table(s, d, "events").select("event_id", ms.alias("ms"), V.from_millis(ms).cast("timestamp_ntz").alias("t"))


@query("fn_text_new", "SELECT doc_id, length(text) AS n, substr(text, 1, 1) AS first FROM documents WHERE text IS NOT NULL")
def _(s, d):
    c = V.characters(F.col("text"))
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.size(c).cast("long").alias("n"), F.coalesce(V.element(c, 0), F.lit("")).alias("first"))


_ARR = "SELECT c_custkey, string_split(c_name, '') AS c FROM customer"


@query("fn_array_read", f"WITH a AS ({_ARR}) SELECT c_custkey, array_to_string(list_slice(c, 2, 4), '') AS sliced, list_position(c, '0') - 1 AS first_zero, len(c) - list_position(list_reverse(c), '0') AS last_zero, list_contains(c, 'u') AS has_u, len(list_filter(c, lambda x: x = '0')) AS zeros, array_to_string(list_transform(c, lambda x: upper(x)), '-') AS joined, list_bool_or(list_transform(c, lambda x: x = '9')) AS some_nine, list_bool_and(list_transform(c, lambda x: x <> 'q')) AS none_q FROM a")
def _(s, d):
    c = V.characters(F.col("c_name"))
    return table(s, d, "customer").select(
        "c_custkey", F.array_join(V.slice_(c, 1, 4), "").alias("sliced"), V.index_of(c, F.lit("0")).alias("first_zero"), V.last_index_of(c, F.lit("0")).alias("last_zero"), F.array_contains(c, "u").alias("has_u"),
        F.size(F.filter(c, lambda x: x == "0")).cast("long").alias("zeros"), F.array_join(F.transform(c, F.upper), "-").alias("joined"), F.exists(c, lambda x: x == "9").alias("some_nine"), F.forall(c, lambda x: x != "q").alias("none_q"),
    )


@query("fn_array_iter", f"WITH a AS ({_ARR}) SELECT c_custkey, unnest(range(len(c))) AS idx, unnest(c) AS value FROM a")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.posexplode(V.characters(F.col("c_name"))).alias("idx", "value")).withColumn("idx", F.col("idx").cast("long"))


@query("agg_array_reduce", "SELECT user_id, sum(event_id) AS total, count(*) AS n FROM events GROUP BY user_id")
def _(s, d):
    per = table(s, d, "events").groupBy("user_id").agg(F.collect_list("event_id").alias("a"))
    return per.select("user_id", F.aggregate("a", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"), F.size("a").cast("long").alias("n"))


@query("fn_nulls", "SELECT r_regionkey, CAST(r_regionkey AS BIGINT) AS n, CAST(0 AS BIGINT) AS filled FROM region")
def _(s, d):
    a = V.nulls(F.col("r_regionkey"))
    return table(s, d, "region").select("r_regionkey", F.size(a).cast("long").alias("n"), F.size(F.filter(a, lambda x: x.isNotNull())).cast("long").alias("filled"))


@query("fn_map_keys", f"{E}, {_VIS} SELECT string_agg(DISTINCT key, ',' ORDER BY key) AS keys, bool_or(key = 'k7') AS has_k7 FROM vis")
def _(s, d):
    m = visibility.visible(event_ops(s, d)).select("key", "ctr", "actor").groupBy("key").agg(F.max(F.struct("ctr", "actor")).alias("w"))
    one = m.agg(F.map_from_entries(F.collect_list(F.struct("key", "w"))).alias("m"))  # one entry per key of a map
    return one.select(F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.map_contains_key("m", "k7").alias("has_k7"))


@query("srt_keys", "SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY key) AS place FROM (SELECT DISTINCT doc_id, key FROM op_log WHERE key IS NOT NULL AND obj IS NULL)")
def _(s, d):
    keys = table(s, d, "op_log").filter("key is not null and obj is null").select("doc_id", "key").distinct()
    return keys.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")).cast("long"))


@query("srt_doc_order", f"WITH {_LOG} SELECT doc_id, id AS op_id, row_number() OVER (PARTITION BY doc_id, obj ORDER BY key, ctr, actor) AS place FROM u WHERE key IS NOT NULL AND action <> 'del'")
def _(s, d):
    ops = _log(s, d).filter("key is not null and action <> 'del'")
    w = Window.partitionBy("doc_id", "obj").orderBy("key", "ctr", "actor")
    return ops.select("doc_id", opid(F.col("ctr"), F.col("actor")).alias("op_id"), F.row_number().over(w).cast("long").alias("place"))


@query("prj_value", "SELECT row_id, CASE val.vtype WHEN 'str' THEN val.s WHEN 'null' THEN 'null' WHEN 'bool' THEN CAST(val.b AS VARCHAR) WHEN 'float64' THEN NULL ELSE coalesce(CAST(val.i AS VARCHAR), 'x') END AS shown, CASE WHEN val.vtype = 'float64' THEN val.d END AS number, CASE WHEN val.vtype = 'timestamp' THEN make_timestamp(val.i * 1000) END AS moment FROM op_log WHERE action = 'set'")
def _(s, d):
    """Values of all types: floating-point ones and times as such, the others as text."""
    v = F.col("val")
    shown = F.when(v["vtype"] == "str", v["s"]).when(v["vtype"] == "null", "null").when(v["vtype"] == "bool", v["b"].cast("string")).when(v["vtype"] != "float64", F.coalesce(v["i"].cast("string"), F.lit("x")))
    moment = F.when(v["vtype"] == "timestamp", V.from_millis(v["i"])).cast("timestamp_ntz")
    return table(s, d, "op_log").filter("action = 'set'").select("row_id", shown.alias("shown"), F.when(v["vtype"] == "float64", v["d"]).alias("number"), moment.alias("moment"))


# --- whole documents, links to touched objects, binary form ------------------------------

_TREE_L = f"""{_LOG}, mk AS (SELECT v.doc_id, v.id, v.obj, v.cell FROM v WHERE action LIKE 'make%'),
rr AS (SELECT doc_id, id, cell AS path, [id] AS up FROM mk WHERE obj = '_root' UNION ALL SELECT mk.doc_id, mk.id, rr.path || '/' || mk.cell, list_append(rr.up, mk.id) FROM rr JOIN mk ON mk.doc_id = rr.doc_id AND mk.obj = rr.id)"""


def _shown(s, d) -> tuple[DataFrame, DataFrame]:
    """Seen operations, and shown objects with their paths."""
    ops = _log(s, d)
    tree = Workspace(s, "tree").put(hierarchy.tree_of_objects(table(s, d, "op_log")), "tree")
    return visibility.visible(ops), tree.join(visibility.reachable_objects(ops, tree), ["doc_id", "object_id"], "left_semi")


@query("crdt_whole_doc", f"WITH RECURSIVE {_TREE_L}, {_TOP} SELECT top.doc_id, coalesce(rr.path || '/', '') || top.cell AS path, w.id AS op_id, w.action AS action, w.vtype AS vtype, coalesce(w.s, CAST(w.b AS VARCHAR)) AS text, w.value_i AS value_i, w.d AS d, top.n_values FROM top LEFT JOIN rr ON rr.doc_id = top.doc_id AND rr.id = top.obj WHERE top.obj = '_root' OR rr.id IS NOT NULL")
def _(s, d):
    """Every value shown, typed, with its path from the root and how many it contends with; elements of lists are named by their ids."""
    seen, shown = _shown(s, d)
    values = [*tables.VALUES, "n_values"]
    top = visibility.agg_lww(seen, *tables.VALUES).select("doc_id", "obj", "cell", opid(F.col("ctr"), F.col("actor")).alias("op_id"), *values)
    at_root = top.filter("obj = '_root'").select("doc_id", F.col("cell").alias("path"), "op_id", *values)
    # A list's element is named by its insertion, which for an assigned object is not the object itself.
    paths = _cell_paths(seen, shown)
    below = top.join(paths, ["doc_id", "obj"]).select("doc_id", F.concat("above", F.lit("/"), "cell").alias("path"), "op_id", *values)
    return _told(at_root.unionByName(below))


@query("crdt_whole_json")
def _(s, d):
    """Documents as JSON, nested, in parts. SQL does not nest without bound; tests compare with a session's value."""
    return documents.whole_documents(_log(s, d))


_UPTO = 100  # the state before has the operations up to this counter, the state after has all
_LISTS = f"""{_log_sql("0", f"ctr <= {_UPTO}")},
el1 AS (SELECT doc_id, obj, cell AS elem, max_by(id, (ctr, actor)) AS after_id, max_by(vtype, (ctr, actor)) AS vtype, max_by(action, (ctr, actor)) AS action, count(*) AS n1 FROM v WHERE key IS NULL GROUP BY ALL),
el0 AS (SELECT doc_id, obj, cell AS elem, max_by(id, (ctr, actor)) AS before_id, count(*) AS n0 FROM v0 WHERE key IS NULL GROUP BY ALL),
bo AS (SELECT doc_id, obj, elem, after_id, before_id, vtype, action, n1, n0 FROM el1 FULL JOIN el0 USING (doc_id, obj, elem)),
pt AS (SELECT bo.*, path, count(after_id) OVER w - (after_id IS NOT NULL)::INT AS idx, CASE WHEN before_id IS NOT NULL THEN count(before_id) OVER w - 1 END AS before_idx,
  CASE WHEN before_id IS NULL THEN 'insert' WHEN after_id IS NULL THEN 'remove' WHEN before_id <> after_id THEN 'update' WHEN n0 <> n1 THEN 'conflict' ELSE 'keep' END AS edit
  FROM bo JOIN tr ON tr.doc_id = bo.doc_id AND tr.obj = bo.obj AND tr.id = bo.elem WINDOW w AS (PARTITION BY bo.doc_id, bo.obj ORDER BY path))"""


def _list_patch(s, d) -> DataFrame:
    ops = _log(s, d)
    return Workspace(s, "list-patch").put(tables.list_patch(ops.filter(F.col("ctr") <= _UPTO), ops), "patch")


@query("crdt_list_patch", f"WITH RECURSIVE {_SEQ}, {_LISTS} SELECT doc_id, obj, elem, CAST(idx AS BIGINT) AS idx, edit, before_id, after_id FROM pt WHERE edit <> 'keep'")
def _(s, d):
    """Edits, with their places, that make the lists of one state those of a later one."""
    return _list_patch(s, d).filter("edit <> 'keep'").select("doc_id", "obj", "elem", "idx", "edit", "before_id", "after_id")


@query("crdt_apply_list_patch", f"WITH RECURSIVE {_SEQ} SELECT doc_id, obj, elem, idx, ctr || '@' || actor AS op_id FROM st")
def _(s, d):
    """List patches applied: the lists of the later state."""
    return tables.apply_list_patch(_list_patch(s, d))


@query("crdt_multi_insert", f"WITH RECURSIVE {_SEQ}, {_LISTS}, a AS (SELECT *, CAST(split_part(elem, '@', 1) AS BIGINT) AS c, split_part(elem, '@', 2) AS k, action = 'set' AND after_id = elem AS plain FROM pt WHERE edit = 'insert'), b AS (SELECT *, CASE WHEN lag(idx) OVER w = idx - 1 AND lag(k) OVER w = k AND lag(c) OVER w = c - 1 AND lag(vtype) OVER w IS NOT DISTINCT FROM vtype AND plain AND lag(plain) OVER w THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY doc_id, obj ORDER BY idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, obj ORDER BY idx) AS run FROM b) SELECT doc_id, obj, CAST(min(idx) AS BIGINT) AS idx, min_by(elem, idx) AS elem, count(*) AS n FROM r GROUP BY doc_id, obj, run")
def _(s, d):
    """Insertions that one edit of several values can say."""
    return tables.multi_inserts(_list_patch(s, d))


@query("crdt_observe_list", f"WITH RECURSIVE {_SEQ}, {_LISTS} SELECT doc_id, obj, elem, CAST(before_idx AS BIGINT) AS before_idx, CASE WHEN after_id IS NOT NULL THEN CAST(idx AS BIGINT) END AS after_idx, edit FROM pt WHERE edit <> 'keep' OR before_idx <> idx")
def _(s, d):
    """What an observer of elements is told: each that changed or moved, with its place before and after."""
    p = _list_patch(s, d).filter("edit <> 'keep' or before_idx <> idx")
    return p.select("doc_id", "obj", "elem", "before_idx", F.when(F.col("after_id").isNotNull(), F.col("idx")).alias("after_idx"), "edit")


def _cell_paths(seen: DataFrame, shown: DataFrame) -> DataFrame:
    """``doc_id, obj, above``: path of cells from the root to each shown object, by doubling."""
    made = seen.filter("action like 'make%'").select("doc_id", opid(F.col("ctr"), F.col("actor")).alias("object_id"), F.col("obj").alias("container"), "cell")
    links = made.join(shown.select("doc_id", "object_id"), ["doc_id", "object_id"], "left_semi")
    key = lambda c: F.concat("doc_id", F.lit("|"), c)
    chain = links.select(key("object_id").alias("x"), F.when(F.col("container") != "_root", key("container")).alias("nxt"), F.col("cell").alias("path"))
    done = hierarchy.follow(Workspace(seen.sparkSession, "cell-paths"), "paths", chain, {"path": lambda a, b: F.concat(b, F.lit("/"), a)})
    return links.withColumn("x", key("object_id")).join(done.select("x", F.col("path").alias("above")), "x").select("doc_id", F.col("object_id").alias("obj"), "above")


@query("prj_path", f"WITH RECURSIVE {_TREE_L} SELECT doc_id, id AS object_id, path FROM rr")
def _(s, d):
    return _cell_paths(*_shown(s, d)).select("doc_id", F.col("obj").alias("object_id"), F.col("above").alias("path"))


@query("crdt_patch_link", f"WITH RECURSIVE {_TREE_L}, touched AS (SELECT DISTINCT doc_id, obj FROM v WHERE action = 'set' AND vtype = 'counter' AND obj <> '_root') SELECT DISTINCT doc_id, unnest(up) AS object_id FROM rr JOIN touched t USING (doc_id) WHERE t.obj = rr.id")
def _(s, d):
    """Objects on the way from the root to those that were touched."""
    seen, shown = _shown(s, d)
    touched = seen.filter("action = 'set' and vtype = 'counter' and obj <> '_root'").select("doc_id", F.col("obj").alias("object_id"), F.lit(1).alias("touched")).distinct()
    marked = shown.join(touched, ["doc_id", "object_id"], "left").fillna(0, ["touched"])
    return visibility.covering(marked, "touched").select("doc_id", "object_id")


def _binary(s, d, chained: bool = False) -> DataFrame:
    ops = event_ops(s, d).withColumn("change_id", F.col("change_hash")).withColumnRenamed("value", "d").withColumn("s", F.lit(None).cast("string"))
    changes = event_changes(s, d).withColumn("change_id", F.col("hash")).withColumns({"time_s": F.lit(0).cast("long"), "message": F.col("epoch").cast("string")})
    if chained:  # a document does not write deletions of nothing, so they are assignments of null there
        nothing = F.expr("action = 'del' and size(pred) = 0")
        ops = ops.withColumns({"action": F.when(nothing, "set").otherwise(F.col("action")), "vtype": F.when(nothing, "null").otherwise(F.col("vtype"))})
    return Workspace(s, "binary").put((binary.snk_chain if chained else binary.snk_change)(changes, ops), "changes")


@query("snk_change", f"{EC} SELECT actor, seq, start_op, CAST(epoch AS VARCHAR) AS message FROM chg")
def _(s, d):
    """Changes encoded and their headers read again."""
    return binary.src_change_meta(_binary(s, d)).select("actor", "seq", "start_op", "message")


@query("src_change_decode", f"{E} SELECT ctr, actor, key, action, CASE WHEN action = 'set' THEN value END AS value FROM op")
def _(s, d):
    """Operations encoded and decoded again."""
    return binary.src_ops(_binary(s, d)).select("ctr", "actor", "key", "action", F.col("d").alias("value"))


@query("src_columns", f"{E} SELECT ctr, actor, pctr, pactor FROM pred")
def _(s, d):
    p = binary.src_ops(_binary(s, d)).select("ctr", "actor", F.explode("pred").alias("p"))
    return p.select("ctr", "actor", F.col("p.ctr").alias("pctr"), F.col("p.actor").alias("pactor"))


@query("src_chunks_lateral", f"{EC} SELECT count(*) AS n, CAST(1 AS INTEGER) AS kind FROM chg")
def _(s, d):
    """Containers found by the table function, from SQL."""
    binary.register(s)
    return s.sql("SELECT count(*) AS n, c.kind FROM {files} f, LATERAL containers(f.data) c GROUP BY c.kind", files=_binary(s, d))


@query("src_chunks", f"{EC} SELECT actor AS doc_id, CAST(1 AS INTEGER) AS kind, count(*) AS n FROM chg GROUP BY actor")
def _(s, d):
    """All changes of an actor in one file, split again."""
    files = binary.src_change_meta(_binary(s, d)).select("hash", "actor").join(_binary(s, d).select("hash", "data"), "hash")
    joined = files.groupBy(F.col("actor").alias("doc_id")).agg(F.expr("listagg(hex(data), '')").alias("h")).select("doc_id", F.unhex("h").alias("data"))
    return binary.src_chunks(joined).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def _saved(s, d) -> DataFrame:
    """The map log saved as one document."""
    return Workspace(s, "saved").put(binary.snk_save(_binary(s, d, chained=True)), "saved")


@query("snk_save", f"{E} SELECT o.ctr, o.actor, o.key, CASE WHEN o.action = 'del' AND count(p.pctr) = 0 THEN 'set' ELSE o.action END AS action, CASE WHEN o.action = 'set' THEN o.value END AS value, coalesce(string_agg(p.pctr || '@' || p.pactor, ',' ORDER BY p.pctr, p.pactor), '') AS pred FROM op o LEFT JOIN pred p ON p.ctr = o.ctr AND p.actor = o.actor GROUP BY o.ctr, o.actor, o.key, o.action, o.value")
def _(s, d):
    """All changes saved as a document, and all operations read from it, deletions and predecessors too, which a document does not write."""
    return binary.src_ops(_saved(s, d)).select("ctr", "actor", "key", "action", F.col("d").alias("value"), _ids("pred").alias("pred"))


@query("src_load", f"{E}, {_VIS} SELECT key, ctr, actor, value FROM vis UNION ALL SELECT key, ctr, actor, NULL FROM op o WHERE action = 'del' AND NOT EXISTS (SELECT 1 FROM pred p WHERE p.ctr = o.ctr AND p.actor = o.actor)")
def _(s, d):
    """What is seen of a document that was saved and loaded."""
    return visibility.visible(binary.src_ops(_saved(s, d)).withColumn("b", F.lit(None).cast("boolean"))).select("key", "ctr", "actor", F.col("d").alias("value"))


@query("src_doc_decode", f"{EC} SELECT actor, seq, start_op, CAST(epoch AS VARCHAR) AS message, (SELECT count(*) FROM dep WHERE dep.hash = chg.hash) AS n_deps FROM chg")
def _(s, d):
    """The changes in a saved document."""
    return binary.src_change_meta(_saved(s, d)).select("actor", "seq", "start_op", "message", F.size("deps").cast("long").alias("n_deps"))


@query("src_doc_header", f"{EC} SELECT string_agg(DISTINCT actor, ',' ORDER BY actor) AS actors, (SELECT count(*) FROM chg WHERE hash NOT IN (SELECT dep FROM dep)) AS n_heads FROM op")
def _(s, d):
    """Actors and heads of a saved document; nothing else of it is decoded."""
    return binary.src_doc_header(_saved(s, d)).select(F.array_join("actors", ",").alias("actors"), F.size("heads").cast("long").alias("n_heads"))


@query("snk_doc_header", f"{EC} SELECT string_agg(DISTINCT actor, ',' ORDER BY actor) AS actors, (SELECT count(*) FROM chg WHERE hash NOT IN (SELECT dep FROM dep)) AS n_heads, TRUE AS same FROM op")
def _(s, d):
    """A header written again from what was read of it is the same bytes."""
    h = binary.src_doc_header(_saved(s, d))
    again = binary.snk_doc_header(h).select("doc_id", F.col("header").alias("written"))
    both = h.join(again, "doc_id")
    return both.select(F.array_join("actors", ",").alias("actors"), F.size("heads").cast("long").alias("n_heads"), (F.col("written") == F.col("header")).alias("same"))


def _chained(s, d) -> DataFrame:
    """A document per region, made of real changes: one per nation that sets its name under its key."""
    from .plans.session import Document

    rows = table(s, d, "nation").select("n_regionkey", "n_nationkey", "n_name").orderBy("n_regionkey", "n_nationkey").collect()  # 25 rows, fixed
    docs: dict[int, Document] = {}
    for r in rows:
        doc = docs.setdefault(r[0], Document(f"{r[0]:02x}"))
        with doc.change(r[2], 0) as root:
            root[f"n{r[1]}"] = r[2]
            root["last"] = r[1]
    return s.createDataFrame([(str(k), doc.save()) for k, doc in docs.items()], "doc_id string, data binary")


_NATIONS = "SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, n_nationkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation"


@query("mut_change", f"WITH n AS ({_NATIONS}) SELECT doc_id, 2 * rn AS ctr, CASE WHEN rn > 1 THEN 2 * rn - 2 END AS pctr FROM n")
def _(s, d):
    """Each assignment of a key names the one before."""
    ops = binary.src_ops(_chained(s, d)).filter("key = 'last'")
    return ops.select("doc_id", "ctr", F.try_element_at("pred", F.lit(1))["ctr"].alias("pctr"))
