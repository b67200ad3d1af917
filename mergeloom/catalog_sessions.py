"""Queries of the codec's kernels, of editing sessions and of synchronisation, with SQL that must give the same.

Sessions run over small fixed tables (regions and nations), which the driver reads as a whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _LOG, E, Query, _log
from .functions import bits, ids
from .functions import values as V
from .functions.keys import opid
from .operators import reconcile, sequences, tables, visibility
from .plans.session import Document
from .problems import table
from .sources import codec
from .sources.derived import event_ops
from .storage import Workspace

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- kernels of the binary format ---------------------------------------------------------

_LEB = "CASE WHEN event_id < 128 THEN printf('%02x', event_id) WHEN event_id < 16384 THEN printf('%02x%02x', event_id % 128 + 128, event_id // 128) ELSE printf('%02x%02x%02x', event_id % 128 + 128, event_id // 128 % 128 + 128, event_id // 16384) END"


@query("enc_leb128", f"SELECT event_id, {_LEB} AS bytes, event_id AS back, -event_id AS signed_back FROM events")
def _(s, d):
    n = F.col("event_id").cast("long")
    coded = table(s, d, "events").select("event_id", bits.uleb(n).alias("b"), bits.sleb(-n).alias("c"))
    return coded.select("event_id", F.lower(F.hex("b")).alias("bytes"), bits.uleb_value(F.col("b")).alias("back"), bits.sleb_value(F.col("c")).alias("signed_back"))


@query("enc_utf8_hex", "SELECT doc_id, lower(hex(encode(text))) AS h, TRUE AS same FROM documents WHERE text IS NOT NULL")
def _(s, d):
    """Whole texts as the digits of their bytes, and read again."""
    coded = table(s, d, "documents").filter("text is not null").select("doc_id", "text", F.lower(F.hex(F.encode("text", "utf-8"))).alias("h"))
    return coded.select("doc_id", "h", (F.decode(F.unhex("h"), "utf-8") == F.col("text")).alias("same"))


_SLEB = "CASE WHEN i >= -64 AND i < 64 THEN 1 WHEN i >= -8192 AND i < 8192 THEN 2 WHEN i >= -1048576 AND i < 1048576 THEN 3 WHEN i >= -134217728 AND i < 134217728 THEN 4 WHEN i >= -17179869184 AND i < 17179869184 THEN 5 WHEN i >= -2199023255552 AND i < 2199023255552 THEN 6 ELSE 7 END"
_ULEB = "CASE " + " ".join(f"WHEN i < {1 << 7 * k} THEN {k}" for k in range(1, 8)) + " ELSE 8 END"
_TAG = f"CASE vtype WHEN 'bool' THEN CASE WHEN b THEN 2 ELSE 1 END WHEN 'uint' THEN ({_ULEB}) * 16 + 3 WHEN 'str' THEN octet_length(encode(s)) * 16 + 6 WHEN 'int' THEN ({_SLEB}) * 16 + 4 WHEN 'counter' THEN ({_SLEB}) * 16 + 8 WHEN 'timestamp' THEN ({_SLEB}) * 16 + 9 WHEN 'float64' THEN 8 * 16 + 5 WHEN 'null' THEN 0 END"


@query("enc_value", f"SELECT row_id, CAST({_TAG} AS BIGINT) AS tag FROM (SELECT row_id, val.vtype AS vtype, val.i AS i, val.s AS s, val.b AS b FROM op_log WHERE action = 'set')")
def _(s, d):
    """Tag of each value, of all types: four bits of type, above them the length of its bytes."""
    v = F.col("val")
    return table(s, d, "op_log").filter("action = 'set'").select("row_id", bits.value_tag(v["vtype"], v["b"], v["i"], v["s"]).alias("tag"))


@query("snk_container", "SELECT c_custkey, sha256('\\x01'::BLOB || unhex(printf('%02x', octet_length(encode(c_name)))) || encode(c_name)) AS hash FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", bits.container_hash(codec.CHANGE, F.encode("c_name", "utf-8")).alias("hash"))


@query("snk_deflate", "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, TRUE AS same FROM documents")
def _(s, d):
    """Whole texts deflated and inflated again."""

    @F.pandas_udf("boolean")
    def same(x: pd.Series) -> pd.Series:
        whole = [t.encode() for t in x]
        return pd.Series([codec.inflate(codec.deflate(t)) == t for t in whole])

    t = F.coalesce("text", F.lit(""))
    return table(s, d, "documents").select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), same(t).alias("same"))


_BLOCKS = f"{_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ctr, actor) - 1 AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM u WHERE action <> 'del'), b AS (SELECT *, CAST(floor(rn * ceil(n / 480) / n) AS BIGINT) AS block FROM k)"


@query("win_block_split", f"WITH {_BLOCKS} SELECT doc_id, ctr, actor, block FROM b")
def _(s, d):
    """Near-equal blocks of at most 480 operations."""
    return sequences.win_block_split(visibility.flt_not_del(_log(s, d))).select("doc_id", "ctr", "actor", "block")


@query("agg_block_meta", f"WITH {_BLOCKS} SELECT doc_id, block, count(*) AS n_ops, min(ctr) AS first_ctr, max(ctr) AS last_ctr, count(DISTINCT actor) AS n_actors, count(*) FILTER (ins) AS n_inserts FROM b GROUP BY ALL")
def _(s, d):
    return sequences.agg_block_meta(sequences.win_block_split(visibility.flt_not_del(_log(s, d))))


@query("syn_block_bloom", f"WITH {_BLOCKS}, e AS (SELECT DISTINCT doc_id, block, cell FROM b WHERE key IS NULL) SELECT doc_id, block, count(*) AS n_entries, CAST(ceil(count(*) * 10 / 8) * 8 AS BIGINT) AS size, TRUE AS all_found FROM e GROUP BY ALL")
def _(s, d):
    """A filter for each block over the elements that its operations are about; each contains all of them."""
    blocks = visibility.cells(sequences.win_block_split(visibility.flt_not_del(_log(s, d)))).filter("key is null")
    by = ["doc_id", "block"]
    hashes = Workspace(s, "block-bloom").put(blocks.select(*by, F.sha2("cell", 256).alias("hash")).distinct(), "hashes")
    bits = Workspace(s, "block-bits").put(reconcile.bloom_bits(hashes, by), "bits")
    found = reconcile.syn_bloom_probe(hashes, bits, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_found"))
    entries = hashes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_entries"))
    return entries.join(bits.select(*by, "size").distinct(), by).join(found, by, "left").select(*by, "n_entries", "size", (F.col("n_found") == F.col("n_entries")).alias("all_found"))


# --- scalar functions ---------------------------------------------------------------------


@query("fn_uuid", "SELECT count(*) AS n_ids, CAST(32 AS BIGINT) AS n_digits FROM customer")
def _(s, d):
    made = table(s, d, "customer").select(ids.new_ids().alias("id"))
    return made.agg(F.countDistinct("id").alias("n_ids"), F.max(F.length("id")).cast("long").alias("n_digits"))


@query("fn_float64", "SELECT event_id, CAST(event_id AS DOUBLE) / 4 AS x FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", (F.col("event_id").cast("double") / 4).alias("x"))


@query("fn_index_of", "SELECT c_custkey, coalesce(list_position(string_split(c_name, ''), 'r'), 0) - 1 AS pos FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", V.index_of(V.characters(F.col("c_name")), F.lit("r")).alias("pos"))


@query("fn_list_index", "SELECT event_id, CASE WHEN regexp_full_match(split_part(props, ' ', 2), '[0-9]+[}]') THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS idx FROM events")
def _(s, d):
    """An index given as text: digits only, else null."""
    given = F.regexp_replace(F.substring_index("props", " ", -1), "[}]$", "")
    return table(s, d, "events").select("event_id", F.when(given.rlike(r"^\d+\z"), given.cast("long")).alias("idx"))


@query("fn_json", "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"v\":\"' || n_name || '\"}' AS json FROM nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))).alias("json"))


@query("crdt_observe", f"WITH {_LOG}, w AS (SELECT doc_id, obj, cell, max_by(id, (ctr, actor)) AS after_id FROM v GROUP BY ALL), m AS (SELECT doc_id, id AS obj FROM u WHERE action = 'makeTable') SELECT w.doc_id, w.obj, w.cell, 'insert' AS edit, w.after_id FROM w JOIN m USING (doc_id, obj)")
def _(s, d):
    """The patch from nothing, as observers of tables get it."""
    ops = _log(s, d)
    cells = visibility.CELL
    after = visibility.agg_lww(visibility.visible(ops)).select(*cells, opid(F.col("ctr"), F.col("actor")).alias("op_id"), "n_values")
    patch = tables.crdt_inc_patch(after.limit(0), after, cells)
    watched = ops.filter("action = 'makeTable'").select("doc_id", opid(F.col("ctr"), F.col("actor")).alias("obj"))
    return patch.join(watched, ["doc_id", "obj"], "left_semi").select(*cells, "edit", "after_id")


@query("src_init", "SELECT CAST(0 AS BIGINT) AS n")
def _(s, d):
    """A new document has the operations' schema and no rows."""
    return event_ops(s, d).limit(0).agg(F.count(F.lit(1)).alias("n"))


@query("src_clone", f"{E} SELECT ctr, actor FROM op")
def _(s, d):
    return event_ops(s, d).alias("copy").select("ctr", "actor")


# --- sessions -----------------------------------------------------------------------------


def _nations(s: SparkSession, d: str) -> list[tuple[int, str, int]]:
    rows = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows, fixed
    return [tuple(r) for r in rows]


def _rows(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


def _filled(s, d) -> Document:
    doc = Document("aa")
    for k, name, region in _nations(s, d):
        with doc.change(name, 0) as root:
            root[name] = {"key": k, "region": region, "tags": [name[:1], name[-1:]]}
    return doc


@query("mut_set_key", "SELECT n_name AS key, n_nationkey + 100 AS value FROM nation")
def _(s, d):
    doc = Document("aa")
    for step in (0, 100):
        with doc.change() as root:
            for k, name, _ in _nations(s, d):
                root[name] = k + step
    return _rows(s, list(doc.value().items()), "key string, value int")


@query("mut_del_key", "SELECT n_name AS key FROM nation WHERE n_regionkey <> 1")
def _(s, d):
    doc = _filled(s, d)
    with doc.change() as root:
        for _, name, region in _nations(s, d):
            if region == 1:
                del root[name]
    return _rows(s, [(k,) for k in doc.value()], "key string")


@query("mut_set_index", "SELECT n_nationkey AS idx, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS value FROM nation WHERE n_nationkey <= 24")
def _(s, d):
    """Assignments beyond the end fill up with nulls."""
    doc = Document("aa")
    with doc.change() as root:
        root["l"] = []
        for k, name, _ in _nations(s, d):
            if k % 3 == 0:
                root["l"][k] = name
    return _rows(s, list(enumerate(doc.value()["l"])), "idx int, value string")


@query("mut_splice", "SELECT row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS idx, n_name AS value FROM nation WHERE n_nationkey % 4 <> 1")
def _(s, d):
    """Every name inserted at the front, then some deleted."""
    doc = Document("aa")
    with doc.change() as root:
        root["l"] = []
        for _, name, _ in _nations(s, d):
            root["l"].insert(0, name)
    with doc.change() as root:
        for k, _, _ in _nations(s, d):
            if k % 4 == 1:
                del root["l"][24 - k]  # from the end, so the places before it stay
    return _rows(s, list(enumerate(doc.value()["l"])), "idx long, value string")


@query("mut_nested", "SELECT n_name AS name, n_nationkey AS key, n_regionkey AS region, substr(n_name, 1, 1) || '|' || right(n_name, 1) AS tags FROM nation")
def _(s, d):
    return _rows(s, [(k, v["key"], v["region"], "|".join(v["tags"])) for k, v in _filled(s, d).value().items()], "name string, key int, region int, tags string")


@query("mut_table_add", "SELECT 'row' || n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey <> 2")
def _(s, d):
    doc = Document("aa")
    with doc.change() as root:
        root["t"] = doc.table()
        for k, name, _ in _nations(s, d):
            root["t"][f"row{k}"] = {"name": name}
    with doc.change() as root:
        for k, _, region in _nations(s, d):
            if region == 2:
                del root["t"][f"row{k}"]
    return _rows(s, [(v["id"], v["name"]) for v in doc.value()["t"].values()], "id string, name string")


@query("mut_increment", "SELECT n_regionkey AS region, sum(n_nationkey) AS total FROM nation GROUP BY n_regionkey")
def _(s, d):
    """Two replicas count at once; both counts add up."""
    a = Document("aa")
    with a.change() as root:
        for r in range(5):
            root[f"r{r}"] = a.counter(0)
    b = Document("bb").merge(a)
    for k, _, region in _nations(s, d):
        with (a if k % 2 else b).change() as root:
            root[f"r{region}"].increment(k)
    return _rows(s, [(int(k[1:]), v) for k, v in a.merge(b).value().items()], "region int, total long")


@query("mut_pred", "SELECT n_name AS key, n_nationkey + 1 AS pctr FROM nation")
def _(s, d):
    """An assignment names what was visible of its key."""
    doc = Document("aa")
    for value in (1, 2):
        with doc.change() as root:
            for _, name, _ in _nations(s, d):
                root[name] = value
    last = list(doc.changes.values())[-1]
    return _rows(s, [(op["key"], int(p.split("@")[0])) for op in last["ops"] for p in op["pred"]], "key string, pctr int")


@query("mut_actor", "SELECT printf('%02x', n_regionkey) AS actor, count(*) AS seq FROM nation GROUP BY n_regionkey")
def _(s, d):
    docs = {r: Document(f"{r:02x}") for r in range(5)}
    for _, name, region in _nations(s, d):
        with docs[region].change() as root:
            root[name] = region
    whole = Document("ff")
    for doc in docs.values():
        whole.merge(doc)
    return _rows(s, list(whole.clock().items()), "actor string, seq long")


@query("mut_proxy", "SELECT n_name AS name, n_nationkey AS key, 3 AS n_keys FROM nation")
def _(s, d):
    """Values read back through item access while editing."""
    doc, out = _filled(s, d), []
    with doc.change() as root:
        for name in root.keys():
            out.append((name, root[name]["key"], len(root[name])))
    return _rows(s, out, "name string, key int, n_keys int")


@query("mut_freeze", "SELECT n_name AS key, n_nationkey AS value FROM nation")
def _(s, d):
    """An edit that fails leaves nothing behind."""
    doc = Document("aa")
    with doc.change() as root:
        for k, name, _ in _nations(s, d):
            root[name] = k
    try:
        with doc.change() as root:
            root["more"] = 1
            root[""] = 2
    except ValueError:
        pass
    return _rows(s, list(doc.value().items()), "key string, value int")


def _pair(s, d) -> tuple[Document, Document]:
    a, b = Document("aa"), Document("bb")
    for k, name, _ in _nations(s, d):
        with (a if k % 2 else b).change(name, 0) as root:
            root[name] = k
    return a, b


def _talk(a: Document, b: Document, sa: dict, sb: dict) -> int:
    """Messages go both ways until nobody has anything to say; the number of rounds."""
    for n in range(10):
        m, r = a.generate(sa), b.generate(sb)
        if m is None and r is None:
            return n
        if m is not None:
            b.receive(sb, m)
        if r is not None:
            a.receive(sa, r)
    raise RuntimeError("the replicas do not agree after ten rounds")


_BOTH = "SELECT r.replica, n_name AS key, n_nationkey AS value FROM nation, (VALUES ('aa'), ('bb')) AS r(replica)"


def _both(s, *docs: Document) -> DataFrame:
    return _rows(s, [(x.actor, k, v) for x in docs for k, v in x.value().items()], "replica string, key string, value int")


@query("syn_generate", _BOTH)
def _(s, d):
    a, b = _pair(s, d)
    _talk(a, b, a.sync_state(), b.sync_state())
    return _both(s, a, b)


@query("syn_receive", "SELECT n_name AS key, n_nationkey AS value FROM nation WHERE n_nationkey % 2 = 1")
def _(s, d):
    """One side has nothing and gets all of the other's."""
    a, _b = _pair(s, d)
    c = Document("cc")
    _talk(a, c, a.sync_state(), c.sync_state())
    return _rows(s, list(c.value().items()), "key string, value int")


@query("syn_reset", _BOTH)
def _(s, d):
    """A replica that lost everything, while the other remembers what it sent, is filled again."""
    a, b = _pair(s, d)
    sa = a.sync_state()
    _talk(a, b, sa, b.sync_state())
    b = Document("bb")
    _talk(a, b, sa, b.sync_state())
    return _both(s, a, b)


@query("syn_init", "SELECT 0 AS n_shared, TRUE AS fresh")
def _(s, d):
    st = Document.sync_state()
    return _rows(s, [(len(st["shared"]), st["their_heads"] is None)], "n_shared int, fresh boolean")


@query("src_load_changes", "SELECT n_name AS key FROM nation")
def _(s, d):
    """All changes loaded at once, in reverse."""
    doc = Document("cc").apply(list(_filled(s, d).changes.values())[::-1])
    return _rows(s, [(k,) for k in doc.value()], "key string")
