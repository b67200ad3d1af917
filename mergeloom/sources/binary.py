"""Changes and documents in binary form as tables: read, written, split.

Decoding is done row by row within Arrow batches; only the columns asked for leave it.
A document is one row however long its history, so of its operations no task holds more
than the bytes and a piece: they are read in pieces, brought together with what they
replace and with their changes by shuffles, and written from pieces in stored order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import chain, islice, pairwise
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.keys import opid
from ..functions.values import parse_opid
from ..operators.sequences import crdt_list_order
from ..storage import Workspace
from . import codec, columns

HEADER = "doc_id string, hash string, actor string, seq long, start_op long, time_s long, message string, deps array<string>"
OPS = "doc_id string, change_hash string, ctr long, actor string, obj string, key string, elem string, insert boolean, action string, vtype string, i long, d double, s string, raw binary, pred array<struct<ctr:bigint,actor:string>>"
_OP = "ctr long, obj string, key string, elem string, insert boolean, action string, vtype string, i long, d double, s string, raw binary, pred array<struct<ctr:bigint,actor:string>>"
DOC_HEADER = "doc_id string, actors array<string>, heads array<string>, change_columns array<struct<id:int,n_bytes:bigint>>, op_columns array<struct<id:int,n_bytes:bigint>>, header binary"


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Any, int, bytes, str]]:
    for pdf in batches:
        for doc, data in zip(pdf["doc_id"], pdf["data"], strict=True):
            if data is not None:
                for kind, body, hash_ in codec.containers(data):
                    yield doc, kind, body, hash_


def src_chunks(files: DataFrame) -> DataFrame:
    """One row per container in ``data (doc_id, data)``: ``doc_id, kind, hash, n_bytes``. Unknown kinds are kept, null data skipped."""

    def run(batches):
        rows = [(d, k, h, len(b)) for d, k, b, h in _split(batches)]
        yield pd.DataFrame(rows, columns=["doc_id", "kind", "hash", "n_bytes"])

    return files.select("doc_id", "data").mapInPandas(run, "doc_id string, kind int, hash string, n_bytes long")


class Containers:
    """The same as a table function: one row per container in the bytes it is given."""

    def eval(self, data: bytes):
        for kind, body, hash_ in codec.containers(bytes(data)) if data is not None else ():
            yield kind, hash_, len(body)


def register(spark: SparkSession) -> None:
    """Make ``containers(data)`` known in SQL, for use with ``LATERAL``: ``kind, hash, n_bytes``."""
    spark.udtf.register("containers", F.udtf(Containers, returnType="kind int, hash string, n_bytes bigint"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of changes or documents as they lie in folders: ``doc_id`` (the file's name) and ``data``. Spark leaves out empty files, which hold nothing."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.col("content").alias("data"))


def src_change_meta(files: DataFrame) -> DataFrame:
    """Headers of all changes in ``data``. Of changes the operations are not decoded; in documents only they tell what the changes depend on."""

    def run(batches):
        rows = []
        for doc, kind, body, hash_ in _split(batches):
            if kind == codec.CHANGE:
                h = codec.decode_header(body)[0]
                rows.append((doc, hash_, h["actor"], h["seq"], h["startOp"], h["time"], h["message"], h["deps"]))
        yield pd.DataFrame(rows, columns=["doc_id", "hash", "actor", "seq", "start_op", "time_s", "message", "deps"])

    alone = files.select("doc_id", "data").mapInPandas(run, HEADER)
    loaded = _loaded(files)
    return alone if loaded is None else alone.unionByName(loaded[0].select(alone.columns))


def src_doc_header(files: DataFrame) -> DataFrame:
    """Headers of all documents in ``data``: actors, heads, columns, and the header's own bytes. Columns are not decoded."""

    def run(batches):
        rows = []
        for doc, kind, body, _ in _split(batches):
            if kind == codec.DOCUMENT:
                r = codec.Reader(body)
                h = codec.read_document_header(r)
                cols = [[{"id": i, "n_bytes": n} for i, n in h[c]] for c in ("changes", "ops")]
                rows.append((doc, h["actors"], h["heads"], *cols, body[: r.at]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOC_HEADER.split(", ")])

    return files.select("doc_id", "data").mapInPandas(run, DOC_HEADER)


def snk_doc_header(headers: DataFrame) -> DataFrame:
    """Headers as bytes, ``doc_id, header``, from what ``src_doc_header`` gives of them."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                cols = [[(c["id"], c["n_bytes"]) for c in part] for part in (r.change_columns, r.op_columns)]
                rows.append((r.doc_id, codec.document_header({"actors": list(r.actors), "heads": list(r.heads), "changes": cols[0], "ops": cols[1]})))
            yield pd.DataFrame(rows, columns=["doc_id", "header"])

    return headers.select("doc_id", "actors", "heads", "change_columns", "op_columns").mapInPandas(run, "doc_id string, header binary")


def _op_row(doc: str, change: dict[str, Any], op: dict[str, Any]) -> tuple:
    ctr, actor = op["id"].split("@")
    v = op.get("value")
    vtype = op.get("datatype") or ({bool: "bool", str: "str", int: "int", float: "float64", type(None): "null"}.get(type(v), "bytes") if op["action"] in ("set", "inc") else None)
    number = isinstance(v, int) and not isinstance(v, bool)
    pred = [{"ctr": int(p.split("@")[0]), "actor": p.split("@")[1]} for p in op["pred"]]
    text = v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else None
    return doc, change["hash"], int(ctr), actor, op["obj"], op.get("key"), op.get("elemId"), op["insert"], str(op["action"]), vtype, v if number else None, v if isinstance(v, float) else None, text, v if isinstance(v, bytes) else None, pred


def src_ops(files: DataFrame) -> DataFrame:
    """All operations of the changes and documents in ``data``, in the form the operators take."""

    def run(batches, schema):
        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                for kind, body, _ in codec.containers(data) if data is not None else ():
                    if kind == codec.CHANGE:
                        c = codec.decode_change(codec.container(kind, body)[0])
                        yield from _rows((dict(zip(schema.names, _op_row(doc, c, op), strict=True)) for op in c["ops"]), schema)

    alone = _by_batch(files.select("doc_id", "data"), run, OPS)
    loaded = _loaded(files)
    return alone if loaded is None else alone.unionByName(loaded[1].select(alone.columns))


def _by_batch(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch], pa.Schema], Iterator[pa.RecordBatch]], out: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function that is also given the schema of what it returns."""
    out = StructType.fromDDL(out) if isinstance(out, str) else out
    return df.mapInArrow(partial(run, schema=to_arrow_schema(out)), out)


def _rows(rows: Iterable[dict[str, Any]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    it = iter(rows)
    while piece := list(islice(it, columns.STEP)):
        yield pa.RecordBatch.from_pylist(piece, schema)


# --- documents read ---

_READ = (
    "doc string, doc_id string, ctr long, actor string, obj string, key string, elem string, insert boolean, action string, vtype string, i long, d double, s string, raw binary, change long, succ array<struct<ctr:bigint,actor:string,change:bigint>>,"
    "seq long, max_op long, time_s long, message string, deps array<bigint>, extra binary, heads array<string>"
)


def _documents(data: bytes) -> Iterator[bytes]:
    """What the documents in a row hold; other containers are passed over and not read."""
    r = codec.Reader(data)
    while not r.done:
        at = r.at
        r.take(8)
        kind, n = r.take(1)[0], r.uint()
        r.at += n
        if kind == codec.DOCUMENT:
            yield codec.containers(r.data[at : r.at])[0][1]


def _ids(ctr: np.ndarray, actor: np.ndarray, actors: list[str], none: str | None) -> list[str | None]:
    return [none if a == columns.NONE else f"{c}@{actors[a]}" for c, a in zip(ctr.tolist(), actor.tolist(), strict=True)]


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of the documents' changes, and of their operations in stored order with the change that covers them."""
    n = 0
    for batch in batches:
        for doc_id, data in zip(batch.column("doc_id"), batch.column("data"), strict=True):
            for body in _documents(data.as_py()) if data.is_valid else ():
                n += 1
                for cols in _read_one(body):
                    size = len(next(iter(cols.values())))
                    own = {"doc": pa.array([f"{TaskContext.get().partitionId()}-{n}"] * size), "doc_id": pa.array([doc_id.as_py()] * size, pa.string())} | cols
                    yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(size, f.type) for f in schema], schema=schema)


def _read_one(body: bytes) -> Iterator[dict[str, pa.Array]]:
    r = codec.Reader(body)
    h = codec.read_document_header(r)
    actors = h["actors"]
    raw = codec.column_bytes(r, h["changes"], codec.DOC_CHANGE_COLUMNS)
    tops = {c: _whole(codec.DOC_CHANGE_COLUMNS[c][1], raw.get(c, b"")) for c in ("actor", "maxOp")}
    if len(tops["actor"]) != len(tops["maxOp"]) or (not len(tops["actor"]) and h["heads"]):
        raise codec.FormatError("the changes are not whole")
    yield from _read_changes(raw, h)
    order = np.lexsort((tops["maxOp"], tops["actor"]))
    spans = {int(a): (tops["maxOp"][at], at) for a in np.unique(tops["actor"]) for at in [order[tops["actor"][order] == a]]}

    def covering(ctr: np.ndarray, actor: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ctr), np.int64)
        for a in np.unique(actor):
            mine = actor == a
            top, k = spans.get(int(a), (np.zeros(0), None))
            at = np.searchsorted(top, ctr[mine])
            if at.max(initial=-1) >= len(top):
                raise codec.FormatError("an operation that no change covers")
            out[mine] = k[at]
        return out

    raw = codec.column_bytes(r, h["ops"], codec.DOC_OPS_COLUMNS)
    yield from _read_ops(raw, actors, covering)


def _whole(kind: int, data: bytes) -> np.ndarray:
    d, out = columns.Decoder(kind, data), []
    while len(v := d.take(columns.STEP)):
        out.append(v)
    return np.concatenate([np.zeros(0, np.int64), *out])


def _columns(raw: dict[str, bytes], names: dict[str, tuple[int, int]]) -> Callable[[str, int], Any]:
    """Takes the next values of a column by its name; where it ends early, there are nulls."""
    col = {c: columns.Decoder(t, raw.get(c, b"")) for c, (_, t) in names.items() if t != codec.VAL_RAW}

    def take(c: str, n: int) -> Any:
        v = col[c].take(n)
        return v + [None] * (n - len(v)) if isinstance(v, list) else np.r_[v, np.full(n - len(v), 0 if c == "insert" else columns.NONE)]

    return take


def _there(v: np.ndarray) -> np.ndarray:
    if (v == columns.NONE).any():
        raise codec.FormatError("a column ends too early")
    return v


def _read_changes(raw: dict[str, bytes], h: dict[str, Any]) -> Iterator[dict[str, pa.Array]]:
    take, extra, at = _columns(raw, codec.DOC_CHANGE_COLUMNS), codec.Reader(raw.get("extraRaw", b"")), 0
    total = len(_whole(codec.ACTOR, raw.get("actor", b"")))
    while at < total:
        n = min(columns.STEP, total - at)
        actor, seq, top, time_s = (_there(take(c, n)) for c in ("actor", "seq", "maxOp", "time"))
        counts = _there(take("depsNum", n))
        deps = _there(take("depsIndex", int(counts.sum())))
        more = [extra.take(max(0, x) >> 4) for x in take("extraLen", n).tolist()]
        yield {
            "change": pa.array(np.arange(at, at + n)), "actor": pa.array([h["actors"][a] for a in actor]), "seq": pa.array(seq), "max_op": pa.array(top), "time_s": pa.array(time_s), "message": pa.array([m or None for m in take("message", n)], pa.string()),
            "deps": pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(deps)), "extra": pa.array(more, pa.binary()), "heads": pa.array([h["heads"] if k == total - 1 else None for k in range(at, at + n)], pa.list_(pa.string())),
        }
        at += n


def _read_ops(raw: dict[str, bytes], actors: list[str], covering: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[dict[str, pa.Array]]:
    take, values, at = _columns({c: b for c, b in raw.items() if c != "action"}, codec.DOC_OPS_COLUMNS), np.frombuffer(raw.get("valRaw", b""), np.uint8), 0
    acts = columns.Decoder(codec.UINT, raw.get("action", b""))
    names, rank = pa.array(actors, pa.string()), np.argsort(np.argsort(np.array(actors, object)))
    while n := len(action := _there(acts.take(columns.STEP))):
        ctr, actor = _there(take("idCtr", n)), _there(take("idActor", n))
        key, kept = take("keyStr", n), (action == codec.ACTIONS.index("set")) | (action == codec.ACTIONS.index("inc"))
        elem = [e if k is None else None for e, k in zip(_ids(take("keyCtr", n), take("keyActor", n), actors, "_head"), key, strict=True)]
        tags = np.maximum(take("valLen", n), 0)
        begin = at + np.cumsum(tags >> 4) - (tags >> 4)
        at = int(begin[-1] + (tags[-1] >> 4))
        if at > len(values):
            raise codec.FormatError("it ends too early")
        v = {c: [None] * n for c in ("vtype", "i", "s", "raw")}
        double, floats = tags == (8 << 4 | codec.VALUES["float64"]), np.zeros(n)
        floats[double] = values[begin[double][:, None] + np.arange(8)].copy().view("<f8").ravel()
        for k in np.flatnonzero(~double).tolist():
            kind, x = codec.decode_value(int(tags[k]), values[begin[k] : begin[k] + (tags[k] >> 4)].tobytes())
            if kept[k]:
                v["vtype"][k] = "bool" if kind in ("true", "false") else kind
                if x is not None:
                    v["s" if isinstance(x, str | bool) else "i" if isinstance(x, int) else "raw"][k] = str(x).lower() if isinstance(x, bool) else x
        for k in np.flatnonzero(double & kept).tolist():
            v["vtype"][k] = "float64"
        counts = np.maximum(take("succNum", n), 0)
        sc, sa = (_there(take(c, int(counts.sum()))) for c in ("succCtr", "succActor"))
        of = np.repeat(np.arange(n), counts)
        if ((of[1:] == of[:-1]) & ((sc[1:] < sc[:-1]) | ((sc[1:] == sc[:-1]) & (rank[sa[1:]] <= rank[sa[:-1]])))).any():
            raise codec.FormatError("operation ids are not ascending")
        succ = pa.StructArray.from_arrays([pa.array(sc), names.take(pa.array(sa)), pa.array(covering(sc, sa))], ["ctr", "actor", "change"])
        yield {
            "ctr": pa.array(ctr), "actor": names.take(pa.array(actor)), "obj": pa.array(_ids(take("objCtr", n), take("objActor", n), actors, "_root")), "key": pa.array(key, pa.string()), "elem": pa.array(elem, pa.string()),
            "insert": pa.array(take("insert", n).astype(bool)), "action": pa.array([codec.ACTIONS[a] if a < len(codec.ACTIONS) else str(a) for a in action.tolist()]), "vtype": pa.array(v["vtype"], pa.string()), "i": pa.array(v["i"], pa.int64()),
            "d": pa.array(floats, mask=~(double & kept)), "s": pa.array(v["s"], pa.string()), "raw": pa.array(v["raw"], pa.binary()), "change": pa.array(covering(ctr, actor)), "succ": pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), succ),
        }


def _loaded(files: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Changes and operations of all documents in ``data``, with hashes: deletions and predecessors are rebuilt, and changes encoded again. None if there are no documents."""
    work = Workspace(files.sparkSession, "loaded")
    read = work.put(_by_batch(files.select("doc_id", "data"), _read, _READ), "read")
    if read.isEmpty():
        return None
    stored, by = read.filter("max_op is null"), ["doc", "doc_id", "ctr", "actor"]
    place = F.when(F.col("key").isNull(), F.when(F.col("insert"), opid(F.col("ctr"), F.col("actor"))).otherwise(F.col("elem")))
    named = stored.select("doc", "doc_id", "obj", "key", place.alias("elem"), F.struct("ctr", "actor").alias("p"), F.explode("succ").alias("n"))
    named = named.groupBy("doc", "doc_id", F.col("n.ctr").alias("ctr"), F.col("n.actor").alias("actor")).agg(F.sort_array(F.collect_list("p")).alias("pred"), F.first(F.struct("obj", "key", "elem", F.col("n.change").alias("change"))).alias("o"))
    new = F.col("action").isNull()  # only deletions have no row
    put = lambda c: F.when(new, F.col(f"o.{c}")).otherwise(F.col(c)).alias(c)
    ops = stored.drop("succ").join(named, by, "full_outer").select(
        "doc", "doc_id", put("change"), "ctr", "actor", put("obj"), put("key"), put("elem"), F.coalesce("insert", F.lit(False)).alias("insert"), F.coalesce("action", F.lit("del")).alias("action"), "vtype", "i", "d", "s", "raw",
        F.coalesce("pred", F.array().cast("array<struct<ctr:bigint,actor:string>>")).alias("pred"),
    )
    ops = work.put(ops, "ops")
    changes = read.filter("max_op is not null").select("doc", "doc_id", "change", "actor", "seq", "max_op", "time_s", "message", "deps", "extra", "heads")
    ids = lambda df: df.withColumnsRenamed({"doc_id": "file", "doc": "doc_id"}).withColumn("change_id", F.col("change").cast("string"))
    tails = _tails(ids(changes).withColumn("deps", F.col("deps").cast("array<string>")), ids(ops))
    found = work.put(_chain(tails, ["change"], False).select(F.col("doc_id").alias("doc"), F.col("file").alias("doc_id"), "change", "hash", "actor", "seq", "start_op", "time_s", "message", F.col("dep_hashes").alias("deps")), "changes")
    return found, ops.join(found.select("doc", "change", F.col("hash").alias("change_hash")), ["doc", "change"])


# --- changes and documents written ---


def _tails(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """``changes`` with ``n_ops`` and the bytes ``tail`` that follow the header; with ``max_op``, counters must lead up to it without a gap, and ``start_op`` is added. A task holds one change's operations."""
    fields = StructType.fromDDL(_OP)
    own = ops.filter("change_id is not null").select("doc_id", "change_id", *[(F.col(f.name) if f.name in ops.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    names, op = changes.columns, fields.names
    whole = "max_op" in names
    added = "n_ops long, tail binary" + ", start_op long" * whole
    out = StructType([*changes.schema, *StructType.fromDDL(added)])

    def run(batches, schema):
        key, heads, held, done, n_bytes = None, [], [], [], 0

        def flush():
            nonlocal n_bytes
            rows = pa.Table.from_batches(held).combine_chunks() if held else None
            n = rows.num_rows if held else 0
            for h in heads:
                more = {"n_ops": n, "tail": (_tail(h["actor"], rows) if n else codec.change_tail({"actor": h["actor"], "startOp": 0, "ops": []})) + (h.get("extra") or b"")}
                if whole:
                    more["start_op"] = h["max_op"] - n + 1
                    if n and (rows["ctr"].to_numpy() != np.arange(more["start_op"], h["max_op"] + 1)).any():
                        raise codec.FormatError("operation ids are not consecutive")
                done.append(h | more)
                n_bytes += len(more["tail"])
            heads.clear(), held.clear()

        for batch in batches:
            docs, ids = batch.column("doc_id").to_pylist(), batch.column("change_id").to_pylist()
            cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1] or docs[k] != docs[k - 1]), len(ids)]
            for a, b in pairwise(cuts) if ids else ():
                if (docs[a], ids[a]) != key:
                    flush()
                    key = docs[a], ids[a]
                    if n_bytes > 1 << 22 or len(done) >= 1000:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, n_bytes = [], 0
                part = batch.slice(a, b - a)
                n = part.column("ctr").null_count  # these come first
                heads += part.slice(0, n).select(names).to_pylist()
                if heads and n < b - a:
                    held.append(part.slice(n).select(op))
        flush()
        yield pa.RecordBatch.from_pylist(done, schema)

    both = changes.unionByName(own, allowMissingColumns=True)
    return _by_batch(both.repartition("doc_id", "change_id").sortWithinPartitions("doc_id", "change_id", F.col("ctr").asc_nulls_first()), run, out)


def _tail(me: str, rows: pa.Table) -> bytes:
    """``codec.change_tail`` of a change's operations. Where values are numbers with fraction, and ids sorted, no row is looked at by itself."""

    def numbered(c: str) -> tuple[np.ndarray, list[Any]]:
        d = pc.dictionary_encode(rows[c].combine_chunks())
        return np.asarray(pc.fill_null(d.indices, -1)).astype(np.int64), d.dictionary.to_pylist()

    def taken(at: np.ndarray, of: list[int]) -> np.ndarray:
        return np.array([*of, columns.NONE], np.int64)[at]  # -1 is the last

    (act, acts), (obj, objs), (elem, elems), (kind, kinds), (key, keys) = (numbered(c) for c in ("action", "obj", "elem", "vtype", "key"))
    preds = rows["pred"].combine_chunks()
    counts = np.asarray(pc.fill_null(pc.list_value_length(preds), 0)).astype(np.int64)
    flat = preds.flatten()
    ctr, by = np.asarray(flat.field("ctr")), pc.dictionary_encode(flat.field("actor"))
    at, who = np.asarray(by.indices), by.dictionary.to_pylist()
    of = np.repeat(np.arange(len(counts)), counts)
    rank = np.argsort(np.argsort(np.array(who, object))) if who else np.zeros(0, np.int64)
    same = of[1:] == of[:-1]
    if not {*kinds} <= {"float64", "null"} or not {*acts} <= {"set", "inc", "del"} or flat.null_count or (same & ((ctr[1:] < ctr[:-1]) | ((ctr[1:] == ctr[:-1]) & (rank[at[1:]] < rank[at[:-1]])))).any() or ((key < 0) != (elem >= 0)).any() or (np.asarray(rows["d"].is_null()) & np.isin(kind, [k for k, x in enumerate(kinds) if x == "float64"])).any():
        return codec.change_tail({"actor": me, "startOp": 0, "ops": _op_dicts(rows.to_pylist())})
    split = lambda ids, none: [(None, None) if x == none else codec.op_id(x) for x in ids]
    places, things = split(elems, "_head"), split(objs, "_root")
    actors = [me, *sorted(({a for _, a in [*places, *things]} | {*who}) - {me, None})]
    num = {a: k for k, a in enumerate(actors)} | {None: columns.NONE}
    valued = np.isin(act, [k for k, a in enumerate(acts) if a in ("set", "inc")])
    double = valued & np.isin(kind, [k for k, x in enumerate(kinds) if x == "float64"])
    none = lambda x: columns.NONE if x is None else x
    col = {
        "objActor": taken(obj, [num[a] for _, a in things]), "objCtr": taken(obj, [none(c) for c, _ in things]), "keyActor": taken(elem, [num[a] for _, a in places]), "keyCtr": taken(elem, [0 if c is None else c for c, _ in places]),
        "keyStr": np.where(key < 0, columns.NONE, key), "insert": np.asarray(pc.fill_null(rows["insert"], False)).astype(np.int64), "action": taken(act, [codec.ACTIONS.index(a) for a in acts]), "valLen": np.where(double, 8 << 4 | codec.VALUES["float64"], 0),
        "predNum": counts, "predActor": np.array([num[a] for a in who], np.int64)[at], "predCtr": ctr,
    }
    parts = []
    for c, v in col.items():
        g, t = codec.CHANGE_COLUMNS[c]
        e = columns.Encoder(t)
        e.feed(v, keys if t == codec.STRING else None)
        parts.append((g << 4 | t, e.finish()))
    g, t = codec.CHANGE_COLUMNS["valRaw"]
    parts.append((g << 4 | t, np.asarray(pc.fill_null(rows["d"], 0.0))[double].astype("<f8").tobytes()))
    return codec.joined_tail(actors, sorted((i, b) for i, b in parts if b))


def _value(o: dict[str, Any]) -> dict[str, Any]:
    kind = o["vtype"]
    if kind in ("str", "null", "bool", None):
        return {"value": {"str": o["s"], "bool": o["s"] == "true"}.get(kind)}
    if kind == "bytes" or kind.isdigit():
        return {"datatype": kind, "value": bytes(o["raw"] or b"")}
    return {"datatype": kind, "value": float(o["d"]) if kind == "float64" else int(o["i"])}


def _op_dicts(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    out = []
    for o in rows:
        place = {"key": o["key"]} if o["key"] is not None else {"elemId": o["elem"]}
        action = int(o["action"]) if o["action"].isdigit() else o["action"]
        out.append({"action": action, "obj": o["obj"], "insert": bool(o["insert"]), "pred": [f"{p['ctr']}@{p['actor']}" for p in o.get("pred") or []], **place, **(_value(o) if action in ("set", "inc") else {})})
    return out


def _sealed(r: dict[str, Any], deps: list[str]) -> tuple[bytes, str]:
    return codec.sealed_change({"actor": r["actor"], "seq": r["seq"], "startOp": r["start_op"], "time": r["time_s"] or 0, "message": r["message"], "deps": deps}, r["tail"])


_CHANGE = ["doc_id", "change_id", "actor", "seq", "start_op", "time_s", "message", "deps"]


def snk_change(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """Binary changes: ``doc_id, hash, data``.

    ``changes`` has ``doc_id, change_id, actor, seq, start_op, time_s, message, deps``; ``ops`` has ``doc_id, change_id, ctr, obj, key,
    elem, insert, action, vtype, i, d, s, pred``, and ``raw`` for bytes and for values of types that are only known by number. A change is one task's row, so it must fit there, as in any replica.
    """

    def run(batches, schema):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (r["doc_id"], *_sealed(r, r["deps"] or [])[::-1]), strict=True)) for r in batch.to_pylist()], schema)

    return _by_batch(_tails(changes.select(_CHANGE), ops), run, "doc_id string, hash string, data binary")


def _chain(tails: DataFrame, order: list[str], data: bool) -> DataFrame:
    """Rows of ``_tails``, without the tail, with ``hash``, ``dep_hashes`` and if asked ``data``. ``deps`` name changes of the document by ``change_id``; ``order`` puts most after what they depend on. ``heads``, if there, must be what none depends on."""
    out = StructType([*tails.drop("tail").schema, *StructType.fromDDL("hash string, dep_hashes array<string>, data binary")])

    def run(batches, schema):
        doc, done, waiting, heads, named, ready = None, {}, {}, None, set(), []

        def end():
            if waiting:
                raise codec.FormatError("changes depend on ones that are not there")
            if heads is not None and sorted(set(done.values()) - named) != sorted(heads):
                raise codec.FormatError("the heads are others")

        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                if r["doc_id"] != doc:
                    end()
                    doc, done, waiting, heads, named = r["doc_id"], {}, {}, None, set()
                heads = heads if r.get("heads") is None else r["heads"]
                todo = [r]
                while todo:
                    r = todo.pop()
                    if (lack := next((d for d in r["deps"] or [] if d not in done), None)) is not None:
                        waiting.setdefault(lack, []).append(r)
                        continue
                    deps = sorted(done[d] for d in r["deps"] or [])
                    named.update(deps)
                    whole, done[r["change_id"]] = _sealed(r, deps)
                    ready.append({c: r[c] for c in r if c != "tail"} | {"hash": done[r["change_id"]], "dep_hashes": deps, "data": whole if data else None})
                    todo += waiting.pop(r["change_id"], [])
                if len(ready) >= 1000 or sum(len(x["data"] or b"") for x in ready[-8:]) > 1 << 20:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready = []
        end()
        yield pa.RecordBatch.from_pylist(ready, schema)

    return _by_batch(tails.repartition("doc_id").sortWithinPartitions("doc_id", *order), run, out)


def snk_chain(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """Binary changes, ``doc_id, hash, data``, of changes whose ``deps`` name one another by ``change_id``.

    A hash covers the hashes before it, so the changes of a document are hashed one after the other, in one task; all but their headers is encoded before.
    """
    return _chain(_tails(changes.select(_CHANGE), ops), ["start_op", "actor"], True).select("doc_id", "hash", "data")


_DECODED = OPS + ", seq long, start_op long, n_ops long, time_s long, message string, deps array<string>, extra binary"


def _decoded(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each change, and rows of its operations."""
    for batch in batches:
        for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
            c = codec.decode_change(data)
            head = {"doc_id": doc, "change_hash": c["hash"], "actor": c["actor"], "seq": c["seq"], "start_op": c["startOp"], "n_ops": len(c["ops"]), "time_s": c["time"], "message": c["message"], "deps": c["deps"], "extra": c.get("extraBytes", b"")}
            yield from _rows(chain([head], (dict(zip(schema.names, _op_row(doc, c, op), strict=False)) for op in c["ops"])), schema)


def _ordered(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """All of a document but its operations."""
    names = {"change_hash": "hash", "start_op": "startOp", "n_ops": "nOps", "time_s": "time", "extra": "extraBytes"}
    done: dict[str, dict[str, Any]] = {}
    todo = sorted((c | {"message": c["message"] or "", "deps": list(c["deps"])} for c in pdf.rename(columns=names).to_dict("records")), key=lambda c: (c["startOp"], c["actor"]))
    while todo:
        ready = [c for c in todo if all(d in done for d in c["deps"])]
        if not ready:
            raise codec.FormatError("changes depend on ones that are not there")
        done |= {c["hash"]: c for c in ready}
        todo = [c for c in todo if c["hash"] not in done]
    h, parts = codec.document_changes(list(done.values()))
    return pd.DataFrame([(key[0], h["actors"], h["heads"], h["headsIndex"], [{"id": i, "data": b} for i, b in parts])], columns=["doc_id", "names", "heads", "heads_index", "change_columns"])


_PIECE = "doc_id string, part int, piece long, col int, names array<string>, kind string, data binary"
_NUMBERED = [c for c in codec.DOC_OPS_COLUMNS if not c.startswith("chld")]  # a piece's column is a place in this


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The columns of operations in stored order, in pieces; actors and keys are numbered within each."""
    n = 0
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        for a, b in pairwise([0, *(k for k in range(1, len(docs)) if docs[k] != docs[k - 1]), len(docs)]) if docs else ():
            rows = batch.slice(a, b - a).to_pylist()
            num: defaultdict[str, int] = defaultdict(lambda: len(num))  # noqa: B023
            ops = [op | {"id": f"{o['ctr']}@{o['actor']}", "succ": [f"{s['ctr']}@{s['actor']}" for s in o["succ"] or []]} for op, o in zip(_op_dicts(rows), rows, strict=True)]
            col = codec.op_columns(ops, num, codec.DOC_OPS_COLUMNS, "succ")
            out, n = [], n + 1
            for c, name in enumerate(_NUMBERED):
                own = {"doc_id": docs[a], "part": TaskContext.get().partitionId(), "piece": n, "col": c, "names": list(num)}
                if name == "valRaw":
                    out.append(own | {"kind": "", "data": b"".join(col[name])})
                    continue
                v = col[name]
                if name == "keyStr":
                    texts: defaultdict[str, int] = defaultdict(lambda: len(texts))  # noqa: B023
                    v = [None if x is None else texts[x] for x in v]
                    own["names"] = list(texts)
                kind, data = columns.packed(np.array([columns.NONE if x is None else int(x) for x in v], np.int64))
                out.append(own | {"kind": kind, "data": data})
            yield pa.RecordBatch.from_pylist(out, schema)


def _assembled(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Documents from a row with all but operations each, and after it the pieces column by column."""
    head: dict[str, Any] | None = None
    now, own, parts, num = None, None, [], {}

    def close() -> None:
        nonlocal own
        if own is not None and (b := bytes(own) if isinstance(own, bytearray) else own.finish()):
            g, t = codec.DOC_OPS_COLUMNS[_NUMBERED[now]]
            parts.append((g << 4 | t | 8, codec.deflate(b)) if len(b) >= codec.DEFLATE_FROM else (g << 4 | t, b))
        own = None

    def finish() -> pa.RecordBatch:
        h = {"actors": head["names"], "heads": head["heads"], "headsIndex": head["heads_index"]}
        data = codec.document(h, [(c["id"], c["data"]) for c in head["change_columns"]], sorted(parts, key=lambda x: x[0] & ~8))
        return pa.RecordBatch.from_pylist([{"doc_id": head["doc_id"], "data": data}], schema)

    for batch in batches:
        data = batch.column("data")
        for k, r in enumerate(batch.drop_columns("data").to_pylist()):
            if r["col"] < 0:
                close()
                if head is not None:
                    yield finish()
                head, now, parts, num = r, None, [], {a: x for x, a in enumerate(r["names"])}
                continue
            if r["col"] != now:
                close()
                now = r["col"]
                kind = codec.DOC_OPS_COLUMNS[_NUMBERED[now]][1]
                own = bytearray() if kind == codec.VAL_RAW else columns.Encoder(kind)
            if isinstance(own, bytearray):
                own += data[k].as_buffer()
                continue
            v = columns.unpacked(r["kind"], data[k].as_buffer())
            if kind == codec.ACTOR:
                if strange := [a for a in r["names"] if a not in num]:
                    raise codec.FormatError(f"no change of actor {strange[0]}")
                v = np.where(v == columns.NONE, v, np.array([*(num[a] for a in r["names"]), 0], np.int64)[np.maximum(v, -1)])
            own.feed(v, r["names"] if kind == codec.STRING else None)
    close()
    if head is not None:
        yield finish()


def snk_save(changes: DataFrame) -> DataFrame:
    """Whole documents, ``doc_id, data``, from binary changes ``doc_id, data`` (each once). A document is one row, as when it is loaded, and must fit in a task as bytes."""
    work = Workspace(changes.sparkSession, "save")
    spread = changes.select("doc_id", "data").repartition(int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "data")  # a chain comes from one task
    read = work.put(_by_batch(spread, _decoded, _DECODED), "read")
    heads = read.filter("seq is not null").select("doc_id", "change_hash", "actor", "seq", "start_op", "n_ops", "time_s", "message", "deps", "extra").groupBy("doc_id")
    heads = heads.applyInPandas(_ordered, "doc_id string, names array<string>, heads array<string>, heads_index array<bigint>, change_columns array<struct<id:int,data:binary>>")
    by = ["doc_id", "ctr", "actor"]
    ops = read.filter("seq is null").select("doc_id", *StructType.fromDDL(_OP).names, "actor").dropDuplicates(by)
    succ = ops.select("doc_id", F.struct("ctr", "actor").alias("by"), F.explode("pred").alias("p"))
    succ = succ.groupBy("doc_id", F.col("p.ctr").alias("ctr"), F.col("p.actor").alias("actor")).agg(F.sort_array(F.collect_list("by")).alias("succ"))
    missing = F.raise_error(F.concat(F.lit("no operation "), opid(F.col("ctr"), F.col("actor"))))
    stored = ops.drop("pred").join(succ, by, "full_outer").withColumn("action", F.when(F.col("action").isNull(), missing).otherwise(F.col("action"))).filter("action <> 'del'")
    stored = work.put(stored, "stored")
    obj = parse_opid(F.when(F.col("obj") != "_root", F.col("obj")))
    first = ["doc_id", obj["ctr"].asc_nulls_first(), obj["actor"]]
    if stored.filter("key is null").isEmpty():
        placed = stored.orderBy(*first, "key", "ctr", "actor")
    else:
        at = F.when(F.col("key").isNull(), F.when(F.col("insert"), opid(F.col("ctr"), F.col("actor"))).otherwise(F.col("elem")))
        order = crdt_list_order(stored, work=work).withColumnRenamed("elem", "at")
        lost = F.col("key").isNull() & F.col("entry_rank").isNull()
        placed = stored.withColumn("at", at).join(order, ["doc_id", "obj", "at"], "left")
        placed = placed.withColumn("rank", F.when(lost, F.raise_error(F.lit("an element refers to one that is not there"))).otherwise(F.col("entry_rank")))
        placed = placed.orderBy(*first, F.col("key").asc_nulls_last(), F.col("rank").desc(), "ctr", "actor")
    pieces = _by_batch(placed, _pieces, _PIECE)
    both = heads.withColumn("col", F.lit(-1)).unionByName(pieces, allowMissingColumns=True)
    return _by_batch(both.repartition("doc_id").sortWithinPartitions("doc_id", "col", "part", "piece"), _assembled, "doc_id string, data binary")
