"""The binary form of columns, changes and containers, in plain Python.

Numbers are LEB128. A column is one of: run lengths of unsigned numbers or of texts, run
lengths of differences, alternating counts of booleans, or raw bytes. A change is a
header and a set of columns within a container that has a checksum; its hash is the
SHA-256 of the container's type, length and content.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable
from itertools import groupby
from typing import Any

SAFE = 2**53 - 1

# Fixed values of the format.
MAGIC = bytes([0x85, 0x6F, 0x4A, 0x83])
DOCUMENT, CHANGE, DEFLATED = 0, 1, 2
DEFLATE_FROM = 256
ACTIONS = ["makeMap", "set", "makeList", "del", "makeText", "inc", "makeTable", "link"]
VALUES = {"null": 0, "false": 1, "true": 2, "uint": 3, "int": 4, "float64": 5, "str": 6, "bytes": 7, "counter": 8, "timestamp": 9}
GROUP, ACTOR, UINT, DELTA, BOOL, STRING, VAL_LEN, VAL_RAW = range(8)
#: Columns of a change: name, group and physical type.
CHANGE_COLUMNS = {
    "objActor": (0, ACTOR), "objCtr": (0, UINT), "keyActor": (1, ACTOR), "keyCtr": (1, DELTA), "keyStr": (1, STRING), "idActor": (2, ACTOR), "idCtr": (2, DELTA), "insert": (3, BOOL), "action": (4, UINT),
    "valLen": (5, VAL_LEN), "valRaw": (5, VAL_RAW), "chldActor": (6, ACTOR), "chldCtr": (6, DELTA), "predNum": (7, GROUP), "predActor": (7, ACTOR), "predCtr": (7, DELTA),
}


class FormatError(ValueError):
    """Bytes that are not of the format."""


# --- numbers ---


def uleb(n: int, bits: int = 64) -> bytes:
    if not 0 <= n < 1 << bits:
        raise FormatError(f"number out of range: {n}")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def sleb(n: int, bits: int = 64) -> bytes:
    if not -(1 << bits - 1) <= n < 1 << bits - 1:
        raise FormatError(f"number out of range: {n}")
    out = bytearray()
    while not -64 <= n < 64:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n & 0x7F)
    return bytes(out)


class Reader:
    """Reads values from bytes, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = bytes(data), 0

    @property
    def done(self) -> bool:
        return self.at >= len(self.data)

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError("it ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def _groups(self) -> tuple[int, int, int]:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value, shift, b
            if shift > 63:
                raise FormatError("number out of range")

    def uint(self, bits: int = 64) -> int:
        value, _, _ = self._groups()
        if value >= 1 << bits:
            raise FormatError("number out of range")
        return value

    def int(self, bits: int = 64) -> int:
        value, shift, last = self._groups()
        if last & 0x40:
            value -= 1 << shift
        if not -(1 << bits - 1) <= value < 1 << bits - 1:
            raise FormatError("number out of range")
        return value

    def blob(self) -> bytes:
        return self.take(self.uint())

    def text(self) -> str:
        return self.blob().decode("utf-8")

    def rest(self) -> bytes:
        return self.take(len(self.data) - self.at)


def blob(b: bytes) -> bytes:
    return uleb(len(b)) + b


def text(s: str) -> bytes:
    return blob(s.encode("utf-8"))


# --- columns ---


def rle(values: Iterable[Any], put: Callable[[Any], bytes]) -> bytes:
    """Runs: a count and the value; minus the number of values that differ, and these; 0 and a number of nulls. All null is nothing."""
    runs = [(v, len(list(g))) for v, g in groupby(values)]
    if all(v is None for v, _ in runs):
        return b""
    out, lone = bytearray(), []

    def flush() -> None:
        if lone:
            out.extend(sleb(-len(lone)) + b"".join(map(put, lone)))
            lone.clear()

    for v, n in runs:
        if v is not None and n == 1:
            lone.append(v)
            continue
        flush()
        out += sleb(0) + uleb(n) if v is None else sleb(n) + put(v)
    flush()
    return bytes(out)


def unrle(data: bytes, get: Callable[[Reader], Any]) -> list[Any]:
    """Values of ``rle``; forms that it would not write are refused."""
    r, out, before = Reader(data), [], None
    while not r.done:
        n = r.int(53)
        if n > 1:
            v = get(r)
            if before in ("run", "lone") and out[-1] == v:
                raise FormatError("neighbouring runs of one value")
            out += [v] * n
            before = "run"
        elif n == 1:
            raise FormatError("a run of one")
        elif n == 0:
            k = r.uint(53)
            if k == 0 or before == "null":
                raise FormatError("runs of nulls that are empty or not joined")
            out += [None] * k
            before = "null"
        else:
            if before == "lone":
                raise FormatError("lists that are not joined")
            for _ in range(-n):
                v = get(r)
                if before in ("run", "lone") and out and out[-1] == v:
                    raise FormatError("equal values in a list")
                out.append(v)
                before = "lone"
    return out


def _differences(values: Iterable[int | None]) -> list[int | None]:
    last, out = 0, []
    for v in values:
        out.append(None if v is None else v - last)
        last = last if v is None else v
    return out


def encode_column(kind: int, values: list[Any]) -> bytes:
    if kind in (GROUP, ACTOR, UINT, VAL_LEN):
        return rle(values, lambda v: uleb(v, 53))
    if kind == DELTA:
        return rle(_differences(values), lambda v: sleb(v, 54))
    if kind == STRING:
        return rle(values, text)
    if kind == BOOL:
        out, now = bytearray(), False
        for v, g in groupby(map(bool, values)):
            if v != now:  # only at the start
                out += uleb(0)
            out += uleb(len(list(g)))
            now = not v
        return bytes(out)
    return b"".join(values)


def decode_column(kind: int, data: bytes) -> list[Any]:
    if kind in (GROUP, ACTOR, UINT, VAL_LEN):
        return unrle(data, lambda r: r.uint(53))
    if kind == DELTA:
        out, last = [], 0
        for d in unrle(data, lambda r: r.int(54)):
            last += d or 0
            out.append(None if d is None else last)
        return out
    if kind == STRING:
        return unrle(data, Reader.text)
    if kind == BOOL:
        r, out, now = Reader(data), [], False
        while not r.done:
            n = r.uint(53)
            if n == 0 and out:
                raise FormatError("an empty run")
            out += [now] * n
            now = not now
        return out
    raise FormatError(f"no column type {kind}")


# --- values ---


def encode_value(vtype: str, value: Any) -> tuple[int, bytes]:
    """Tag with length, and bytes."""
    if vtype in ("null", "false", "true"):
        raw = b""
    elif vtype == "uint":
        raw = uleb(value, 53)
    elif vtype in ("int", "counter", "timestamp"):
        raw = sleb(value, 54)
    elif vtype == "float64":
        raw = struct.pack("<d", value)
    elif vtype == "str":
        raw = value.encode("utf-8")
    elif vtype == "bytes" or vtype.isdigit():
        raw = bytes(value)
    else:
        raise FormatError(f"no value type {vtype}")
    tag = VALUES.get(vtype)
    return len(raw) << 4 | (int(vtype) if tag is None else tag), raw


_TYPE = {v: k for k, v in VALUES.items()}


def decode_value(tag: int, raw: bytes) -> tuple[str, Any]:
    vtype = _TYPE.get(tag & 15, str(tag & 15))
    if vtype in ("null", "false", "true"):
        return vtype, {"null": None, "false": False, "true": True}[vtype]
    if vtype == "float64":
        if len(raw) != 8:
            raise FormatError("a float of other than 8 bytes")
        return vtype, struct.unpack("<d", raw)[0]
    if vtype == "str":
        return vtype, raw.decode("utf-8")
    if vtype in ("uint", "int", "counter", "timestamp"):
        r = Reader(raw)
        return vtype, r.uint(53) if vtype == "uint" else r.int(54)
    return vtype, raw


# --- containers ---


def container(kind: int, body: bytes) -> tuple[bytes, str]:
    """The container's bytes, and the hash of what it holds."""
    digest = content_digest(kind, body)
    return b"".join([MAGIC, digest[:4], bytes([kind]), uleb(len(body)), body]), digest.hex()


def content_digest(kind: int, body: bytes) -> bytes:
    """SHA-256 of a container's type, length and content."""
    h = hashlib.sha256(bytes([kind]) + uleb(len(body)))
    h.update(body)
    return h.digest()


def containers(data: bytes) -> list[tuple[int, bytes, str]]:
    """Type, content and hash of each container in a row. Deflated changes come out as plain ones; wrong checksums are refused."""
    r, out = Reader(data), []
    while not r.done:
        if r.take(4) != MAGIC:
            raise FormatError("no container")
        check, kind, body = r.take(4), r.take(1)[0], r.blob()
        if kind == DEFLATED:
            kind, body = CHANGE, inflate(body)
        digest = content_digest(kind, body)
        if digest[:4] != check:
            raise FormatError("wrong checksum")
        out.append((kind, body, digest.hex()))
    return out


def deflate(body: bytes) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return c.compress(body) + c.flush()


def inflate(body: bytes) -> bytes:
    return zlib.decompress(body, wbits=-15)


# --- changes ---


def _id(s: str) -> tuple[int, str]:
    ctr, _, actor = s.partition("@")
    if not (ctr.isdigit() and actor):
        raise FormatError(f"no operation id: {s}")
    return int(ctr), actor


op_id = _id


def expand(ops: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Single operations for those of several values or deletions; each inserted value follows the one before."""
    out: list[dict[str, Any]] = []
    for op in ops:
        n = len(op["values"]) if "values" in op else op.get("multiOp", 1)
        for k in range(n):
            one = {x: v for x, v in op.items() if x not in ("values", "multiOp")}
            if "values" in op:
                one["value"] = op["values"][k]
            one["_follows"] = bool(k) and "values" in op
            if k and "multiOp" in op:
                c, a = _id(op["elemId"])
                one["elemId"] = f"{c + k}@{a}"
                one["pred"] = [f"{_id(p)[0] + k}@{_id(p)[1]}" for p in op["pred"]]
            out.append(one)
    return out


def op_columns(ops: list[dict[str, Any]], num: dict[str, int], columns: dict[str, tuple[int, int]], refs: str) -> dict[str, list[Any]]:
    """Column values of single operations; ``refs`` is ``pred`` in changes and ``succ`` in documents."""
    col: dict[str, list[Any]] = {c: [] for c in columns}
    for op in ops:
        obj = op.get("obj", "_root")
        c, a = (None, None) if obj == "_root" else _id(obj)
        col["objActor"].append(None if a is None else num[a])
        col["objCtr"].append(c)
        ka = kc = None
        if op.get("key") is None and op["elemId"] == "_head":
            kc = 0
        elif op.get("key") is None:
            kc, actor = _id(op["elemId"])
            ka = num[actor]
        col["keyActor"].append(ka)
        col["keyCtr"].append(kc)
        col["keyStr"].append(op.get("key"))
        if "id" in op:
            c, a = _id(op["id"])
            col["idActor"].append(num[a])
            col["idCtr"].append(c)
        col["insert"].append(bool(op.get("insert")))
        col["action"].append(ACTIONS.index(op["action"]) if isinstance(op["action"], str) else op["action"])
        tag, raw = encode_value(*_typed(op)) if op["action"] in ("set", "inc") else (0, b"")
        col["valLen"].append(tag)
        col["valRaw"].append(raw)
        col["chldActor"].append(None)
        col["chldCtr"].append(None)
        named = [_id(p) for p in op.get(refs, [])]
        col[refs + "Num"].append(len(named))
        col[refs + "Ctr"] += [c for c, _ in named]
        col[refs + "Actor"] += [num[a] for _, a in named]
    return col


def packed_columns(col: dict[str, list[Any]], columns: dict[str, tuple[int, int]], compress: bool = False) -> list[tuple[int, bytes]]:
    """Ids and bytes of the columns that are not empty; large ones are deflated if asked."""
    parts = [(g << 4 | t, encode_column(t, col[c])) for c, (g, t) in columns.items()]
    parts = [(i | 8, deflate(b)) if compress and len(b) >= DEFLATE_FROM else (i, b) for i, b in parts if b]
    return sorted(parts, key=lambda x: x[0] & ~8)


def encode_change(change: dict[str, Any], compress: bool = True) -> tuple[bytes, str]:
    """Bytes and hash of a change with ``actor, seq, startOp, time, message, deps, ops``."""
    data, hash_ = sealed_change(change, change_tail(change), compress)
    if change.get("hash") not in (None, hash_):
        raise FormatError("the change has another hash")
    return data, hash_


def change_tail(change: dict[str, Any]) -> bytes:
    """What of a change comes after its message: other actors, operations and extra bytes. It does not tell what the change depends on."""
    ops = expand(change["ops"])
    me, start = change["actor"], change["startOp"]
    ids = [_id(x) for op in ops for x in (op.get("obj"), op.get("elemId"), *op.get("pred", [])) if x and x not in ("_root", "_head")]
    actors = [me, *sorted({a for _, a in ids} - {me})]
    num = {a: k for k, a in enumerate(actors)}
    singles = []
    for k, op in enumerate(ops):
        if op.pop("_follows"):
            op["elemId"] = f"{start + k - 1}@{me}"
        singles.append(op | {"pred": [f"{c}@{a}" for c, a in sorted(_id(p) for p in op.get("pred", []))]})
    col = op_columns(singles, num, CHANGE_COLUMNS, "pred")
    parts = packed_columns(col | {"idActor": [], "idCtr": []}, CHANGE_COLUMNS)
    return joined_tail(actors, parts) + change.get("extraBytes", b"")


def joined_tail(actors: list[str], parts: list[tuple[int, bytes]]) -> bytes:
    """The tail of a change from its actors, of which the first is its own, and its columns."""
    return b"".join([uleb(len(actors) - 1), *(blob(bytes.fromhex(a)) for a in actors[1:]), uleb(len(parts)), *(uleb(i) + uleb(len(b)) for i, b in parts), *(b for _, b in parts)])


def sealed_change(change: dict[str, Any], tail: bytes, compress: bool = True) -> tuple[bytes, str]:
    """Bytes and hash of a change from its header and its tail."""
    deps = sorted(bytes.fromhex(h) for h in change.get("deps", []))
    head = uleb(len(deps)) + b"".join(deps) + blob(bytes.fromhex(change["actor"])) + uleb(change["seq"], 53) + uleb(change["startOp"], 53) + sleb(change.get("time", 0), 54) + text(change.get("message") or "")
    body = head + tail
    data, hash_ = container(CHANGE, body)
    if compress and len(data) >= DEFLATE_FROM:
        data = MAGIC + data[4:8] + bytes([DEFLATED]) + blob(deflate(body))
    return data, hash_


def _typed(op: dict[str, Any]) -> tuple[str, Any]:
    v, kind = op.get("value"), op.get("datatype")
    if kind:
        return kind, v
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v], v
    if isinstance(v, str):
        return "str", v
    if isinstance(v, bytes):
        return "bytes", v
    return ("int", v) if isinstance(v, int) and abs(v) <= SAFE else ("float64", float(v))


def decode_header(body: bytes) -> tuple[dict[str, Any], Reader, list[str]]:
    """A change without its operations, what is left to read, and its actors."""
    r = Reader(body)
    deps = [r.take(32).hex() for _ in range(r.uint())]
    actor, seq, start, time, message = r.blob().hex(), r.uint(53), r.uint(53), r.int(54), r.text()
    actors = [actor, *[r.blob().hex() for _ in range(r.uint())]]
    return {"actor": actor, "seq": seq, "startOp": start, "time": time, "message": message or None, "deps": deps}, r, actors


def decode_change(data: bytes) -> dict[str, Any]:
    """The change in one container, with its ``hash``; operations have ``id`` and sorted ``pred``. Unknown columns are skipped."""
    (kind, body, hash_), *more = containers(data)
    if kind != CHANGE or more:
        raise FormatError("not one change")
    head, r, actors = decode_header(body)
    sizes = [(r.uint(), r.uint()) for _ in range(r.uint())]
    ops = read_ops(read_columns(r, sizes, CHANGE_COLUMNS), actors, "pred", head["startOp"])
    out = head | {"ops": ops, "hash": hash_}
    if not r.done:
        out["extraBytes"] = r.rest()
    return out


def read_columns(r: Reader, sizes: list[tuple[int, int]], columns: dict[str, tuple[int, int]]) -> dict[str, Any]:
    """Values of known columns; unknown ones are skipped, raw ones stay bytes."""
    raw = column_bytes(r, sizes, columns)
    return {c: raw.get(c, b"") if t == VAL_RAW else decode_column(t, raw.get(c, b"")) for c, (_, t) in columns.items()}


def column_bytes(r: Reader, sizes: list[tuple[int, int]], columns: dict[str, tuple[int, int]]) -> dict[str, bytes]:
    """Inflated bytes of those known columns that are there."""
    names = {g << 4 | t: c for c, (g, t) in columns.items()}
    raw: dict[str, bytes] = {}
    for i, n in sizes:
        piece = r.take(n)
        if i & 8:  # this column is deflated by itself
            i, piece = i ^ 8, inflate(piece)
        if i in names:
            raw[names[i]] = piece
    return raw


def read_ops(col: dict[str, Any], actors: list[str], refs: str, start: int | None = None) -> list[dict[str, Any]]:
    """Operations from column values; ids count on from ``start`` in a change and are columns in a document."""
    at = lambda c, k: col[c][k] if k < len(col[c]) else (False if c == "insert" else None)
    values, p, ops = Reader(col["valRaw"]), 0, []
    for k in range(len(col["action"])):
        own = f"{start + k}@{actors[0]}" if start is not None else f"{col['idCtr'][k]}@{actors[col['idActor'][k]]}"
        op: dict[str, Any] = {"id": own, "action": ACTIONS[a] if (a := at("action", k)) < len(ACTIONS) else a}
        op["obj"] = "_root" if at("objCtr", k) is None else f"{at('objCtr', k)}@{actors[at('objActor', k)]}"
        if (key := at("keyStr", k)) is not None:
            op["key"] = key
        else:
            op["elemId"] = "_head" if at("keyActor", k) is None else f"{at('keyCtr', k)}@{actors[at('keyActor', k)]}"
        op["insert"] = at("insert", k)
        tag = at("valLen", k) or 0
        vtype, value = decode_value(tag, values.take(tag >> 4))
        if op["action"] in ("set", "inc"):
            op["value"] = value
            if vtype not in ("null", "true", "false", "str", "bytes"):
                op["datatype"] = vtype
        m = at(refs + "Num", k) or 0
        op[refs] = [f"{col[refs + 'Ctr'][x]}@{actors[col[refs + 'Actor'][x]]}" for x in range(p, p + m)]
        if [_id(x) for x in op[refs]] != sorted(set(map(_id, op[refs]))):
            raise FormatError("operation ids are not ascending")
        p += m
        ops.append(op)
    return ops


# --- documents ---

DOC_OPS_COLUMNS = {c: v for c, v in CHANGE_COLUMNS.items() if not c.startswith("pred")} | {"succNum": (8, GROUP), "succActor": (8, ACTOR), "succCtr": (8, DELTA)}
#: Columns of a document's changes.
DOC_CHANGE_COLUMNS = {
    "actor": (0, ACTOR), "seq": (0, DELTA), "maxOp": (1, DELTA), "time": (2, DELTA), "message": (3, STRING), "depsNum": (4, GROUP), "depsIndex": (4, DELTA), "extraLen": (5, VAL_LEN), "extraRaw": (5, VAL_RAW),
}


def _stored_order(ops: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The root first, then objects by id; keys in order, elements in sequence, operations of one place by id."""
    by_obj: dict[str, list[dict[str, Any]]] = {}
    for op in ops:
        by_obj.setdefault(op["obj"], []).append(op)
    out: list[dict[str, Any]] = []
    for obj in sorted(by_obj, key=lambda o: (0, "") if o == "_root" else _id(o)):
        rows = by_obj[obj]
        out += sorted((op for op in rows if "key" in op), key=lambda op: (op["key"], _id(op["id"])))
        places: dict[str, list[dict[str, Any]]] = {}
        below: dict[str, list[str]] = {}
        for op in rows:
            if "key" not in op:
                places.setdefault(op["id"] if op["insert"] else op["elemId"], []).append(op)
                if op["insert"]:
                    below.setdefault(op["elemId"], []).append(op["id"])
        todo = sorted(below.get("_head", []), key=_id)
        while todo:
            elem = todo.pop()
            out += sorted(places.pop(elem), key=lambda op: _id(op["id"]))
            todo += sorted(below.get(elem, []), key=_id)
        if places:
            raise FormatError("an element refers to one that is not there")
    return out


def document_header(h: dict[str, Any]) -> bytes:
    """What a document begins with: actors, heads, and id and length of each column of its changes and of its operations."""
    out = uleb(len(h["actors"])) + b"".join(blob(bytes.fromhex(a)) for a in h["actors"]) + uleb(len(h["heads"])) + b"".join(map(bytes.fromhex, h["heads"]))
    for columns in (h["changes"], h["ops"]):
        out += uleb(len(columns)) + b"".join(uleb(i) + uleb(n) for i, n in columns)
    return out


def read_document_header(r: Reader) -> dict[str, Any]:
    actors = [r.blob().hex() for _ in range(r.uint())]
    heads = [r.take(32).hex() for _ in range(r.uint())]
    changes, ops = ([(r.uint(), r.uint()) for _ in range(r.uint())] for _ in range(2))
    return {"actors": actors, "heads": heads, "changes": changes, "ops": ops}


def encode_document(changes: list[dict[str, Any]]) -> bytes:
    """A whole document from its decoded changes, in an order in which none comes before what it depends on."""
    ops, succ = {}, {}
    for c in changes:
        for op in c["ops"]:
            ops[op["id"]] = op
            for p in op["pred"]:
                succ.setdefault(p, []).append(op["id"])
    if missing := [p for p in succ if p not in ops]:
        raise FormatError(f"no operation {missing[0]}")
    kept = _stored_order([op | {"succ": sorted(succ.get(i, []), key=_id)} for i, op in ops.items() if op["action"] != "del"])
    h, parts = document_changes(changes)
    num = {a: k for k, a in enumerate(h["actors"])}
    return document(h, parts, packed_columns(op_columns(kept, num, DOC_OPS_COLUMNS, "succ"), DOC_OPS_COLUMNS, True))


def document_changes(changes: list[dict[str, Any]]) -> tuple[dict[str, Any], list[tuple[int, bytes]]]:
    """Of changes in their order, what a document tells of all but operations: ``actors, heads, headsIndex``, and columns. ``nOps`` may stand for ``ops``."""
    index = {c["hash"]: k for k, c in enumerate(changes)}
    actors = sorted({c["actor"] for c in changes})
    num = {a: k for k, a in enumerate(actors)}
    deps = [sorted(index[h] for h in c["deps"]) for c in changes]
    extra = [c.get("extraBytes", b"") for c in changes]
    meta = {
        "actor": [num[c["actor"]] for c in changes], "seq": [c["seq"] for c in changes], "maxOp": [c["startOp"] + (c["nOps"] if "nOps" in c else len(c["ops"])) - 1 for c in changes], "time": [c["time"] for c in changes],
        "message": [c["message"] or "" for c in changes], "depsNum": [len(d) for d in deps], "depsIndex": [x for d in deps for x in d], "extraLen": [len(e) << 4 | VALUES["bytes"] for e in extra], "extraRaw": extra,
    }
    named = {h for c in changes for h in c["deps"]}
    heads = sorted(set(index) - named)
    return {"actors": actors, "heads": heads, "headsIndex": [index[h] for h in heads]}, packed_columns(meta, DOC_CHANGE_COLUMNS, True)


def document(h: dict[str, Any], changes: list[tuple[int, bytes]], ops: list[tuple[int, bytes]]) -> bytes:
    """A document from what ``document_changes`` gives and the columns of its operations."""
    head = document_header({"actors": h["actors"], "heads": h["heads"], "changes": [(i, len(b)) for i, b in changes], "ops": [(i, len(b)) for i, b in ops]})
    return container(DOCUMENT, b"".join([head, *(b for _, b in changes), *(b for _, b in ops), *map(uleb, h["headsIndex"])]))[0]


def decode_document(data: bytes) -> list[dict[str, Any]]:
    """The changes of a document, with their hashes: deletions and predecessors are rebuilt, operations given to the change that covers them."""
    (kind, body, _), *more = containers(data)
    if kind != DOCUMENT or more:
        raise FormatError("not one document")
    r = Reader(body)
    header = read_document_header(r)
    actors, heads = header["actors"], header["heads"]
    meta = read_columns(r, header["changes"], DOC_CHANGE_COLUMNS)
    ops = {op["id"]: op for op in read_ops(read_columns(r, header["ops"], DOC_OPS_COLUMNS), actors, "succ")}
    for op in list(ops.values()):
        for s in op.pop("succ"):
            if s not in ops:  # only deletions have no row
                place = {"key": op["key"]} if "key" in op else {"elemId": op["id"] if op["insert"] else op["elemId"]}
                ops[s] = {"id": s, "action": "del", "obj": op["obj"], **place, "insert": False}
            ops[s].setdefault("pred", []).append(op["id"])
    spans: dict[str, list[tuple[int, int]]] = {}
    for k, (a, top) in enumerate(zip(meta["actor"], meta["maxOp"], strict=True)):
        spans.setdefault(actors[a], []).append((top, k))
    for own in spans.values():
        own.sort()
    held: list[list[dict[str, Any]]] = [[] for _ in meta["actor"]]
    for op in ops.values():
        ctr, actor = _id(op["id"])
        own = spans.get(actor, [])
        at = bisect_left(own, (ctr, -1))
        if at == len(own):
            raise FormatError("an operation that no change covers")
        held[own[at][1]].append(op | {"pred": sorted(op.get("pred", []), key=_id)})
    out: list[dict[str, Any]] = []
    depth, raw = 0, Reader(meta["extraRaw"])
    for k, mine in enumerate(held):
        mine.sort(key=lambda op: _id(op["id"]))
        n = meta["depsNum"][k]
        deps = sorted(out[x]["hash"] for x in meta["depsIndex"][depth : depth + n])
        depth += n
        change = {"actor": actors[meta["actor"][k]], "seq": meta["seq"][k], "startOp": meta["maxOp"][k] - len(mine) + 1, "time": meta["time"][k], "message": meta["message"][k] or None, "deps": deps, "ops": mine}
        if extra := raw.take((meta["extraLen"][k] if k < len(meta["extraLen"]) else 0) >> 4):
            change["extraBytes"] = extra
        if [_id(op["id"])[0] for op in mine] != list(range(change["startOp"], change["startOp"] + len(mine))):
            raise FormatError("operation ids are not consecutive")
        out.append(change | {"hash": encode_change(change)[1]})
    if sorted({c["hash"] for c in out} - {h for c in out for h in c["deps"]}) != sorted(heads):
        raise FormatError("the heads are others")
    return out


# --- sync messages ---

SYNC_MESSAGE, SYNC_STATE = 0x42, 0x43  # fixed values


def _hashes(hs: list[str]) -> bytes:
    if hs != sorted(set(hs)):
        raise FormatError("hashes are not sorted")
    return uleb(len(hs), 32) + b"".join(map(bytes.fromhex, hs))


def encode_message(m: dict[str, Any]) -> bytes:
    out = bytes([SYNC_MESSAGE]) + _hashes(m["heads"]) + _hashes(m["need"]) + uleb(len(m["have"]), 32)
    for h in m["have"]:
        out += _hashes(h["lastSync"]) + blob(h["bloom"])
    return out + uleb(len(m["changes"]), 32) + b"".join(map(blob, m["changes"]))


def decode_message(data: bytes) -> dict[str, Any]:
    r = Reader(data)
    if r.take(1)[0] != SYNC_MESSAGE:
        raise FormatError("no sync message")
    hs = lambda: [r.take(32).hex() for _ in range(r.uint(32))]
    heads, need = hs(), hs()
    have = [{"lastSync": hs(), "bloom": r.blob()} for _ in range(r.uint(32))]
    return {"heads": heads, "need": need, "have": have, "changes": [r.blob() for _ in range(r.uint(32))]}


def encode_state(shared_heads: list[str]) -> bytes:
    """What of a peer's state outlives a connection: the heads both have."""
    return bytes([SYNC_STATE]) + _hashes(shared_heads)


def decode_state(data: bytes) -> list[str]:
    r = Reader(data)
    if r.take(1)[0] != SYNC_STATE:
        raise FormatError("no peer state")
    return [r.take(32).hex() for _ in range(r.uint(32))]


def _bloom_places(hash_: str, size: int, probes: int) -> list[int]:
    x, y, z = (w % size for w in struct.unpack("<3I", bytes.fromhex(hash_)[:12]))
    out = []
    for _ in range(probes):
        out.append(x)
        x, y = (x + y) % size, (y + z) % size
    return out


def encode_bloom(hashes: list[str], bits: int = 10, probes: int = 7) -> bytes:
    """A filter in wire form; nothing for no hashes."""
    if not hashes:
        return b""
    out = bytearray(-(-len(hashes) * bits // 8))
    for h in hashes:
        for p in _bloom_places(h, 8 * len(out), probes):
            out[p >> 3] |= 1 << (p & 7)
    return uleb(len(hashes), 32) + uleb(bits, 32) + uleb(probes, 32) + bytes(out)


def bloom_contains(data: bytes, hash_: str) -> bool:
    if not data:
        return False
    r = Reader(data)
    n, bits, probes = r.uint(32), r.uint(32), r.uint(32)
    field = r.take(-(-n * bits // 8))
    return n > 0 and all(field[p >> 3] >> (p & 7) & 1 for p in _bloom_places(hash_, 8 * len(field), probes))
