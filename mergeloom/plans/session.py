"""A document edited on one machine: changes are built by ordinary item access.

This is the small end of the engine: a driver-side builder whose changes are the rows
that the operators take. State is computed from the set of operations, never edited.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from ..functions import ids
from ..sources import codec


class MergeError(ValueError):
    """An edit that is not allowed, or changes that do not fit."""


class _New:
    def __init__(self, kind: str, value: Any):
        self.kind, self.value = kind, value


def _key(i: str) -> tuple[int, str]:
    ctr, _, actor = i.partition("@")
    return int(ctr), actor


def _cell_of(op: dict[str, Any]) -> str:
    """The key or element that an operation is about; an insertion is about itself."""
    return op["key"] if "key" in op else op["id"] if op["insert"] else op["elemId"]


class Document:
    """A replica. ``merge`` takes in another's changes; both then have the same value."""

    def __init__(self, actor: str, on_change: Callable[[Document], None] | None = None):
        """``on_change`` is called with the document after each change made here."""
        self.on_change = on_change
        if not re.fullmatch(r"([0-9a-f]{2})+", actor):
            raise MergeError(f"no actor id: {actor}")
        self.actor = actor
        self.changes: dict[str, dict[str, Any]] = {}  # applied, in order
        self.waiting: dict[str, dict[str, Any]] = {}
        self.ops: dict[str, dict[str, Any]] = {}
        self.succ: dict[str, list[str]] = {}
        self.cells: dict[str, dict[str, list[str]]] = {}  # of each object, operations that may be seen by cell
        self.below: dict[tuple[str, str], list[str]] = {}  # elements inserted after each
        self.tops: dict[int, int] = {}  # operations by counter, so that the greatest is known again after an edit is undone
        self.max_op = 0
        self._clock: dict[str, int] = {}
        self._heads: set[str] = set()
        self._pending: list[dict[str, Any]] | None = None

    # --- values ---

    @staticmethod
    def text(s: str = "") -> _New:
        return _New("makeText", list(s))

    @staticmethod
    def table() -> _New:
        return _New("makeTable", {})

    @staticmethod
    def counter(n: int = 0) -> _New:
        return _New("counter", n)

    # --- changes ---

    def apply(self, changes: list[dict[str, Any]]) -> Document:
        """Take in decoded changes in any order; what lacks a dependency waits."""
        added = [c for c in changes if c["hash"] not in self.changes and c["hash"] not in self.waiting]
        self.waiting |= {c["hash"]: c for c in added}
        taken: list[dict[str, Any]] = []
        begun = dict(self.waiting), dict(self._clock), set(self._heads)
        try:
            moved = True
            while moved:
                moved = False
                for h, c in list(self.waiting.items()):
                    if all(d in self.changes for d in c["deps"]):
                        self._take(c)
                        taken.append(c)
                        del self.waiting[h]
                        moved = True
        except MergeError:  # all of them or none
            for c in reversed(taken):
                del self.changes[c["hash"]]
                for op in reversed(c["ops"]):
                    self._remove(op)
            self.waiting, self._clock, self._heads = begun
            for c in added:
                self.waiting.pop(c["hash"], None)
            raise
        return self

    def _take(self, c: dict[str, Any]) -> None:
        at = self._clock.get(c["actor"], 0)
        if c["seq"] != at + 1:
            raise MergeError(f"{'reuse of' if c['seq'] <= at else 'skipped'} sequence number {c['seq']} of {c['actor']}")
        mine = {op["id"]: op for op in c["ops"]}
        for op in c["ops"]:
            for p in op["pred"]:
                named = self.ops.get(p) or mine.get(p)
                if named is None or named["obj"] != op["obj"] or _cell_of(named) != _cell_of(op):
                    raise MergeError(f"no operation {p} under {_cell_of(op)} of {op['obj']}")
        self.changes[c["hash"]] = c
        self._clock[c["actor"]] = c["seq"]
        self._heads = self._heads - set(c["deps"]) | {c["hash"]}
        for op in c["ops"]:
            self._add(op)

    def _add(self, op: dict[str, Any]) -> None:
        self.ops[op["id"]] = op
        ctr = _key(op["id"])[0]
        self.tops[ctr] = self.tops.get(ctr, 0) + 1
        self.max_op = max(self.max_op, ctr)
        if op["action"] not in ("del", "inc"):
            self.cells.setdefault(op["obj"], {}).setdefault(_cell_of(op), []).append(op["id"])
        if op["insert"]:
            self.below.setdefault((op["obj"], op["elemId"]), []).append(op["id"])
        for p in op["pred"]:
            self.succ.setdefault(p, []).append(op["id"])

    def _remove(self, op: dict[str, Any]) -> None:
        """Undo ``_add`` of the last operation that was added."""
        i = op["id"]
        del self.ops[i]
        ctr = _key(i)[0]
        self.tops[ctr] -= 1
        if not self.tops[ctr]:
            del self.tops[ctr]
            while self.max_op and self.max_op not in self.tops:
                self.max_op -= 1
        if op["action"] not in ("del", "inc"):
            self.cells[op["obj"]][_cell_of(op)].remove(i)
        if op["insert"]:
            self.below[op["obj"], op["elemId"]].remove(i)
        for p in op["pred"]:
            self.succ[p].remove(i)

    def merge(self, other: Document) -> Document:
        return self.apply(list(other.changes.values()))

    def clock(self) -> dict[str, int]:
        return dict(self._clock)

    def heads(self) -> list[str]:
        return sorted(self._heads)

    def missing(self) -> list[str]:
        """Dependencies of waiting changes that are nowhere."""
        return sorted({d for c in self.waiting.values() for d in c["deps"]} - set(self.changes) - set(self.waiting))

    def changes_since(self, heads: list[str]) -> list[dict[str, Any]]:
        """Changes that are neither among ``heads`` nor before them, in the order applied."""
        known, todo = set(), [h for h in heads if h in self.changes]
        while todo:
            h = todo.pop()
            if h not in known:
                known.add(h)
                todo += self.changes[h]["deps"]
        return [c for h, c in self.changes.items() if h not in known]

    def history(self) -> list[dict[str, Any]]:
        return list(self.changes.values())

    def at(self, n: int) -> Document:
        """The document after its first ``n`` changes."""
        return Document(self.actor).apply(list(self.changes.values())[:n])

    def save(self) -> bytes:
        return codec.encode_document(list(self.changes.values()))

    @classmethod
    def load(cls, data: bytes, actor: str = "00") -> Document:
        """From any containers in a row: documents, changes or both."""
        doc = cls(actor)
        for kind, body, _ in codec.containers(data):
            whole = codec.container(kind, body)[0]
            if kind == codec.DOCUMENT:
                doc.apply(codec.decode_document(whole))
            elif kind == codec.CHANGE:
                doc.apply([codec.decode_change(whole)])
        return doc

    # --- state ---

    def _cell(self, obj: str, cell: str) -> dict[str, dict[str, Any]]:
        """Values of a cell by operation id; counters are folded."""
        out: dict[str, dict[str, Any]] = {}
        for i in self.cells.get(obj, {}).get(cell, ()):
            op = self.ops[i]
            after = [self.ops[s] for s in self.succ.get(i, [])]
            if op["action"] == "set" and op.get("datatype") == "counter":
                fold = [s for s in after if s["action"] == "inc" and max((p for p in s["pred"] if self.ops[p].get("datatype") == "counter"), key=_key) == i]
                if len(fold) == len(after):
                    out[i] = op | {"value": op["value"] + sum(s["value"] for s in fold)}
            elif not after:
                out[i] = op
        return out

    def _cells(self, obj: str) -> dict[str, dict[str, dict[str, Any]]]:
        """All cells of an object that show anything."""
        return {c: got for c in self.cells.get(obj, ()) if (got := self._cell(obj, c))}

    def _order(self, obj: str) -> list[str]:
        out, todo = [], sorted(self.below.get((obj, "_head"), []), key=_key)
        while todo:
            out.append(e := todo.pop())
            todo += sorted(self.below.get((obj, e), []), key=_key)
        return out

    def _kind(self, obj: str) -> str:
        return "makeMap" if obj == "_root" else self.ops[obj]["action"]

    def value(self, obj: str = "_root") -> Any:
        """Plain value of an object: the winner of every cell."""
        seen = self._cells(obj)

        def one(cell: str) -> Any:
            op = seen[cell][max(seen[cell], key=_key)]
            return op.get("value") if op["action"] == "set" else self.value(op["id"])

        if self._kind(obj) in ("makeMap", "makeTable"):
            return {k: one(k) | {"id": k} if self._kind(obj) == "makeTable" else one(k) for k in seen}
        items = [one(e) for e in self._order(obj) if e in seen]
        return "".join(x for x in items if isinstance(x, str)) if self._kind(obj) == "makeText" else items

    def conflicts(self, cell: str, obj: str = "_root") -> dict[str, Any]:
        """All values of a cell by operation id, if there is more than one."""
        got = self._cell(obj, cell)
        return {i: op.get("value") if op["action"] == "set" else self.value(i) for i, op in got.items()} if len(got) > 1 else {}

    # --- editing ---

    @contextmanager
    def change(self, message: str | None = None, seconds: int | None = None) -> Iterator[_Object]:
        """Edit the root object; on leaving, the edits are one change. Errors undo all of it; no edits make no change."""
        if self._pending is not None:
            raise MergeError("changes cannot be nested")
        self._pending = []
        start = self.max_op + 1
        try:
            yield _Object(self, "_root")
            ops = self._undo()
            if ops:
                own = [h for h, c in self.changes.items() if c["actor"] == self.actor]
                head = {"actor": self.actor, "seq": len(own) + 1, "startOp": start, "time": int(time.time()) if seconds is None else seconds, "message": message, "deps": sorted({*self.heads(), *own[-1:]})}
                data, _ = codec.encode_change(head | {"ops": [{k: v for k, v in op.items() if k != "id"} for op in ops]})
                self.apply([codec.decode_change(data)])
                if self.on_change:
                    self.on_change(self)
        finally:
            if self._pending is not None:
                self._undo()

    def _undo(self) -> list[dict[str, Any]]:
        """Take back the edits that are pending, and return them."""
        ops, self._pending = self._pending or [], None
        for op in reversed(ops):
            self._remove(op)
        return ops

    def _emit(self, **op: Any) -> str:
        op = {"id": f"{self.max_op + 1}@{self.actor}", "insert": False, "pred": []} | op
        op["pred"] = sorted(op["pred"], key=_key)
        self._pending.append(op)
        self._add(op)
        return op["id"]

    def _put(self, obj: str, place: dict[str, Any], value: Any, insert: bool = False, pred: tuple[str, ...] = ()) -> None:
        """Assign a value of any depth; keys of nested maps in sorted order."""
        common = {"obj": obj, "insert": insert, "pred": list(pred), **place}
        if isinstance(value, _Object | _Counter):
            raise MergeError("an object that is in the document cannot be put elsewhere")
        if isinstance(value, _New) and value.kind == "counter":
            self._emit(action="set", value=value.value, datatype="counter", **common)
        elif isinstance(value, dict | list | _New):
            kind = value.kind if isinstance(value, _New) else "makeMap" if isinstance(value, dict) else "makeList"
            inner = value.value if isinstance(value, _New) else value
            made = self._emit(action=kind, **common)
            if isinstance(inner, dict):
                for k in sorted(inner):
                    self._put(made, {"key": _checked(k)}, inner[k])
            else:
                _Object(self, made).extend(inner)
        elif value is None or isinstance(value, bool | int | float | str):
            self._emit(action="set", value=value, **common)
        else:
            raise MergeError(f"no value of a document: {value!r}")

    # --- reconciliation ---

    @staticmethod
    def sync_state() -> dict[str, Any]:
        return {"shared": [], "last_sent": None, "their_heads": None, "their_need": None, "their_have": None, "sent": set()}

    def generate(self, s: dict[str, Any]) -> bytes | None:
        """The next message to the peer, None if there is nothing to say."""
        ours = self.heads()
        need = self.missing() if s["their_heads"] is None else sorted({*self.missing(), *(h for h in s["their_heads"] if h not in self.changes and h not in self.waiting)})
        have = []
        if s["their_heads"] is None or all(h in s["their_heads"] for h in need):
            have = [{"lastSync": s["shared"], "bloom": codec.encode_bloom([c["hash"] for c in self.changes_since(s["shared"])])}]
        if s["their_have"] and any(h not in self.changes for h in s["their_have"][0]["lastSync"]):
            return codec.encode_message({"heads": ours, "need": [], "have": [{"lastSync": [], "bloom": b""}], "changes": []})
        send = self._to_send(s) if s["their_have"] is not None and s["their_need"] is not None else []
        send = [c for c in send if c["hash"] not in s["sent"]]
        if s["last_sent"] == ours and s["their_heads"] == ours and not send:
            return None
        s["last_sent"], s["sent"] = ours, s["sent"] | {c["hash"] for c in send}
        return codec.encode_message({"heads": ours, "need": need, "have": have, "changes": [codec.encode_change(c)[0] for c in send]})

    def _to_send(self, s: dict[str, Any]) -> list[dict[str, Any]]:
        """What the peer's filters lack, all that depends on it, and what it asks for."""
        if not s["their_have"]:
            wanted = set(s["their_need"])
            return [c for h, c in self.changes.items() if h in wanted]
        since = {c["hash"]: c for c in self.changes_since([h for x in s["their_have"] for h in x["lastSync"]])}
        lacking = {h for h in since if not any(codec.bloom_contains(x["bloom"], h) for x in s["their_have"])}
        for h, c in since.items():  # in order, so dependents come after
            if any(d in lacking for d in c["deps"]):
                lacking.add(h)
        lacking |= {h for h in s["their_need"] if h in self.changes}
        return [c for h, c in self.changes.items() if h in lacking]

    def receive(self, s: dict[str, Any], message: bytes) -> None:
        m = codec.decode_message(message)
        before = self.heads()
        if m["changes"]:
            self.apply([codec.decode_change(c) for c in m["changes"]])
            now = self.heads()
            s["shared"] = sorted({h for h in now if h not in before} | {h for h in s["shared"] if h in now})
        elif m["heads"] == before:
            s["last_sent"] = m["heads"]
        known = [h for h in m["heads"] if h in self.changes]
        if len(known) == len(m["heads"]):
            s["shared"] = m["heads"]
            if not m["heads"]:  # the peer has lost everything
                s["last_sent"], s["sent"] = [], set()
        else:
            s["shared"] = sorted({*known, *s["shared"]})
        s["their_have"], s["their_heads"], s["their_need"] = m["have"], m["heads"], m["need"]


def _checked(key: Any) -> str:
    if not isinstance(key, str) or not key:
        raise MergeError(f"no key of a map: {key!r}")
    return key


class _Counter:
    def __init__(self, doc: Document, obj: str, place: dict[str, Any], pred: tuple[str, ...], value: int):
        self.doc, self.obj, self.place, self.pred, self.value = doc, obj, place, pred, value

    def increment(self, by: int = 1) -> None:
        if isinstance(by, bool) or not isinstance(by, int):
            raise MergeError("a counter goes up by whole numbers")
        self.doc._emit(action="inc", obj=self.obj, value=by, pred=list(self.pred), **self.place)

    def decrement(self, by: int = 1) -> None:
        self.increment(-by)


class _Object:
    """A map, table, list or text within a change."""

    def __init__(self, doc: Document, obj: str):
        self.doc, self.obj = doc, obj

    def _cell(self, cell: str) -> dict[str, Any]:
        return self.doc._cell(self.obj, cell)

    def _elements(self) -> list[str]:
        return [e for e in self.doc._order(self.obj) if self._cell(e)]

    def _place(self, at: Any, beyond: bool = False) -> tuple[str, dict[str, Any]]:
        if self.doc._kind(self.obj) in ("makeMap", "makeTable"):
            return _checked(at), {"key": at}
        if isinstance(at, bool) or not isinstance(at, int) or at < 0:
            raise MergeError(f"no index: {at!r}")
        e = self._elements()
        if at >= len(e):
            raise MergeError(f"index {at} is beyond the end")
        return e[at], {"elemId": e[at]}

    def __len__(self) -> int:
        return len(self.keys()) if self.doc._kind(self.obj) in ("makeMap", "makeTable") else len(self._elements())

    def keys(self) -> list[str]:
        return sorted(self.doc._cells(self.obj))

    def __getitem__(self, at: Any) -> Any:
        cell, place = self._place(at)
        got = self._cell(cell)
        if not got:
            raise KeyError(at)
        op = got[max(got, key=_key)]
        if op["action"] != "set":
            return _Object(self.doc, op["id"])
        return _Counter(self.doc, self.obj, place, tuple(got), op["value"]) if op.get("datatype") == "counter" else op["value"]

    def __setitem__(self, at: Any, value: Any) -> None:
        listed = self.doc._kind(self.obj) not in ("makeMap", "makeTable")
        if listed and isinstance(at, int) and at >= len(self):
            return self.extend([None] * (at - len(self)) + [value])
        if self.doc._kind(self.obj) == "makeTable" and (not isinstance(value, dict) or "id" in value):
            raise MergeError("a table's row is a map without id")
        cell, place = self._place(at)
        got = self._cell(cell)
        if any(op.get("datatype") == "counter" for op in got.values()):
            raise MergeError("a counter is not overwritten: increment it")
        if len(got) == 1 and (op := next(iter(got.values())))["action"] == "set" and type(op.get("value")) is type(value) and op.get("value") == value:
            return None  # as it is
        self.doc._put(self.obj, place, value, pred=tuple(got))

    def __delitem__(self, at: Any) -> None:
        cell, place = self._place(at)
        got = self._cell(cell)
        if "elemId" in place and any(op.get("datatype") == "counter" for op in got.values()):
            raise MergeError("a counter in a list cannot be deleted")
        if got:
            self.doc._emit(action="del", obj=self.obj, pred=list(got), **place)

    def insert(self, at: int, *values: Any) -> None:
        e = self._elements()
        if not 0 <= at <= len(e):
            raise MergeError(f"index {at} is beyond the end")
        after = e[at - 1] if at else "_head"
        for v in values:
            for one in v if self.doc._kind(self.obj) == "makeText" and isinstance(v, str) else [v]:
                self.doc._put(self.obj, {"elemId": after}, one, insert=True)
                after = next(op["id"] for op in reversed(self.doc._pending) if op["obj"] == self.obj and op["insert"])

    def append(self, value: Any) -> None:
        self.insert(len(self), value)

    def extend(self, values: list[Any]) -> None:
        self.insert(len(self._elements()), *values)

    def pop(self, at: int | None = None) -> Any:
        at = len(self) - 1 if at is None else at
        value = self[at]
        del self[at]
        return value

    # Lists and texts, by the names arrays have for it.

    insert_at = insert

    def push(self, *values: Any) -> int:
        """Add values at the end; the new length."""
        self.extend(list(values))
        return len(self)

    def shift(self) -> Any:
        """Take the first value off; None if there is none."""
        return self.pop(0) if len(self) else None

    def unshift(self, *values: Any) -> int:
        """Add values at the beginning; the new length."""
        self.insert(0, *values)
        return len(self)

    def delete_at(self, at: int, n: int = 1) -> None:
        if at + n > len(self):
            raise MergeError(f"index {at + n - 1} is beyond the end")
        for _ in range(n):
            del self[at]

    def splice(self, at: int, n: int | None = None, *values: Any) -> list[Any]:
        """Replace ``n`` values (all that follow, if None) by others; those taken out. Negative places count from the end."""
        size = len(self)
        at = max(0, size + at) if at < 0 else min(at, size)
        n = size - at if n is None else max(0, min(n, size - at))
        gone = [self[at + k] for k in range(n)]
        self.delete_at(at, n)
        self.insert(at, *values)
        return gone

    def fill(self, value: Any, start: int = 0, end: int | None = None) -> None:
        """Assign one value to all places from ``start`` up to before ``end``."""
        for k in range(start, len(self) if end is None else min(end, len(self))):
            self[k] = value

    def add(self, row: dict[str, Any]) -> str:
        """Add a row to a table under a new id, which is returned."""
        if self.doc._kind(self.obj) != "makeTable":
            raise MergeError("rows are added to tables")
        i = ids.new_id()
        self[i] = row
        return i
