"""Columns of a document piece by piece, as arrays: memory holds a piece and what is encoded, never all values.

The bytes are the same as those of ``codec``, and the same forms are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np

from .codec import BOOL, DELTA, STRING, FormatError, Reader, sleb, text, uleb

NONE = np.iinfo(np.int64).min  # stands for null among numbers
STEP = 20_000  # values at a time


def leb(n: np.ndarray, signed: np.ndarray) -> bytes:
    """Numbers one after the other; up to 53 bits, and signed ones a bit for the sign."""
    if len(n) and ((n >= 1 << 53) | (n < np.where(signed, -(1 << 53), 0))).any():
        raise FormatError("number out of range")
    size = np.ones(len(n), np.int64)
    for k in range(1, 9):
        half = 1 << 7 * k - 1
        more = np.where(signed, (n >= half) | (n < -half), n >= 2 * half)
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = (n[has] >> 7 * k & 0x7F) | np.where(size[has] > k + 1, 0x80, 0)
    return out.tobytes()


class Encoder:
    """A column that is fed in pieces. The last run stays open, and so does a list of values that differ, for its length comes first."""

    def __init__(self, kind: int):
        self.kind, self.out, self.lone = kind, bytearray(), bytearray()
        self.n_lone, self.open, self.seen, self.last = 0, None, False, 0

    def feed(self, v: np.ndarray, texts: list[str] | None = None) -> None:
        """``v`` has ``NONE`` for nulls; of texts it has the places in ``texts``, which are distinct."""
        if not len(v):
            return
        if self.kind == DELTA:
            there = v != NONE
            own = v[there]
            v = v.copy()
            v[there] = np.diff(own, prepend=self.last)
            self.last = int(own[-1]) if len(own) else self.last
        start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        vals, counts = v[start], np.diff(np.r_[start, len(v)])
        name = lambda x: None if x == NONE else texts[x] if texts is not None else int(x)
        if self.open is not None and self.open[0] == name(vals[0]):
            counts[0] += self.open[1]
        else:
            self._close_open()
        self._close(vals[:-1], counts[:-1], texts)
        self.open = name(vals[-1]), int(counts[-1])

    def _close_open(self) -> None:
        if self.open is not None:
            v, n = self.open
            self._close(np.array([NONE if v is None else 0 if self.kind == STRING else v]), np.array([n]), [v])
            self.open = None

    def _close(self, vals: np.ndarray, counts: np.ndarray, texts: list[str] | None) -> None:
        if not len(vals):
            return
        if self.kind == BOOL:
            self.out += (b"\0" if vals[0] and not self.out else b"") + leb(counts, np.zeros(len(counts), bool))
            self.seen = True
            return
        null = vals == NONE
        self.seen |= not null.all()
        lone = ~null & (counts == 1)
        firm = np.flatnonzero(~lone)
        a, b = (firm[0], firm[-1] + 1) if len(firm) else (len(vals), len(vals))
        self._add(vals[:a], texts)
        if a < b:
            self._flush()
            self.out += self._runs(vals[a:b], counts[a:b], lone[a:b], null[a:b], texts)
            self._add(vals[b:], texts)

    def _add(self, vals: np.ndarray, texts: list[str] | None) -> None:
        self.lone += b"".join(text(texts[x]) for x in vals.tolist()) if self.kind == STRING else leb(vals, np.full(len(vals), self.kind == DELTA))
        self.n_lone += len(vals)

    def _flush(self) -> None:
        if self.n_lone:
            self.out += sleb(-self.n_lone) + self.lone
            self.lone, self.n_lone = bytearray(), 0

    def _runs(self, vals: np.ndarray, counts: np.ndarray, lone: np.ndarray, null: np.ndarray, texts: list[str] | None) -> bytes:
        """Runs of which first and last are no single values: a head for each but the further ones of a list, and what it is of."""
        first = np.flatnonzero(lone & ~np.r_[False, lone[:-1]])
        ends = np.flatnonzero(~lone)
        head = np.where(null, 0, counts)
        head[first] = first - ends[np.searchsorted(ends, first)]
        heads = ~lone
        heads[first] = True
        if self.kind == STRING:
            rows = zip(vals.tolist(), counts.tolist(), head.tolist(), heads.tolist(), null.tolist(), strict=True)
            return b"".join((sleb(h) if has else b"") + (uleb(n) if no else text(texts[v])) for v, n, h, has, no in rows)
        at = np.cumsum(1 + heads) - 1  # of the values
        n, signed = np.zeros(len(vals) + int(heads.sum()), np.int64), np.zeros(len(vals) + int(heads.sum()), bool)
        n[at[heads] - 1], signed[at[heads] - 1] = head[heads], True
        n[at], signed[at] = np.where(null, counts, vals), ~null & (self.kind == DELTA)
        return leb(n, signed)

    def finish(self) -> bytes:
        self._close_open()
        self._flush()
        return bytes(self.out) if self.seen else b""


class Decoder:
    """A column that is taken in pieces: numbers with ``NONE`` for nulls, or a list of texts."""

    def __init__(self, kind: int, data: bytes):
        self.texts = kind == STRING
        self.parts = self._bools(data) if kind == BOOL else self._sums(self._values(data, kind)) if kind == DELTA else self._values(data, kind)
        self.held: list[Any] = []
        self.have = 0

    def take(self, n: int) -> Any:
        """The next ``n`` values, or as many as are left."""
        while self.have < n and (x := next(self.parts, None)) is not None:
            self.held.append(x)
            self.have += len(x)
        whole = [v for x in self.held for v in x] if self.texts else np.concatenate([np.zeros(0, np.int64), *self.held])
        self.held, self.have = [whole[n:]], max(0, len(whole) - n)
        return whole[:n]

    def _same(self, v: Any, n: int) -> Iterator[Any]:
        for k in range(0, n, STEP):
            m = min(STEP, n - k)
            yield [v] * m if self.texts else np.full(m, NONE if v is None else v, np.int64)

    @staticmethod
    def _bools(data: bytes) -> Iterator[np.ndarray]:
        r, now, begun = Reader(data), False, False
        while not r.done:
            n = r.uint(53)
            if n == 0 and begun:
                raise FormatError("an empty run")
            for k in range(0, n, STEP):
                yield np.full(min(STEP, n - k), now, np.int64)
            now, begun = not now, begun or n > 0

    @staticmethod
    def _sums(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        last = 0
        for v in parts:
            there = v != NONE
            out = np.cumsum(np.where(there, v, 0)) + last
            last = int(out[-1])
            yield np.where(there, out, NONE)

    def _values(self, data: bytes, kind: int) -> Iterator[Any]:
        r, before, last = Reader(data), None, None
        get = Reader.text if self.texts else (lambda r: r.int(54)) if kind == DELTA else (lambda r: r.uint(53))
        while not r.done:
            n = r.int(53)
            if n > 1:
                v = get(r)
                if before in ("run", "lone") and last == v:
                    raise FormatError("neighbouring runs of one value")
                yield from self._same(v, n)
                before, last = "run", v
            elif n == 1:
                raise FormatError("a run of one")
            elif n == 0:
                k = r.uint(53)
                if k == 0 or before == "null":
                    raise FormatError("runs of nulls that are empty or not joined")
                yield from self._same(None, k)
                before = "null"
            else:
                if before == "lone":
                    raise FormatError("lists that are not joined")
                left = -n
                while left:
                    m = min(left, STEP)
                    x = [get(r) for _ in range(m)] if self.texts or m < 16 else _numbers(r, m, kind == DELTA)
                    if before in ("run", "lone") and x[0] == last or (any(p == q for p, q in zip(x, x[1:], strict=False)) if isinstance(x, list) else (x[1:] == x[:-1]).any()):
                        raise FormatError("equal values in a list")
                    before, last = "lone", x[-1]
                    yield x if self.texts else np.asarray(x, np.int64)
                    left -= m


def _numbers(r: Reader, m: int, signed: bool) -> np.ndarray:
    w = np.frombuffer(r.data, np.uint8, min(10 * m, len(r.data) - r.at), r.at)
    ends = np.flatnonzero(w < 0x80)[:m]
    if len(ends) < m:
        raise FormatError("it ends too early")
    starts = np.r_[0, ends[:-1] + 1]
    size = ends - starts + 1
    if size.max() > 8:  # more bytes than such numbers need
        return np.array([r.int(54) if signed else r.uint(53) for _ in range(m)], np.int64)
    v = np.zeros(m, np.int64)
    for k in range(int(size.max())):
        has = size > k
        v[has] |= (w[starts[has] + k] & 0x7F).astype(np.int64) << 7 * k
    if signed:
        negative = (w[ends] & 0x40) != 0
        v[negative] -= np.int64(1) << 7 * size[negative]
    if ((v >= 1 << 53) | (v < -(1 << 53))).any():
        raise FormatError("number out of range")
    r.at += int(ends[-1]) + 1
    return v


def packed(v: np.ndarray) -> tuple[str, bytes]:
    """Numbers in as few bytes each as hold all of them; the least one stands for null."""
    there = v[v != NONE]
    for t in ("i1", "i2", "i4"):
        lim = np.iinfo(t)
        if not len(there) or (there.min() > lim.min and there.max() <= lim.max):
            return t, np.where(v == NONE, lim.min, v).astype(t).tobytes()
    return "i8", v.tobytes()


def unpacked(t: str, data: Any) -> np.ndarray:
    v = np.frombuffer(data, t)
    return np.where(v == np.iinfo(t).min, NONE, v.astype(np.int64))
