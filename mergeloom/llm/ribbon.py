"""Has this key been seen before? Ribbon filters over sealed batches.

Earlier keys come in sealed batches. Of each batch and shard of keys one filter is
kept: every key stands for a linear equation over bits, whose left side is a band of
64 coefficients at a place that the key chooses and whose right side is the key's
fingerprint. The equations are solved, and only the solution is kept: ``FINGERPRINT``
bits for about each key, instead of the keys. A key of the batch reproduces its
fingerprint from the solution; any other does so once in 2 ** FINGERPRINT times. How
often is measured with keys that certainly are in no batch.

The keys of a filter are divided into lanes with a system each. The systems are solved
side by side, a step of all lanes at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clean_hash
from ..operators.prefix import looked_up
from ..storage import Workspace

FINGERPRINT = 24
BAND = 64
LANE_KEYS = 800  # each lane has 64 places more than it needs, so it must not be too small
LANES = 128
GENERATIONS = 8
SHARD_KEYS = 100_000  # of a batch, if batches are alike; a batch that has all keys has GENERATIONS times as many in a shard
_M64 = (1 << 64) - 1
_BYTES = FINGERPRINT // 8


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Well mixed 64 bits of each value."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _M64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _scaled(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes as whole numbers below ``n``."""
    return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def equations(a: np.ndarray, b: np.ndarray, seed: int, lanes: int, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lane, start, coefficients (the lowest is 1) and fingerprint of each key, given as two 64-bit hashes."""
    right = (_mix(a ^ b, seed + 2) & np.uint64((1 << FINGERPRINT) - 1)).astype(np.uint32)
    return _scaled(_mix(a + b, 3), lanes), _scaled(_mix(a, seed), slots - BAND + 1), _mix(b, seed + 1) | np.uint64(1), right


def _eliminated(lane: np.ndarray, start: np.ndarray, coeff: np.ndarray, right: np.ndarray, lanes: int, slots: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Coefficients and right sides by lane and slot, each row beginning at its slot; None if two equations contradict each other."""
    order = np.lexsort((start, lane))
    start, coeff, right = start[order], coeff[order], right[order]
    at = np.searchsorted(lane[order], np.arange(lanes))
    end = np.r_[at[1:], len(order)]
    rows, values = np.zeros(lanes * slots, np.uint64), np.zeros(lanes * slots, np.uint32)
    live = np.flatnonzero(at < end)  # lanes with equations left
    s, c, v = live * slots + start[at[live]], coeff[at[live]], right[at[live]]
    while len(live):
        held = rows[s]
        free = held == 0
        rows[s[free]], values[s[free]] = c[free], v[free]
        v = np.where(free, v, v ^ values[s])
        c = np.where(free, np.uint64(0), c ^ held)
        gone = c == 0
        if (v[gone & ~free] != 0).any():
            return None
        shift = np.bitwise_count((c & (~c + np.uint64(1))) - np.uint64(1))
        shift[gone] = 0
        c, s = c >> shift.astype(np.uint64), s + shift
        done = np.flatnonzero(gone)  # these lanes go on to their next equation
        at[live[done]] += 1
        more = at[live[done]] < end[live[done]]
        nxt, into = at[live[done[more]]], done[more]
        s[into], c[into], v[into] = live[into] * slots + start[nxt], coeff[nxt], right[nxt]
        if not more.all():
            keep = np.ones(len(live), bool)
            keep[done[~more]] = False
            live, s, c, v = live[keep], s[keep], c[keep], v[keep]
    return rows.reshape(lanes, slots), values.reshape(lanes, slots)


def _substituted(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The solution of every lane, from the last slot to the first, all bits of a fingerprint at once."""
    lanes, slots = rows.shape
    bits = np.arange(FINGERPRINT, dtype=np.uint32)
    solution = np.zeros((slots, lanes), np.uint32)
    window = np.zeros((lanes, FINGERPRINT), np.uint64)  # of each bit, the 64 solved slots that follow
    rows, values = rows.T.copy(), values.T.copy()
    for s in range(slots - 1, -1, -1):
        one = np.bitwise_count((rows[s] >> np.uint64(1))[:, None] & window) ^ (values[s][:, None] >> bits)
        one = (one & 1) * (rows[s] != 0)[:, None]
        window = (window << np.uint64(1)) | one.astype(np.uint64)
        solution[s] = (one.astype(np.uint32) << bits).sum(axis=1, dtype=np.uint32)
    return solution.T


def build(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, lanes, slots of a lane, and solution for the keys; a system without a solution is tried again with another seed and more slots."""
    lanes = max(1, min(LANES, len(a) // LANE_KEYS))
    most = int(np.bincount(_scaled(_mix(a + b, 3), lanes)).max())
    for attempt in range(64):
        slots = BAND + int(most * (1.06 + 0.03 * attempt)) + 8
        got = _eliminated(*equations(a, b, attempt, lanes, slots), lanes, slots)
        if got is not None:
            packed = _substituted(*got).astype("<u4").reshape(-1, 1).view(np.uint8)[:, :_BYTES]
            return attempt, lanes, slots, packed.tobytes()
    raise ValueError("no ribbon system could be solved")


def unpacked(solution: bytes) -> np.ndarray:
    wide = np.zeros((len(solution) // _BYTES, 4), np.uint8)
    wide[:, :_BYTES] = np.frombuffer(solution, np.uint8).reshape(-1, _BYTES)
    return wide.view("<u4").ravel()


def probe(solution: bytes, seed: int, lanes: int, slots: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter: never False for a key that is."""
    z = np.r_[unpacked(solution), np.zeros(BAND, np.uint32)]
    lane, start, coeff, right = equations(a, b, seed, lanes, slots)
    at = lane * slots + start
    out = np.zeros(len(a), np.uint32)
    for j in range(BAND):
        out ^= z[at + j] * ((coeff >> np.uint64(j)) & np.uint64(1)).astype(np.uint32)
    return out == right


def _hashes(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["a"].to_numpy(np.int64).view(np.uint64), pdf["b"].to_numpy(np.int64).view(np.uint64)


_FILTER = "shard int, n_keys long, seed int, lanes int, slots int, solution binary, origin string, gen int"


def _seal(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, lanes, slots, solution = build(*_hashes(pdf))
    one = pdf.iloc[0]
    return pd.DataFrame([{"shard": one["shard"], "n_keys": len(pdf), "seed": seed, "lanes": lanes, "slots": slots, "solution": solution, "origin": one["origin"], "gen": one["gen"]}])


def _ask(probes: pd.DataFrame, filters: pd.DataFrame, every: bool) -> pd.DataFrame:
    """Of each probe, the filters that say yes, or only one of them unless ``every``; ``absent`` marks probes for the audit."""
    found = [probes.iloc[:0][["key", "gen", "absent"]].assign(origin=pd.Series(dtype=object), seen_gen=pd.Series(dtype="int32"))]
    a, b = _hashes(probes) if len(probes) else (None, None)
    gen = probes["gen"].to_numpy() if len(probes) else None
    open_ = np.ones(len(probes), bool)
    for f in filters.to_dict("records") if len(probes) else ():
        asked = np.flatnonzero(open_ & ((f["origin"] == "have") | (gen > f["gen"])))
        yes = asked[probe(f["solution"], f["seed"], f["lanes"], f["slots"], a[asked], b[asked])]
        found.append(probes.iloc[yes][["key", "gen", "absent"]].assign(origin=f["origin"], seen_gen=f["gen"]))
        if not every:
            open_[yes] = False
    return pd.concat(found, ignore_index=True)


class Sealed:
    """Filters of sealed batches, kept in a folder for each batch: a new one is added, none is built again.

    ``origin`` and ``gen`` name a batch. The number of shards is settled when the first is sealed.
    """

    def __init__(self, work: Workspace, shards: int):
        self.work, self.shards = work, shards
        self.filters = work.spark.createDataFrame([], _FILTER)

    def hashed(self, key: Column) -> list[Column]:
        """Two hashes of a key and its shard."""
        a, b = F.xxhash64(key), F.xxhash64(key, F.lit(7))
        return [a.alias("a"), b.alias("b"), F.pmod(F.xxhash64(b), F.lit(self.shards)).cast("int").alias("shard")]

    def seal(self, keys: DataFrame) -> Sealed:
        """Add the batches of ``keys`` (``origin, gen, key``, each key once a batch)."""
        hashed = keys.select("origin", "gen", *self.hashed(F.col("key")))
        built = hashed.groupBy("origin", "gen", "shard").applyInPandas(_seal, _FILTER)
        self.filters = self.work.append(built, "filters", by=("origin", "gen"))
        return self

    def ask(self, probes: DataFrame, every: bool = False) -> DataFrame:
        """``key, gen, absent, origin, seen_gen``: filters that say yes to ``probes`` (``key, gen, absent``); own batches are asked only by later ones."""
        hashed = probes.select("key", "gen", "absent", *self.hashed(F.col("key")))
        asked = hashed.groupBy("shard").cogroup(self.filters.groupBy("shard"))
        return asked.applyInPandas(lambda p, f: _ask(p, f, every), "key binary, gen int, absent boolean, origin string, seen_gen int")


def _generation(c: Column, least: int | None, most: int | None) -> Column:
    """Batches of equal width from the least to the greatest id; a null id belongs to the last."""
    low, high = float(least or 0), float(most or 0)
    wide = F.floor((c.cast("double") - F.lit(low)) / F.lit(high - low + 1) * GENERATIONS)
    return F.least(F.coalesce(wide, F.lit(GENERATIONS - 1)), F.lit(GENERATIONS - 1)).cast("int")


class SeenBefore:
    """Filters over all of ``have`` and over the batches of ``offers``, and what they answer.

    ``have`` has ``message_id, hash``; ``offers`` has ``offer_id, hash``; other columns are ignored. Values that are no hash are
    no keys: they are never found and never count as seen, and nor do nulls. A null ``message_id`` belongs to the last batch. Both
    tables may be empty.
    """

    def __init__(self, have: DataFrame, offers: DataFrame, shard_keys: int = SHARD_KEYS):
        self.work = Workspace(offers.sparkSession, "ribbon")
        low, high, n_have = have.select(F.min("message_id"), F.max("message_id"), F.count(F.lit(1))).first()
        low_offer, high_offer, self.n_offers = offers.select(F.min("offer_id"), F.max("offer_id"), F.count(F.lit(1))).first()
        self.have = have.select(F.unhex(clean_hash(F.col("hash"))).alias("key"), _generation(F.col("message_id"), low, high).alias("gen")).filter("key is not null")
        self.offers = offers.select("offer_id", F.unhex(clean_hash(F.col("hash"))).alias("key"), _generation(F.col("offer_id"), low_offer, high_offer).alias("gen")).filter("key is not null and offer_id is not null")
        # However often a key was offered, it is one row a batch.
        self.firsts = self.work.put(self.offers.groupBy("key", "gen").agg(F.min("offer_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "firsts")
        self.sealed = Sealed(self.work, max(1, -(-(n_have + self.n_offers) // (shard_keys * GENERATIONS))))
        self.sealed.seal(self._batches())

    def _batches(self) -> DataFrame:
        theirs = self.have.select(F.lit("have").alias("origin"), "gen", "key").distinct()
        return theirs.unionByName(self.firsts.select(F.lit("offer").alias("origin"), "gen", "key"))

    def seen(self) -> DataFrame:
        """Offers whose key occurred before: ``offer_id``.

        The filters decide. No offer that was seen is left out; one that was not is in the result with a chance of 2 ** -FINGERPRINT for
        each batch asked, the rate that ``audit`` measures. Within its own batch, which was not sealed yet, all but a key's first offer repeat it.
        """
        yes = self.sealed.ask(self.firsts.select("key", "gen", F.lit(False).alias("absent")))
        before = yes.select("key", "gen").distinct().withColumn("before", F.lit(True))
        state = self.work.put(self.firsts.join(before, ["key", "gen"], "left").filter("before or n > 1"), "state")
        return looked_up(self.offers, state, ["key", "gen"], self.n_offers).filter("before or offer_id > first_id").select("offer_id")

    def answers(self) -> DataFrame:
        """All answers of all filters to offered keys, and to as many (``absent``) that are in none: the same bytes behind a mark are longer than any key."""
        real = self.firsts.select("key", "gen", F.lit(False).alias("absent"))
        absent = self.firsts.select(F.concat(F.encode(F.lit("absent"), "utf-8"), F.col("key")).alias("key"), "gen", F.lit(True).alias("absent"))
        return self.sealed.ask(real.unionByName(absent), every=True)

    def audit(self) -> DataFrame:
        """Rates of wrong answers per origin and sealed batch.

        ``n_keys`` in the batch's filters and their ``bits_per_key``; ``n_asked`` absent keys
        and ``n_false`` of them said to be there, ``false_rate``; ``n_true`` offered keys that really are in the batch, of which ``n_missed``
        were denied (always 0), and ``n_wrong`` that are not and were said to be. Positive answers are verified by whole keys.
        """
        answers = self.work.put(self.answers(), "answers")
        on = ["origin", "gen"]
        kept = self._batches().withColumnRenamed("gen", "seen_gen")
        told = answers.filter("not absent").select("key", "gen", "origin", "seen_gen", F.lit(True).alias("told"))
        really = self.firsts.select("key", "gen").join(kept, "key").filter("origin = 'have' or gen > seen_gen").withColumn("real", F.lit(True))
        both = really.join(told, ["key", "gen", "origin", "seen_gen"], "full").groupBy("origin", F.col("seen_gen").alias("gen"))
        checked = both.agg(F.count("real").alias("n_true"), F.count_if(F.col("told").isNull()).alias("n_missed"), F.count_if(F.col("real").isNull()).alias("n_wrong"))
        false = answers.filter("absent").groupBy("origin", F.col("seen_gen").alias("gen")).agg(F.count(F.lit(1)).alias("n_false"))
        of = self.sealed.filters.groupBy(*on).agg(F.sum("n_keys").alias("n_keys"), F.round(F.sum(F.octet_length("solution")) * 8 / F.sum("n_keys"), 2).alias("bits_per_key"))
        per = self.firsts.groupBy(F.col("gen").alias("g")).agg(F.count(F.lit(1)).alias("n"))
        asked = of.join(per, (F.col("origin") == "have") | (F.col("g") > F.col("gen"))).groupBy(*on).agg(F.sum("n").alias("n_asked"))
        out = of.join(asked, on, "left").join(false, on, "left").join(checked, on, "left").fillna(0)
        return out.withColumn("false_rate", F.when(F.col("n_asked") > 0, F.col("n_false") / F.col("n_asked"))).select("origin", "gen", "n_keys", "bits_per_key", "n_asked", "n_false", "false_rate", "n_true", "n_missed", "n_wrong")
