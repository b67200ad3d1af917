"""Reconciling the change sets of two replicas with Bloom filters.

A filter has ``BITS`` bits per entry and ``PROBES`` probes. The places of a hash follow
from its first twelve bytes, read as three little-endian numbers, by triple hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dag

#: Fixed values of the wire format.
BITS, PROBES = 10, 7


def _word(hash_: Column, k: int) -> Column:
    """Little-endian number in bytes 4k to 4k+3 of a hash in hexadecimal digits."""
    byte = [F.substring(hash_, 8 * k + 2 * i + 1, 2) for i in (3, 2, 1, 0)]
    return F.conv(F.concat(*byte), 16, 10).cast("long")


def probes(hash_: Column, size: Column, n: Column | int = PROBES) -> Column:
    """Array of the ``n`` places of a hash among ``size`` bits."""
    n = F.lit(n) if isinstance(n, int) else n
    start = F.struct((_word(hash_, 0) % size).alias("x"), (_word(hash_, 1) % size).alias("y"), (_word(hash_, 2) % size).alias("z"))
    first = F.struct(start["x"].alias("x"), start["y"].alias("y"), F.array(start["x"]).alias("at"))
    z = _word(hash_, 2) % size

    def step(acc: Column, _: Column) -> Column:
        x = (acc["x"] + acc["y"]) % size
        return F.struct(x.alias("x"), ((acc["y"] + z) % size).alias("y"), F.concat(acc["at"], F.array(x)).alias("at"))

    rounds = F.when(n > 1, F.sequence(F.lit(1), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, first, step, lambda acc: acc["at"])


def bits_of(n_entries: Column) -> Column:
    """Bits of a filter for so many entries, in whole bytes."""
    return (F.ceil(n_entries * BITS / 8) * 8).cast("long")


def syn_bloom_build(hashes: DataFrame, by: list[str]) -> DataFrame:
    """Filters over ``hash`` within ``by``: ``*by, n_entries, size, bits`` with the places that are set, sorted.

    A filter is as large as its entries make it; places are made distinct before they are gathered.
    """
    keys = hashes.filter("hash is not null").select(*by, "hash").distinct()
    counts = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n_entries")).withColumn("size", bits_of(F.col("n_entries")))
    places = keys.join(counts, by).select(*by, F.explode(probes(F.col("hash"), F.col("size"))).alias("at")).distinct()
    return counts.join(places.groupBy(*by).agg(F.sort_array(F.collect_list("at")).alias("bits")), by)


def bloom_bits(hashes: DataFrame, by: list[str]) -> DataFrame:
    """The same filters as one row per bit, for any number of entries: ``*by, size, at``."""
    keys = hashes.filter("hash is not null").select(*by, "hash").distinct()
    counts = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n_entries")).withColumn("size", bits_of(F.col("n_entries")))
    return keys.join(counts, by).select(*by, "size", F.explode(probes(F.col("hash"), F.col("size"))).alias("at")).distinct()


def syn_bloom_probe(hashes: DataFrame, bits: DataFrame, by: list[str]) -> DataFrame:
    """Hashes that a filter may contain: all their places are set. Where there is no filter, none."""
    sizes = bits.select(*by, "size").distinct()
    asked = hashes.filter("hash is not null").select(*by, "hash").distinct().join(sizes, by)
    places = asked.select(*by, "hash", F.explode(F.array_distinct(probes(F.col("hash"), F.col("size")))).alias("at"))
    wanted = places.groupBy(*by, "hash").agg(F.count(F.lit(1)).alias("n"))
    got = places.join(bits.select(*by, "at"), [*by, "at"]).groupBy(*by, "hash").agg(F.count(F.lit(1)).alias("m"))
    return wanted.join(got, [*by, "hash"]).filter("n = m").select(*by, "hash")


def wire_fields(bloom: Column) -> dict[str, Column]:
    """Entries, bits per entry, probes and first byte of the bits of a filter in wire form (empty: no entries)."""
    digits = F.hex(bloom)
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("long")
    wide = F.when(byte(0) < 128, 1).when(byte(1) < 128, 2).otherwise(3)
    n = (byte(0) % 128) + F.when(wide >= 2, (byte(1) % 128) * 128).otherwise(0) + F.when(wide >= 3, (byte(2) % 128) * 16384).otherwise(0)
    at = lambda k: F.conv(F.substring(digits, 2 * (wide + k) + 1, F.lit(2)), 16, 10).cast("long")
    return {"n_entries": n, "bits_per_entry": at(0), "n_probes": at(1), "first_byte": wide + 2}


def wire_contains(bloom: Column, hash_: Column) -> Column:
    """Whether a filter in wire form may contain a hash; an empty filter contains nothing."""
    f = wire_fields(bloom)
    size = ((F.octet_length(bloom) - f["first_byte"]) * 8).cast("long")
    digits = F.hex(bloom)

    def is_set(p: Column) -> Column:
        start = (2 * (f["first_byte"] + F.floor(p / 8)) + 1).cast("int")
        byte = F.conv(F.substring(digits, start, F.lit(2)), 16, 10).cast("int")
        return F.getbit(byte, (p % 8).cast("int")) == 1

    return F.when((f["n_entries"] > 0) & (size > 0), F.forall(probes(hash_, size, f["n_probes"]), is_set)).otherwise(F.lit(False))


def syn_to_send(changes: DataFrame, bits: DataFrame, need: DataFrame) -> DataFrame:
    """Changes to send to a peer: those its filter lacks, all that depend on these, and those it asks for.

    ``bits`` are by ``doc_id``; a change the filter wrongly contains is sent once the peer needs it.
    """
    known = syn_bloom_probe(changes.select("doc_id", "hash"), bits, ["doc_id"])
    lacking = changes.select("doc_id", "hash").join(known, dag.KEY, "left_anti")
    return dag.dag_descendants(changes, lacking).unionByName(need.select(*dag.KEY).join(changes.select(*dag.KEY), dag.KEY, "left_semi")).distinct()


def set_known_union(known: Column, shared: Column) -> Column:
    """Heads known of a peer: both arrays, distinct and sorted."""
    return F.sort_array(F.array_union(known, shared))


def set_sent_filter(to_send: DataFrame, sent: DataFrame) -> DataFrame:
    """Changes not sent before."""
    return to_send.join(sent.select(*dag.KEY), dag.KEY, "left_anti")


def _heads(messages: DataFrame) -> DataFrame:
    return messages.select("message_id", "doc_id", F.explode(F.array_distinct("heads")).alias("hash")).filter("hash is not null")


def syn_receive(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """What a replica that has ``changes`` notes of each message of a new peer: ``message_id, shared, all_known, starts_over``.

    ``shared`` are the heads that it has too, sorted; ``starts_over`` is whether the peer has nothing, so that what was sent is forgotten. ``messages`` has ``message_id, doc_id, heads``.
    """
    heads = _heads(messages).join(changes.select(*dag.KEY).withColumn("known", F.lit(True)), dag.KEY, "left")
    per = heads.groupBy("message_id").agg(F.sort_array(F.collect_list(F.when(F.col("known"), F.col("hash")))).alias("shared"), F.count(F.lit(1)).alias("n"))
    none = F.array().cast("array<string>")
    out = messages.select("message_id").join(per, "message_id", "left").withColumn("shared", F.coalesce("shared", none))
    return out.select("message_id", "shared", (F.size("shared") == F.coalesce("n", F.lit(0))).alias("all_known"), F.col("n").isNull().alias("starts_over"))


def syn_generate(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """What a replica that has ``changes`` answers to each message: ``message_id, n_need, sends_filter, asks_anew``.

    Needed are the peer's heads that it lacks, and what its own changes depend on and is not there. A filter goes along if the peer has all of that among its
    heads. ``asks_anew`` is whether the peer counts from a state that this replica does not know, so that all is started from nothing. ``messages`` also has ``have``.
    """
    missing = dag.anti_missing_deps(changes).select("doc_id", F.col("dep").alias("hash"), F.lit(True).alias("missing"))
    lacking = missing.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_missing"))
    heads = _heads(messages).join(changes.select(*dag.KEY).withColumn("known", F.lit(True)), dag.KEY, "left").join(missing, dag.KEY, "left")
    per = heads.groupBy("message_id").agg(F.count_if(F.col("known").isNull() & F.col("missing").isNull()).alias("n_new"), F.count_if("missing").alias("n_named"))
    since = messages.select("message_id", "doc_id", F.explode(F.flatten("have.last_sync")).alias("hash")).distinct().join(changes.select(*dag.KEY), dag.KEY, "left_anti")
    anew = since.groupBy("message_id").agg(F.lit(True).alias("asks_anew"))
    out = messages.select("message_id", "doc_id").join(lacking, "doc_id", "left").join(per, "message_id", "left").join(anew, "message_id", "left").fillna(0, ["n_missing", "n_new", "n_named"])
    return out.select("message_id", (F.col("n_missing") + F.col("n_new")).alias("n_need"), (F.col("n_named") == F.col("n_missing")).alias("sends_filter"), F.coalesce("asks_anew", F.lit(False)).alias("asks_anew"))
