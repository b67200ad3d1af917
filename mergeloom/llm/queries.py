"""Queries of the training-data problems on texts and keys, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Workspace
from . import mixing, packing, ribbon, stuffing
from .tokens import with_tokens

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sizes(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    """Tokens are counted once, also where several steps need them."""
    return Workspace(spark, "sizes").put(with_tokens(_table(spark, sf_dir, "documents"), keep), "tokens")


def _seen(spark: SparkSession, sf_dir: str) -> ribbon.SeenBefore:
    return ribbon.SeenBefore(_table(spark, sf_dir, "sync_have"), _table(spark, sf_dir, "sync_offers"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).seen()


def p2_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).audit()


def p2_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the audit is the same for any filters: keys sealed and asked, and those that are there, none of which may be denied."""
    return _seen(spark, sf_dir).audit().select("origin", "gen", "n_keys", "n_asked", "n_true", "n_missed")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir, ["doc_id"]), _table(spark, sf_dir, "pack_capacity"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = _table(spark, sf_dir, "pack_capacity")
    return packing.fill_report(packing.pack(_sizes(spark, sf_dir, ["doc_id"]), caps), caps)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir, ["doc_id", "source"]), _table(spark, sf_dir, "mix_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "mix_target")
    return mixing.shares(mixing.mix(_sizes(spark, sf_dir, ["doc_id", "source"]), targets), targets)


def p6_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the packing of all texts, which is nothing."""
    caps, sizes = _table(spark, sf_dir, "pack_capacity"), _sizes(spark, sf_dir, ["doc_id"])
    packed = Workspace(spark, "packed").put(packing.pack(sizes, caps), "packed")
    return packing.broken(packed, sizes, caps)


def p7_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the mixture, which is nothing."""
    sizes, targets = _sizes(spark, sf_dir, ["doc_id", "source"]), _table(spark, sf_dir, "mix_target")
    mixture = Workspace(spark, "mixture").put(mixing.mix(sizes, targets), "mixture")
    return mixing.broken(mixture, sizes, targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed(_table(spark, sf_dir, "documents"), language="lang").filter("spam").select("doc_id")


def p8_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spam documents, and their characters, per source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", mixing.source_name(F.col("source")).alias("source"))
    found = stuffing.stuffed(docs, ["doc_id", "source"], language="lang")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("spam").alias("n_spam"), F.round(F.avg("spam_share"), 4).alias("mean_share"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_audit, p2_audit_counts, p6_packed, p6_report, p6_broken, p7_mixture, p7_shares, p7_broken, p8_found, p8_by_source)}

_HASH = r"regexp_extract(regexp_replace(regexp_replace(lower(hash), '\s', '', 'g'), '^(.*:)?(0x)?', ''), '^[0-9a-f]{64}$')"



def _gen(id_: str, table: str) -> str:
    return f"CAST(least(7, coalesce(floor((CAST({id_} AS DOUBLE) - (SELECT CAST(min({id_}) AS DOUBLE) FROM {table})) / ((SELECT CAST(max({id_}) AS DOUBLE) - CAST(min({id_}) AS DOUBLE) + 1 FROM {table})) * 8), 7)) AS INTEGER)"


ORACLE: dict[str, str] = {
    "p2_audit_counts": f"""WITH h AS (SELECT DISTINCT {_HASH} AS k, {_gen("message_id", "sync_have")} AS gen FROM sync_have), f AS (SELECT DISTINCT {_HASH} AS k, {_gen("offer_id", "sync_offers")} AS gen FROM sync_offers),
b AS (SELECT 'have' AS origin, gen, k FROM h WHERE k <> '' UNION ALL SELECT 'offer', gen, k FROM f WHERE k <> ''),
n AS (SELECT origin, gen, count(*) AS n_keys FROM b GROUP BY ALL),
a AS (SELECT n.origin, n.gen, count(*) AS n_asked FROM n JOIN f ON k <> '' AND (origin = 'have' OR f.gen > n.gen) GROUP BY ALL),
t AS (SELECT b.origin, b.gen, count(*) AS n_true FROM b JOIN f ON f.k = b.k AND (origin = 'have' OR f.gen > b.gen) GROUP BY ALL)
SELECT origin, gen, n_keys, coalesce(n_asked, 0) AS n_asked, coalesce(n_true, 0) AS n_true, CAST(0 AS BIGINT) AS n_missed FROM n LEFT JOIN a USING (origin, gen) LEFT JOIN t USING (origin, gen)""",
    "p6_broken": """SELECT capacity_id, (SELECT count(*) FROM documents WHERE length(text) > 0) AS n_docs, CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS cut_though_fitting, CAST(0 AS BIGINT) AS lost_or_doubled FROM pack_capacity""",
    "p7_broken": r"""SELECT d.source, count(*) AS n_docs, CAST(0 AS BIGINT) AS over_used, CAST(0 AS BIGINT) AS strange, FALSE AS share_off
FROM (SELECT regexp_replace(lower(source), '\s', '', 'g') AS source FROM documents WHERE length(text) > 0) d JOIN (SELECT DISTINCT regexp_replace(lower(source), '\s', '', 'g') AS source FROM mix_target WHERE target_share > 0 AND max_repeats > 0) t ON t.source = d.source GROUP BY d.source""",
    "p2_found": f"""WITH h AS (SELECT DISTINCT {_HASH} AS k FROM sync_have), o AS (SELECT offer_id, {_HASH} AS k FROM sync_offers),
f AS (SELECT k, min(offer_id) AS first_id FROM o GROUP BY k)
SELECT offer_id FROM o JOIN f USING (k) WHERE k <> '' AND (offer_id > first_id OR k IN (SELECT k FROM h))""",
}
