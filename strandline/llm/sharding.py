"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled within each source by a seeded hash. A row of rank r (from 0) among n gets the fractional
rank (r + 1/2) / n, so that every source is spread evenly over 0 to 1; in the order of fractional ranks every
run of rows has the mixture of the whole. The order is cut into shards whose row counts differ by one at most.

The law that holds is ``rows``. Rows of equal texts are dealt like any others: they aren't kept together, as a
third of all rows may be copies of one text.

Defined cases: null sources are a source of their own; a null text has no bytes and the check sum of the empty
text; ties in fractional rank go to the source that sorts first, ties in the hash to the smaller doc_id; rows
that repeat a doc_id are dealt as separate rows; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_BITS, hash63, rank_within

SEED = "shard-1"
SHARDS = 24


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("_source"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        hash63(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"),
    )
    sizes = keyed.groupBy("_source").agg(F.count("*").alias("_n"))
    total = docs.count()
    ranked = rank_within(keyed, ["_source"], "_key", ["doc_id", "text_crc32"], "_rank").join(sizes, "_source")
    fraction = ((2 * F.col("_rank") + 1) / (2 * F.col("_n")) * float(1 << HASH_BITS)).cast("long")
    placed = rank_within(ranked.withColumn("_fraction", F.least(fraction, F.lit((1 << HASH_BITS) - 1))), [], "_fraction", ["_source", "_rank"], "_place", bits=12)
    number = F.floor((F.col("_place") * shards) / max(total, 1))
    # The first place of shard s is the least p with p * shards >= s * total.
    first = F.floor((F.col("shard") * total + (shards - 1)) / shards)
    return placed.withColumn("shard", number.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
