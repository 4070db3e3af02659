"""Rendezvous sharding of records over weighted shards, in SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanledger.llm.common import hash_bits, hash_fraction, key_text
from spanledger.session import materialize

#: Parts into which the rows of a shard are numbered side by side.
SLOT_PARTS = 4096


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    return -F.ln(hash_fraction(F.concat(key, F.lit(":"), shard.cast("string")))) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Struct (cost, shard): the shard whose weighted hash of ``key`` is the cheapest.

    A shard's cost depends on the key and that shard alone. Adding a shard
    moves only the records for which the new one is the cheapest; a shard of
    weight w holds w / sum(weights) of the keys. Equal costs go to the lower
    shard. A null key is a key of its own.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    table = F.array(*(F.lit(float(w)) for w in weights))
    return F.array_min(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(weights) - 1)),
            lambda s: F.struct(
                _cost(key_text(key), s, F.get(table, s)).alias("cost"),
                s.alias("shard"),
            ),
        )
    )


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weight: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per record with its shard, slot and, if asked, its shard after growth.

    Columns: id, size (UTF-8 bytes and 1 for the end), text_crc32, shard, slot
    and grown_shard (null without ``grown_weight``). Slots number the records
    of a shard from 0 without gaps, in the order of a hash of the key.

    No task sees a whole shard: each is cut into ``SLOT_PARTS`` hash ranges,
    numbered side by side and shifted by the counts of the ranges before.
    A null text has size 1 and checksum 0. A null key, repeated keys and
    repeated rows are kept; equal keys share a shard and get neighbouring
    slots. An empty table gives no rows. Other columns are ignored.
    """
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    best = rendezvous(key, weights)
    slim = docs.select(
        key.alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        hash_bits(key_text(key)).alias("place"),
        best.alias("best"),
    )
    grown = F.lit(None).cast("int")
    if grown_weight is not None:
        extra = _cost(key_text(F.col("key")), F.lit(len(weights)), F.lit(float(grown_weight)))
        grown = F.when(extra < F.col("best.cost"), F.lit(len(weights))).otherwise(F.col("best.shard"))
    slim = slim.select(
        "key",
        "size",
        "text_crc32",
        "place",
        F.col("best.shard").cast("int").alias("shard"),
        grown.cast("int").alias("grown_shard"),
        # 15 hex digits are 60 bits; the upper 12 are the part.
        F.shiftright("place", 60 - SLOT_PARTS.bit_length() + 1).cast("int").alias("part"),
    )
    slim = materialize(slim)
    counts = slim.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("place", "key", "size", "text_crc32")
    return (
        slim.withColumn("rank", F.row_number().over(within) - 1)
        # At most len(weights) * SLOT_PARTS rows.
        .join(F.broadcast(offsets), ["shard", "part"])
        .select(
            F.col("key").alias(id_col),
            "size",
            "text_crc32",
            "shard",
            (F.col("offset") + F.col("rank")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
