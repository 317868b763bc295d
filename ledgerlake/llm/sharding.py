"""Sharding by fixed virtual slots.

A hash of its id puts each record into one of ``SLOTS`` virtual slots, for good. Bytes
are summed per slot, and a versioned map assigns slots to shards: ``balanced`` makes the
first version, heaviest slot first to the lightest shard, and ``rebalanced`` edits a
version, moving only slots that overfull shards must give up. Records never move
between slots, so an edit moves whole slots and nothing else.

The query's map has SLOTS rows whatever the data (slots without rows have a shard too, so
a stored version places records that come later), which bounds the broadcast and the one list
that is folded; the records are shuffled once, by slot, with a few numbers each and
without their text. The law is ``bytes``: sizes of shards are near equal. No record is
heavy enough in expectation to matter among thousands of slots, and copies of one text
spread over slots by their ids.

Defined results: a null text has size 1 and the checksum of an empty one; records with
a null id are spread over slots by checksum and size; equal ids share a slot and are placed
in the order of checksum and size; a record whose slot a map lacks is an error; an empty table gives an empty table and map; other
columns are ignored by the query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table

SLOTS = 4096
SHARDS = 16
#: Share above the mean that rebalancing leaves a shard.
TOLERANCE = 0.01


def slot_of(doc_id: Column, other: Column, slots: int = SLOTS) -> Column:
    """The slot of an id, by ``other`` (a string) where it is null."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), other).cast("binary")), 1, 8), 16, 10)
    return F.pmod(digits.cast("long"), F.lit(slots))


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and virtual_slot of each row."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return found.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.concat_ws("/", F.lit(""), "text_crc32", "size"), slots))


def slot_bytes(rows: DataFrame, slots: int | None = None) -> DataFrame:
    """virtual_slot, bytes and n_rows of each slot that has rows, or of all ``slots``; partial sums come before the shuffle."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    if slots is None:
        return found
    every = rows.sparkSession.range(slots).withColumnRenamed("id", "virtual_slot")
    return every.join(found, "virtual_slot", "left").select("virtual_slot", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("bytes", "n_rows")])


def _spread(slots: Column, loads: Column, shards: int) -> Column:
    """Slots (an array of structs of bytes and virtual_slot, heaviest first), each to the shard then lightest."""
    start = F.struct(loads.alias("loads"), F.expr("CAST(array() AS array<struct<virtual_slot: bigint, shard: int>>)").alias("placed"))

    def step(state: Column, slot: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        grown = F.transform(state["loads"], lambda x, i: F.when(i == at, x + slot["bytes"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(state["placed"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), at.alias("shard")))).alias("placed"))

    return F.aggregate(slots, start, step, lambda state: state["placed"])


def _heaviest_first(found: DataFrame) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot")))
    return F.transform(ordered, lambda x: F.struct((-x["minus"]).alias("bytes"), x["virtual_slot"].alias("virtual_slot")))


def balanced(found: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """The first map: virtual_slot, shard, version."""
    lists = found.agg(_heaviest_first(found).alias("slots"))
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    return lists.select(F.explode(_spread(F.col("slots"), none, shards)).alias("p")).select("p.*", F.lit(version).alias("version"))


def rebalanced(slot_map: DataFrame, found: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The next version of ``slot_map`` for new bytes per slot and a new number of shards.

    In each shard slots stay, heaviest first, while they fit under the mean load plus the
    tolerance; the others, new slots, and slots of shards that are no more, are spread.
    """
    last = slot_map.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    known = found.join(slot_map.where(f"shard < {shards}").select("virtual_slot", "shard"), "virtual_slot", "left")
    everywhere, inside = W.partitionBy(F.lit(0)), W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(W.unboundedPreceding, 0)
    most = F.sum("bytes").over(everywhere) / shards * (1 + tolerance)
    judged = known.withColumn("most", most).withColumn("stays", F.col("shard").isNotNull() & (F.sum("bytes").over(inside) <= F.col("most")))
    stay = judged.where("stays").select("virtual_slot", "shard", "bytes")
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.element_at(F.map_from_entries("loads"), s), F.lit(0).cast("long")))
    sums = stay.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.collect_list(F.struct("shard", "b")).alias("loads"))
    moving = judged.where("NOT stays").agg(_heaviest_first(judged).alias("slots"))
    both = moving.withColumn("k", F.lit(0)).join(sums.withColumn("k", F.lit(0)), "k")
    moved = both.select(F.explode(_spread(F.col("slots"), loads, shards)).alias("p")).select("p.*")
    return stay.select("virtual_slot", "shard").unionByName(moved).select("virtual_slot", "shard", F.lit(last + 1).alias("version"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the maps stored in a folder, which keeps all versions."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, by default the last."""
    maps = spark.read.schema("virtual_slot long, shard int, version int").parquet(path)
    return maps.where(F.col("version") == (F.lit(version) if version is not None else maps.agg(F.max("version")).first()[0]))


def place(rows: DataFrame, slot_map: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with shard and position: gapless from 0 in each shard, slot by slot.

    Only the rows of one virtual slot are ordered together; the rows of the slots before
    it in its shard are counted on the map.
    """
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = slot_map.join(found.select("virtual_slot", "n_rows"), "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(starts), "virtual_slot", "left")
    unknown = F.raise_error(F.concat(F.lit("no shard for slot "), F.col("virtual_slot").cast("string"))).cast("int")
    placed = placed.withColumn("shard", F.coalesce("shard", unknown))
    return placed.withColumn("position", F.col("first") + F.col("nth") - 1).drop("first", "nth")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the position in the shard), grown_shard and virtual_slot."""
    rows = materialise(records(table(spark, sf_dir, "documents")), "records")
    found = materialise(slot_bytes(rows, SLOTS), "slots")
    path = f"{shared_dir(spark)}/ledgerlake/slot-map-{uuid.uuid4().hex}"
    store_map(balanced(found), path)
    placed = place(rows, load_map(spark, path, 1), found)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def crc_table() -> list[int]:
    found = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        found.append(n)
    return found


def oracle() -> str:
    return f"""
WITH RECURSIVE q AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST(('0x' || x) AS BIGINT)),
        lambda c, b: xor(c >> 8, {crc_table()}[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
    FROM documents),
r AS (SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '/' || text_crc32 || '/' || size)), 1, 8)) AS BIGINT) % {SLOTS} AS virtual_slot FROM q),
found AS (SELECT s AS virtual_slot, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(size) AS n_rows
  FROM range({SLOTS}) AS t(s) LEFT JOIN r ON virtual_slot = s GROUP BY 1),
ordered AS (SELECT row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS k, * FROM found),
spread AS (SELECT 0::BIGINT AS k, [0::BIGINT for x in range({SHARDS})] AS loads, -1::BIGINT AS virtual_slot, -1 AS shard
  UNION ALL SELECT o.k, list_transform(s.loads, lambda v, i: v + CASE WHEN i = list_position(s.loads, list_min(s.loads)) THEN o.bytes ELSE 0 END),
    o.virtual_slot, CAST(list_position(s.loads, list_min(s.loads)) - 1 AS INTEGER) FROM spread s JOIN ordered o ON o.k = s.k + 1),
starts AS (SELECT virtual_slot, shard, coalesce(sum(n_rows) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM spread JOIN found USING (virtual_slot))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(first + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot
FROM r JOIN starts USING (virtual_slot)
"""
