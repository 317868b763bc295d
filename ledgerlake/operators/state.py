"""Current state without MERGE: change logs, latest versions, as-of lookups, posting tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A version has 35 bits for a block's place in the feed and 28 for a document's place in its block.
PLACE_BITS = 35
SEQUENCE_BITS = 28
#: Of the latter 22 are for the row in its delta, the others for the delta.
ROW_BITS = 22


def _within(value: Column, bits: int, what: str) -> Column:
    wrong = F.raise_error(F.concat(F.lit(f"{what} beyond {bits} bits: "), value.cast("string"))).cast("long")
    return F.when(value.isNull() | ((value >= 0) & (value < 1 << bits)), value.cast("long")).otherwise(wrong)


def version(block: Column, sequence: Column) -> Column:
    """One ordered number, never negative, from a block's place and a document's place in it; an error where it would not fit."""
    return F.call_function("shiftleft", _within(block, PLACE_BITS, "place"), F.lit(SEQUENCE_BITS)).bitwiseOR(_within(sequence, SEQUENCE_BITS, "sequence"))


def row_sequence(delta: Column, row: Column) -> Column:
    """A row's place in its block, by its delta and its place there."""
    return F.call_function("shiftleft", _within(delta, SEQUENCE_BITS - ROW_BITS, "delta"), F.lit(ROW_BITS)).bitwiseOR(_within(row, ROW_BITS, "row"))


def latest(changes: DataFrame, key: list[str], order: str = "_version", operation: str = "_op", ties: list[str] | None = None) -> DataFrame:
    """The row of the highest version of each key, without keys whose last operation is a delete.

    One aggregation with partial maxima: hot keys are reduced before the shuffle. Equal
    versions go to the first by ``ties`` (in descending order of these columns).
    """
    rest = [c for c in changes.columns if c not in key]
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in [order, *(ties or [])]]))
    found = changes.groupBy(*[F.col(f"`{c}`") for c in key]).agg(best.alias("_last"))
    return found.where(F.col("_last")[operation] != "delete").select(*[F.col(f"`{c}`") for c in key], "_last.*")


#: So many keys at most are dealt to several parts, each of about so many rows.
HOT_KEYS = 256
PART_ROWS = 1_000


def spread(probes: DataFrame, key: str, position: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``probes`` with a part ``_part`` of their key, and a function that gives rows of the key's other side to all its parts.

    The HOT_KEYS keys with most probes have a part for each PART_ROWS of them, all others
    one: such a key has at most one in HOT_KEYS of all probes. So what is broadcast has
    HOT_KEYS rows, and copies on the other side are as many as there are parts. Rows of
    keys without probes are left out.
    """
    counts = probes.groupBy(key).agg(F.count(F.lit(1)).alias("_probes"))
    parts = F.ceil(F.col("_probes") / PART_ROWS).cast("int").alias("_parts")
    hot = F.broadcast(counts.orderBy(F.desc("_probes"), key).limit(HOT_KEYS).select(key, parts).where("_parts > 1"))
    several = F.coalesce("_parts", F.lit(1))
    dealt = probes.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(position), several).cast("int")).drop("_parts")

    def copied(rows: DataFrame) -> DataFrame:
        found = rows.join(counts.select(key), key, "left_semi").join(hot, key, "left")
        return found.withColumn("_part", F.explode(F.sequence(F.lit(0), several - 1))).drop("_parts")

    return dealt, copied


def ranges(probes: DataFrame, key: str, place: Column, tasks: int) -> tuple[DataFrame, Callable[[DataFrame, str, str], DataFrame]]:
    """``probes`` with a part ``_part`` of their key, and a function that gives versions (key, position, value) to the parts that need them.

    As ``spread``, but a part is a range of ``place``, which orders as the position does:
    its bounds are approximate quantiles, so probes of one place stay together. A version
    goes to the part of its own place only; each part also gets the last version of the
    parts before it, at a null position. So versions are not copied, however many a hot key
    has, and there are ``tasks`` parts of a key at most. Rows of keys without probes are
    left out.
    """
    whole = max(tasks, 2)
    counts = probes.groupBy(key).agg(F.count(F.lit(1)).alias("_probes"))
    most = counts.orderBy(F.desc("_probes"), key).limit(HOT_KEYS).where(F.col("_probes") > PART_ROWS)
    bounds = F.percentile_approx(place, [k / whole for k in range(1, whole)]).alias("_bounds")
    hot = probes.join(F.broadcast(most), key).groupBy(key).agg(bounds, F.least(F.ceil(F.first("_probes") / PART_ROWS), F.lit(whole)).cast("int").alias("_parts"))
    below = F.size(F.filter("_bounds", lambda b: b < place))
    part = F.when(F.col("_bounds").isNotNull(), F.floor(below * F.col("_parts") / whole)).otherwise(0).cast("int")
    dealt = lambda rows: rows.join(F.broadcast(hot), key, "left").withColumn("_part", part)

    def met(versions: DataFrame, position: str, value: str) -> DataFrame:
        known = dealt(versions.join(counts.select(key), key, "left_semi"))
        last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(position, value)).alias("_last")
        ends = known.where("_parts > 1").groupBy(key, "_part").agg(last)
        every = hot.select(key, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).join(ends, [key, "_part"], "left")
        before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        carried = every.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).where("_before IS NOT NULL")
        carried = carried.select(key, F.lit(None).cast(versions.schema[position].dataType).alias(position), F.col("_before.v").alias(value), "_part")
        return known.select(key, position, value, "_part").unionByName(carried)

    return dealt(probes).drop("_bounds", "_parts"), met


def as_of(probes: DataFrame, versions: DataFrame, key: str, position: str, value: str, fallback: DataFrame | None = None, into: str = "found") -> DataFrame:
    """Each probe with the value of its key in force at its position (a version counts at its own position).

    Versions of a key are few against probes: they become one sorted array a key, and each
    probe picks from its key's array; probes of hot keys are dealt to several tasks (see
    ``spread``). A version with a null value is a tombstone: it hides earlier ones and the
    fallback, which (columns key and value) otherwise serves keys and positions before any
    version. Large values, such as schemas to decode by, are better met by a sorted merge:
    ``functions.decoding.decode_in_force``.
    """
    probes, copied = spread(probes, key, position)
    lists = versions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v")))).alias("_all"))
    # a version equal to the one before it changes nothing
    lists = copied(lists.select(key, F.expr("filter(_all, (x, i) -> i = 0 OR NOT (x.v <=> _all[i - 1].v))").alias("_versions")))
    joined = probes.join(lists, [key, "_part"], "left")
    before = F.filter("_versions", lambda x: x["p"] <= F.col(position))
    joined = joined.withColumn("_at", F.when(F.size(before) > 0, F.element_at(before, -1)))
    if fallback is None:
        return joined.withColumn(into, F.col("_at.v")).drop("_versions", "_at", "_part")
    joined = joined.join(copied(fallback.select(key, F.col(value).alias("_fallback"))), [key, "_part"], "left")
    return joined.withColumn(into, F.when(F.col("_at").isNull(), F.col("_fallback")).otherwise(F.col("_at.v"))).drop("_versions", "_at", "_fallback", "_part")


def as_of_by_window(rows: DataFrame, key: str, order: list[str], value: Column, into: str = "found") -> DataFrame:
    """The last non-null ``value`` up to each row of a key: builds and probes in one table, in one window."""
    frame = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(into, F.last_value(value, ignoreNulls=True).over(frame))


def postings(rows: DataFrame, array: str = "notified", keep: tuple[str, ...] = ("global_sequence", "block_num")) -> DataFrame:
    """One row per member of an array column: the table that makes membership an equality."""
    return rows.select(F.explode(F.array_distinct(array)).alias("account"), *keep)


def anti_lookup(rows: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose pair is not in a set of pairs."""
    return rows.join(pairs, on, "left_anti")


def resume_block(explicit: int | None, checkpoint: DataFrame, blocks: DataFrame, actions: DataFrame) -> DataFrame:
    """Where to go on: the stated block, after the checkpoint, after the last block, after the last action, or 1."""
    most = lambda df, name: df.agg(F.max("block_num").alias(name)).withColumn("k", F.lit(0))
    joined = most(checkpoint, "c").join(most(blocks, "b"), "k").join(most(actions, "a"), "k")
    return joined.select(F.coalesce(F.lit(explicit).cast("long"), F.col("c") + 1, F.col("b") + 1, F.col("a") + 1, F.lit(1)).cast("long").alias("start_block"))


def forks(blocks: DataFrame, order: str = "arrival_ordinal", number: str = "block_num", stream: str | None = None, run_bits: int = 14) -> DataFrame:
    """Arrivals at or below the height before them: a replay after a fork.

    Arrivals are compared within runs of 2 ** ``run_bits`` places; only the last height of
    each run is ordered over the whole stream, for the first arrival of the next.
    """
    of = [F.col(stream)] if stream else [F.lit(0)]
    keyed = blocks.withColumn("_of", of[0]).withColumn("_run", F.shiftright(F.col(order).cast("long"), run_bits))
    ends = keyed.groupBy("_of", "_run").agg(F.max_by(number, order).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(W.partitionBy("_of").orderBy("_run"))).drop("_end")
    inside = F.lag(number).over(W.partitionBy("_of", "_run").orderBy(order))
    found = keyed.withColumn("previous", inside).withColumnRenamed("_of", "_stream").withColumnRenamed("_run", "_place")
    joined = found.join(ends, F.col("_stream").eqNullSafe(F.col("_of")) & F.col("_place").eqNullSafe(F.col("_run")), "left")
    joined = joined.withColumn("previous", F.coalesce("previous", "_before"))
    return joined.where(F.col(number) <= F.col("previous")).drop("_stream", "_place", "_of", "_run", "_before")
