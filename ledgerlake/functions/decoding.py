"""Decoding by schema as columns and SQL functions: Arrow batches, compiled schemas per worker."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..codec import keys, schema
from ..codec.cursor import Cursor, DecodeError
from ..operators import state


def _text_or_null(make) -> str | None:
    try:
        return make()
    except DecodeError:
        return None


def _named(section: str):
    @F.arrow_udf("string")
    def run(abi: pa.Array, name: pa.Array, data: pa.Array) -> pa.Array:
        rows = zip(abi.to_pylist(), name.to_pylist(), data.to_pylist(), strict=True)
        return pa.array([_text_or_null(lambda: schema.to_json(schema.schema_of(a).decode_named(section, n, d))) if a is not None and n is not None and d is not None else None for a, n, d in rows], type=pa.string())

    return run


def decode_action(abi: Column, name: Column, data: Column) -> Column:
    """An action's data as JSON text, by the schema (JSON text) in force; null where it does not decode."""
    return _named("actions")(abi, name, data)


def decode_row(abi: Column, table: Column, data: Column) -> Column:
    """A table row's data as JSON text; null where it does not decode."""
    return _named("tables")(abi, table, data)


def decode_in_force(probes: DataFrame, versions: DataFrame, section: str, key: str, position: str, place: Column, name: str, data: str, fallback: DataFrame | None = None, into: str = "data_json") -> DataFrame:
    """Each probe with its data as JSON text, by the schema of its key in force at its position; null where there is none or it does not decode.

    ``versions`` has the key, the position and ``abi``, null where a schema was removed;
    ``fallback`` (key, abi) serves positions before any version; a version counts at its
    own position. Both sides are sorted by key and position and read in one pass, so a
    schema travels once for each part of a key, not once a row, and a worker holds the one
    in force. Probes of hot keys are dealt to several tasks by ranges of ``place``, a
    number that orders as the position does (see ``state.ranges``).
    """
    # a stated number of partitions, as decoding is work of the processor: sizes would join them to a few
    tasks = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, met = state.ranges(probes, key, place, tasks)
    known = versions.select(key, position, F.col("abi").alias("_abi"))
    if fallback is not None:
        known = known.unionByName(fallback.select(key, F.lit(None).cast(probes.schema[position].dataType).alias(position), F.col("abi").alias("_abi")))
    rows = dealt.withColumn("_probe", F.lit(True)).unionByName(met(known, position, "_abi").withColumn("_probe", F.lit(False)), allowMissingColumns=True)
    order = [key, "_part", position, "_probe", "_abi"]
    # the parts of a key go to tasks one after the other, so no two meet before all tasks have one
    rows = rows.repartitionById(tasks, F.pmod(F.hash(key).cast("long") + F.col("_part"), F.lit(tasks)).cast("int")).sortWithinPartitions(*order)
    keep = probes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, force = None, None
        for batch in batches:
            made = []
            for k, part, probe, abi, n, d in zip(*(batch.column(c).to_pylist() for c in (key, "_part", "_probe", "_abi", name, data)), strict=True):
                if (k, part) != at:
                    at, force = (k, part), None
                if not probe:
                    force = None if abi is None else schema.schema_of(abi)
                else:
                    made.append(None if force is None or n is None or d is None else _text_or_null(lambda: schema.to_json(force.decode_named(section, n, d))))
            found = batch.select(keep).filter(batch.column("_probe"))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(made, pa.string())], names=[*keep, into])

    return rows.mapInArrow(run, StructType([*probes.schema.fields]).add(into, "string"))


@lru_cache(512)
def _unpacked(data: bytes) -> str | None:
    found = schema.unpacked_schema(data)
    return None if found is None else schema.to_json(found)


def unpack_schema(data: Column) -> Column:
    """A packed schema as JSON text; null if it isn't one."""

    @F.arrow_udf("string")
    def run(found: pa.Array) -> pa.Array:
        return pa.array([_unpacked(d) if d else None for d in found.to_pylist()], type=pa.string())

    return run(data)


def _key(reader):
    @F.arrow_udf("string")
    def run(found: pa.Array) -> pa.Array:
        return pa.array([_text_or_null(lambda: reader(Cursor(d))) if d is not None else None for d in found.to_pylist()], type=pa.string())

    return run


def public_key_text(data: Column) -> Column:
    return _key(keys.public_key)(data)


def signature_text(data: Column) -> Column:
    return _key(keys.signature)(data)


def register(spark: SparkSession) -> None:
    """The decoders as SQL functions."""
    spark.udf.register("decode_action", _named("actions"))
    spark.udf.register("decode_row", _named("tables"))
    spark.udf.register("public_key_text", _key(keys.public_key))
    spark.udf.register("signature_text", _key(keys.signature))


