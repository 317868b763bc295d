"""Rows out: bulk lines for a search index, and views up to the last irreversible block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ingest


def bulk_lines(rows: DataFrame, kind: str, index: str, version: str = "_version", operation: str = "_op") -> DataFrame:
    """NDJSON for a bulk interface, one string a row: the operation with id and external version, then the document.

    Deletes have the first line only. Ids are the table's key, joined by dashes.
    """
    key = F.concat_ws("-", *[F.col(f"`{c}`").cast("string") for c in ingest.KEYS[kind]])
    meta = F.struct(F.lit(index).alias("_index"), key.alias("_id"), F.col(version).alias("version"), F.lit("external").alias("version_type"))
    gone = F.col(operation) == "delete" if operation in rows.columns else F.lit(False)
    head = F.when(gone, F.to_json(F.struct(meta.alias("delete")))).otherwise(F.to_json(F.struct(meta.alias("index"))))
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in (version, operation)]))
    return rows.select(F.when(gone, F.concat(head, F.lit("\n"))).otherwise(F.concat(head, F.lit("\n"), body, F.lit("\n"))).alias("lines"))


def irreversible(rows: DataFrame, lib: int) -> DataFrame:
    """Rows that no fork can replace any more."""
    return rows.where(F.col("block_num") <= lib)
