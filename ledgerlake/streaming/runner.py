"""Structured Streaming from the block feed into a store."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import ingest
from ..sources.config import Config
from ..sources.feed import FRAME_BITS, register
from .store import KINDS, Store

log = logging.getLogger(__name__)


class Throughput(StreamingQueryListener):
    """Blocks a second of each micro-batch, to the log."""

    def onQueryStarted(self, event) -> None:
        log.info("ingest %s started", event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        log.info("batch %d: %d blocks, %.1f a second", p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryTerminated(self, event) -> None:
        log.info("ingest %s ended: %s", event.id, event.exception or "all taken")


def schemas_before(store: Store, batch: int, fallback: DataFrame | None) -> DataFrame:
    """For each account the schema last set in confirmed batches before this one, else the fallback's."""
    last = store.log("abi").where(F.col("batch") < batch).groupBy("account").agg(F.max_by("abi", "arrival_ordinal").alias("abi"))
    return last if fallback is None else last.unionByName(fallback.join(last, "account", "left_anti").select("account", "abi"))


def write_batch(store: Store, raw: DataFrame, batch: int, fallback: DataFrame | None = None, skip_actions: list[str] | None = None) -> None:
    """One micro-batch: all tables under the batch's number, then the progress row that confirms it."""
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    raw = hold(raw)
    try:
        tables = ingest.block_tables(raw, schemas_before(store, batch, fallback), skip_actions, hold)
        for kind in KINDS:
            store.append(kind, tables[kind], batch)
        store.confirm(batch, *raw.agg(F.max("block_num"), F.max("arrival_ordinal")).first())
    finally:
        for df in held:
            df.unpersist()


def start(spark: SparkSession, config: Config, fallback: DataFrame | None = None, bounded: bool = False) -> StreamingQuery:
    """Follow the feed, some files at a time, or with ``bounded`` take all there are and end."""
    register(spark)
    store = Store(spark, config.table("").rstrip("/"))
    store.create()
    i = config.indexer
    last = store.progress().agg(F.max("arrival_ordinal")).first()[0]
    options = {"path": config.feed, "startBlock": i.start_block or 0, "stopBlock": i.stop_block, "fetchBlock": i.fetch_block, "fetchTraces": i.fetch_traces, "fetchDeltas": i.fetch_deltas, "maxFilesPerTrigger": 0 if bounded else i.max_files_per_trigger, "resumeFile": 0 if last is None else (last >> FRAME_BITS) + 1}
    stream = spark.readStream.format("block_feed").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()
    writer = stream.writeStream.option("checkpointLocation", config.table("_checkpoint"))
    writer = writer.trigger(availableNow=True) if bounded else writer.trigger(processingTime=f"{i.flush_interval_ms} milliseconds")
    return writer.foreachBatch(lambda raw, batch: write_batch(store, raw, batch, fallback, list(i.skip_actions))).start()
