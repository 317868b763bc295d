"""The chain's tables as folders of Parquet: append logs by batch, current views, compaction, progress.

A batch writes ``<kind>/batch=<n>`` in overwrite mode, so a batch that runs again
replaces itself: with the offsets of Structured Streaming that makes each change appear
once. Readers take the batches up to the last that the progress table confirms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ingest, state

KINDS = ("action", "block", "delta", "abi", "perm", "token")
#: Tables whose rows replace each other, with what orders them.
CURRENT = {"perm": "_version", "token": "_version"}
PROGRESS = "batch long, block_num long, arrival_ordinal long"
#: Compacted rows of current tables; a negative number sorts before all batches.
COMPACTED = -1
SCHEMAS: dict[str, StructType] = {}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str) -> str:
        return f"{self.root}/{kind}"

    def exists(self, kind: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(kind))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def create(self) -> None:
        """All tables, empty, where they are missing; compactions that were cut off are finished."""
        for kind in CURRENT:
            self.recover(kind)
        for kind in ingest.KEYS:
            if not self.exists(kind):
                self.spark.createDataFrame([], self._schema(kind)).write.parquet(self.path(kind))
        if not self.exists("progress"):
            self.spark.createDataFrame([], PROGRESS).write.parquet(self.path("progress"))

    def append(self, kind: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path(kind)}/batch={batch}")

    def confirm(self, batch: int, block_num: int | None, arrival_ordinal: int | None) -> None:
        self.spark.createDataFrame([(batch, block_num, arrival_ordinal)], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{self.path('progress')}/step={batch}")

    def progress(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").schema(PROGRESS).parquet(self.path("progress"))

    def confirmed(self) -> int:
        last = self.progress().agg(F.max("batch")).first()[0]
        return COMPACTED if last is None else last

    def log(self, kind: str) -> DataFrame:
        """Every confirmed row of a table, as it was appended."""
        found = self.spark.read.option("basePath", self.path(kind)).schema(self._schema(kind)).parquet(self.path(kind))
        return found.where(F.coalesce("batch", F.lit(COMPACTED)) <= self.confirmed())

    def _schema(self, kind: str) -> StructType:
        """A table's columns; the plan that they come from is made once a process."""
        if not SCHEMAS:
            empty = ingest.block_tables(self.spark.createDataFrame([], ingest.RAW))
            SCHEMAS.update({k: rows.withColumn("batch", F.lit(0).cast("long")).schema for k, rows in empty.items()})
        return SCHEMAS[kind]

    def table(self, kind: str) -> DataFrame:
        """The present rows: the latest version of each key; of histories, each id's last arrival."""
        log = self.log(kind)
        if kind in CURRENT:
            return state.latest(log, ingest.KEYS[kind], CURRENT[kind])
        order = "arrival_ordinal" if "arrival_ordinal" in log.columns else "batch"
        return state.latest(log.withColumn("_op", F.lit("index")), ingest.KEYS[kind], order).drop("_op")

    def compact(self, kind: str) -> None:
        """Fold a current table's confirmed log, tombstones with it, into one base; older batches go."""
        self.recover(kind)
        last, found = self.confirmed(), self.table(kind)
        base = found.drop("batch").withColumn("_op", F.lit("index"))
        # The new base is whole, beside the table, before anything goes; a rename that a crash
        # cut off is made up by the next ``recover``, with which a start or compaction begins.
        base.write.mode("overwrite").parquet(f"{self.root}/_compacted/{kind}/batch={last}")
        self.recover(kind)

    def recover(self, kind: str) -> None:
        """Finish a compaction: drop what the written base holds, then put it in place."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs_path = jvm.org.apache.hadoop.fs.Path
        fs, waiting = fs_path(self.root).getFileSystem(conf), fs_path(f"{self.root}/_compacted/{kind}")
        if not fs.exists(waiting):
            return
        for made in fs.listStatus(waiting):
            last = int(made.getPath().getName().removeprefix("batch="))
            if not fs.exists(fs_path(made.getPath(), "_SUCCESS")):
                fs.delete(made.getPath(), True)
                continue
            for item in fs.listStatus(fs_path(self.path(kind))):
                name = item.getPath().getName()
                if name.startswith("batch=") and int(name.removeprefix("batch=")) <= last:
                    fs.delete(item.getPath(), True)
            fs.rename(made.getPath(), fs_path(f"{self.path(kind)}/batch={COMPACTED}"))
