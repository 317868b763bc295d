"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a folder, read by Spark (the path may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that travel to a Python worker at once; whole texts are long rows.
BATCH_ROWS = 500


def on_workers(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package, and bound their batches.

    On a cluster the package is shipped with ``--py-files``; a worker that has it
    installed ignores the additional path. A session with smaller batches keeps them.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


class ByteMemo(dict):
    """A dictionary that fills itself and starts anew where it would hold more than ``most`` bytes.

    Values know their size by ``nbytes`` or ``len``; a single larger one is not remembered.
    """

    ENTRY = 120

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.make(key)
        size = self.ENTRY + (len(key) if isinstance(key, (str, bytes)) else 0) + (value.nbytes if hasattr(value, "nbytes") else len(value) if isinstance(value, (str, bytes)) else 0)
        if size <= self.most:
            if self.held + size > self.most:
                self.clear()
                self.held = 0
            self.held += size
            self[key] = value
        return value


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names; only a local session without that setting
    (tests, one machine) gets a folder of its own, a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage and computes a plan that several branches read only once;
    the files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark clean up after frames that are no longer in use.

    Shuffle files and broadcasts go when the driver's collectors find their frames
    unreachable. A loop of many small jobs allocates too little on the driver for that
    to happen by itself, while they pile up on the executors.
    """
    gc.collect()
    spark._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete the files that ``materialise`` wrote for ``df``, through Spark's own file system."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
