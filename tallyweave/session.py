"""Session settings, and cutting lineage in a place every executor can reach."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings this package relies on.  Its joins look keys up in a side
#: that is unique per key (see ``operators.lookup``), so splitting the other
#: side's hot partitions is enough to spread a key that holds a large share of
#: the rows; it is forced even where it costs one more exchange.
EXCLUDED = "spark.sql.optimizer.excludedRules"
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What a job has shuffled goes when the job ends, not when the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Exploding a computed array would otherwise first filter on its size, down
    # at the scan, and so work out every array twice.
    EXCLUDED: (
        "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"
    ),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if key == EXCLUDED:
            # Rules that the session's owner has excluded stay so.
            theirs = [r for r in (spark.conf.get(key, None) or "").split(",") if r.strip()]
            value = ",".join(dict.fromkeys([*theirs, value]))
        spark.conf.set(key, value)
    return spark


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan of few, small files at least one task per core.

    Reading a document costs little and working on it much.  A large table has
    more splits than cores and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that names none and runs in local mode gets a temporary
    folder; on a cluster a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tallyweave-")
    context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the folder all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, outlast: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts lineage: later jobs read the table, also after an executor is lost.  Within ``passing`` it goes
    at the end of the innermost block, or with ``outlast`` of the one around that.
    """
    spark, folder = df.sparkSession, scratch(df.sparkSession, name)
    blocks = _blocks()[:-1] if outlast else _blocks()
    if blocks:
        blocks[-1].append(folder)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


_passing = threading.local()


def _blocks() -> list[list[str]]:
    """The folders of this thread's ``passing`` blocks, the innermost last."""
    if not hasattr(_passing, "blocks"):
        _passing.blocks = []
    return _passing.blocks


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored within the block are for it alone and are deleted when it ends."""
    folders: list[str] = []
    _blocks().append(folders)
    try:
        yield
    finally:
        _blocks().pop()
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
