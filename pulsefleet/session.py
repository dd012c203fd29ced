"""Session helpers: local sessions for tests, the shared checkpoint folder, and the row budget."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SEGMENT_ROWS = "spark.pulsefleet.segmentRows"
BROADCAST_ROWS = "spark.pulsefleet.broadcastRows"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pulsefleet")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # The JVM never compiles a method above 8000 bytes; let Spark split such stages instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@dataclass(frozen=True)
class RowBudget:
    """Bounds that decide when a key is split and when a side may be broadcast.

    segment_rows    rows of one key that a single task may hold; a key above it is cut in segments
    broadcast_rows  rows a side may have and still be broadcast; a larger one is joined by shuffle
    """

    segment_rows: int = 5_000_000
    broadcast_rows: int = 1_000_000

    @classmethod
    def of(cls, spark: SparkSession) -> "RowBudget":
        return cls(
            int(spark.conf.get(SEGMENT_ROWS, str(cls.segment_rows))),
            int(spark.conf.get(BROADCAST_ROWS, str(cls.broadcast_rows))),
        )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names.

    Only a local master may fall back to a temporary folder: on a cluster the other executors
    could not read it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pulsefleet-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables: a new one below the checkpoint folder.

    The application owns it: Hadoop's file system removes it when the application ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        checkpointed(spark.range(1))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{context.getCheckpointDir()}/tables/{uuid.uuid4().hex}")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path.getParent())
    files.mkdirs(path)
    files.deleteOnExit(path)
    files.delete(path, True)
    return path.toString()
