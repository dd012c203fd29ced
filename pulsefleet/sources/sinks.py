"""Writers: keyed batch appends, CSV export, report rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefleet.operators.tables import latest_by_key


def flatten_snapshots(snapshots: DataFrame, order: Sequence[str] = ()) -> dict[str, DataFrame]:
    """System, process and intent rows of nested snapshots (device_id, ts, system, processes, intent).

    ``order`` are the snapshot's columns that say which of several rows of a key was written last.
    """
    key = ["device_id", "ts", *order]
    return {
        "metrics": snapshots.select(*key, "system.*"),
        "process_samples": snapshots.select(*key, F.explode("processes").alias("p")).select(*key, "p.*"),
        "user_intent_samples": snapshots.where(F.col("intent").isNotNull()).select(*key, "intent.*"),
    }


SNAPSHOT_KEYS = {
    "metrics": ["device_id", "ts"],
    "process_samples": ["device_id", "ts", "pid"],
    "user_intent_samples": ["device_id", "ts"],
}


def write_batch(
    tables: Mapping[str, DataFrame], folder: str, batch_id: int, order: Sequence[str], keys: Mapping[str, Sequence[str]] = SNAPSHOT_KEYS
) -> None:
    """Write one batch of tables, the last row of a key by ``order`` kept, below ``batch=<id>``.

    A repeated batch overwrites its own folder, so a retry after a lost executor adds nothing twice.
    Rows of a key in several batches stay beside each other; ``read_keyed`` takes the last of them.
    """
    for name, rows in tables.items():
        latest_by_key(rows, keys[name], order).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")


def read_keyed(
    spark: SparkSession, folder: str, name: str, order: Sequence[str], keys: Mapping[str, Sequence[str]] = SNAPSHOT_KEYS
) -> DataFrame:
    """The table that the batches add up to: one row per key, the last by ``order``, then by batch."""
    stored = spark.read.parquet(f"{folder}/{name}")
    return latest_by_key(stored, keys[name], [*order, "batch"]).drop("batch")


def compact(spark: SparkSession, folder: str, name: str, order: Sequence[str], target: str, keys: Mapping[str, Sequence[str]] = SNAPSHOT_KEYS) -> None:
    """Write the keyed table as a single batch of ``target``, so that later reads need not resolve old batches."""
    rows = read_keyed(spark, folder, name, order, keys)
    rows.write.mode("overwrite").parquet(f"{target}/{name}/batch=0")


EXPORT_COLUMNS = (
    "episode_id",
    "observed_at",
    "cpu_percent",
    "memory_percent",
    "disk_free_percent",
    "network_down_kbps",
    "network_up_kbps",
    "process_count",
    "collector_health",
)


def device_export(summaries: DataFrame, episodes: DataFrame, device_id: str) -> DataFrame:
    """Summaries of one device in time order."""
    mine = episodes.where(F.col("device_id") == device_id).select("episode_id")
    return summaries.join(mine, "episode_id").orderBy("observed_at").select(*EXPORT_COLUMNS)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header per part file; the row order of a sorted frame is the part order."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows as JSON lines; null fields are kept so that failures stay visible."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def failure_row(rows: DataFrame, message: str) -> DataFrame:
    """A report that could not be built, as one row."""
    return rows.sparkSession.range(1).select(F.lit("NOT_CERTIFIED").alias("status"), F.lit(message).alias("fatal_error"))
