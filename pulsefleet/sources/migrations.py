"""Numbered migrations of a table's layout, recorded in a ledger beside it.

A table is a folder: ``rows/schema_version=N`` holds the files written in layout N, ``schema_migrations`` the
ledger (version, name, applied_at). A migration adds columns, so it rewrites no file: reading takes the rows of each
layout through the steps that they lack. Steps that the ledger holds are skipped, so a migration can be run again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefleet.operators.tables import conform

LEDGER = "version int, name string, applied_at long"


@dataclass(frozen=True)
class Step:
    """One migration: the columns it adds, as a DDL string, and the defaults of some of them (others are null)."""

    version: int
    name: str
    adds: str
    defaults: Mapping[str, object] = field(default_factory=dict)


def _ordered(steps: Sequence[Step]) -> list[Step]:
    steps = sorted(steps, key=lambda s: s.version)
    for step, after in zip(steps, steps[1:]):
        if step.version == after.version:
            raise ValueError(f"two migrations have version {step.version}: {step.name}, {after.name}")
    return steps


def _found(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """One row per applied version; of two migrators that recorded one version, the earlier counts."""
    path = f"{folder}/schema_migrations"
    if not _found(spark, path):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(path)
    first = F.min(F.struct("applied_at", "name")).alias("first")
    return rows.groupBy("version").agg(first).select("version", "first.name", "first.applied_at")


def version(spark: SparkSession, folder: str) -> int:
    """The newest applied version; 0 before the first migration."""
    return ledger(spark, folder).agg(F.max("version")).first()[0] or 0


def layout(steps: Sequence[Step], upto: int) -> tuple[T.StructType, dict[str, object]]:
    """Columns and defaults of the layout of a version. A column that several steps add keeps its first place and type."""
    fields, defaults = {}, {}
    for step in _ordered(steps):
        if step.version <= upto:
            for added in T.StructType.fromDDL(step.adds).fields:
                fields.setdefault(added.name, added)
            for name, value in step.defaults.items():
                defaults.setdefault(name, value)
    unknown = defaults.keys() - fields.keys()
    if unknown:
        raise ValueError(f"defaults of columns that no migration adds: {sorted(unknown)}")
    return T.StructType(list(fields.values())), defaults


def migrate(spark: SparkSession, folder: str, steps: Sequence[Step], applied_at: int) -> list[int]:
    """Apply the steps that the ledger lacks, in order of version; the versions applied now.

    All are recorded by one write, after the layout has been built and the ledger compared: either all count or none.
    """
    steps = _ordered(steps)
    known = {row["version"]: row["name"] for row in ledger(spark, folder).collect()}
    for step in steps:
        if known.get(step.version, step.name) != step.name:
            raise ValueError(f"version {step.version} is recorded as {known[step.version]}, not {step.name}")
    pending = [step for step in steps if step.version not in known]
    if pending:
        layout(steps, pending[-1].version)
        rows = [(step.version, step.name, applied_at) for step in pending]
        spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(f"{folder}/schema_migrations")
    return [step.version for step in pending]


def write_rows(df: DataFrame, folder: str, steps: Sequence[Step], mode: str = "append") -> None:
    """Write rows in the layout of the table's present version."""
    now = version(df.sparkSession, folder)
    schema, defaults = layout(steps, now)
    conform(df, schema, defaults).write.mode(mode).parquet(f"{folder}/rows/schema_version={now}")


def read_rows(spark: SparkSession, folder: str, steps: Sequence[Step]) -> DataFrame:
    """All rows in the layout of the table's present version, with ``written_version``.

    Files are read with that layout's columns, so a column that they lack costs no read, and filters and the choice of
    columns reach the files of every layout.
    """
    now = version(spark, folder)
    schema, defaults = layout(steps, now)
    out = spark.createDataFrame([], T.StructType(schema.fields)).withColumn("written_version", F.lit(0))
    for written in [0, *[step.version for step in _ordered(steps) if step.version <= now]]:
        path = f"{folder}/rows/schema_version={written}"
        if _found(spark, path):
            own, _ = layout(steps, written)
            rows = conform(spark.read.schema(own).parquet(path), schema, defaults)
            out = out.unionByName(rows.withColumn("written_version", F.lit(written)))
    return out
