"""Tables laid out by a bucket of the key and a period of the clock, so that maintenance touches few files.

A change set, an erased device or a retention cut first names the partitions in which a row goes or comes. Only those
are written anew (``partitionOverwriteMode=dynamic``); partitions that lose all rows are removed, and all others keep
their files. Names of partitions pass through the driver, which holds them as the table's file index anyway; rows never do.

A repeated call gives the same table, so a job that was cut short is run again with the same change set. Spark moves the
written partitions one by one when the job commits: a reader may meet old and new partitions beside each other, and a driver that is lost
in that moment leaves a partition's new files below ``.spark-staging``. Change sets must not be read from the table itself.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, IntegralType, StructField, StructType

from pulsefleet.session import checkpointed

BUCKET, PERIOD = "key_bucket", "clock_period"
_ABSENT = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Stored:
    """A written table. ``clock`` is a date, a timestamp or whole microseconds; without one a bucket is one partition.

    unit     period of a partition: day, week, month, quarter or year
    """

    path: str
    schema: StructType
    key: str
    clock: str | None = None
    buckets: int = 256
    unit: str = "day"

    def placed(self, rows: DataFrame) -> DataFrame:
        """The rows with their partition. Rows with a null key or clock have partitions as well."""
        clash = {BUCKET, PERIOD} & set(rows.columns)
        if clash:
            raise ValueError(f"columns of the layout are taken: {sorted(clash)}")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        return rows.select(*self.schema.names).withColumns({BUCKET: bucket, PERIOD: self._period(self._time())})

    def _time(self) -> Column:
        if self.clock is None:
            return F.lit(None).cast("date")
        return F.timestamp_micros(self.clock) if isinstance(self.schema[self.clock].dataType, IntegralType) else F.col(self.clock)

    def _period(self, time: Column) -> Column:
        return F.date_trunc(self.unit, time).cast("date")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.read_placed(spark).drop(BUCKET, PERIOD)

    def read_placed(self, spark: SparkSession) -> DataFrame:
        layout = StructType([*self.schema.fields, StructField(BUCKET, IntegerType()), StructField(PERIOD, DateType())])
        return spark.read.schema(layout).parquet(self.path)


def create(rows: DataFrame, path: str, key: str, clock: str | None = None, buckets: int = 256, unit: str = "day") -> Stored:
    table = Stored(path, rows.schema, key, clock, buckets, unit)
    _write(table, table.placed(rows))
    return table


def _write(table: Stored, placed: DataFrame) -> None:
    # The rebalancing splits a partition that is too large for one task and joins small ones.
    (
        placed.hint("rebalance", F.col(BUCKET), F.col(PERIOD))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET, PERIOD).parquet(table.path)
    )


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def partitions(spark: SparkSession, table: Stored) -> list[tuple[int, dt.date | None]]:
    """Bucket and period of every partition, from the names of the folders."""
    where, files = _files(spark, f"{table.path}/{BUCKET}=*/{PERIOD}=*")
    names = [status.getPath().toString().split("/")[-2:] for status in files.globStatus(where) or []]
    pairs = [(bucket.partition("=")[2], period.partition("=")[2]) for bucket, period in names]
    return [(int(b), None if p == _ABSENT else dt.date.fromisoformat(p)) for b, p in pairs]


def _remove(spark: SparkSession, table: Stored, gone: list[tuple[int, dt.date | None]]) -> None:
    for bucket, period in gone:
        where, files = _files(spark, f"{table.path}/{BUCKET}={bucket}/{PERIOD}={period or _ABSENT}")
        files.delete(where, True)


def _within(parts: list[tuple[int, dt.date | None]]) -> Column:
    """A condition on partition columns alone, which prunes folders: a few more than ``parts`` may pass."""
    days = sorted({p for _, p in parts if p is not None})
    period = F.col(PERIOD).isin(days) if days else F.lit(False)
    if any(p is None for _, p in parts):
        period = period | F.col(PERIOD).isNull()
    return F.col(BUCKET).isin(sorted({b for b, _ in parts})) & period


def _apply(spark: SparkSession, table: Stored, marked: DataFrame, added: DataFrame | None = None) -> list[tuple[int, dt.date | None]]:
    """Take out the rows of ``marked`` with ``__gone`` and put in ``added``; the partitions that were touched.

    marked   whole partitions of the table (with those of ``added``), and a boolean ``__gone``
    """
    counts = marked.groupBy(BUCKET, PERIOD).agg(F.count_if("__gone").alias("gone"), F.count_if(~F.col("__gone")).alias("stay"))
    counts = {(c[BUCKET], c[PERIOD]): (c["gone"], c["stay"]) for c in counts.toLocalIterator()}
    fresh = set() if added is None else {(c[BUCKET], c[PERIOD]) for c in added.select(BUCKET, PERIOD).distinct().toLocalIterator()}
    touched = fresh | {part for part, (gone, _) in counts.items() if gone}
    emptied = [part for part in touched - fresh if not counts[part][1]]
    rewritten = sorted(touched.difference(emptied), key=str)
    if rewritten:
        names = F.broadcast(spark.createDataFrame(rewritten, "__b int, __p date"))
        same = (F.col(BUCKET) == F.col("__b")) & F.col(PERIOD).eqNullSafe(F.col("__p"))
        rows = marked.where(_within(rewritten)).where(~F.col("__gone")).drop("__gone").join(names, same, "left_semi")
        _write(table, rows if added is None else rows.unionByName(added))
    _remove(spark, table, emptied)
    return sorted(touched, key=str)


def _marked_keys(spark: SparkSession, table: Stored, keys: DataFrame) -> DataFrame:
    """The buckets of the keys, read alone, with ``__gone`` for their rows. ``keys`` has the table's key column."""
    keys = keys.select(table.key).distinct()
    buckets = keys.select(F.pmod(F.xxhash64(table.key), F.lit(table.buckets)).cast("int").alias("b")).distinct()
    base = table.read_placed(spark).where(F.col(BUCKET).isin([row["b"] for row in buckets.collect()]))
    hit = keys.select(F.col(table.key).alias("__key"), F.lit(True).alias("__hit"))
    joined = base.join(hit, base[table.key].eqNullSafe(hit["__key"]), "left")
    return joined.withColumn("__gone", F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def replace_children(spark: SparkSession, table: Stored, delta: DataFrame) -> list[tuple[int, dt.date | None]]:
    """The rows of the keys in ``delta`` are replaced by delta's rows, wherever those lie."""
    return _apply(spark, table, _marked_keys(spark, table, delta), table.placed(delta))


def erase_keys(spark: SparkSession, table: Stored, keys: DataFrame) -> list[tuple[int, dt.date | None]]:
    """Erase all rows of the keys; only their buckets are read."""
    return _apply(spark, table, _marked_keys(spark, table, keys))


def drop_before(spark: SparkSession, table: Stored, cutoff: dt.datetime) -> list[tuple[int, dt.date | None]]:
    """Drop the rows before ``cutoff``. Past periods go unread; the period of the cut is written anew.

    Rows without a time stay.
    """
    edge = spark.range(1).select(table._period(F.lit(cutoff.isoformat()).cast("timestamp_ntz")).alias("p")).first()["p"]
    parts = partitions(spark, table)
    old = [(b, p) for b, p in parts if p is not None and p < edge]
    _remove(spark, table, old)
    if not any(p == edge for _, p in parts):
        return sorted(old, key=str)
    before = table._time().cast("timestamp_ntz") < F.lit(cutoff.isoformat()).cast("timestamp_ntz")
    marked = table.read_placed(spark).where(F.col(PERIOD) == F.lit(edge)).withColumn("__gone", F.coalesce(before, F.lit(False)))
    return sorted([*old, *_apply(spark, table, marked)], key=str)


def drop_old(spark: SparkSession, table: Stored, span: int) -> list[tuple[int, dt.date | None]]:
    """Drop the rows more than ``span`` microseconds before the newest row of their key. Rows without a time stay.

    The newest time of a key needs the key and the clock of all rows. The comparison then reads, of each
    bucket, the periods up to its latest cut.
    """
    micros = F.unix_micros(table._time().cast("timestamp"))
    base = table.read_placed(spark)
    cuts = base.groupBy(BUCKET, table.key).agg((F.max(micros) - F.lit(span)).alias("__cut")).where("__cut is not null")
    ends = cuts.groupBy(BUCKET).agg(table._period(F.timestamp_micros(F.max("__cut"))).alias("end")).collect()
    reach = F.lit(False)
    for row in ends:
        reach = reach | ((F.col(BUCKET) == row[BUCKET]) & (F.col(PERIOD) <= F.lit(row["end"])))
    cuts = cuts.select(F.col(table.key).alias("__key"), "__cut")
    joined = base.where(reach).join(cuts, base[table.key].eqNullSafe(cuts["__key"]), "left")
    return _apply(spark, table, joined.withColumn("__gone", F.coalesce(micros < F.col("__cut"), F.lit(False))).drop("__key", "__cut"))


def erase_devices(
    spark: SparkSession, tables: dict[str, Stored], devices: DataFrame, episodes: str, summaries: str,
    by_summary: list[str], by_episode: list[str], by_device: list[str],
) -> None:
    """Erase devices from all tables, children first, so that a call that was cut short can be repeated.

    Episodes are laid out by device_id, summaries by episode_id, the listed tables by summary_id, episode_id and
    device_id. Ids are found through the buckets of the devices, then through those of their episodes.
    """
    gone = devices.select("device_id").distinct()
    own = _marked_keys(spark, tables[episodes], gone).where("__gone").select("episode_id").distinct()
    doomed = checkpointed(own)
    parts = _marked_keys(spark, tables[summaries], doomed).where("__gone").select("summary_id").distinct()
    doomed_summaries = checkpointed(parts)
    for name in by_summary:
        erase_keys(spark, tables[name], doomed_summaries)
    for name in [summaries, *by_episode]:
        erase_keys(spark, tables[name], doomed)
    for name in [episodes, *by_device]:
        erase_keys(spark, tables[name], gone)
