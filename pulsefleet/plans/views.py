"""Views that bind the driver's Parquet tables to the telemetry model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_us(name: str):
    """Microseconds since the epoch of a zone-free timestamp, whatever the session zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """One system sample per event."""
    return as_telemetry(table(spark, folder, "events"))


def as_telemetry(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as system samples."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("user_id").alias("device_id"),
        epoch_us("ts").alias("t"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("phase"),
        F.least("value", F.lit(100.0)).alias("cpu"),
        k.alias("mem"),
        (100.0 - k / 2.0).alias("disk"),
        F.col("value").alias("net"),
        (150.0 + F.pmod(F.col("event_id"), F.lit(64))).alias("process"),
        (F.col("value") % 50.0).alias("top_cpu"),
        (k * 9.0).alias("top_mem"),
    )


TELEMETRY = """
tel AS (
  SELECT user_id AS device_id, epoch_us(ts) AS t, event_id AS seq, event_type AS phase,
         least(value, 100.0) AS cpu, k AS mem, 100.0 - k / 2.0 AS disk, value AS net,
         CAST(150 + event_id % 64 AS DOUBLE) AS process, value % 50.0 AS top_cpu, k * 9.0 AS top_mem
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
)
"""


def with_telemetry(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([TELEMETRY.strip(), *ctes]) + "\n" + body


PRESSURE = (
    "least(100, greatest(0, 0.42 * least(100, greatest(0, {cpu} / 80 * 100)) "
    "+ 0.42 * least(100, greatest(0, {mem} / 85 * 100)) "
    "+ 0.16 * CASE WHEN {disk} < 10 THEN least(100, greatest(0, (10 - {disk}) / 10 * 100)) ELSE 0 END))"
)


def pressure_sql(cpu="cpu", mem="mem", disk="disk") -> str:
    return PRESSURE.format(cpu=cpu, mem=mem, disk=disk)


def processes(spark: SparkSession, folder: str) -> DataFrame:
    """One process row per order line: an order is a tick of a device (the customer).

    The order table supplies the device; the part key picks the process name.
    """
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("device_id"),
        F.col("l_orderkey").alias("tick"),
        (F.col("l_linenumber") * 10).cast("long").alias("pid"),
        (F.floor(F.col("l_linenumber") / 2) * 10).cast("long").alias("parent_pid"),
        F.col("l_suppkey").alias("line_supplier"),
        process_name().alias("name"),
        F.when(F.col("l_discount") > 0.05, "C:\\Windows\\System32\\x").otherwise("D:\\apps\\x").alias("exe_path"),
        F.col("l_quantity").alias("cpu"),
        (F.col("l_extendedprice") / 100.0).alias("private_mb"),
        (F.col("l_extendedprice") / 80.0).alias("working_set_mb"),
        (F.col("l_quantity") * 40.0).alias("io_read_kbps"),
        (F.col("l_tax") * 1000.0).alias("io_write_kbps"),
        (F.col("l_quantity") * 20.0).alias("lifetime_sec"),
        F.when(F.col("l_tax") > 0.06, 0).otherwise(1).alias("session_id"),
        (F.col("l_linestatus") == "F").alias("trusted_path"),
        (F.col("l_returnflag") == "R").alias("has_visible_window"),
        F.lit(False).alias("signed_trusted"),
        F.lit(False).alias("is_foreground"),
    )


# Process names that stand for the (part key modulo 12) classes of the test tables.
PROCESS_NAMES = (
    "chrome.exe",
    "csrss.exe",
    "steam_updater.exe",
    "ninja.exe",
    "msmpeng.exe",
    "helper.exe",
    "onedrive.exe",
    "vlc.exe",
    "clang.exe",
    "editor.exe",
    "audiodg.exe",
    "firefox.exe",
)


def process_name():
    names = F.array(*[F.lit(n) for n in PROCESS_NAMES])
    return F.element_at(names, (F.pmod(F.col("l_partkey"), F.lit(12)) + 1).cast("int"))


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in PROCESS_NAMES) + "]"
PROCESSES = f"""
proc AS (
  SELECT o_custkey AS device_id, l_orderkey AS tick, CAST(l_linenumber * 10 AS BIGINT) AS pid,
         CAST(l_linenumber // 2 * 10 AS BIGINT) AS parent_pid, l_suppkey AS line_supplier,
         {_NAMES_SQL}[l_partkey % 12 + 1] AS name,
         CASE WHEN l_discount > 0.05 THEN 'C:\\Windows\\System32\\x' ELSE 'D:\\apps\\x' END AS exe_path,
         l_quantity AS cpu, l_extendedprice / 100.0 AS private_mb, l_extendedprice / 80.0 AS working_set_mb,
         l_quantity * 40.0 AS io_read_kbps, l_tax * 1000.0 AS io_write_kbps, l_quantity * 20.0 AS lifetime_sec,
         CASE WHEN l_tax > 0.06 THEN 0 ELSE 1 END AS session_id, l_linestatus = 'F' AS trusted_path,
         l_returnflag = 'R' AS has_visible_window, false AS signed_trusted, false AS is_foreground
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with a score derived from the document id, and the document's slices."""
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("lang").alias("workload_class"),
        F.col("source").alias("device_id"),
        F.concat(F.lit("family"), F.col("doc_id") % 6).alias("application_family"),
        F.col("quality").alias("label"),
        (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("probability"),
        (F.col("toxic") == 1).alias("toxic"),
    )


PREDICTIONS = """
pred AS (
  SELECT l.doc_id AS row_id, d.lang AS workload_class, d.source AS device_id, 'family' || (l.doc_id % 6) AS application_family, l.quality AS label,
         (l.doc_id * 37 % 101) / 100.0 AS probability, l.toxic = 1 AS toxic
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
)
"""


def with_predictions(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([PREDICTIONS.strip(), *ctes]) + "\n" + body


def with_processes(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([PROCESSES.strip(), *ctes]) + "\n" + body
