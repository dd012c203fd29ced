"""Queries for the maintenance of tables laid out by key buckets and periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulsefleet.operators import tables as K
from pulsefleet.plans import operations  # noqa: F401  (its SQL is that of the plans on partitions)
from pulsefleet.plans.registry import ORACLES, query
from pulsefleet.plans.views import table, telemetry
from pulsefleet.session import shared_folder
from pulsefleet.sources import partitions as P

BUCKETS = 4


def laid_out(spark, rows, key, clock=None, unit="year"):
    return P.create(rows, shared_folder(spark), key, clock, BUCKETS, unit)


def sizes(spark, stored: dict[str, P.Stored]):
    return K.union_all([s.read(spark).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, s in stored.items()])


@query("a11_replace_in_partitions", ORACLES["a11_replace_children"])
def a11_replace_in_partitions(spark, folder):
    """The lines of pending orders are replaced by one new line each; other partitions keep their files."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.lit("kept").alias("origin"), F.col("l_shipdate").alias("day")
    )
    stored = laid_out(spark, lines, "l_orderkey", "day")
    pending = table(spark, folder, "orders").where(F.col("o_orderstatus") == "P")
    delta = pending.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(100).alias("l_linenumber"), F.lit("new").alias("origin"), F.col("o_orderdate").alias("day"))
    P.replace_children(spark, stored, delta)
    return stored.read(spark).groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_linenumber").alias("numbers"))


@query("a16_drop_old_partitions", ORACLES["a16_retain_by_age"])
def a16_drop_old_partitions(spark, folder):
    """A week of each device is kept; the comparison reads the days up to a bucket's latest cut."""
    stored = laid_out(spark, telemetry(spark, folder).select("device_id", "t", "seq"), "device_id", "t", "week")
    P.drop_old(spark, stored, 7 * 86_400_000_000)
    return stored.read(spark).groupBy("device_id").agg(F.count(F.lit(1)).alias("kept"), F.min("t").alias("oldest"))


@query("a18_drop_past_partitions", ORACLES["a18_cascade_retention"])
def a18_drop_past_partitions(spark, folder):
    """Tables age by their own clock. Baselines are laid out by the earliest clock of their summary's id and go with it."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    summaries = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("summary_id"), F.col("l_shipdate").alias("observed_at"))
    baselines = summaries.select("summary_id").join(summaries.groupBy("summary_id").agg(F.min("observed_at").alias("observed_at")), "summary_id")
    events = table(spark, folder, "events")
    stored = {
        "summaries": laid_out(spark, summaries, "summary_id", "observed_at"),
        "baselines": laid_out(spark, baselines, "summary_id", "observed_at"),
        "outcomes": laid_out(spark, orders.select("o_orderkey", F.col("o_orderdate").alias("observed_at")), "o_orderkey", "observed_at"),
        "health": laid_out(spark, events.select("event_id", F.col("ts").alias("observed_at")), "event_id", "observed_at"),
        "episodes": laid_out(spark, orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("ended_at")), "o_orderkey", "ended_at"),
    }
    for name in ("baselines", "summaries", "outcomes", "health", "episodes"):
        P.drop_before(spark, stored[name], dt.datetime(1998, 1, 1))
    return sizes(spark, stored)


@query("a19_erase_from_partitions", ORACLES["a19_erase_devices"])
def a19_erase_from_partitions(spark, folder):
    """Customers of a segment are erased from nine tables, children first; only the buckets of erased ids are read."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("device_id"), "c_mktsegment")
    episodes = table(spark, folder, "orders").select(F.col("o_custkey").alias("device_id"), F.col("o_orderkey").alias("episode_id"))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("summary_id"))
    stored = {name: laid_out(spark, customers.select("device_id"), "device_id") for name in ("devices", "descriptors", "sessions")}
    stored |= {name: laid_out(spark, episodes.select("episode_id"), "episode_id") for name in ("qoe_outcomes", "label_provenance", "action_outcomes")}
    stored["episodes"] = laid_out(spark, episodes, "device_id")
    stored["summaries"] = laid_out(spark, lines, "episode_id")
    stored["baselines"] = laid_out(spark, lines.select("summary_id"), "summary_id")
    P.erase_devices(
        spark, stored, customers.where(F.col("c_mktsegment") == "HOUSEHOLD"), "episodes", "summaries",
        ["baselines"], ["qoe_outcomes", "label_provenance", "action_outcomes"], ["devices", "descriptors", "sessions"],
    )
    return sizes(spark, stored)
