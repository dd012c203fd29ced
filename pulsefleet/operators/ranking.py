"""Global orderings without a single-task sort: bucketed ranks, prefix sums and exact quantiles.

Values are first compressed to distinct values with counts. Cut points then spread the distinct
values over buckets; bucket totals (a small table) give each bucket its offset, and the order inside
a bucket is a window over one bucket only. Results are exact: the cut points only place the work.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.session import RowBudget, checkpointed

BUCKETS = 256
TIE_SLICES = 64
ONE_TASK_ROWS = 200_000

#: Column of a constant, for callers that order the whole table.
WHOLE = "__all"
PERCENTILE_ROWS = 500_000


def cut_points(df: DataFrame, value: str, buckets: int = BUCKETS) -> list[float]:
    """At most ``buckets - 1`` increasing values that split the rows roughly evenly."""
    probs = [i / buckets for i in range(1, buckets)]
    found = df.stat.approxQuantile(value, probs, 1.0 / (4 * buckets))
    return sorted(set(found))


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points at or below the value, by a balanced chain of comparisons."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(cuts[middle]), pick(middle + 1, high)).otherwise(pick(low, middle))

    return pick(0, len(cuts))


def prefix_sums(
    df: DataFrame, groups: Sequence[str], value: str, weights: Sequence[str], cuts: Sequence[float] | None = None
) -> DataFrame:
    """Add ``<w>_before``: the sum of w over smaller values of the group.

    ``df`` must hold each (group, value) once.
    """
    budget = RowBudget.of(df.sparkSession)
    if cuts is None:
        # A group of the whole table is always dealt in buckets; ordinary groups while one of them is large.
        whole = list(groups) in ([], [WHOLE])
        if whole or _largest(df, groups) > min(budget.segment_rows, ONE_TASK_ROWS):
            df = checkpointed(df)  # read for the cuts, the bucket totals and the ranks
            cuts = cut_points(df, value)
        else:
            cuts = []
    before = Window.unboundedPreceding
    if not cuts:
        w = Window.partitionBy(*groups).orderBy(value).rowsBetween(before, -1)
        return df.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in weights})
    bucketed = df.withColumn("__bucket", bucket_of(F.col(value), cuts))
    totals = bucketed.groupBy(*groups, "__bucket").agg(*[F.sum(c).alias(f"__t_{c}") for c in weights])
    across = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(before, -1)
    offsets = totals.select(
        *groups, "__bucket", *[F.coalesce(F.sum(f"__t_{c}").over(across), F.lit(0)).alias(f"__o_{c}") for c in weights]
    )
    inside = Window.partitionBy(*groups, "__bucket").orderBy(value).rowsBetween(before, -1)
    return (
        bucketed.withColumns({f"__i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in weights})
        .join(offsets, [*groups, "__bucket"])
        .withColumns({f"{c}_before": F.col(f"__i_{c}") + F.col(f"__o_{c}") for c in weights})
        .drop("__bucket", *[f"__{k}_{c}" for k in "io" for c in weights])
    )


def global_rank(df: DataFrame, value: str, tie: str, rank: str = "rank", rows: int | None = None) -> DataFrame:
    """1-based rank of each row by (value, hash of tie, tie) over the whole table; ``tie`` is unique.

    ``rows`` is the row count where the caller knows it; a short table is ranked by one task. Rows
    that share a cut value can be many, so they are spread over slices of the hash of ``tie``.
    """
    hashed = df.withColumn("__h", F.xxhash64(tie).bitwiseXOR(F.lit(-(2**63))))
    if (df.count() if rows is None else rows) <= ONE_TASK_ROWS:
        return hashed.withColumn(rank, F.row_number().over(Window.orderBy(value, "__h", tie))).drop("__h")
    numeric = hashed.withColumn("__v", F.col(value).cast("double"))
    cuts = cut_points(numeric, "__v")
    at_cut = F.col("__v").isin(*cuts) if cuts else F.lit(False)
    placed = numeric.withColumns(
        {
            "__bucket": bucket_of(F.col("__v"), cuts),
            "__off_cut": (~at_cut).cast("int"),
            "__slice": F.when(at_cut, F.floor((F.col("__h") / 2.0**63 + 1.0) * (TIE_SLICES / 2))).otherwise(F.lit(0)),
        }
    )
    parts = ["__bucket", "__off_cut", "__slice"]
    counts = placed.groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"))
    # At most BUCKETS * (TIE_SLICES + 1) rows, so one task orders them.
    over = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*parts, F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*parts).orderBy(value, "__h", tie)
    return (
        placed.withColumn("__i", F.row_number().over(inside))
        .join(F.broadcast(offsets), parts)
        .withColumn(rank, F.col("__i") + F.col("__offset"))
        .drop(*parts, "__v", "__h", "__i", "__offset")
    )


def _largest(df: DataFrame, groups: Sequence[str]) -> int:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0


def device_medians(df: DataFrame, groups: Sequence[str], series: Sequence[str]) -> DataFrame:
    """Rows per group and the exact median of each series."""
    long = df.select(*groups, F.inline(F.array(*[F.struct(F.lit(s).alias("__series"), F.col(s).cast("double").alias("__v")) for s in series])))
    medians = exact_quantiles(long, [*groups, "__series"], "__v", {"__m": 0.5})
    wide = medians.groupBy(*groups).agg(*[F.max(F.when(F.col("__series") == s, F.col("__m"))).alias(s) for s in series])
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("count")).join(wide, list(groups))


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    extras: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact for groups of any size.

    ``percentile`` keeps the distinct values of a group in one task, so it is used where the largest
    group is small, first on the rows and then on values compressed with their counts. Beyond that
    the prefix sums above find the two neighbours of each position. ``extras`` are further aggregates
    of the rows, computed in the same pass where that is possible.
    """
    extras = extras or {}
    if not groups:
        whole = exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, extras)
        return whole.drop("__all")
    groups = list(groups)
    source = df.where(F.col(value).isNotNull())
    limit = min(RowBudget.of(df.sparkSession).segment_rows, PERCENTILE_ROWS)
    wanted = F.array(*[F.lit(float(p)) for p in probs.values()])
    unpack = [F.get("__q", i).alias(n) for i, n in enumerate(probs)]
    if _largest(source, groups) <= limit:
        packed = source.groupBy(*groups).agg(
            F.percentile(value, wanted).alias("__q"),
            F.count(F.lit(1)).alias("count"),
            *[c.alias(n) for n, c in extras.items()],
        )
        return packed.select(*groups, "count", *unpack, *extras)
    if extras:
        also = source.groupBy(*groups).agg(*[c.alias(n) for n, c in extras.items()])
        return exact_quantiles(source, groups, value, probs).join(also, groups)
    counts = source.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__n"))
    if _largest(counts, groups) <= limit:
        packed = counts.groupBy(*groups).agg(F.percentile(value, wanted, F.col("__n")).alias("__q"), F.sum("__n").alias("count"))
        return packed.select(*groups, "count", *unpack)
    counts = checkpointed(counts)
    ranked = prefix_sums(counts, groups, value, ["__n"], cut_points(counts, value))
    totals = counts.groupBy(*groups).agg(F.sum("__n").alias("count"))
    ranked = ranked.join(totals, groups)
    first, last = F.col("__n_before"), F.col("__n_before") + F.col("__n") - 1
    aggs = []
    for name, p in probs.items():
        low = F.floor((F.col("count") - 1) * F.lit(p))
        high = F.ceil((F.col("count") - 1) * F.lit(p))
        hit = lambda at: F.max(F.when((first <= at) & (last >= at), F.col(value)))
        aggs += [hit(low).alias(f"__lo_{name}"), hit(high).alias(f"__hi_{name}")]
    found = ranked.groupBy(*groups, "count").agg(*aggs)
    part = lambda p: (F.col("count") - 1) * F.lit(p) - F.floor((F.col("count") - 1) * F.lit(p))
    return found.select(
        *groups,
        "count",
        *[
            (F.col(f"__lo_{n}") * (1.0 - part(p)) + F.col(f"__hi_{n}") * part(p)).alias(n) for n, p in probs.items()
        ],
    )
