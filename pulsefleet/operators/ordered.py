"""Per-key ordered computation that does not put a whole key in one task.

A window over ``partitionBy(device).orderBy(ts)`` sorts all rows of a device in a single task, which
fails once one device holds a large share of a big table. ``Ordered`` keeps that plain window for
ordinary keys and cuts only the keys above the row budget into consecutive segments:

* the rows of the heavy keys are written in ranges of (key, order); the ranges follow a sample of the
  full order, so a burst within one second, or many rows with one timestamp and a tie-break, are split
  like any others;
* counts per range give every row its place in its key, and a segment is a fixed number of places;
* rows near a cut are copied into the neighbouring segment (halo), so frames bounded in rows see
  the same neighbours as before; the copies are dropped by ``cut``;
* running values restart in each segment and get the value carried from the segments before it,
  which is one row per (key, segment).

When no key is heavy (one small aggregate decides), the plan is the plain single-shuffle window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.session import RowBudget, shared_folder

SEG, HALO, HEAVY = "__seg", "__halo", "__heavy"
_HELPERS = (SEG, HALO, HEAVY)
RANGES_PER_SEGMENT = 4


class Ordered:
    """Rows of ``df`` per ``keys`` in the total order ``order``.

    before  rows before the current one that any frame reads
    after   rows after the current one that any frame reads

    Only rows that agree in all of ``order`` cannot be told apart, so they stay in one range.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], *, before: int = 0, after: int = 0) -> None:
        self.keys = list(keys)
        self.order = list(order)
        budget = RowBudget.of(df.sparkSession)
        self.reach = max(before, after)
        self.rows_per_segment = max(budget.segment_rows, 2 * self.reach + 2)
        heavy = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > self.rows_per_segment)
        segments = F.ceil(F.col("__n") / self.rows_per_segment)
        found = heavy.agg(F.count(F.lit(1)).alias("keys"), F.sum(segments).alias("segments")).first()
        self.split = found["keys"] > 0
        self._carry_fits = self.split and found["segments"] <= budget.broadcast_rows
        self.parts = self.keys + [SEG] if self.split else self.keys
        self.df = df
        if self.split:
            side = F.broadcast if found["keys"] <= budget.broadcast_rows else (lambda frame: frame)
            self.df = self._segmented(df, side(heavy), before, after, int(found["segments"]))

    # -- segments ---------------------------------------------------------------------------

    def _segmented(self, df: DataFrame, heavy: DataFrame, before: int, after: int, segments: int) -> DataFrame:
        """Attach segment, halo and heavy columns; one row per copy."""
        spark = df.sparkSession
        ranges = max(2, RANGES_PER_SEGMENT * segments)
        placed = df.join(heavy, self.keys).repartitionByRange(ranges, *self.keys, *self.order)
        placed = placed.withColumn("__range", F.spark_partition_id())
        # Written, because a range is where a row came to lie: it must not be dealt anew.
        folder = shared_folder(spark)
        placed.write.parquet(folder)
        placed = spark.read.schema(placed.schema).parquet(folder)
        counts = placed.groupBy(*self.keys, "__range").agg(F.count(F.lit(1)).alias("__c"))
        across = Window.partitionBy(*self.keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(*self.keys, "__range", F.coalesce(F.sum("__c").over(across), F.lit(0)).alias("__start"))
        inside = Window.partitionBy(*self.keys, "__range").orderBy(*self.order)
        place = F.col("__start") + F.row_number().over(inside) - 1
        placed = placed.join(starts, [*self.keys, "__range"]).withColumn("__place", place)

        size = F.lit(self.rows_per_segment)
        seg = F.floor(F.col("__place") / size)
        last = F.floor((F.col("__n") - 1) / size)
        offset = F.col("__place") - seg * size
        copy = lambda s, halo: F.struct(s.cast("int").alias(SEG), F.lit(halo).alias(HALO))
        copies = F.array_compact(
            F.array(
                copy(seg, False),
                F.when((size - 1 - offset < before) & (seg < last), copy(seg + 1, True)),
                F.when((offset < after) & (seg > 0), copy(seg - 1, True)),
            )
        )
        placed = placed.withColumn("__copy", F.explode(copies))
        split = placed.select(*df.columns, F.lit(True).alias(HEAVY), f"__copy.{SEG}", f"__copy.{HALO}")
        light = df.join(heavy.select(*self.keys), self.keys, "left_anti")
        whole = (F.lit(False).alias(HEAVY), F.lit(0).alias(SEG), F.lit(False).alias(HALO))
        return light.select(*df.columns, *whole).unionByName(split)

    # -- bounded frames ---------------------------------------------------------------------

    @cached_property
    def window(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def rows(self, start: int, end: int):
        return self.window.rowsBetween(start, end)

    def with_columns(self, columns: Mapping[str, Column]) -> "Ordered":
        """Add columns; window expressions must use ``window`` or ``rows`` of this object."""
        self.df = self.df.withColumns(dict(columns))
        return self

    def cut(self) -> "Ordered":
        """Drop the halo copies. Bounded frames are no longer right after this."""
        if self.split and HALO in self.df.columns:
            self.df = self.df.where(~F.col(HALO)).drop(HALO)
        return self

    # -- running values ---------------------------------------------------------------------

    def cumulate(self, specs: Mapping[str, tuple[str, Column]]) -> "Ordered":
        """Add running values from the first row of the key up to the current row.

        specs maps a new column to (kind, expression); kind is ``sum``, ``max`` or ``last``
        (the latest non-null value).
        """
        self.cut()
        whole = self.window.rowsBetween(Window.unboundedPreceding, 0)
        local = {
            name: {
                "sum": lambda e: F.sum(e),
                "max": lambda e: F.max(e),
                "last": lambda e: F.last(e, ignorenulls=True),
            }[kind](expr).over(whole)
            for name, (kind, expr) in specs.items()
        }
        if not self.split:
            self.df = self.df.withColumns(local)
            return self

        position = F.struct(*self.order)
        totals = {
            "sum": lambda e: F.sum(e),
            "max": lambda e: F.max(e),
            "last": lambda e: F.max_by(e, F.when(e.isNotNull(), position)),
        }
        carried = (
            self.df.where(HEAVY)
            .groupBy(*self.keys, SEG)
            .agg(*[totals[kind](expr).alias(name) for name, (kind, expr) in specs.items()])
        )
        earlier = Window.partitionBy(*self.keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        merge = {
            "sum": lambda n: F.sum(n),
            "max": lambda n: F.max(n),
            "last": lambda n: F.last(n, ignorenulls=True),
        }
        carried = carried.select(
            *self.keys,
            SEG,
            *[merge[kind](name).over(earlier).alias(f"__c_{name}") for name, (kind, _) in specs.items()],
        )
        if self._carry_fits:
            carried = F.broadcast(carried)
        joined = self.df.withColumns(local).join(carried, self.keys + [SEG], "left")
        combine = {
            "sum": lambda a, b: F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
                F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
            ),
            "max": lambda a, b: F.greatest(a, b),
            "last": lambda a, b: F.coalesce(a, b),
        }
        self.df = joined.withColumns(
            {name: combine[kind](F.col(name), F.col(f"__c_{name}")) for name, (kind, _) in specs.items()}
        ).drop(*[f"__c_{name}" for name in specs])
        return self

    def result(self) -> DataFrame:
        self.cut()
        return self.df.drop(*_HELPERS)
