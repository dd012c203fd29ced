"""Mixing sources to target weights through a budget tree.

The tree has the levels domain, language and source; its leaves hold documents with token counts. The
total budget goes down from the root. A node shares its budget among its children by their weights, and
no child gets more than its subtree can supply in ``epochs`` passes; what a short child leaves is shared
among its siblings by their weights. A node's budget never exceeds its own supply, so a shortage goes to
the siblings first, and to the next ancestor's children only where a whole family is short.

A leaf's budget is filled from seeded epochs: in each epoch its documents come in an order given by a hash
of seed, epoch and document, and the leaf takes the prefix of that stream of tokens that its budget pays
for. Running token counts come from sums over ranges of the hash, so no leaf is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.llm.common import counted_before, packed, stored

LEVELS = ("domain", "lang", "source")
NONE = "none"


@dataclass(frozen=True)
class Plan:
    """share: part of all tokens (per mille) that the budget is; weights: per level, value to weight (positive; else 1)."""

    share: int = 1000
    epochs: int = 4
    seed: int = 11
    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)


def tokens(text: Column) -> Column:
    """Words of the text: runs of characters other than blank, tab, line feed and carriage return."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^ \\t\\n\\r]+"), F.lit(0))), F.lit(0)).cast("long")


def domain(source: Column) -> Column:
    """Sources are named by a kind and a number; the last digit of the name stands for their domain."""
    return F.concat(F.lit("d"), F.right(source, F.lit(1)))


def _weight(level: str, plan: Plan) -> Column:
    out = F.lit(1)
    for value, weight in plan.weights.get(level, {}).items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("long")


def shared_out(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Add ``budget`` to children with weight, supply and their parent's ``given``.

    Children are taken in the order of supply per weight. As long as a child's part of what is left is
    more than its supply it gets its supply; all others share the rest by weight, in whole tokens, and
    the tokens lost by rounding down go one each to the first of them.
    """
    by_need = Window.partitionBy(*parents).orderBy(F.col("supply") / F.col("weight"), child)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = children.withColumns(
        {
            "paid": F.coalesce(F.sum("supply").over(before), F.lit(0)),
            "open_weight": F.sum("weight").over(after),
            "nth": F.row_number().over(by_need),
        }
    )
    # Exact in decimals: supply * open_weight <= (given - paid) * weight.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    short = wide("supply") * wide("open_weight") <= (wide("given") - wide("paid")) * wide("weight")
    rows = rows.withColumn("short", short)
    family = Window.partitionBy(*parents)
    first = F.min(F.when(~F.col("short"), F.col("nth"))).over(family)
    rows = rows.withColumn("first", first).withColumns(
        {
            "left": F.max(F.when(F.col("nth") == F.col("first"), F.col("given") - F.col("paid"))).over(family),
            "pool": F.max(F.when(F.col("nth") == F.col("first"), F.col("open_weight"))).over(family),
        }
    )
    part = F.floor(F.col("left").cast("decimal(19,0)") * wide("weight") / F.col("pool")).cast("long")
    shares = F.col("first").isNotNull() & (F.col("nth") >= F.col("first"))
    rows = rows.withColumn("part", F.when(shares, part))
    lost = F.col("left") - F.sum("part").over(family)
    extra = (F.col("nth") - F.col("first") < lost).cast("long")
    return rows.withColumn("budget", F.when(shares, F.least(F.col("part") + extra, "supply")).otherwise(F.col("supply"))).drop(
        "paid", "open_weight", "nth", "short", "first", "left", "pool", "part"
    )


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Per leaf (domain, lang, source, tokens): its budget. ``leaves`` has one row per leaf."""
    leaves = leaves.withColumn("supply", F.col("tokens") * plan.epochs)
    total = F.least(F.floor(F.sum("tokens") * plan.share / 1000), F.sum("supply")).cast("long")
    given = leaves.agg(F.coalesce(total, F.lit(0)).alias("given"))
    upper: list[str] = []
    for level in LEVELS:
        nodes = leaves.groupBy(*upper, level).agg(F.sum("supply").alias("supply")).withColumn("weight", _weight(level, plan))
        nodes = nodes.join(given, upper) if upper else nodes.join(F.broadcast(given))
        given = shared_out(nodes, upper or [F.lit(0)], level).select(*upper, level, F.col("budget").alias("given"))
        upper.append(level)
    return leaves.join(given.withColumnRenamed("given", "budget"), list(LEVELS)).select(*LEVELS, "tokens", "budget")


def mixed(docs: DataFrame, plan: Plan, keep: list[str]) -> DataFrame:
    """Selected documents: ``keep``, leaf, epoch, n_tokens, start (in the epoch's stream), taken (tokens).

    docs  ``keep``, ident (a string that stands for the document), domain, lang, source, n_tokens

    Only documents with tokens are selected; nulls of a level are the value ``none``.
    """
    docs = docs.where("n_tokens > 0").withColumns({c: F.coalesce(F.col(c), F.lit(NONE)) for c in LEVELS})
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan_rows = stored(budgets(leaves, plan)).withColumn("full", F.floor(F.col("budget") / F.col("tokens")))
    plan_rows = plan_rows.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    rows = docs.join(plan_rows, list(LEVELS)).where("budget > 0")
    last = F.col("full") + F.when(F.col("rest") > 0, 0).otherwise(-1)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    hashed = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("epoch").cast("string"), "ident").cast("binary"))
    # 60 bits of the hash, as a long whose top bits are spread evenly over all values.
    order = F.shiftleft(F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long") - F.lit(1 << 59), 4)
    rows = counted_before(rows, [*LEVELS, "epoch"], order, F.col("n_tokens"), "start")
    limit = F.when(F.col("epoch") < F.col("full"), F.col("tokens")).otherwise(F.col("rest"))
    taken = F.least(F.col("n_tokens"), limit - F.col("start"))
    return rows.withColumn("taken", taken).where("taken > 0").select(
        *keep, *LEVELS, F.col("epoch").cast("int").alias("epoch"), "n_tokens", F.col("start").cast("long"), F.col("taken").cast("long")
    )


def mixture(docs: DataFrame, plan: Plan) -> DataFrame:
    """The mixture of ``docs`` (doc_id, text, lang, source): doc_id, domain, lang, source, epoch, n_tokens, start, taken.

    A row per selected document and epoch; taken is below n_tokens only where a budget ends inside a
    document. Null and empty texts have no tokens and are never selected. Documents with a null lang or
    source belong to the value ``none``. Repeated rows come each, in any order among themselves. Empty
    tables give no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", "lang", "source", domain(F.col("source")).alias("domain"), tokens(F.col("text")).alias("n_tokens"))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return mixed(stored(rows.withColumn("ident", ident)), plan, ["doc_id"])


def mixed_documents(docs: DataFrame, plan: Plan) -> DataFrame:
    """The documents of the mixture, whole, with the columns of ``docs``; once per epoch that selects them.

    Equal rows are selected together, and their tokens count together.
    """
    rows = packed(docs)
    parts = rows.select(
        "key",
        F.col("row.lang").alias("lang"),
        F.col("row.source").alias("source"),
        domain(F.col("row.source")).alias("domain"),
        tokens(F.col("row.text")).alias("n_tokens"),
    )
    parts = parts.groupBy("key", "lang", "source", "domain").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.withColumn("ident", F.concat_ws("-", "key.a", "key.b"))
    chosen = stored(mixed(stored(parts), plan, ["key"]).select("key", "epoch"))
    return rows.join(chosen, "key").select("row.*")
