"""Keyed table maintenance: last-write-wins, merges, retention, erasure, integrity."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Spark prunes "row_number <= n" per map task up to this n; above it a salted first pass does.
PRUNED_LIMIT = 1000
SALTS = 64


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins. ``max_by`` combines on the map side, so a hot key moves one row per task."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return last.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, ascending: bool = False) -> DataFrame:
    """The n newest rows of each key (or of the table when there are no keys)."""
    by = [F.col(c).asc() if ascending else F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*by).limit(n)
    if n > PRUNED_LIMIT:
        salt = F.pmod(F.xxhash64(*order), F.lit(SALTS))
        first = Window.partitionBy(*keys, "__salt").orderBy(*by)
        df = (
            df.withColumn("__salt", salt)
            .withColumn("__rn", F.row_number().over(first))
            .where(F.col("__rn") <= n)
            .drop("__salt", "__rn")
        )
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def retain_newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, floor: int) -> DataFrame:
    """Retention by count with a lower floor on the count."""
    return newest_rows(df, keys, order, max(floor, n))


def retain_age(df: DataFrame, keys: Sequence[str], clock: str, span: int) -> DataFrame:
    """Rows no older than ``span`` before the newest row of their key."""
    cut = df.groupBy(*keys).agg((F.max(clock) - F.lit(span)).alias("__cut"))
    return df.join(cut, list(keys)).where(F.col(clock) >= F.col("__cut")).drop("__cut")


def merge_keyed(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], order: str, rules: Mapping[str, str]
) -> DataFrame:
    """Upsert by key. Each column has a rule: first, last, min or max (by ``order``)."""
    both = base.unionByName(delta)
    pick = {
        "first": lambda c: F.min_by(c, order),
        "last": lambda c: F.max_by(c, order),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
    }
    merged = both.groupBy(*keys).agg(*[pick[rule](c).alias(c) for c, rule in rules.items()])
    return merged.select(*keys, *rules)


def insert_absent(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of delta whose key is new; of several, the first by ``order``."""
    rest = [c for c in delta.columns if c not in keys]
    first = delta.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    first = first.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*delta.columns)
    return first.join(base.select(*keys), list(keys), "left_anti")


def replace_children(children: DataFrame, delta: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Children of the parents present in delta are replaced by delta's rows."""
    touched = delta.select(*parent).distinct()
    return children.join(touched, list(parent), "left_anti").unionByName(delta)


def update_where_present(base: DataFrame, delta: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Overwrite columns of existing rows; delta rows without a base row are ignored.

    Of several delta rows of a key the last by ``order`` counts, then the one with the largest values.
    """
    new = latest_by_key(delta.select(*dict.fromkeys([*keys, *order, *columns])), keys, [*order, *columns])
    new = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = base.join(new, list(keys), "left")
    picked = [
        F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in base.columns
    ]
    return joined.select(*picked)


def cascade_retention(
    tables: Mapping[str, DataFrame], clocks: Mapping[str, str], cutoff, children: Mapping[str, tuple[str, str]]
) -> dict[str, DataFrame]:
    """Drop rows that are old by their table's own clock and, by id, the children of such rows.

    clocks maps a table to its clock column, children a table without one to its parent and the id column.
    Rows without a time stay.
    """
    out = {}
    for name, clock in clocks.items():
        out[name] = tables[name].where(~(F.col(clock) < cutoff) | F.col(clock).isNull())
    for name, (parent, id_column) in children.items():
        doomed = tables[parent].where(F.col(clocks[parent]) < cutoff).select(id_column).distinct()
        out[name] = tables[name].join(doomed, id_column, "left_anti")
    return out


def erase_devices(
    tables: Mapping[str, DataFrame],
    devices: DataFrame,
    episodes: str,
    summaries: str,
    by_summary: Sequence[str],
    by_episode: Sequence[str],
    by_device: Sequence[str],
) -> dict[str, DataFrame]:
    """Erase devices everywhere; ids are found through episodes and summaries first."""
    gone = devices.select("device_id").distinct()
    doomed_episodes = tables[episodes].join(gone, "device_id", "left_semi").select("episode_id").distinct()
    doomed_summaries = (
        tables[summaries].join(doomed_episodes, "episode_id", "left_semi").select("summary_id").distinct()
    )
    out = {}
    for name in by_summary:
        out[name] = tables[name].join(doomed_summaries, "summary_id", "left_anti")
    for name in by_episode:
        out[name] = tables[name].join(doomed_episodes, "episode_id", "left_anti")
    for name in by_device:
        out[name] = tables[name].join(gone, "device_id", "left_anti")
    return out


def conform(df: DataFrame, schema: StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Project onto a schema: cast what is there, add what is absent, fill nulls that have a default."""
    defaults = defaults or {}
    out = []
    for field in schema.fields:
        present = field.name in df.columns
        value = F.col(field.name).cast(field.dataType) if present else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)


def missing_columns(df: DataFrame, schema: StructType) -> list[str]:
    """Columns a migration to ``schema`` would add."""
    return [field.name for field in schema.fields if field.name not in df.columns]


def pseudonym(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit("dev-"), F.sha2(value, 256))


def category_token(salt: Column, category: Column) -> Column:
    """First 16 bytes, in hex, of the salted hash."""
    return F.substring(F.sha2(F.concat(salt, F.lit("|"), category), 256), 1, 32)


def encode_vector(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def decode_vector(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.try_cast("double"))


def encode_matrix(rows: Column) -> Column:
    return F.array_join(F.transform(rows, encode_vector), "|")


def decode_matrix(text: Column) -> Column:
    return F.transform(F.split(text, "\\|"), decode_vector)


def same_ids(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Ids on one side only, with the side; empty when the sets are equal."""
    a = left.select(F.col(column).alias("id")).distinct().withColumn("__l", F.lit(True))
    b = right.select(F.col(column).alias("id")).distinct().withColumn("__r", F.lit(True))
    both = a.join(b, "id", "full_outer").where(F.col("__l").isNull() | F.col("__r").isNull())
    return both.select("id", F.when(F.col("__r").isNull(), "left_only").otherwise("right_only").alias("side"))


def in_name_list(name: Column, csv: str) -> Column:
    """Case-folded membership in a comma-separated list."""
    names = [part.strip().lower() for part in csv.split(",") if part.strip()]
    return F.lower(F.trim(name)).isin(*names) if names else F.lit(False)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
