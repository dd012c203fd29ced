"""Maintenance of partitioned tables: right rows, and files of untouched partitions stay."""

import datetime as dt
import os

import pytest

from pulsefleet.operators import tables as K
from pulsefleet.sources import partitions as P

DAY = 86_400_000_000
SCHEMA = "device long, t long, v string"


def rows(spark):
    data = [(d, day * DAY + 3_600_000_000 * d, f"{d}-{day}") for d in range(40) for day in range(6)]
    data += [(None, 0, "no key"), (7, None, "no time"), (None, None, "nothing"), (3, 0, "again"), (3, 0, "again")]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def stored(spark, tmp_path):
    return P.create(rows(spark), f"{tmp_path}/table", "device", "t", buckets=16)


def files(table):
    out = {}
    for where, _, names in os.walk(table.path):
        for name in names:
            if name.endswith(".parquet"):
                out.setdefault(os.path.relpath(where, table.path), set()).add((name, os.stat(f"{where}/{name}").st_mtime_ns))
    return out


def folder(part):
    return f"{P.BUCKET}={part[0]}/{P.PERIOD}={part[1] or '__HIVE_DEFAULT_PARTITION__'}"


def same_rows(a, b):
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)


def untouched_stay(before, after, touched):
    touched = {folder(p) for p in touched}
    assert touched and {k: v for k, v in before.items() if k not in touched} == {k: v for k, v in after.items() if k not in touched}
    assert set(before) - touched  # there is something that must stay
    assert all(before.get(k) != after.get(k) for k in touched)


def test_replace_children(spark, stored):
    delta = spark.createDataFrame([(3, 2 * DAY, "new"), (99, 40 * DAY, "first"), (None, 1, "null key")], SCHEMA)
    want = rows(spark).where("device is not null and device <> 3").unionByName(delta)
    before = files(stored)
    touched = P.replace_children(spark, stored, delta)
    untouched_stay(before, files(stored), touched)
    same_rows(stored.read(spark), want)
    P.replace_children(spark, stored, delta)
    same_rows(stored.read(spark), want)


def test_untouched_partitions_of_a_touched_bucket_stay(spark, tmp_path):
    table = P.create(rows(spark), f"{tmp_path}/one", "device", "t", buckets=1)
    before = files(table)
    touched = P.erase_keys(spark, table, spark.createDataFrame([(None,)], "device long"))
    assert touched == [(0, None), (0, dt.date(1970, 1, 1))] or touched == [(0, dt.date(1970, 1, 1)), (0, None)]
    untouched_stay(before, files(table), touched)
    same_rows(table.read(spark), rows(spark).where("device is not null"))


def test_erased_keys_leave_no_empty_partition(spark, stored):
    keys = spark.createDataFrame([(d,) for d in range(0, 40)] + [(None,)], "device long")
    few = keys.where("device in (5, 6)")
    before = files(stored)
    touched = P.erase_keys(spark, stored, few)
    untouched_stay(before, files(stored), touched)
    same_rows(stored.read(spark), rows(spark).where("device is null or device not in (5, 6)"))
    P.erase_keys(spark, stored, keys)
    assert stored.read(spark).count() == 0 and not files(stored) and not P.partitions(spark, stored)
    assert P.erase_keys(spark, stored, keys) == [] and P.drop_old(spark, stored, DAY) == []


def test_drop_before_cuts_within_a_period(spark, stored):
    before = files(stored)
    cut = dt.datetime(1970, 1, 3, 5, 0)
    touched = P.drop_before(spark, stored, cut)
    untouched_stay(before, files(stored), touched)
    micros = 2 * DAY + 5 * 3_600_000_000
    same_rows(stored.read(spark), rows(spark).where(f"t >= {micros} or t is null"))
    assert P.drop_before(spark, stored, cut) == []


def test_drop_old_is_by_key(spark, stored):
    extra = spark.createDataFrame([(1, 50 * DAY, "new")], SCHEMA)
    P.replace_children(spark, stored, rows(spark).where("device = 1").unionByName(extra))
    all_rows = rows(spark).unionByName(extra)
    before = files(stored)
    touched = P.drop_old(spark, stored, 3 * DAY)
    untouched_stay(before, files(stored), touched)
    want = K.retain_age(all_rows.where("device is not null"), ["device"], "t", 3 * DAY)
    same_rows(stored.read(spark), want.select("device", "t", "v").unionByName(all_rows.where("device is null or t is null")))


def test_clash_with_layout(spark, tmp_path):
    with pytest.raises(ValueError, match="key_bucket"):
        P.create(spark.range(3).withColumn(P.BUCKET, P.F.lit(1)), f"{tmp_path}/x", "id")


def test_empty_table_and_no_clock(spark, tmp_path):
    table = P.create(spark.createDataFrame([], SCHEMA), f"{tmp_path}/empty", "device")
    assert table.read(spark).count() == 0
    delta = spark.createDataFrame([(1, 1, "a")], SCHEMA)
    assert len(P.replace_children(spark, table, delta)) == 1
    same_rows(table.read(spark), delta)
