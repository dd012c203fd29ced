"""Streams whose files come in any order: the windows are those of the sorted rows, late rows are in quarantine."""

import os

import pytest

from pulsefleet.streaming import event_order as E
from pulsefleet.streaming import stream as K

MINUTE = 60_000_000
SCHEMA = "device_id long, t long, seq long, v double"


def write(spark, folder, batches):
    """A file per batch, with file times in the order of the list."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/raw-{i}")
        name = next(f for f in os.listdir(f"{folder}/raw-{i}") if f.startswith("part"))
        os.replace(f"{folder}/raw-{i}/{name}", f"{folder}/batch-{i}.parquet")
        os.utime(f"{folder}/batch-{i}.parquet", (10**9 + i, 10**9 + i))


def run(spark, tmp_path, batches, lateness, name="a", **options):
    folder = f"{tmp_path}/{name}"
    write(spark, folder, batches)
    source = K.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    rows = E.in_event_order(source, ["device_id"], ["t", "seq"], K.window_kernel(["v"], 3), "v_window array<double>", lateness, **options)
    E.store_in_order(rows, f"{folder}/out", f"{folder}/cp").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def samples(devices=3, n=30):
    return [(d, i * MINUTE, 100 * d + i, float(i)) for i in range(n) for d in range(devices)]


def windows(rows):
    return sorted((r.device_id, r.seq, tuple(r.v_window)) for r in rows.where("not late and v_window is not null").collect())


END = [(None, 10**6 * MINUTE, 0, 0.0)]


@pytest.mark.parametrize("turned", [False, True])
def test_any_order_of_files_gives_the_windows_of_the_sorted_rows(spark, tmp_path, turned):
    rows = samples()
    batches = [rows[i : i + 15] for i in range(0, len(rows), 15)]
    got = run(spark, tmp_path, [*(reversed(batches) if turned else batches), END], "1 hour")
    want = sorted((d, 100 * d + i, (float(i - 2), float(i - 1), float(i))) for d in range(3) for i in range(2, 30))
    assert windows(got) == want
    assert got.where("late").count() == 0 and got.count() == 90


def test_rows_behind_the_watermark_are_quarantined_and_counted(spark, tmp_path):
    rows = samples(devices=2)
    late = [r for r in rows if r[1] in (3 * MINUTE, 4 * MINUTE)]
    early = [r for r in rows if r not in late]
    got = run(spark, tmp_path, [early, [(9, 2 * 24 * 60 * MINUTE, 1, 0.0)], late, END], "10 minutes")
    quarantine = sorted((r.device_id, r.t, r.seq) for r in E.quarantined(got, ["t", "seq"]).collect())
    assert quarantine == sorted((d, t, s) for d, t, s, _ in late)
    kept = [i for i in range(30) if i not in (3, 4)]
    want = sorted((d, 100 * d + kept[k], tuple(float(x) for x in kept[k - 2 : k + 1])) for d in range(2) for k in range(2, len(kept)))
    assert windows(got) == want


def test_a_silent_key_is_closed_once_and_starts_anew(spark, tmp_path):
    first = [(1, i * MINUTE, i, 1.0) for i in range(4)]
    later = [(1, 10_000 * MINUTE + i * MINUTE, 100 + i, 2.0) for i in range(3)]
    closed = lambda state: {"v_window": [-1.0, *state[0]]}
    got = run(spark, tmp_path, [first, [(2, 5_000 * MINUTE, 1, 0.0)], later, END], "1 minute", idle_ms=3_600_000, close=closed)
    ends = sorted((r.device_id, r.t, tuple(r.v_window)) for r in got.where("v_window[0] = -1").collect())
    assert ends == [(1, 3 * MINUTE, (-1.0, 1.0, 1.0)), (1, 10_002 * MINUTE, (-1.0, 2.0, 2.0)), (2, 5_000 * MINUTE, (-1.0, 0.0))]
    # The window after the silence does not reach back over it.
    assert [w for _, s, w in windows(got.where("v_window[0] <> -1")) if s >= 100] == [(2.0, 2.0, 2.0)]
