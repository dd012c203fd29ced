"""Every driver query against its SQL twin, and the heavy-key plans against the same SQL."""

import pytest

import __spark_entry__ as entry
from pulsefleet import plans
from tests import compare

QUERIES, ORACLES = plans.QUERIES, plans.ORACLES
ORDERED = [
    "e1_window_features", "e2_future_labels", "e4_rolling_means", "e5_deviation_scores", "e7_counter_rates", "e8_rolling_p95",
    "e9_adaptive_baseline", "e10_latency_ewma", "e11_episode_building", "e12_context_episodes", "e13_focus_duration",
    "e14_recent_apps", "e15_alert_hysteresis", "e16_action_cooldown", "e17_action_budget", "e18_adaptive_sampling",
    "e19_budget_governor", "e20_change_or_every", "b12_replay_filter", "c12_asof_with_ttl", "c13_asof_reuse",
    "d11_distribution_summary", "d18_auroc", "d19_auprc", "d42_conformal_sets",
]


@pytest.fixture(scope="module")
def duck(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    got = compare.spark_rows(QUERIES[name](spark, data))
    assert compare.difference(got, compare.sql_rows(duck, ORACLES[name])) is None


@pytest.mark.parametrize("name", ORDERED)
def test_heavy_key_plan_equals_sql(spark, data, duck, small_segments, name):
    got = compare.spark_rows(QUERIES[name](spark, data))
    assert compare.difference(got, compare.sql_rows(duck, ORACLES[name])) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
