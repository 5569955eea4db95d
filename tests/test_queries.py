"""Registered queries against their SQL on the smallest data folder (a spread of areas; compare.py runs all)."""

import pytest

from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = ["hit_distribution_by_round", "draw_validity", "rank_features", "shape_transition", "basin_summary", "channel_fields", "paired_runs",
         "run_audit", "fold_statistics", "trajectory_features", "quality_metrics_by_scope", "ranking_metrics", "survival_metrics", "beta_pooling",
         "selections", "sensitivity", "mutual_information", "recurrence", "two_group_comparison", "followup_confidence", "append_log_runs", "prediction_gate",
         "field_forecasts", "rank_forecast", "overlap_matrix", "sign_flip_test", "oof_completeness", "model_frame", "reference_comparison", "benchmark_check", "strategy_evaluation", "hypergeometric_null"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    import __spark_entry__ as entry

    assert compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name]).startswith("ok")


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_loads_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], timeout=60).returncode == 0
