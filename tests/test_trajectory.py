"""Trajectories that stand still."""

from trialgrid.operators import runs as RU


def test_constant_trajectory_has_no_autocorrelation(spark):
    rows = [(1, s, 100, s / 100, 2.5, 0.0) for s in range(1, 6)] + [(2, s, 100, s / 100, float(s), 0.0) for s in range(1, 6)]
    t = spark.createDataFrame(rows, "run_id long, step long, steps long, fraction double, objective double, failure_signal double")
    got = {r["run_id"]: round(r["autocorrelation"], 9) for r in RU.trajectory_features(t, [0.05]).collect()}
    assert got == {1: 0.0, 2: 1.0}
