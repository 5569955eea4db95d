import random

from trialgrid.operators import walkforward as WF


def test_keys_ignore_the_target_and_the_future(spark):
    rng = random.Random(9)
    rows = [(1, i, i + 1, sorted(rng.sample(range(1, 46), 6))) for i in range(14)]

    def seeds(data):
        df = spark.createDataFrame([(*r, sum(1 << v for v in r[3])) for r in data], "s bigint, idx bigint, round_no bigint, numbers array<int>, mask bigint")
        return {(r["round_no"], r["strategy"]): r["seed"] for r in WF.evaluate_strategies(df, ["s"], "idx", 1, 4, 5).collect()}

    base = seeds(rows)
    changed = seeds([*rows[:10], (1, 10, 11, [1, 2, 3, 4, 5, 6]), *rows[11:]])
    assert len(base) == 9 * 3
    assert all(base[k] == changed[k] for k in base if k[0] <= 11)
    assert base[(12, "history-digest")] != changed[(12, "history-digest")]
    assert base[(12, "round")] == changed[(12, "round")]


def test_series_with_equal_rounds_stay_apart(spark):
    rng = random.Random(4)
    rows = [(s, i, i + 1, sorted(rng.sample(range(1, 46), 6))) for s in (1, 2) for i in range(12)]
    df = spark.createDataFrame([(*r, sum(1 << v for v in r[3])) for r in rows], "s bigint, idx bigint, round_no bigint, numbers array<int>, mask bigint")
    both = WF.evaluate_strategies(df, ["s"], "idx", 2, 4, 5)
    assert both.count() == 2 * 7 * 3
    alone = {tuple(r) for s in (1, 2) for r in WF.evaluate_strategies(df.where(f"s = {s}"), ["s"], "idx", 2, 4, 5).collect()}
    assert alone == {tuple(r) for r in both.collect()}
