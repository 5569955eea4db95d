"""Scores of retrieved follow-ups stay one row a target: nothing of 45 rows a target is broadcast."""

import math

from trialgrid.operators import retrieval as RT

SF = "/root/testdata/sf0.001"


def test_no_table_of_votes_is_broadcast(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    for name in ("candidate_scores", "broad_retrieval", "candidate_funnel", "best_combinations"):
        plan = queries[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan, name


def test_votes_of_one_target(spark):
    rows = [(1, 7, 0.5, [1, 2, 3, 4, 5, 45], 20.0, 21.0), (1, 7, 0.25, [1, 10, 20, 30, 40, 44], 22.0, 21.0)]
    m = spark.createDataFrame(rows, "k long, label long, similarity double, followup array<int>, past_mean double, current_mean double")
    got = RT.candidate_scores(m, ["k"], ["label"]).first()
    vote = lambda f: [sum(s * f(i, fu, p, c) for _, _, s, fu, p, c in rows) for i in range(1, 46)]
    norm = lambda v: [(x - min(v)) / (max(v) - min(v)) for x in v]
    steps = lambda i, v: abs((i - 1) // 7 - (v - 1) // 7) + abs((i - 1) % 7 - (v - 1) % 7)
    turn = lambda i, v: min(abs(i - v), 45 - abs(i - v)) * 2 * math.pi / 45
    want = {"exact": norm(vote(lambda i, fu, p, c: i in fu)), "grid": norm(vote(lambda i, fu, p, c: sum(math.exp(-steps(i, v) / 2) for v in fu))),
            "circle": norm(vote(lambda i, fu, p, c: sum(math.exp(-turn(i, v) / 0.65) for v in fu))),
            "band": norm(vote(lambda i, fu, p, c: sum(math.exp(-abs(i - v) / 8) for v in fu))),
            "transition": norm(vote(lambda i, fu, p, c: math.exp(-abs(i - (c + sum(fu) / 6 - p)) / 9)))}
    for name, values in want.items():
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[name], values)), name
    agree = [sum(want[n][i] >= 0.7 for n in want) / 5 for i in range(45)]
    score = [(sum(want[n][i] for n in want) + 2 * agree[i]) / 7 for i in range(45)]
    assert got["label"] == 7 and got["ranking"] == sorted(range(1, 46), key=lambda i: (-round(score[i - 1], 9), i))


def test_best_combinations_against_a_full_sort(spark):
    from itertools import combinations

    score = [round(((i * 37) % 11) / 11, 3) for i in range(45)]  # many ties
    ranking = sorted(range(1, 46), key=lambda i: (-score[i - 1], i))
    sets = sorted(combinations(range(20), 6), key=lambda c: -round(sum(score[ranking[j] - 1] for j in c), 9))
    rows, want = [], {}
    for k, drawn in enumerate([ranking[:6], ranking[3:15:2], ranking[14:20], ranking[20:26], [*ranking[17:20], *ranking[30:33]]]):
        rows.append((k, ranking, score, sum(1 << i for i in drawn)))
        hits = [sum(ranking[j] in drawn for j in c) for c in sets[:10000]]
        want[k] = tuple(max(hits[:b]) for b in (100, 1000, 10000))
    df = spark.createDataFrame(rows, "k long, ranking array<bigint>, score array<double>, mask long")
    got = {r["k"]: (r["best_100"], r["best_1000"], r["best_10000"]) for r in RT.best_combinations(df, ["k"], "mask").collect()}
    assert got == want
