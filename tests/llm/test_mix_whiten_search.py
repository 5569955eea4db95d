"""Source mixing, whitening and lexical search against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgrid.llm import lexical_search, mixing, queries, whitening

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size string, key string, words string, terms string, item_id string"


def docs_of(spark, rows):
    """(doc_id, text, source) rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "9", "k", "w", "t", "i") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(120)]
    out = []
    for i in range(160):
        source = r.choice(["hot", "hot", "hot", "b", "a", "Z", "é", None, ""])
        out.append((i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))), source))
    out += [(200 + k, out[3][1], "hot") for k in range(30)]  # copies: ties
    out += [(300, None, "b"), (301, "", "nothing"), (302, None, "nothing"), (303, "x " * 20_000, "long"), (304, "Ab-CD_ef\x00gh É1", "b"), (None, "null id here", "b"), (None, "null id here", "b"),
            (5, out[5][1], out[5][2]), (2**60 + 1, "large number", "a")]
    return out


# ------------------------------------------------------------------ mixing

def fair_targets(sizes):
    """Targets by resharing what capped sources leave, in exact fractions."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, pace = total - sum(3 * sizes[s] for s in capped), sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in order if s not in capped and Fraction(rest * weight[s], pace) > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else rest * weight[s] / pace for s in order}
        capped |= over


def test_mix(spark, rows):
    mixed, placed = mixing.mix(docs_of(spark, rows))
    got = mixing.taken(mixed, placed).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = fair_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    by_size = {v: s for s, v in sizes.items()}
    took = Counter()
    for r in got:
        s = by_size[r["source_size"]]
        assert math.isclose(r["target"], want[s], rel_tol=1e-12, abs_tol=1e-9) and 0 <= r["taken"] <= 3 * r["size"]
        took[s] += r["taken"]
    assert sum(took.values()) == sum(sizes.values())
    assert all(abs(took[s] - want[s]) <= 1 + len(sizes) for s in sizes)
    again = mixing.taken(*mixing.mix(docs_of(spark, rows).repartition(7))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    # the mix itself: places are gapless in order of finish time, and every prefix is close to the weights
    order = mixed.orderBy("place").collect()
    at, finish = 0, -1.0
    for r in order:
        assert r["place"] == at and r["finish"] >= finish
        at, finish = at + r["words"], r["finish"]
    assert at == sum(sizes.values())


def test_mix_of_nothing(spark):
    for rows in ([], [(1, None, "a"), (2, "", None)]):
        got = mixing.taken(*mixing.mix(docs_of(spark, rows))).collect()
        assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == [(i, 0, 0, 0.0, 0) for i, _, _ in rows]


# ------------------------------------------------------------------ whitening

def test_inertia_counts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 12):
        a = rng.standard_normal((n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in rng.uniform(-3, 3, 20):
            assert whitening.above(a, shift) == (values > shift).sum()
        f = whitening.factored(a)
        b = rng.standard_normal(n)
        assert np.allclose(a @ f.solve(b, 1e-300), b)
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # a pivot of two rows


def test_leading_values_and_spaces():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    for values in (np.arange(1.0, 21), np.array([3.0] * 5 + [2.0] * 4 + [1.0] + [0.0] * 10), np.array([1.0] * 20), np.array([1e9, 1.0, 1e-3] + [0.0] * 17)):
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        e, x = whitening.leading(v, 16)
        want = np.sort(values[values > 1e-14 * values.sum()])[::-1][:16]
        assert np.allclose(e, want, rtol=1e-9, atol=1e-12 * values.sum()) and np.allclose(x.T @ x, np.eye(len(e)), atol=1e-8)
        assert np.abs(v @ x - x * e).max() < 1e-13 * values.sum()
    assert len(whitening.leading(np.zeros((4, 4)), 16)[0]) == 0


VECTORS = "vec_id long, embedding array<float>, n string, component string"


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((300, 20)) * np.linspace(1, 3, 20)).astype(np.float32)
    rows = [(i, [float(x) for x in v], "n", "c") for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1], "n", "c") for i in range(200)]  # copies count once in the fit list
    rows += [(None, rows[1][1], "n", "c"), (7, None, "n", "c"), (8, [], "n", "c"), (9, [1.0] * 19 + [None], "n", "c"), (10, [float("nan")] * 20, "n", "c"), (11, [float("inf")] + [0.0] * 19, "n", "c"),
             (12, [1.0], "n", "c"), (2**60 + 1, rows[2][1], "n", "c")]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    kept = [r for r in rows if r[1] and len(r[1]) == 20 and all(x is not None and math.isfinite(x) for x in r[1])]
    assert len(got) == 16 * len(kept)
    x = {tuple(math.floor(64 * c) + 1_000_000 for c in r[1]) for r in kept}
    n, s = len(x), [sum(v[i] for v in x) for i in range(20)]
    z = np.array([[float(Fraction(n * v[i] - s[i], n)) for i in range(20)] for v in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    trace = np.trace(z.T @ z / n)
    by_row = defaultdict(dict)
    for r in got:
        by_row[r["vec_id"]][r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-9 and math.isclose(r["explained"], e[r["component"] - 1] / trace, rel_tol=1e-9)
    signs = {}
    for i, v, *_ in kept:
        whole = [math.floor(64 * c) + 1_000_000 for c in v]
        c = np.array([float(Fraction(n * whole[k] - s[k], n)) for k in range(20)]) @ u / np.sqrt(e)
        for k in range(1, 17):
            r = by_row[i][k]
            assert r["deviation"] == sum((n * whole[j] - s[j]) ** 2 for j in range(20))
            sign = signs.setdefault(k, np.sign(r["whitened"] * c[k - 1]))
            assert math.isclose(r["whitened"], sign * c[k - 1], abs_tol=1e-9)


def test_whitening_without_spread(spark):
    for rows in ([], [(1, None, "", "")], [(1, [0.5, 0.25], "", ""), (2, [0.5, 0.25], "", "")]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    line = [(i, [float(i), float(2 * i)], "", "") for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(line, VECTORS)).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    wide = [(i, [float(3e7 * (-1) ** i), float(i)], "", "") for i in range(4)]  # (n * x - S)^2 is above the range of long
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame(wide, VECTORS)).collect()} == {None}


# ------------------------------------------------------------------ search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERMS.findall(text or "")]


def brute_search(docs, items, top):
    lists = [(i, terms(t)) for i, t, *_ in docs]
    n_docs, length = sum(bool(w) for _, w in lists), sum(len(w) for _, w in lists)
    df = Counter(t for _, w in lists for t in set(w))
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = {}
    for item, words in asked.items():
        found = []
        for i, w in lists:
            c, m = Counter(w), 50 + (50 * len(w) * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out[item] = [(k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top])]
    return {k: v for k, v in out.items() if v}


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "item_id long, text string, doc_id int, score double")


@pytest.fixture(scope="module")
def asked(rows):
    r = random.Random(8)
    texts = [t for _, t, _ in rows if t]
    out = [(k, " ".join(w for w in r.choice(texts).split()[:40] if r.random() < 0.6)) for k in range(40)]
    return out + [(50, None), (51, ""), (52, "--- !"), (None, "null id"), (53, "absent1 absent2"), (54, rows[3][1]), (54, "more words ab"), (55, "É1 é1 GH x")]


@pytest.mark.parametrize("top", [3, 50])
def test_search(spark, rows, asked, top):
    got = lexical_search.search(docs_of(spark, rows).repartition(3), items_of(spark, asked), top).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    assert dict(found) == brute_search(rows, asked, top)


def test_search_in_blocks_with_sampled_thresholds(spark, rows, asked, monkeypatch):
    monkeypatch.setattr(lexical_search, "TERMS", 60)  # several blocks of items
    monkeypatch.setattr(lexical_search, "SAMPLE", 40)  # scores to beat come from a part of the documents
    monkeypatch.setattr(lexical_search, "CELLS", 2000)  # many parts a batch
    got = lexical_search.search(docs_of(spark, rows), items_of(spark, asked), 5).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    assert dict(found) == brute_search(rows, asked, 5)


def test_whole_batches_are_left_unscored():
    """Documents of other words than an item's are never scored once enough good ones are known."""
    rng = np.random.default_rng(5)
    sizes, n = 400, 4096
    block = lexical_search.Block(list(range(32)), [rng.choice(sizes, 12, replace=False) for _ in range(32)], np.full(sizes, 1000), n, n * 20).grow()
    dense = np.zeros((sizes, n), np.int64)
    for d in range(n):  # documents of a cluster share their words
        words = (d // 128 * 12 + rng.integers(0, 12, 8)) % sizes
        dense[words, d] = rng.integers(1, 1000, 8)
    best, seen = lexical_search.Best(block, 5, np.zeros(32, np.int64)), Counter()
    for a in range(0, n, 1024):
        lexical_search.search_part(block, best, np.arange(a, a + 1024), dense[:, a:a + 1024], seen)
    for k, t in enumerate(block.terms):
        scores = dense[t].sum(0)
        want = sorted(((-s, d) for d, s in enumerate(scores) if s > 0))[:5]
        assert sorted(zip((-best.scores[k]).tolist(), best.docs[k].tolist())) == want
    assert seen["scored"] < 0.6 * 32 * n


def test_search_of_nothing(spark, rows, asked):
    assert lexical_search.search(docs_of(spark, []), items_of(spark, asked)).count() == 0
    assert lexical_search.search(docs_of(spark, rows), items_of(spark, [])).count() == 0


def test_registered(spark):
    assert {"op11_source_mix", "op12_embedding_whitening", "op13_lexical_search"} <= set(queries.QUERIES)
    assert {"op11_source_mix", "op13_lexical_search"} <= set(queries.ORACLE)
    got = queries.QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001")
    assert got.count() == 16 * 500 and got.agg(F.max("identity_error")).first()[0] < 1e-9
