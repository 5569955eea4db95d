"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and strength of learned lexicon words, nearness of second-person words to them, capitals,
punctuation, and words that hide letters behind digits or signs. The lexicon is learned from labelled texts: word starts
of four to six letters and whole words that toxic texts hold more often, which also covers inflected forms. Features for
training come from the lexicon of the other half of the labelled rows, so the trees see weights as they are on new texts.

Labelled rows are taken in hash order up to `max_labelled` (the bound of all that is fitted on the driver or broadcast);
every text is scored whole. Null and empty texts have zero features and get the score these lead to. Null labels are
ignored, repeated labels of one id count as their maximum, repeated texts score alike. Without labels of both kinds the
score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import fold_of, whole_text, written

#: Fixed word list: second-person words of the corpus languages.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
#: Fixed table: signs that stand for letters.
SIGNS = str.maketrans("013457@$!|", "oleastasil")
STARTS = (4, 5, 6)
NAMES = ("n_words", "hit_share", "strong_share", "strength", "top", "second_top", "distinct_strong", "you_share", "near_you", "capitals", "shouted",
         "exclaims", "questions", "other_signs", "hidden_share", "hidden_hits")
FEATURES = "doc_id bigint, features array<double>"


def core(token: str) -> str:
    return token.strip(string.punctuation + "«»“”„‘’…¿¡")


def shown(word: str) -> str:
    """A word with its disguised letters."""
    return word if word.isalpha() else "".join(c for c in word.translate(SIGNS) if c.isalpha())


def stems(word: str) -> list[str]:
    return [word[:n] for n in STARTS if len(word) >= n] + ["=" + word]


class Lexicon(dict):
    """Raw token -> its row in `cells`: weight, second person, disguised."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.cells = weights, []

    def __missing__(self, token: str) -> int:
        plain = core(token)
        word = shown(plain)
        hidden = bool(word) and word != plain and any(c.isalpha() for c in plain) and not plain.replace("-", "").replace("'", "").isalpha()
        weight = max((self.weights.get(s, 0.0) for s in stems(word)), default=0.0) if word else 0.0
        self[token] = len(self.cells)
        self.cells.append((weight, plain in YOU, hidden))
        return self[token]

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        if not tokens:
            return [0.0] * len(NAMES)
        rows = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        seen, back = np.unique(rows, return_inverse=True)
        cells = np.array([self.cells[i] for i in seen], dtype=float)
        weight, you, hidden = cells[back].T
        n, strong = len(tokens), weight >= 3.0
        at, yours = np.flatnonzero(weight > 0), np.flatnonzero(you)
        near = 0.0
        if len(at) and len(yours):
            k = np.searchsorted(yours, at)
            gap = np.minimum(np.abs(at - yours[np.minimum(k, len(yours) - 1)]), np.abs(at - yours[np.maximum(k - 1, 0)]))
            near = float(np.mean(gap <= 4))
        tops = sorted(cells[:, 0][cells[:, 0] > 0], reverse=True)[:2]
        size = len(text)
        sign = {c: text.count(c) for c in "!?"}
        ascii_text = text.encode()
        capitals = size and (len(ascii_text) - len(ascii_text.translate(None, string.ascii_uppercase.encode()))) / size
        others = (len(ascii_text) - len(ascii_text.translate(None, string.punctuation.encode())) - sum(sign.values())) / size
        if len(self) > 400_000:
            self.clear()
            self.cells.clear()
        return [math.log1p(n), len(at) / n, float(strong.sum()) / n, float(weight.sum()) / math.sqrt(n), tops[0] if tops else 0.0,
                tops[1] if len(tops) > 1 else 0.0, math.log1p(int((cells[:, 0] >= 3.0).sum())), len(yours) / n, near, capitals,
                len(re.findall(r"\b[A-Z]{3,}\b", text)) / n, sign["!"] / n, sign["?"] / n, others, float(hidden.mean()), float((hidden * (weight > 0)).sum()) / n]


def featured(texts: DataFrame, weights: list[dict[str, float]]) -> DataFrame:
    """`texts` has doc_id, text and half, the place of the lexicon in `weights`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(w) for w in weights]
        for batch in batches:  # ids stay in Arrow: pandas has no whole numbers beside nulls
            features = [lexicons[h].features(t) for h, t in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "half").mapInArrow(run, FEATURES)


def learn_lexicon(rows: DataFrame, counts: dict[tuple[int, int], int], least: int, entries: int) -> list[dict[str, float]]:
    """Weights (log odds) of word starts from labelled rows of half 0, half 1 and both.

    Candidates are counted over the toxic rows; clean rows are then counted for the candidates only."""
    def counted(keep: set[str] | None):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: list[Counter] = [Counter(), Counter()]
            for f in frames:
                for half, text in zip(f["half"], f["text"]):
                    these = {s for t in set(text.lower().split()) for s in stems(shown(core(t))) if len(s) > 2}
                    found[half].update(these if keep is None else these & keep)
            yield pd.DataFrame([(s, h, n) for h in (0, 1) for s, n in found[h].items()], columns=["stem", "half", "n"])

        return run

    def totals(label: int, keep: set[str] | None) -> DataFrame:
        return rows.where(F.col("toxic") == label).select("text", "half").mapInPandas(counted(keep), "stem string, half int, n bigint").groupBy("stem").agg(
            *[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)])

    top = totals(1, None).where(F.col("n0") + F.col("n1") >= least).orderBy(F.desc(F.col("n0") + F.col("n1")), "stem").limit(20 * entries)
    bad = {r["stem"]: (r["n0"], r["n1"]) for r in top.collect()}
    good = {r["stem"]: (r["n0"], r["n1"]) for r in totals(0, set(bad)).collect()}
    out = []
    for halves in ((0,), (1,), (0, 1)):
        n1, n0 = (sum(counts.get((h, label), 0) for h in halves) for label in (1, 0))
        weight = {}
        for stem, found in bad.items():
            a, b = (sum(x[h] for h in halves) for x in (found, good.get(stem, (0, 0))))
            odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
            if a >= 2 and odds > 1.0:
                weight[stem] = odds
        best = sorted(weight, key=lambda s: (-weight[s], s))[:entries]
        out.append({s: weight[s] for s in best})
    return out


@dataclass
class Model:
    prior: float
    weights: dict[str, float]
    trees: object = None
    calibration: object = None
    trust: float = 1.0  # with few toxic labels scores are drawn towards the base rate


def raw_scores(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, trees: int = 30, depth: int = 3, entries: int = 4_000, folds: int = 3,
        held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labels whose id falls in another fold than `held_out`."""
    marked = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held_out))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    # at most max_labelled short rows: bounded, so the texts need no shuffle
    marked = F.broadcast(marked.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).join(marked, F.col("doc_id") == F.col("label_id"))
    rows = written(rows.select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")), "labelled")
    counts = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    n = sum(counts.values())
    toxic = sum(c for (_, label), c in counts.items() if label == 1)
    if not toxic or toxic == n:
        return Model(toxic / n if n else 0.0, {})
    weights = learn_lexicon(rows, counts, 3, entries)
    # a row's features come from the other half's lexicon
    crossed = featured(rows.withColumn("half", 1 - F.col("half")), weights[:2]).join(F.broadcast(marked), F.col("doc_id") == F.col("label_id"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4))
    data = written(crossed.select("doc_id", "features", F.col("toxic").cast("double").alias("label"), part.alias("part")), "features")
    data = data.select("doc_id", array_to_vector("features").alias("features"), "label", "part").coalesce(6).persist()
    has_both = data.where("part > 0").select("label").distinct().count() == 2 and data.where("part = 0").select("label").distinct().count() == 2
    train = data.where("part > 0") if has_both else data
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, minInstancesPerNode=2, maxBins=32, cacheNodeIds=False).fit(train)
    held = raw_scores(model, data.where("part = 0") if has_both else data)
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(held)
    data.unpersist()
    return Model(toxic / n, weights[2], model, calibration, toxic / (toxic + 10))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, whole texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.lit(0).alias("half"))
    if model.trees is None:
        return rows.select("doc_id", F.lit(float(model.prior)).alias("score"))
    found = featured(rows, [model.weights])
    raw = raw_scores(model.trees, found.select("doc_id", array_to_vector("features").alias("features")))
    calibrated = model.calibration.transform(raw.drop("features"))
    # the calibrated value has steps; a little of the raw one keeps the order inside a step
    value = 0.98 * F.col("prediction") + 0.02 * F.col("raw")
    value = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return calibrated.select("doc_id", (model.trust * value + (1 - model.trust) * model.prior).alias("score"))


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    scored = score(docs, fit(docs, labels, **options))
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows that are not predicted toxic, with all columns; a row with a null id stays."""
    gone = score(docs, fit(docs, labels)).where(F.col("score") >= threshold).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(written(gone, "toxic"), F.col("doc_id") == F.col("__gone"), "left_anti")
