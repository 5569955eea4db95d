"""Contracts of tables as one-pass aggregates: rules, completeness, identities, one-to-one joins, comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expect(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows, failed, passed) of each rule; a null outcome fails. All rules share one pass."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return sums.select("rows", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed")) for n in rules]))).select(
        "rule", "rows", "failed", (F.col("failed") == 0).alias("passed"))


def completeness(table: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys expected, found once, missing, repeated, not expected, and whether the table is complete."""
    want = expected.select(*keys).distinct().withColumn("_want", F.lit(1))
    have = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    both = want.join(have, list(keys), "full")
    out = both.agg(F.count("_want").alias("expected"), F.count_if(F.col("_want").isNotNull() & (F.col("_rows") == 1)).alias("found_once"),
                   F.count_if(F.col("_rows").isNull()).alias("missing"), F.count_if(F.col("_rows") > 1).alias("repeated"), F.count_if(F.col("_want").isNull()).alias("unexpected"))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("unexpected") == 0))


def column_leaks(df: DataFrame, tokens: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(name, filled, forbidden) of each column: a name with a forbidden token, or of a target, leaks."""
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("name"), F.col(c).alias("filled"), F.lit(c in targets or any(t in c.lower() for t in tokens)).alias("forbidden")) for c in df.columns]
    return filled.select(F.inline(F.array(*rows)))


def identity_joined(rows: DataFrame, runs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` with the identity columns of their run, and whether the copies they carry agree with it."""
    ids = runs.select(key, *[F.col(c).alias(f"run_{c}") for c in columns])
    out = rows.join(ids, key, "left")
    same = [F.col(c).eqNullSafe(F.col(f"run_{c}")) for c in columns if c in rows.columns]
    return out.withColumn("identity_ok", reduce(lambda a, b: a & b, same, F.col(f"run_{columns[0]}").isNotNull()))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of tables that hold each key once; a repeated or unmatched key fails when its row is evaluated."""
    a = left.join(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")), list(keys))
    b = right.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), list(keys))
    both = a.join(b, list(keys), "full")
    bad = F.coalesce(F.col("_l") != 1, F.lit(True)) | F.coalesce(F.col("_r") != 1, F.lit(True))
    text = F.concat(F.lit("not one to one: "), F.to_json(F.struct(*keys)))
    return both.withColumn(keys[0], F.when(bad, F.raise_error(text)).otherwise(F.col(keys[0]))).drop("_l", "_r")


def model_tables(runs: DataFrame, key: str, features: Sequence[str], targets: Sequence[str], fold: Column) -> dict[str, DataFrame]:
    """Features, targets and splits of the same rows, each with a content-derived ``feature_id``."""
    base = runs.withColumn("feature_id", F.substring(F.sha2(F.concat_ws("|", F.lit("row"), F.col(key).cast("string")), 256), 1, 24))
    return {"features": base.select("feature_id", *features), "targets": base.select("feature_id", *targets), "splits": base.select("feature_id", key, fold.alias("fold"))}


def compared(rows: DataFrame, keys: Sequence[str], observed: str, model: str, reference: str) -> DataFrame:
    """Mean absolute and squared error of a model and a reference, their differences and the skill, per key."""
    e = lambda c: F.abs(F.col(c) - F.col(observed))
    s = lambda c: (F.col(c) - F.col(observed)) * (F.col(c) - F.col(observed))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(e(model)).alias("model_mae"), F.avg(e(reference)).alias("reference_mae"),
                                  F.sqrt(F.avg(s(model))).alias("model_rmse"), F.sqrt(F.avg(s(reference))).alias("reference_rmse"))
    return out.withColumns({"delta_mae": F.col("model_mae") - F.col("reference_mae"), "delta_rmse": F.col("model_rmse") - F.col("reference_rmse"),
                            "skill": F.when(F.col("reference_mae") > 0, 1 - F.col("model_mae") / F.col("reference_mae"))})


def fold_support(rows: DataFrame, fold: str, group: str) -> DataFrame:
    """Per fold: groups outside it that train for it, groups inside, and inside groups that no training row has.

    A group's training rows of a fold are all its rows less those inside, so no row is copied per fold.
    """
    inside = rows.groupBy(group, fold).agg(F.count(F.lit(1)).alias("_in"))
    total = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_all"))
    cells = inside.join(total, group).withColumn("_train", F.col("_all") - F.col("_in"))
    n = total.agg(F.count(F.lit(1)).alias("_groups"), F.sum("_all").alias("_rows"))
    out = cells.groupBy(fold).agg(F.count(F.lit(1)).alias("groups"), F.sum("_in").alias("rows"), F.count_if(F.col("_train") == 0).alias("unseen_groups"))
    return out.crossJoin(F.broadcast(n)).select(  # one row
        fold, "groups", "rows", "unseen_groups", (F.col("_rows") - F.col("rows")).alias("training_rows"), (F.col("_groups") - F.col("unseen_groups")).alias("training_groups"),
        (F.col("unseen_groups") == 0).alias("supported"))


def checkpoint_steps(total: Column, fractions: Sequence[float]) -> Column:
    """Sorted distinct steps at the given fractions of ``total``, each within 1 and ``total``."""
    steps = F.transform(F.lit([float(f) for f in fractions]), lambda f: F.least(total, F.greatest(F.lit(1), F.ceil(total * f))).cast("bigint"))
    return F.array_sort(F.array_distinct(steps))


def gap_clusters(numbers: Column, gap: int) -> Column:
    """1 + gaps above ``gap`` between neighbours of a sorted array."""
    ordered = F.sort_array(numbers)
    return F.aggregate(F.zip_with(F.slice(ordered, 1, F.size(ordered) - 1), F.slice(ordered, 2, F.size(ordered)), lambda a, b: b - a), F.lit(1), lambda n, g: n + (g > gap).cast("int"))


def prediction_integrity(records: DataFrame, target: Sequence[str], history_end: str, at: str, ranking: str, size: int, low: int, high: int, accessed: Column, blind: Column) -> DataFrame:
    """One row of counts over all predictions, in one pass over targets: repeated targets, rankings that are short, repeat or leave the range, history
    that reaches its target, missing values, and labels that were read although they were blind."""
    top = F.slice(ranking, 1, size)
    bad = (F.size(F.array_distinct(top)) != size) | F.exists(top, lambda v: v.isNull() | (v < low) | (v > high))
    flags = {"bad_rankings": F.coalesce(bad, F.lit(True)), "late_history": F.coalesce(F.col(history_end) >= F.col(at), F.lit(True)),
             "missing": F.col(at).isNull() | F.col(history_end).isNull() | F.col(ranking).isNull(), "blind_reads": accessed & blind}
    per = records.groupBy(*target).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    out = per.agg(F.sum("_n").alias("targets"), F.sum(F.col("_n") - 1).alias("repeated_targets"), *[F.sum(n).alias(n) for n in flags])
    counts = [F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in ("targets", "repeated_targets", *flags)]
    clean = F.lit(True)
    for n in ("repeated_targets", *flags):
        clean = clean & (F.coalesce(F.col(n), F.lit(0)) == 0)
    return out.select(*counts, F.when(clean, "PASS").otherwise("FAIL").alias("status"))
