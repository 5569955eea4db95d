"""Fold assignment and statistics fitted strictly outside a row's own fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.ordered import fits_a_task, quantiles, selected_quantiles


def other_folds(df: DataFrame, fold: str, folds: int, out: str = "eval_fold") -> DataFrame:
    """Each row once per fold it may train (all folds but its own)."""
    return df.withColumn(out, F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold)))).withColumn(
        out, F.col(out).cast("bigint"))


def out_of_fold_quantiles(df: DataFrame, keys: Sequence[str], fold: str, folds: int, value: str,
                          levels: Sequence[float], name: str = "q") -> DataFrame:
    """Quantiles of ``value`` per key for every evaluation fold, from the other folds only; keys are few (families)."""
    if not fits_a_task(df):
        return selected_quantiles(df, keys, value, levels, name, fold, folds)
    t = other_folds(df.select(*keys, fold, value), fold, folds)
    q = quantiles(t, [*keys, "eval_fold"], value, levels, name)
    return q.withColumnRenamed("eval_fold", fold)


def out_of_fold_sums(df: DataFrame, keys: Sequence[str], fold: str, sums: dict[str, Column]) -> DataFrame:
    """Training sums per (key, fold) = key total - fold share, so rows are never copied per fold."""
    names = list(sums)
    per = df.groupBy(*keys, fold).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return per.select(*keys, fold, *[(F.sum(n).over(w) - F.col(n)).alias(n) for n in names])


def modular_folds(df: DataFrame, keys: Sequence[str], order: Sequence[str], folds: int, name: str = "fold") -> DataFrame:
    """Running index inside a family modulo the fold count."""
    from trialgrid.operators.ordered import position
    return position(df, keys, order, "_i").withColumn(name, F.col("_i") % folds).drop("_i")


def dense_index_folds(df: DataFrame, family: str, folds: int, name: str = "family_fold") -> DataFrame:
    """Alphabetical index of the family modulo the fold count; families are pre-deduplicated."""
    from trialgrid.operators.ordered import position
    fam = position(df.select(family).distinct().withColumn("_g", F.lit(0)).withColumn(
        "_o", F.col(family)), ["_g"], ["_o"], "_i")
    return df.join(fam.select(family, (F.col("_i") % folds).alias(name)), family)
