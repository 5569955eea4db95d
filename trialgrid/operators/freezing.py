"""A configuration chosen on an earlier cohort, bound to a content id, and judged on a later cohort only through that id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.operators.ordered import top_rows


def choose(rows: DataFrame, keys: Sequence[str], config: str, score: str, cohort: str, earlier: str, larger_is_better: bool = True, ties: Sequence[Column] = ()) -> DataFrame:
    """(keys, config, score, rows, version): the configuration with the best mean score over the earlier cohort.

    Equal means (12 digits) go by `ties`, then by name. The version is a digest of what was chosen and of the evidence, so a stage that reads it knows
    whether its choice is still the one that was made.
    """
    own = rows.where(F.col(cohort) == earlier).groupBy(*keys, config).agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("rows"))
    rounded = F.round("score", 12)
    best = top_rows(own, keys, [rounded.desc() if larger_is_better else rounded.asc(), *ties, F.col(config).asc()], 1).drop("rank")
    evidence = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(earlier), F.col(config), F.col("rows").cast("string"), F.format_string("%.9f", F.col("score")))
    return best.select(*keys, config, "score", "rows", F.sha2(evidence, 256).alias("version"))


def frozen(rows: DataFrame, chosen: DataFrame, keys: Sequence[str], config: str, cohort: str, later: str) -> DataFrame:
    """The later cohort's rows of the chosen configuration, each with the version it was judged under; a key without a choice has none."""
    picked = chosen.select(*keys, config, "version")
    return rows.where(F.col(cohort) == later).join(F.broadcast(picked) if not keys else picked, [*keys, config])
