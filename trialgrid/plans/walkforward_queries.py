"""Walk-forward strategy evaluation over the draw series."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialgrid.functions.exprs import r6
from trialgrid.operators import walkforward as WF
from trialgrid.plans.registry import query
from trialgrid.plans.search_queries import MAE, NUMS, generator_sql
from trialgrid.plans.views import ODRAWS, R, ordered_draws, with_

VARIANTS, WINDOW, HISTORY = 4, 16, 8

_FREQ = "list_transform(range(1, 46), lambda v: len(list_filter(flatten(list_transform(past, lambda p: p.numbers)), lambda n: n = v)))"
_STATES = f"""wh AS (SELECT series_id, round_no, mask, numbers, past FROM (SELECT *, list({{'round_no': round_no, 'numbers': numbers}}) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS past
 FROM odraws) WHERE idx >= {HISTORY}),
ws AS (SELECT *, 'round' AS strategy, '' AS state FROM wh UNION ALL
 SELECT *, 'history-digest', sha256('[' || array_to_string(list_transform(past, lambda p: '{{"round_no":' || p.round_no || ',"numbers":[' || array_to_string(p.numbers, ',') || ']}}'), ',') || ']') FROM wh UNION ALL
 SELECT *, 'rolling-mix', sha256('{{"f":[' || array_to_string({_FREQ}, ',') || '],"s":[' || array_to_string(list_transform(past, lambda p: list_sum(p.numbers)), ',') || ']}}') FROM wh),
wv AS MATERIALIZED (SELECT * EXCLUDE (past, state), CAST('0x' || substr(sha256(strategy || ':' || round_no || ':' || state || ':' || variant), 1, 15) AS BIGINT) AS seed FROM ws, (SELECT unnest(range({VARIANTS})) AS variant)),
{generator_sql("wv", "wc")},
wr AS MATERIALIZED (SELECT *, {MAE} AS mae, list_sum(list_transform(range(1,7), lambda i: a[i]-b[i]))/6.0 AS bias, bit_count(cand & mask)::BIGINT AS hits FROM
 (SELECT wv.*, wc.mask AS cand, {NUMS.format(m="wc.mask")} AS a, {NUMS.format(m="wv.mask")} AS b FROM wv JOIN wc USING (seed))),
wb AS MATERIALIZED (SELECT * FROM wr QUALIFY row_number() OVER (PARTITION BY series_id, round_no, strategy ORDER BY hits DESC, mae, seed) = 1)"""
STRATEGIES = ODRAWS + ",\n" + _STATES


def _rows(spark, sf):
    return WF.evaluate_strategies(ordered_draws(spark, sf), ["series_id"], "idx", VARIANTS, WINDOW, HISTORY)


@query("strategy_evaluation", with_(STRATEGIES) + f"SELECT series_id, round_no, strategy, variant::INTEGER AS variant, seed, hits, 12 - 2 * hits AS set_distance, {R('mae')} AS positional_mae, {R('bias')} AS signed_bias FROM wb")
def strategy_evaluation(spark, sf):
    """Best of four variants per draw and strategy from earlier draws only."""
    return _rows(spark, sf).select("series_id", "round_no", "strategy", "variant", "seed", "hits", "set_distance", r6(F.col("positional_mae")).alias("positional_mae"), r6(F.col("signed_bias")).alias("signed_bias"))


@query("strategy_summary", with_(STRATEGIES) + f"""SELECT strategy, count(*)::BIGINT AS rounds, {R('avg(hits)')} AS mean_hits, max(hits) AS max_hits, {', '.join(f'count_if(hits = {k})::BIGINT AS hits_{k}' for k in range(7))},
 {R('avg(mae)')} AS mean_mae, {R('avg(bias)')} AS mean_bias FROM wb GROUP BY 1""")
def strategy_summary(spark, sf):
    s = WF.strategy_summary(_rows(spark, sf))
    return s.withColumns({c: r6(F.col(c)) for c in ("mean_hits", "mean_mae", "mean_bias")})
