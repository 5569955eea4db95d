"""Order-based primitives whose work can be cut along (keys, order), so that no key is bound to one task.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  That is kept only where the files behind a table are
so few bytes that the whole table would fit a task; the plan's leaves tell, no job runs for it.  For all other tables rows
are range-partitioned: cut points are a sample of (keys, order) tuples, taken by hash and held in one row of the plan, and
a row's block is the number of cut points up to its own tuple.  A key with a third of all rows gets a third of the
blocks.  Each (key, block) is worked on alone, one summary row of each is combined along the key, and the summary is
joined back.  Any orderable type can be an order column, nulls included.  Tests run both ways and compare.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions.exprs import bisect_right

BLOCKS_A_TASK = 4  # blocks for each shuffle partition; a setting of the cluster, not of the data
FRAME = 100_000  # positions of a key that are framed together
WHOLE_BYTES = 256 << 20  # tables read from fewer bytes may have a key in one task
CUTS = 1 << 16  # cut points of all keys together when quantiles are selected
CUTS_A_KEY = 1023


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest key (one scalar; partial counts are combined map-side)."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return int(row[0] or 0)


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of everything ``df`` reads, from the sizes its plan's leaves know; no job runs.

    Leaves without a size are rows that the driver has made (profiles, scenarios) and count as nothing.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 62)


def fits_a_task(df: DataFrame) -> bool:
    """Whether everything ``df`` reads is below ``WHOLE_BYTES``."""
    return leaf_bytes(df) <= WHOLE_BYTES


def with_blocks(df: DataFrame, by: Sequence[str], blocks: int | None = None, name: str = "_block") -> DataFrame:
    """Add the block of each row along the tuple of ``by``; blocks ascend with the tuple."""
    n = blocks or BLOCKS_A_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tuple_of = F.struct(*by)
    picked = df.select(tuple_of.alias("_t")).orderBy(F.xxhash64("_t"), "_t").limit(n)
    cuts = picked.agg(F.sort_array(F.collect_list("_t")).alias("_cuts"))  # one row of at most n tuples
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, bisect_right(F.col("_cuts"), n, tuple_of)).drop("_cuts")


def joined_back(rows: DataFrame, sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summary columns for each row; null keys are keys like any other."""
    right = sums.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(by)], *[c for c in sums.columns if c not in by])
    on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(right[f"_s{i}"]) for i, c in enumerate(by)])
    return rows.join(right, on, "left").drop(*[f"_s{i}" for i in range(len(by))])


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", total: str | None = None, blocks: int | None = None) -> DataFrame:
    """Dense 0-based position of each row inside its key, and optionally the key's row count."""
    by = [*keys, "_block"]
    w = Window.partitionBy(*keys)
    if blocks is None and fits_a_task(df):
        out = df.withColumn(name, (F.row_number().over(w.orderBy(*order)) - 1).cast("bigint"))
        return out.withColumn(total, F.count(F.lit(1)).over(w)) if total else out
    df = with_blocks(df, [*keys, *order], blocks)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*by, (F.sum("_n").over(w.orderBy("_block")) - F.col("_n")).alias("_start"), F.sum("_n").over(w).alias("_total"))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    out = joined_back(df, sizes, by).withColumn(name, (F.col("_start") + inside).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_block", "_start", "_total")


_COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            aggs: dict[str, tuple[str, Column]], blocks: int | None = None) -> DataFrame:
    """Inclusive prefix aggregates ``name -> (sum|count|min|max|last, column)`` in order inside each key.

    ``last`` ignores nulls (the as-of carry).
    """
    def over(fn, c, win):
        if fn == "last":
            return F.last(c, ignorenulls=True).over(win)
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[fn](c).over(win)

    names = list(aggs)
    if blocks is None and fits_a_task(df):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: over(fn, c, w) for n, (fn, c) in aggs.items()})
    df = with_blocks(df, [*keys, *order], blocks)
    by = [*keys, "_block"]
    tagged = df.withColumns({f"_v_{n}": c for n, (_, c) in aggs.items()})
    parts = []
    for n, (fn, _) in aggs.items():
        v = F.col(f"_v_{n}")
        if fn == "last":
            parts.append(F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"_p_{n}"))
        else:
            parts.append({"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[fn](v).alias(f"_p_{n}"))
    sums = tagged.groupBy(*by).agg(*parts)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for n, (fn, _) in aggs.items():
        p = F.col(f"_p_{n}")
        c = F.last(p, ignorenulls=True) if fn == "last" else _COMBINE[fn](p)
        carried.append(c.over(before).alias(f"_c_{n}"))
    carry = sums.select(*by, *carried)
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined_back(tagged, carry, by)
    cols = {}
    for n, (fn, _) in aggs.items():
        here = over(fn, F.col(f"_v_{n}"), inner)
        c = F.col(f"_c_{n}")
        if fn in ("sum", "count"):
            cols[n] = F.when(c.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + c)
        elif fn == "last":
            cols[n] = F.coalesce(here, c)
        else:
            cols[n] = (F.least if fn == "min" else F.greatest)(here, c)
    out = out.withColumns(cols)
    return out.drop("_block", *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


def framed(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int,
           build: Callable[[DataFrame, list[str]], DataFrame], size: int | None = None) -> DataFrame:
    """Run window expressions whose frame reaches at most ``before``/``after`` positions.

    ``build(df, keys)`` adds the window columns.  Keys are cut into chunks of ``size`` positions; the rows a neighbour
    chunk needs are sent to it as a halo and dropped afterwards.
    """
    if size is None and fits_a_task(df):
        return build(df, list(keys))
    size = max(size or FRAME, before + after + 1)
    chunk = F.floor(F.col(pos) / size)
    inside = F.pmod(F.col(pos), F.lit(size))
    copies = F.array(
        F.struct(chunk.alias("c"), F.lit(False).alias("halo")),
        F.when(inside >= size - before, F.struct((chunk + 1).alias("c"), F.lit(True).alias("halo"))),
        F.when(inside < after, F.struct((chunk - 1).alias("c"), F.lit(True).alias("halo"))),
    )
    spread = df.withColumn("_copy", F.explode(F.filter(copies, lambda s: s.isNotNull())))
    spread = spread.select(*df.columns, F.col("_copy.c").alias("_chunk"), F.col("_copy.halo").alias("_halo"))
    return build(spread, [*keys, "_chunk"]).filter(~F.col("_halo")).drop("_chunk", "_halo")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, extra: dict[str, Column] | None = None,
                blocks: int | None = None) -> DataFrame:
    """One row per distinct (key, value): count ``n``, rows below ``n_before``, key total ``n_total``.

    Counting happens map-side first, so ties and repeated values never travel as rows.
    ``extra`` adds further sums per distinct value, each with its own ``<name>_before``.
    """
    extra = extra or {}
    counts = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in extra.items()])
    names = ["n", *extra]
    run = running(counts, keys, [value], {f"{n}_before": ("sum", F.col(n)) for n in names}, blocks)
    run = run.withColumns({f"{n}_before": F.col(f"{n}_before") - F.col(n) for n in names})
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), *[F.sum(c).alias(f"{n}_total") for n, c in extra.items()])
    if not keys:
        return run.crossJoin(F.broadcast(totals))  # one row
    return run.join(totals, list(keys))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              name: str = "q", blocks: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key as one ``array<double>`` column."""
    df = df.filter(F.col(value).isNotNull())
    r = value_ranks(df.select(*keys, value), keys, value, blocks=blocks)
    # small key: Spark's exact percentile would do; this form has no per-key buffer
    picks = F.filter(
        F.transform(F.lit([[i, float(p)] for i, p in enumerate(probs)]), lambda ip: F.struct(
            ip[0].cast("int").alias("i"), ((F.col("n_total") - 1) * ip[1]).alias("h"))),
        lambda s: ((F.floor(s["h"]) >= F.col("n_before")) & (F.floor(s["h"]) < F.col("n_before") + F.col("n")))
        | ((F.ceil(s["h"]) >= F.col("n_before")) & (F.ceil(s["h"]) < F.col("n_before") + F.col("n"))),
    )
    e = r.select(*keys, F.col(value).cast("double").alias("_x"), F.inline(picks), )
    per = e.groupBy(*keys, "i", "h").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    per = per.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h")))
    return per.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias(name))


def _value_cuts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _cuts): distinct values picked by hash; they only say where a key is cut, every row is counted."""
    apart = max(1, leaf_bytes(df) // (8 * CUTS))
    h = F.xxhash64(*keys, value)
    picked = df.where(F.pmod(h, F.lit(apart)) == 0).select(*keys, value).distinct().orderBy(h, *keys, value).limit(CUTS)
    cuts = picked.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_cuts"))
    every = F.ceil(F.size("_cuts") / CUTS_A_KEY).cast("int")
    return cuts.select(*keys, F.filter("_cuts", lambda x, i: i % every == 0).alias("_cuts"))


def selected_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q",
                       fold: str | None = None, folds: int = 1) -> DataFrame:
    """``quantiles`` for few keys (families, folds, features) of any size; with ``fold``, of all other folds for each ``fold``.

    Values of a key are cut into blocks, blocks are counted (a column of counts for each fold, so no row is copied), and
    only the rows of blocks that hold a wanted position are ordered.  Keys times levels are broadcast.
    """
    if not keys:
        return selected_quantiles(df.withColumn("_one", F.lit(0)), ["_one"], value, probs, name, fold, folds).drop("_one")
    keys = list(keys)
    by, out = [*keys, "_block"], [*keys, "_f"]
    df = df.where(F.col(value).isNotNull()).select(*keys, *([fold] if fold else []), value).persist()  # four passes read these few columns
    takes = [F.count_if(F.col(fold) != f) if fold else F.count(F.lit(1)) for f in range(folds)]
    counted = [c.alias(f"_n{f}") for f, c in enumerate(takes)]
    cells = lambda extra: F.inline(F.array(*[F.struct(F.lit(f).cast("bigint").alias("_f"), *extra(f)) for f in range(folds)]))
    blocked = joined_back(df, F.broadcast(_value_cuts(df, keys, value)), keys)
    blocked = blocked.withColumn("_block", bisect_right(F.col("_cuts"), CUTS_A_KEY, F.col(value))).drop("_cuts")

    w = Window.partitionBy(*keys)
    sizes = blocked.groupBy(*by).agg(*counted)
    sizes = sizes.select(*by, *[c for f in range(folds) for c in (
        F.col(f"_n{f}"), (F.sum(f"_n{f}").over(w.orderBy("_block")) - F.col(f"_n{f}")).alias(f"_b{f}"), F.sum(f"_n{f}").over(w).alias(f"_t{f}"))])
    sizes = sizes.select(*by, cells(lambda f: [F.col(f"_n{f}").alias("_n"), F.col(f"_b{f}").alias("_before"), F.col(f"_t{f}").alias("_total")]))
    inside = lambda rank: (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))
    levels = F.transform(F.lit([[i, float(p)] for i, p in enumerate(probs)]), lambda ip: F.struct(
        ip[0].cast("int").alias("_i"), ((F.col("_total") - 1) * ip[1]).alias("_h")))
    wanted = sizes.where("_n > 0").select(*out, "_block", F.col("_before").alias("_start"), F.inline(F.filter(
        levels, lambda s: inside(F.floor(s["_h"])) | inside(F.ceil(s["_h"])))))

    need = wanted.select(*by).distinct().withColumn("_need", F.lit(True))
    rows = joined_back(blocked, F.broadcast(need), by).where("_need")
    rows = rows.groupBy(*by, F.col(value).alias("_x")).agg(*counted)
    order = Window.partitionBy(*by).orderBy("_x")
    rows = rows.select(*by, "_x", *[c for f in range(folds) for c in (F.col(f"_n{f}"), (F.sum(f"_n{f}").over(order) - F.col(f"_n{f}")).alias(f"_b{f}"))])
    rows = rows.select(*by, F.col("_x").cast("double").alias("_x"), cells(lambda f: [F.col(f"_n{f}").alias("_n"), F.col(f"_b{f}").alias("_in")])).where("_n > 0")
    rows = joined_back(rows, F.broadcast(wanted), [*by, "_f"]).withColumn("_before", F.col("_start") + F.col("_in"))
    rows = rows.where(inside(F.floor("_h")) | inside(F.ceil("_h")))
    per = rows.groupBy(*out, "_i", "_h").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    per = per.withColumn("_v", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h")))
    per = per.groupBy(*out).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias(name))
    return per.withColumnRenamed("_f", fold) if fold else per.drop("_f")


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, [0.5], name).withColumn(name, F.get(name, 0))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key in a total order; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= k)


def islands(df: DataFrame, keys: Sequence[str], pos: str, label: Column, name: str = "run_no",
            size: int | None = None, blocks: int | None = None) -> DataFrame:
    """Number of the maximal stretch of equal consecutive labels each row belongs to."""
    df = df.withColumn("_label", label)
    df = framed(df, keys, pos, 1, 0, lambda d, k: d.withColumn(
        "_new", F.when(F.col("_label").eqNullSafe(F.lag("_label").over(Window.partitionBy(*k).orderBy(pos))), 0)
        .otherwise(1)), size)
    return running(df, keys, [pos], {name: ("sum", F.col("_new"))}, blocks).drop("_label", "_new")


def tiles(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], size: int) -> DataFrame:
    """Pack each run of ``size`` positions of a key into one row of arrays (a bounded group)."""
    packed = df.groupBy(*keys, F.floor(F.col(pos) / size).alias("tile")).agg(
        F.array_sort(F.collect_list(F.struct(pos, *cols))).alias("rows"))
    return packed


def tile_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All tile pairs (right tile not later than left tile) of each key.

    Each pair gets its own join key, so the tile pairs of a hot key spread over the cluster.
    Rows of a pair are compared inside a vectorised kernel; no row pairs are emitted.
    """
    last = left.groupBy(*keys).agg(F.max("tile").alias("_last"))
    a = left.select(*keys, F.col("tile").alias("tile_a"), F.col("rows").alias("rows_a"),
                    F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tile").cast("bigint"))).alias("tile_b"))
    b = right.join(last, list(keys)).select(
        *keys, F.col("tile").cast("bigint").alias("tile_b"), F.col("rows").alias("rows_b"),
        F.explode(F.sequence(F.col("tile").cast("bigint"), F.col("_last").cast("bigint"))).alias("tile_a"))
    return a.join(b, [*keys, "tile_a", "tile_b"])
