"""Series-dynamics diagnostics; the input is one ordered numeric series per key (key, idx, n, value columns)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions.kernels import time_warp_distance  # noqa: F401  (kernels ship with the job)
from trialgrid.operators.landscape import nearest_earlier
from trialgrid.operators.ordered import framed, islands, largest_group, median, position, running, tile_pairs, tiles, value_ranks

STATES = 4
STATE_WIDTH = 250_000

GROUP_LIMIT = 2_000_000  # symbols of a series that one task parses
SPECTRUM = 65_536  # rows of a series, or numbers of a grid, that one task transforms


def state_of(v: Column) -> Column:
    return F.least(F.floor(v / STATE_WIDTH), F.lit(STATES - 1))


def lagged(df: DataFrame, cols: dict[str, tuple[str, int]], key: str = "key") -> DataFrame:
    """name -> (column, offset); positive offsets look back, negative ones ahead."""
    back = max([o for _, o in cols.values() if o > 0], default=0)
    ahead = max([-o for _, o in cols.values() if o < 0], default=0)

    def build(d, k):
        w = Window.partitionBy(*k).orderBy("idx")
        return d.withColumns({n: (F.lag(c, o) if o > 0 else F.lead(c, -o)).over(w) for n, (c, o) in cols.items()})

    return framed(df, [key], "idx", back, ahead, build)


def mean_change(df: DataFrame, value: str, segment: int = 24) -> DataFrame:
    """Split with the largest |left mean - right mean| / std (first one on ties)."""
    tot = df.groupBy("key").agg(F.sum(value).alias("_t"), F.stddev_samp(value).alias("_sd"))
    r = running(df, ["key"], ["idx"], {"_s": ("sum", F.col(value).cast("double"))}).join(tot, "key")
    k = F.col("idx") + 1
    score = F.abs(F.col("_s") / k - (F.col("_t") - F.col("_s")) / (F.col("n") - k)) / F.col("_sd")
    ok = r.filter((k >= segment) & (k <= F.col("n") - segment)).select("key", k.alias("split"), F.round(score, 9).alias("score"))
    return ok.groupBy("key").agg(F.max(F.struct("score", (-F.col("split")).alias("m"))).alias("b")).select(
        "key", (-F.col("b.m")).alias("split"), F.col("b.score").alias("score"))


def variance_change(df: DataFrame, value: str, segment: int = 24) -> DataFrame:
    """Split with the largest |log variance ratio|; sums are taken around the key mean."""
    m = df.groupBy("key").agg(F.avg(value).alias("_m"))
    d = df.join(m, "key").withColumn("_c", F.col(value) - F.col("_m"))
    tot = d.groupBy("key").agg(F.sum("_c").alias("_t"), F.sum(F.col("_c") * F.col("_c")).alias("_tt"))
    r = running(d, ["key"], ["idx"], {"_s": ("sum", F.col("_c")), "_ss": ("sum", F.col("_c") * F.col("_c"))}).join(tot, "key")
    k = (F.col("idx") + 1).cast("double")
    rest = F.col("n") - k
    left = (F.col("_ss") - F.col("_s") * F.col("_s") / k) / (k - 1)
    rs, rss = F.col("_t") - F.col("_s"), F.col("_tt") - F.col("_ss")
    right = (rss - rs * rs / rest) / (rest - 1)
    ok = r.filter((k >= segment) & (k <= F.col("n") - segment))
    ok = ok.select("key", (F.col("idx") + 1).alias("split"), F.round(F.abs(F.ln((left + 1e-12) / (right + 1e-12))), 9).alias("score"))
    return ok.groupBy("key").agg(F.max(F.struct("score", (-F.col("split")).alias("m"))).alias("b")).select(
        "key", (-F.col("b.m")).alias("split"), F.col("b.score").alias("score"))


def transitions(df: DataFrame, value: str) -> DataFrame:
    """Chi-square of the state transition matrix against its margins, and persistence."""
    s = lagged(df.withColumn("s", state_of(F.col(value))), {"p": ("s", 1)}).filter("p IS NOT NULL")
    c = s.groupBy("key", "p", "s").agg(F.count(F.lit(1)).alias("o"))  # at most 16 cells a key
    w = Window.partitionBy("key")
    c = c.withColumns({"row": F.sum("o").over(Window.partitionBy("key", "p")), "col": F.sum("o").over(Window.partitionBy("key", "s")), "t": F.sum("o").over(w)})
    e = F.col("row") * F.col("col") / F.col("t")
    # cells with no observation add e each: sum over all row/col pairs of e is t, so add t - sum of seen e
    return c.groupBy("key").agg(
        (F.sum((F.col("o") - e) * (F.col("o") - e) / e) + F.first("t") - F.sum(e)).alias("chi_square"),
        (F.sum(F.when(F.col("p") == F.col("s"), F.col("o")).otherwise(0)) / F.first("t")).alias("persistence"))


def ordinal_entropy(df: DataFrame, value: str) -> DataFrame:
    """Normalised entropy of order-3 rank patterns (stable order on ties)."""
    d = lagged(df.withColumn("a", F.col(value)), {"b": ("a", -1), "c": ("a", -2)}).filter("c IS NOT NULL")
    pattern = F.concat((F.col("b") < F.col("a")).cast("int").cast("string"), (F.col("c") < F.col("a")).cast("int").cast("string"),
                       (F.col("c") < F.col("b")).cast("int").cast("string"))
    c = d.groupBy("key", pattern.alias("p")).agg(F.count(F.lit(1)).alias("m"))
    t = F.sum("m")
    return c.groupBy("key").agg(((F.ln(t) - F.sum(F.col("m") * F.ln("m")) / t) / math.log(6)).alias("entropy"), F.count(F.lit(1)).alias("patterns"))


def turning_statistics(df: DataFrame, value: str) -> DataFrame:
    """Turning points, sign alternation and lag-1 correlation of absolute deltas."""
    d = lagged(df.withColumn("v", F.col(value)), {"p": ("v", 1), "pp": ("v", 2)})
    d1, d0 = F.col("v") - F.col("p"), F.col("p") - F.col("pp")
    return d.filter("pp IS NOT NULL").groupBy("key").agg(
        F.count_if(d1 * d0 < 0).alias("turning_points"),
        F.avg((F.signum(d1.cast("double")) != F.signum(d0.cast("double"))).cast("int")).alias("sign_alternation"),
        F.corr(F.abs(d0), F.abs(d1)).alias("volatility_autocorrelation"))


def spectral_peak(df: DataFrame, value: str, limit: int = SPECTRUM) -> DataFrame:
    """Largest share of the periodogram, its period and bin.

    Series up to ``limit`` rows are transformed whole, longer ones by `long_spectral_peak`; each series takes its own way,
    so no group grows with a hot key.
    """
    import numpy as np
    import pandas as pd

    d = df.select("key", "idx", "n", F.col(value).cast("double").alias("v"))

    def fft(pdf):
        x = pdf.sort_values("idx")["v"].to_numpy()
        p = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
        if len(p) == 0 or p.sum() == 0:
            return pd.DataFrame({"key": pdf["key"].iloc[:1], "peak_share": 0.0, "period": float(len(x)), "bin": 0})
        i = int(np.argmax(np.round(p / p.sum(), 9)))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "peak_share": [p[i] / p.sum()], "period": [len(x) / (i + 1)], "bin": [i + 1]})

    short = d.filter(F.col("n") <= limit).groupBy("key").applyInPandas(fft, "key bigint, peak_share double, period double, bin bigint")
    return short.unionByName(long_spectral_peak(d.filter(F.col("n") > limit), limit))


def long_spectral_peak(d: DataFrame, block: int) -> DataFrame:
    """`spectral_peak` of (key, idx, n, v) series of any length n, in groups of about ``block`` numbers.

    The transform is a convolution with a chirp (Bluestein) of M >= 2n places, M a power of two, laid out as a grid of
    rows x columns: columns are transformed, then rows (there the product is taken and turned back), then columns. A group
    has some whole columns or some whole rows. The sum of the periodogram comes from the sum of squares (Parseval).
    """
    import numpy as np
    import pandas as pd

    block = 1 << block.bit_length() - 1  # groups of a grid are alike

    def shape(n):
        lg = (2 * n - 1).bit_length()
        rows, cols = 1 << (lg + 1) // 2, 1 << lg // 2
        return rows, cols, min(cols, max(1, block // rows)), min(rows, max(1, block // cols))  # columns and rows of a group

    def chirp(j, n):
        return np.exp(1j * np.pi * (j * j % (2 * n)) / n)

    def turn(i, j, n, sign):
        rows, cols, _, _ = shape(n)
        return np.exp(sign * 2j * np.pi * (np.outer(i, j) % (rows * cols)) / (rows * cols))

    def head(pdf, name):
        return int(pdf["n"].iloc[0]), int(pdf[name].iloc[0]), {c: pdf[c].iloc[0] for c in ("key", "n", "total")}

    def columns(pdf):
        n, c, same = head(pdf, "c")
        rows, cols, wide, high = shape(n)
        own = np.arange(c * wide, (c + 1) * wide)
        at = pdf["idx"].to_numpy()
        a = np.zeros((rows, wide), complex)
        a[at // cols, at % cols - own[0]] = (pdf["v"].to_numpy() - pdf["mean"].to_numpy()) * chirp(at, n).conj()
        j = np.arange(rows)[:, None] * cols + own
        j = np.minimum(j, rows * cols - j)  # the chirp runs backwards from the end
        b = np.where(j < n, chirp(j, n), 0)
        w = turn(np.arange(rows), own, n, -1)
        a, b = np.fft.fft(a, axis=0) * w, np.fft.fft(b, axis=0) * w
        r = range(rows // high)
        return pd.DataFrame(same | {"r": r, "c": c, "a": [a[k * high:(k + 1) * high].tobytes() for k in r], "b": [b[k * high:(k + 1) * high].tobytes() for k in r]})

    def lines(pdf):
        n, r, same = head(pdf, "r")
        rows, cols, wide, high = shape(n)
        a, b = (np.hstack([np.frombuffer(x, complex).reshape(high, wide) for x in pdf.sort_values("c")[side]]) for side in "ab")
        z = np.fft.ifft(np.fft.fft(a, axis=1) * np.fft.fft(b, axis=1), axis=1) * turn(np.arange(r * high, (r + 1) * high), np.arange(cols), n, 1)
        c = range(cols // wide)
        return pd.DataFrame(same | {"c": c, "r": r, "z": [np.ascontiguousarray(z[:, k * wide:(k + 1) * wide]).tobytes() for k in c]})

    def peaks(pdf):
        n, c, same = head(pdf, "c")
        rows, cols, wide, high = shape(n)
        z = np.vstack([np.frombuffer(x, complex).reshape(high, wide) for x in pdf.sort_values("r")["z"]])
        j = (np.arange(rows)[:, None] * cols + np.arange(c * wide, (c + 1) * wide)).ravel()
        p = np.abs(np.fft.ifft(z, axis=0).ravel()) ** 2
        keep = (j >= 1) & (j <= n // 2)
        j, share = j[keep], p[keep] / same["total"] if same["total"] else p[keep] * 0
        if not len(j):
            return pd.DataFrame({"key": [], "n": [], "rounded": [], "back": [], "share": []})
        i = int(np.argmax(np.round(share, 9)))  # places ascend
        return pd.DataFrame({"key": [same["key"]], "n": [n], "rounded": [round(share[i], 9)], "back": [-j[i] if same["total"] else 0], "share": [share[i]]})

    signed = F.when(F.col("idx") % 2 == 0, F.col("v")).otherwise(-F.col("v"))
    facts = d.groupBy("key").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("_v"), F.sum(signed).alias("_half"), F.first("n").alias("_n"))
    middle = F.when(F.col("_n") % 2 == 0, F.col("_half") * F.col("_half")).otherwise(0.0)  # an even n has a middle bin, which counts once
    total = F.when(F.col("_v") == 0, 0.0).otherwise((F.col("_n") * F.col("_n").cast("double") * F.col("_v") + middle) / 2)
    facts = facts.select("key", "mean", total.alias("total"))
    lg = F.length(F.bin(2 * F.col("n") - 1))
    power = lambda e: F.pow(F.lit(2.0), F.floor(e)).cast("bigint")
    wide = F.least(power(lg / 2), F.greatest(F.lit(1), F.floor(F.lit(block) / power((lg + 1) / 2))))
    e = d.join(F.broadcast(facts), "key")  # one row for each series of more than `limit` rows
    e = e.withColumn("c", F.floor(F.pmod("idx", power(lg / 2)) / wide).cast("bigint"))
    same = "key bigint, n bigint, total double, "
    grid = e.groupBy("key", "c").applyInPandas(columns, same + "r bigint, c bigint, a binary, b binary")
    grid = grid.groupBy("key", "r").applyInPandas(lines, same + "c bigint, r bigint, z binary")
    best = grid.groupBy("key", "c").applyInPandas(peaks, "key bigint, n bigint, rounded double, back bigint, share double")
    best = best.groupBy("key", "n").agg(F.max(F.struct("rounded", "back", "share")).alias("b")).withColumn("bin", -F.col("b.back"))
    return best.select("key", F.col("b.share").alias("peak_share"), (F.col("n") / F.greatest("bin", F.lit(1))).alias("period"), "bin")


def mutual_information(df: DataFrame, value: str, max_lag: int = 12) -> DataFrame:
    """Normalised mutual information of states at each lag, and the best lag per key."""
    d = lagged(df.withColumn("s", state_of(F.col(value))), {f"l{k}": ("s", k) for k in range(1, max_lag + 1)})
    e = d.select("key", "s", F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"l{k}").alias("p")) for k in range(1, max_lag + 1)]))).filter("p IS NOT NULL")
    c = e.groupBy("key", "lag", "p", "s").agg(F.count(F.lit(1)).alias("o"))  # at most 16 cells a (key, lag)
    c = c.withColumns({"a": F.sum("o").over(Window.partitionBy("key", "lag", "p")), "b": F.sum("o").over(Window.partitionBy("key", "lag", "s")),
                       "t": F.sum("o").over(Window.partitionBy("key", "lag"))})
    o, a, b, t = (F.col(x) for x in "oabt")
    g = c.groupBy("key", "lag").agg(F.sum(o / t * F.ln(o * t / (a * b))).alias("mi"),
                                    F.sum(-o / t * F.ln(a / t)).alias("ha"), F.sum(-o / t * F.ln(b / t)).alias("hb"))
    h = F.least("ha", "hb")
    g = g.select("key", "lag", F.round(F.when(h > 1e-12, F.col("mi") / h).otherwise(0.0), 9).alias("score"))
    return g.groupBy("key").agg(F.max(F.struct("score", (-F.col("lag")).alias("m"))).alias("x")).select(
        "key", F.col("x.score").alias("score"), (-F.col("x.m")).alias("lag"))


def recurrence(df: DataFrame, value: str, epsilon: float, tile: int = 512) -> DataFrame:
    """Recurrence rate, determinism and laminarity.

    A run of length L >= 2 has L points, L-1 neighbouring pairs and L-2 triples, so the points on
    runs are 2 x pairs - triples: counts that add up over tiles, with no matrix or pair rows kept.
    """
    import numpy as np
    import pandas as pd

    d = lagged(df.select("key", "idx", F.col(value).cast("double").alias("v")), {"v1": ("v", -1), "v2": ("v", -2)})
    d = d.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("v1", "v2")})
    packed = tiles(d, ["key"], "idx", ["v", "v1", "v2"], tile)
    pairs = tile_pairs(packed, packed, ["key"])

    def kernel(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                A = np.array([[x["idx"], x["v"], x["v1"], x["v2"]] for x in r.rows_a])
                B = np.array([[x["idx"], x["v"], x["v1"], x["v2"]] for x in r.rows_b])
                total = d2 = d3 = v2 = v3 = 0
                for P, S in ([(A, B)] if r.tile_a == r.tile_b else [(A, B), (B, A)]):
                    i, j = P[:, 0][:, None], S[:, 0][None, :]
                    near = [[np.abs(P[:, a][:, None] - S[:, b][None, :]) <= epsilon for b in (1, 2, 3)] for a in (1, 2, 3)]
                    off = i != j
                    r0 = near[0][0] & off
                    total += int(r0.sum())
                    dd = r0 & near[1][1]
                    d2 += int(dd.sum())
                    d3 += int((dd & near[2][2]).sum())
                    vv = r0 & near[1][0] & (i + 1 != j)
                    v2 += int(vv.sum())
                    v3 += int((vv & near[2][0] & (i + 2 != j)).sum())
                out.append((r.key, total, d2, d3, v2, v3))
            yield pd.DataFrame(out, columns=["key", "total", "d2", "d3", "v2", "v3"])

    c = pairs.mapInPandas(kernel, "key bigint, total bigint, d2 bigint, d3 bigint, v2 bigint, v3 bigint")
    s = c.groupBy("key").agg(*[F.sum(x).alias(x) for x in ("total", "d2", "d3", "v2", "v3")])
    n = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    t = F.col("total")
    share = lambda a, b: F.when(t > 0, (2 * F.col(a) - F.col(b)) / t).otherwise(0.0)
    return s.join(n, "key").select("key", F.when(F.col("n") > 1, t / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("rate"),
                                   share("d2", "d3").alias("determinism"), share("v2", "v3").alias("laminarity"))


def phrase_counts(df: DataFrame, value: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Exhaustive-history phrase count over state symbols.

    The parse of a series is sequential: it is one string in one task, read through an automaton of all substrings so far in
    time that grows with its length. A series above ``limit`` symbols is refused, not truncated.
    """
    from array import array

    import pandas as pd

    biggest = largest_group(df, ["key"])
    if biggest > limit:
        raise ValueError(f"a series has {biggest} symbols, above the limit of {limit}")
    s = df.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", state_of(F.col(value)).alias("s")))), lambda r: r["s"].cast("string")), "").alias("text"))

    def parsed(text):
        place = {c: i for i, c in enumerate(sorted(set(text)))}
        codes, k = [place[c] for c in text], len(place)
        # states of the automaton: where each symbol leads, the next shorter class, the longest substring
        step, link, longest, last = array("i", [-1] * k), array("i", [-1]), array("i", [0]), 0
        none = array("i", [-1] * k)
        at = phrases = 0
        while at < len(codes):
            state, end = 0, at
            while end < len(codes) and step[state * k + codes[end]] >= 0:
                state = step[state * k + codes[end]]
                end += 1
            end = min(end + 1, len(codes))
            phrases += 1
            for c in codes[at:end] if end < len(codes) else ():  # after the last phrase nothing is looked up
                new = len(link)
                link.append(0)
                longest.append(longest[last] + 1)
                step.extend(none)
                p = last
                while p >= 0 and step[p * k + c] < 0:
                    step[p * k + c] = new
                    p = link[p]
                if p >= 0:
                    q = step[p * k + c]
                    if longest[q] == longest[p] + 1:
                        link[new] = q
                    else:
                        copy = len(link)
                        link.append(link[q])
                        longest.append(longest[p] + 1)
                        step.extend(step[q * k:q * k + k])
                        while p >= 0 and step[p * k + c] == q:
                            step[p * k + c] = copy
                            p = link[p]
                        link[q] = link[new] = copy
                last = new
            at = end
        return phrases

    def kernel(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "phrases": [parsed(text) for text in pdf["text"]]})

    return s.mapInPandas(kernel, "key bigint, phrases bigint")


def block_profile(df: DataFrame, value: str, width: int = 16) -> DataFrame:
    """Mean, std, drift and mean absolute delta of consecutive blocks."""
    d = df.withColumn("block", F.floor(F.col("idx") / width)).withColumn("v", F.col(value))
    d = lagged(d, {"p": ("v", 1), "pb": ("block", 1)})
    step = F.when(F.col("pb") == F.col("block"), F.abs(F.col("v") - F.col("p")))
    return d.groupBy("key", "block").agg(
        F.min("idx").alias("start"), F.max("idx").alias("end"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        (F.max_by("v", "idx") - F.min_by("v", "idx")).alias("drift"), F.avg(step).alias("mean_abs_delta"))


def walk_forward_errors(df: DataFrame, value: str, minimum_train: int = 32, scale: float = 1.0) -> DataFrame:
    """MAE of expanding mean, persistence, ridge AR(3) and 5 nearest neighbours, each from earlier rows only.

    AR(3) needs only running sums of the normal equations; the 4x4 systems are solved in batches.
    """
    import numpy as np
    import pandas as pd

    d = df.select("key", "idx", (F.col(value) / scale).alias("y"))
    d = lagged(d, {"x1": ("y", 1), "x2": ("y", 2), "x3": ("y", 3)}).filter("idx >= 3")
    terms = {"1": F.lit(1.0), "a": F.col("x3"), "b": F.col("x2"), "c": F.col("x1")}
    names = list(terms)
    sums = {f"g_{p}{q}": ("sum", terms[p] * terms[q]) for i, p in enumerate(names) for q in names[i:]}
    sums |= {f"h_{p}": ("sum", terms[p] * F.col("y")) for p in names}
    r = running(d, ["key"], ["idx"], sums)
    r = framed(r, ["key"], "idx", 1, 0, lambda t, k: t.withColumns({
        f"p_{n}": F.lag(n).over(Window.partitionBy(*k).orderBy("idx")) for n in sums}))
    t = r.filter(F.col("idx") >= minimum_train)
    gcols = [f"p_g_{p}{q}" for i, p in enumerate(names) for q in names[i:]]
    hcols = [f"p_h_{p}" for p in names]
    work = t.select("key", "idx", "y", "x1", "x2", "x3", *gcols, *hcols)

    def solve(batches):
        for pdf in batches:
            m = len(pdf)
            G = np.zeros((m, 4, 4))
            for (i, p) in enumerate(names):
                for j in range(i, 4):
                    G[:, i, j] = G[:, j, i] = pdf[f"p_g_{p}{names[j]}"]
            for i in (1, 2, 3):
                G[:, i, i] += 1e-6
            h = pdf[hcols].to_numpy()
            coef = np.linalg.solve(G, h[:, :, None])[:, :, 0] if m else np.zeros((0, 4))
            x = np.c_[np.ones(m), pdf["x3"], pdf["x2"], pdf["x1"]]
            y = pdf["y"].to_numpy()
            yield pd.DataFrame({"key": pdf["key"], "idx": pdf["idx"], "e_mean": np.abs(y - h[:, 0] / G[:, 0, 0]),
                                "e_persistence": np.abs(y - pdf["x1"]), "e_ar3": np.abs(y - (x * coef).sum(axis=1))})

    e = work.mapInPandas(solve, "key bigint, idx bigint, e_mean double, e_persistence double, e_ar3 double")
    v = d.select("key", "idx", F.array("x3", "x2", "x1").alias("vec"), "y")
    near = nearest_earlier(v, ["key"], "idx", "vec", ["y"], 5)
    kn = near.groupBy("key", F.col("pos").alias("idx")).agg(F.avg("y").alias("k"))
    ek = kn.join(v.select("key", "idx", "y"), ["key", "idx"]).filter(F.col("idx") >= minimum_train).groupBy("key").agg(
        F.avg(F.abs(F.col("y") - F.col("k"))).alias("knn5"))
    return e.groupBy("key").agg(*[F.avg(f"e_{c}").alias(c) for c in ("mean", "persistence", "ar3")]).join(ek, "key")


def autocorrelations(df: DataFrame, value: str, max_lag: int = 20) -> DataFrame:
    d = lagged(df.withColumn("v", F.col(value).cast("double")), {f"l{k}": ("v", k) for k in range(1, max_lag + 1)})
    # one pass, one row per key: no explosion over lags
    g = d.groupBy("key").agg(*[F.corr("v", f"l{k}").alias(f"r{k}") for k in range(1, max_lag + 1)])
    return g.select("key", F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"r{k}").alias("r")) for k in range(1, max_lag + 1)])))


def spearman_trend(df: DataFrame, value: str) -> DataFrame:
    """Rank correlation of the value with its position."""
    r = value_ranks(df.select("key", value), ["key"], value)
    r = r.select("key", value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank"))
    return df.select("key", "idx", value).join(r, ["key", value]).groupBy("key").agg(F.corr("rank", "idx").alias("trend"))


def gap_statistics(df: DataFrame, value: str) -> DataFrame:
    """Min, max and coefficient of variation of the gaps between sorted distinct values."""
    s = position(df.select("key", value).distinct(), ["key"], [value], "idx")
    g = lagged(s, {"nx": (value, -1)}).filter("nx IS NOT NULL").withColumn("gap", F.col("nx") - F.col(value))
    return g.groupBy("key").agg(F.count(F.lit(1)).alias("gaps"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
                                (F.stddev_samp("gap") / F.avg("gap")).alias("gap_cv"))


def runs_test(df: DataFrame, value: str) -> DataFrame:
    """Runs above/below the median: count, expectation and z."""
    m = median(df, ["key"], value, "m")
    d = df.join(m, "key").withColumn("up", (F.col(value) > F.col("m")).cast("int"))
    d = lagged(d, {"pu": ("up", 1)})
    g = d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("a"),
                             (F.count_if(F.col("pu") != F.col("up")) + 1).alias("runs"))
    a, b, n = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double"), F.col("n").cast("double")
    mu = 2 * a * b / n + 1
    var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    return g.select("key", "runs", mu.alias("expected"), ((F.col("runs") - mu) / F.sqrt(var)).alias("z"))


def pair_statistics(df: DataFrame, key: str, value: str, bits: int = 20) -> DataFrame:
    """Mean absolute distance and mean Hamming distance over all pairs, without building a pair.

    Sum |a - b| over pairs = sum of x (2 rank - n - 1) over the sorted values; the Hamming sum is
    ones x zeros of each bit.
    """
    r = value_ranks(df.select(key, value), [key], value)
    # each copy at 0-based rank j adds v (2j - n + 1); copies occupy n_before .. n_before + n - 1
    n, nb, tot = F.col("n"), F.col("n_before"), F.col("n_total")
    part = F.col(value) * (2 * (nb * n + n * (n - 1) / 2.0) - n * (tot - 1))
    d = r.groupBy(key).agg(F.sum(part).alias("dist"), F.max(tot).alias("n"))
    ones = [F.sum(F.call_function("shiftright", F.col(value), F.lit(b)).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"b{b}") for b in range(bits)]
    h = df.groupBy(key).agg(*ones)
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    ham = sum(F.col(f"b{b}") * (F.col("n") - F.col(f"b{b}")) for b in range(bits))
    return d.join(h, key).filter("n > 1").select(key, pairs.cast("bigint").alias("pairs"), (F.col("dist") / pairs).alias("mean_distance"), (ham / pairs).alias("mean_hamming"))
