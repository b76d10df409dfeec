"""Mixing sources to target weights by entropy balancing.

Document rates r minimise the sum of r log r - r + 1 with 0 <= r <= cap, under one constraint a source: the sum of
r * size is the source's target. The dual is convex; its solution tilts exponentially, r = min(cap, exp(lambda * size)).
Distributed Newton iterations over a histogram (source, size, documents) find the lambdas: each sums the gradient and
the curvature of every source in one aggregation. Rates become whole copies by strata of equal size: from the largest
size down, each stratum takes the whole number of copies that brings the running sum nearest its ideal.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import copies, n_words, pick, stash

CAP = 3
SEED = 7_919
#: Sources are entries of a mixing recipe, one weight each; more are refused, none is left out.
MAX_SOURCES = 100_000
#: Rows of a stratum that are ranked together.
BUCKET_ROWS = 256
TOLERANCE = 1e-7
MAX_STEPS = 60


def cycle_weights(rank: int) -> int:
    """1, 2, 3, repeating, by the source's rank in code-point order."""
    return rank % 3 + 1


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Share the sum of sizes by weight; none above cap times its size, the excess reshared until none is."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        share = {i: left * weights[i] / whole for i in free} if whole else dict.fromkeys(free, 0.0)
        over = [i for i in free if share[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def solve_rates(hist: DataFrame, sizes: list[int], want: list[float], means: list[float], cap: float = CAP) -> list[float]:
    """The lambda of each source (in units of 1 / mean size); infinite where the target takes the cap of every document.

    Raises ArithmeticError where MAX_STEPS do not bring every source within TOLERANCE of its target.
    """
    spark = hist.sparkSession
    lam = [0.0 if w < cap * s * (1 - 1e-12) else math.inf for s, w in zip(sizes, want, strict=True)]
    low, high = [-math.inf] * len(lam), [math.inf] * len(lam)
    open_ = [i for i, x in enumerate(lam) if math.isfinite(x) and sizes[i] and want[i] > 0]
    for _ in range(MAX_STEPS):
        if not open_:
            break
        # one row for each source
        now = F.broadcast(spark.createDataFrame([(i, lam[i], means[i]) for i in open_], "sid int, lam double, mean double"))
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * x))
        mass = F.col("n") * F.col("size") * rate
        sums = hist.join(now, "sid").groupBy("sid").agg(F.sum(mass).alias("mass"), F.sum(F.when(rate < cap, mass * x).otherwise(0.0)).alias("slope")).collect()
        still = []
        for r in sums:
            i, off = r["sid"], r["mass"] - want[r["sid"]]
            if abs(off) <= TOLERANCE * want[i]:
                continue
            if off > 0:
                high[i] = lam[i]
            else:
                low[i] = lam[i]
            step = lam[i] - off / r["slope"] if r["slope"] > 0 else math.nan
            if not low[i] < step < high[i] or abs(step - lam[i]) > 4 * (1 + abs(lam[i])):
                far = 2 * lam[i] + (1 if off < 0 else -1)
                step = (low[i] + high[i]) / 2 if math.isfinite(low[i]) and math.isfinite(high[i]) else far
            lam[i] = step
            still.append(i)
        open_ = still
    if open_:
        raise ArithmeticError(f"{len(open_)} sources are not within {TOLERANCE} of their targets after {MAX_STEPS} steps")
    return lam


def _rounded(cap: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        carry, out = 0.0, []
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
            ideal = n * rate + (carry / size if size else 0.0)
            k = min(max(math.floor(ideal + 0.5), 0), int(cap * n))
            carry += size * (n * rate - k)
            out.append(k)
        return pdf.assign(k=out)[["sid", "size", "n", "k"]]

    return run


def mix(docs: DataFrame, weights: Callable[[int], float] = cycle_weights, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, further columns) -> the same with source_size, target, copies and taken (copies * size).

    Null sizes count as 0. A null source is a source, last in order. Documents of size 0 get one copy each; they add
    nothing to any sum. Equal rows each get copies of their own. Which documents of a stratum get one copy more is decided
    by a seeded hash of the whole row and, of equal rows, the number of the copy, so reruns agree and a common id fills no
    bucket. Columns named as the new ones are replaced; of columns whose names differ in case only the first counts. An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    made = {"source_size", "target", "copies", "taken"}
    first = {n.lower(): i for i, n in reversed(list(enumerate(docs.columns)))}
    docs = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select(*(F.col(f"c{i}").alias(docs.columns[i]) for n, i in sorted(first.items(), key=lambda x: x[1]) if n not in made))
    docs = stash(docs.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")), "sized")
    hist = stash(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "hist")
    by_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n"))
    if (found := by_source.count()) > MAX_SOURCES:
        raise ValueError(f"{found} sources; at most {MAX_SOURCES}")
    rows = sorted(by_source.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    want = targets(sizes, [weights(i) for i in range(len(rows))], cap)
    means = [max(1.0, r["size"] / r["n"]) for r in rows]
    # one row for each source, at most MAX_SOURCES
    names = F.broadcast(spark.createDataFrame([(i, r["source"], sizes[i], want[i], means[i]) for i, r in enumerate(rows)], "__sid int, __name string, source_size long, target double, __mean double"))
    named: Callable[[DataFrame], DataFrame] = lambda df: df.join(names, F.col("source").eqNullSafe(F.col("__name"))).drop("__name")
    hist = stash(named(hist).select(F.col("__sid").alias("sid"), "size", "n"), "hist")
    lam = solve_rates(hist, sizes, want, means, cap)
    tilt = F.broadcast(spark.createDataFrame([(i, x if math.isfinite(x) else None, means[i]) for i, x in enumerate(lam)], "sid int, lam double, mean double"))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))), F.lit(float(cap))))
    strata = hist.join(tilt, "sid").select("sid", "size", "n", rate.alias("rate"))
    # a group has one row for each different size of its source: at most as many as its longest document has words, whatever the rows
    strata = stash(strata.groupBy("sid").applyInPandas(_rounded(cap), "sid int, size long, n long, k long"), "strata")
    return _deal(named(docs), strata, seed)


def _deal(docs: DataFrame, strata: DataFrame, seed: int) -> DataFrame:
    """Deal the k copies of each stratum to its documents; large strata in buckets by hash, each with its share of k."""
    own = [c for c in docs.columns if c not in ("__sid", "__mean")]
    size = own.index("size")
    # by position from here on, so that the caller's names cannot meet those used here
    docs = copies(docs.withColumn("__row", F.xxhash64(*own)))
    docs = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(own)), F.col("size"), F.col("__sid").alias("sid"), F.col("__row").alias("row"), F.col("__copy").alias("copy"))
    names, own = own, [f"c{i}" for i in range(len(own))]
    h: Column = F.xxhash64("row", "copy", F.lit(seed))
    keyed = docs.join(strata, ["sid", "size"]).withColumn("bucket", F.pmod(F.xxhash64("row", "copy", F.lit(seed + 1)), F.ceil(F.col("n") / BUCKET_ROWS)))
    keyed = stash(keyed.select(*own, "size", "sid", "row", "copy", "bucket", "n", "k"), "keyed")
    upto = Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = keyed.groupBy("sid", "size", "bucket").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("k").alias("k")).withColumn("upto", F.sum("m").over(upto))
    share = lambda x: F.floor(F.col("k").cast("decimal(38,0)") * x / F.col("n")).cast("long")
    counts = counts.select("sid", "size", "bucket", "m", (share(F.col("upto")) - share(F.col("upto") - F.col("m"))).alias("kb"))
    rank = F.row_number().over(Window.partitionBy("sid", "size", "bucket").orderBy(h, *own))
    taken = (F.expr("kb div m") + (F.col("rank") <= F.col("kb") % F.col("m")).cast("long")).alias("copies")
    out = keyed.withColumn("rank", rank).join(counts, ["sid", "size", "bucket"]).select(*own, taken)
    return out.select(*(F.col(c).alias(n) for c, n in zip(own, names, strict=True)), "copies", (F.col("copies") * F.col(own[size])).alias("taken"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", source="source", text="text")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
