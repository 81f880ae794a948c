"""Distributions of turns and detours by time gap: histograms, seeds, fits and survival tables.

``stats`` has interval_s and value. Histograms are counted by bin with partial sums, so a gap of many rows is never sorted in
one task; order statistics are found by the bin that holds them and read from the rows of that bin alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import BIN, FLOOR, mixture

KEEP = 0.999
SEEDS = {"sig": 0.6827 * 0.5, "sig3": (0.9973 + 1) / 2, "third": 0.75}
WIDTH, ROUNDS = 10, 15
PARAMETERS = "val0 double, sig1 double, s1 double, sig2 double, mu2 double"


def accepted_values(stats: DataFrame, negative: bool = False) -> DataFrame:
    """interval_s, x: values in bins' units; the negative side is mirrored and loses its zeros."""
    v = -F.col("value") if negative else F.col("value")
    return stats.select("interval_s", (v / BIN).alias("x")).where("x > 0" if negative else "x >= 0")


def binned(values: DataFrame) -> DataFrame:
    """interval_s, bin, n, and running counts up to the bin, with the number of all and of accepted rows."""
    counts = values.groupBy("interval_s", F.floor("x").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x") == 0).cast("long")).alias("zeros"))
    w = Window.partitionBy("interval_s")
    total = F.sum("n").over(w)
    return counts.select(
        "interval_s", "bin", "n", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.floor(total * KEEP).cast("long").alias("accept"), F.sum("zeros").over(w).alias("begins"),
    )


def histogram(counts: DataFrame) -> DataFrame:
    """interval_s, bin, share: of the lowest 99.9 % of rows."""
    low = F.least(F.col("upto") - F.col("n"), F.col("accept"))
    share = (F.least("upto", "accept") - low) / F.col("accept")
    return counts.where("accept > 0").select("interval_s", "bin", share.alias("share")).where("share > 0")


def limits(counts: DataFrame) -> DataFrame:
    """interval_s, up_lim: one more than the bin of the largest accepted value."""
    return counts.where("upto >= accept AND accept > 0").groupBy("interval_s").agg((F.min("bin") + 1).alias("up_lim"))


PARTS = 4096


def seeds(values: DataFrame, counts: DataFrame) -> DataFrame:
    """interval_s with the order statistics at fixed shares of the positive part.

    A wanted rank is followed from its bin to one of ``PARTS`` parts of the bin, and ranked among the distinct values of that part,
    each counted once: a bin that holds most of the rows is never sorted in one task.
    """
    at = F.array(*[F.struct(F.lit(k).alias("name"), (F.col("begins") + F.floor((F.col("accept") - F.col("begins")) * share)).alias("i")) for k, share in SEEDS.items()])
    wanted = counts.where("accept > 0").select("interval_s", "bin", "n", "upto", F.explode(at).alias("a")).where((F.col("a.i") < F.col("upto")) & (F.col("a.i") >= F.col("upto") - F.col("n")))
    wanted = F.broadcast(wanted.select("interval_s", "bin", "a.name", (F.col("a.i") - F.col("upto") + F.col("n") + 1).alias("place")))  # three rows an interval
    part = F.floor((F.col("x") - F.floor("x")) * PARTS).cast("int").alias("part")
    held = values.select("interval_s", F.floor("x").cast("long").alias("bin"), part, "x")
    held = held.join(F.broadcast(wanted.select("interval_s", "bin").distinct()), ["interval_s", "bin"], "left_semi")
    key = ["interval_s", "bin"]
    for finer in ("part", "x"):
        sums = held.groupBy(*key, finer).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy(finer).rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("upto", upto).join(wanted, key).where((F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("n")))
        wanted = F.broadcast(found.select(*key, finer, "name", (F.col("place") - F.col("upto") + F.col("n")).alias("place")))
        key = [*key, finer]
        if finer == "part":
            held = held.join(F.broadcast(wanted.select(*key).distinct()), key, "left_semi")
    return wanted.groupBy("interval_s").pivot("name", list(SEEDS)).agg(F.first("x"))


def losses(hist: DataFrame, lims: DataFrame, parameters: DataFrame) -> DataFrame:
    """L1 distance of each parameter row (interval_s, pid, val0, sig1, s1, sig2, mu2) from the histogram: interval_s, pid, loss."""
    grid = lims.select("interval_s", F.explode(F.sequence(F.lit(0).cast("long"), "up_lim")).alias("bin")).join(hist, ["interval_s", "bin"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    x = F.col("bin").cast("double")
    est = mixture(x, "val0", "sig1", "s1", "sig2", "mu2") + F.when(F.col("bin") == 0, F.col("val0")).otherwise(0.0)
    each = grid.join(parameters, "interval_s").withColumn("est", est)
    share = F.col("est") / F.sum("est").over(Window.partitionBy("interval_s", "pid"))
    return each.withColumn("gap", F.abs(F.col("share") - share)).groupBy("interval_s", "pid").agg(F.sum("gap").alias("loss"))


def best(scored: DataFrame) -> DataFrame:
    """The parameter row of least loss of each interval, the first on a tie."""
    return scored.groupBy("interval_s").agg(F.min_by("pid", F.struct("loss", "pid")).alias("pid"), F.min("loss").alias("loss"))


def _cdf(x):
    from ..functions import probability as p

    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + p.P * z)
    y = 1 - ((((p.A5 * t + p.A4) * t + p.A3) * t + p.A2) * t + p.A1) * t * np.exp(-z * z)
    return 0.5 * (1 + np.sign(x) * y)


def curve(p: np.ndarray, n: int) -> np.ndarray:
    """Estimates of rows of parameters at bins 0..n-1, with the mass at zero, normalised."""
    val0, sig1, s1, sig2, mu2 = (p[:, i : i + 1] for i in range(5))
    x = np.arange(n)[None, :]
    root = math.sqrt(2 * math.pi)
    with np.errstate(all="ignore"):
        est = s1 / (1 - _cdf(0 * sig1)) / (root * sig1) * np.exp(-x * x / (2 * sig1**2)) + (1 - val0 - s1) / (1 - _cdf(-mu2 / sig2)) / (root * sig2) * np.exp(-((x - mu2) ** 2) / (2 * sig2**2))
        est[:, :1] += val0
        return est / est.sum(1, keepdims=True)


def fit_one(share: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Least L1 loss by refining one or two parameters at a time around the best so far, steps halved once they settle."""
    now, step = start.copy(), start / WIDTH
    loss = float(np.abs(curve(now[None], len(share)) - share).sum())
    offsets = np.arange(-WIDTH, WIDTH + 1)
    for _ in range(ROUNDS):
        origin = now.copy()
        for a in range(5):
            for b in range(a, 5):
                grid = np.repeat(now[None], len(offsets) ** (1 + (b != a)), 0)
                if a == b:
                    grid[:, a] += step[a] * offsets
                else:
                    i, j = (g.ravel() for g in np.meshgrid(offsets, offsets, indexing="ij"))
                    grid[:, a] += step[a] * i
                    grid[:, b] += step[b] * j
                grid = grid[(grid > 1e-10).all(1) & (grid[:, 0] < 1) & (grid[:, 0] + grid[:, 2] < 1)]
                if len(grid):
                    found = np.abs(curve(grid, len(share)) - share).sum(1)
                    k = int(np.nanargmin(found)) if not np.isnan(found).all() else 0
                    if found[k] < loss:
                        loss, now = float(found[k]), grid[k]
        settled = np.abs(now - origin) < step * (WIDTH // 2)
        step = np.where(settled, step / 2, step)
    return now, loss


def fit(hist: DataFrame, lims: DataFrame, start: DataFrame) -> DataFrame:
    """Fitted parameters of each interval, a grouped kernel over its histogram (of bins, not rows): interval_s, up_lim, parameters, loss."""
    rows = hist.join(lims, "interval_s").join(start, "interval_s")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        share = np.zeros(int(r.up_lim) + 1)
        share[pdf.bin.to_numpy()] = pdf.share.to_numpy()
        first = np.array([0.1, max(r.sig, 1e-3), 0.45, max((r.sig3 - r.third) / 3, 1e-3), max(r.third, 1e-3)])
        p, loss = fit_one(share, first)
        return pd.DataFrame([[int(r.interval_s), int(r.up_lim), *p, loss]], columns=["interval_s", "up_lim", "val0", "sig1", "s1", "sig2", "mu2", "loss"])

    return rows.groupBy("interval_s").applyInPandas(one, f"interval_s int, up_lim long, {PARAMETERS}, loss double")


def survival(parameters: DataFrame, bins: int = 8192) -> DataFrame:
    """interval_s, bin, p: the share of the fitted distribution at or beyond each bin, up to where its density vanishes."""
    x = F.col("bin").cast("double")
    grid = parameters.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("d", mixture(x, "val0", "sig1", "s1", "sig2", "mu2"))
    first = Window.partitionBy("interval_s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    kept = grid.withColumn("_gone", F.sum((F.col("d") < 1e-40).cast("int")).over(first)).where("_gone = 0 OR (_gone = 1 AND d < 1e-40)")
    mass = F.col("d") + F.when(F.col("bin") == 0, F.col("val0")).otherwise(0.0)
    ahead = Window.partitionBy("interval_s").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum(mass).over(ahead) / F.sum(mass).over(Window.partitionBy("interval_s"))
    return kept.select("interval_s", "bin", F.greatest(share, F.lit(FLOOR)).alias("p"))


def brackets(table: DataFrame) -> DataFrame:
    """interval_s with the next larger one (itself if there is none)."""
    t = table.select("interval_s").distinct()
    return t.select("interval_s", F.coalesce(F.lead("interval_s").over(Window.orderBy("interval_s")), F.col("interval_s")).alias("next_s"))


def lookup(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Adds p for rows value, gap_s: the survival table at the value's bin, between the intervals around the gap.

    Values beyond a table take its last entry, gaps beyond the intervals the nearest. The table is small and broadcast: at most 24
    intervals of 8192 bins.
    """
    edges = brackets(table)
    ends = edges.agg(F.min("interval_s").alias("lo"), F.max("interval_s").alias("hi"))
    last = table.groupBy("interval_s").agg(F.max("bin").alias("last"))
    t = table.join(last, "interval_s")
    rows = asked.crossJoin(F.broadcast(ends)).withColumn("_g", F.least(F.greatest(F.col("gap_s"), "lo"), "hi"))
    rows = rows.join(F.broadcast(edges), (F.col("_g") >= F.col("interval_s")) & ((F.col("_g") < F.col("next_s")) | ((F.col("interval_s") == F.col("next_s")) & (F.col("_g") == F.col("interval_s")))))
    rows = rows.withColumn("_b", F.floor(F.abs("value") / BIN).cast("int"))
    for side, key in (("l", "interval_s"), ("r", "next_s")):
        s = t.select(F.col("interval_s").alias(f"_{side}k"), F.col("bin").alias(f"_{side}b"), F.col("p").alias(f"_{side}p"), F.col("last").alias(f"_{side}n"))
        n = last.select(F.col("interval_s").alias(f"_{side}m"), F.col("last").alias(f"_{side}last"))
        rows = rows.join(F.broadcast(n), F.col(key) == F.col(f"_{side}m")).withColumn(f"_{side}at", F.least("_b", f"_{side}last"))
        rows = rows.join(F.broadcast(s), (F.col(key) == F.col(f"_{side}k")) & (F.col(f"_{side}at") == F.col(f"_{side}b")))
    width = F.col("next_s") - F.col("interval_s")
    p = F.when(width == 0, F.col("_lp")).otherwise(F.col("_lp") * (F.col("next_s") - F.col("_g")) / width + F.col("_rp") * (F.col("_g") - F.col("interval_s")) / width)
    return rows.select(*asked.columns, p.alias("p"))
