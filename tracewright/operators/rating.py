"""Rating of recovered traces against the truth: point errors, distances along roads, and what the road sequences share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m

FAR_M = 5000


def paired(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Points of the same trace and place: traj_id, seq, dist, same_road. Traces of unequal length are left out, see ``uneven``."""
    f = found.select("traj_id", "seq", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), F.col("road_id").alias("f_road"))
    both = truth.join(f, ["traj_id", "seq"], "full")
    whole = F.bool_and(F.col("lat").isNotNull() & F.col("f_lat").isNotNull()).over(Window.partitionBy("traj_id"))
    kept = both.withColumn("_whole", whole).where("_whole")
    return kept.select("traj_id", "seq", haversine_m("lat", "lon", "f_lat", "f_lon").alias("dist"), (F.col("road_id") == F.col("f_road")).alias("same_road"))


def uneven(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Traces whose numbers of points differ."""
    n = lambda df, name: df.groupBy("traj_id").agg(F.count(F.lit(1)).alias(name))
    return n(truth, "n_truth").join(n(found, "n_found"), "traj_id", "full").where("NOT (n_truth <=> n_found)")


def trace_errors(points: DataFrame) -> DataFrame:
    """MAE, RMSE and accuracy of each trace, and how many points are odd."""
    return points.groupBy("traj_id").agg(
        F.avg("dist").alias("mae"), F.sqrt(F.avg(F.col("dist") * F.col("dist"))).alias("rmse"), F.avg(F.col("same_road").cast("double")).alias("accuracy"), F.sum((F.col("dist") > FAR_M).cast("long")).alias("n_far"),
    )


def network_errors(distances: DataFrame) -> DataFrame:
    """MAE and RMSE along roads by trace, over the points that can be reached; null if none can. ``distances`` has there, back."""
    d = F.least("there", "back")
    return distances.groupBy("traj_id").agg(F.avg(d).alias("rn_mae"), F.sqrt(F.avg(d * d)).alias("rn_rmse"), F.sum(d.isNull().cast("long")).alias("skipped"))


def without_repeats(sequence: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(sequence, lambda x, i: (i == 0) | (x != F.get(sequence, i - 1)))


def lcs_weight(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> float:
    """Largest total weight of a common subsequence of two arrays, ``weights`` being those of a's elements.

    A row of the table at a time: an element of weight w that matches adds it to the cell before, and a row never falls, so its running
    maximum is the row.
    """
    row = np.zeros(len(b) + 1)
    for x, w in zip(a, weights, strict=True):
        row[1:] = np.maximum.accumulate(np.where(b == x, row[:-1] + w, row[1:]))
    return float(row[-1])


def weighted_lcs(a: Column, b: Column, weight) -> Column:
    """``lcs_weight`` of two array columns, in Arrow batches; ``weight`` maps an element to its weight, as a column."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([lcs_weight(x, y, w) if x is not None and y is not None else None for x, y, w in zip(a, b, weights, strict=True)], dtype=float)

    return run(a, b, F.transform(a, weight))


def lcs_of(a: list[int], b: list[int], weight) -> tuple[float, list[int]]:
    """The same for one pair of lists, with the subsequence itself."""
    table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + weight(x) if x == y else max(table[i - 1][j], table[i][j - 1])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] > table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return table[len(a)][len(b)], out[::-1]


def sequence_scores(seqs: DataFrame, weight) -> DataFrame:
    """Recall, precision and F1 by length of traces with arrays ``truth`` and ``found``; an empty side scores 0."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + weight(x))
    rows = seqs.withColumn("shared", weighted_lcs(F.col("truth"), F.col("found"), weight))
    rows = rows.withColumn("recall", F.coalesce(F.try_divide("shared", total(F.col("truth"))), F.lit(0.0))).withColumn("precision", F.coalesce(F.try_divide("shared", total(F.col("found"))), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(F.col("recall") * F.col("precision") * 2, F.col("recall") + F.col("precision")), F.lit(0.0))
    return rows.select("traj_id", "shared", "recall", "precision", f1.alias("f1"))


def odd_ones(errors: DataFrame, network: DataFrame, scores: DataFrame) -> DataFrame:
    """What should be looked at, one row: points further than ``FAR_M`` off, points that can't be reached, traces of zero recall or precision."""
    nil = lambda c: F.coalesce(F.sum((F.col(c) == 0).cast("long")), F.lit(0)).alias(f"zero_{c}")
    far = errors.agg(F.coalesce(F.sum("n_far"), F.lit(0)).alias("far_points"))
    skipped = network.agg(F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped_points"))
    return far.join(skipped).join(scores.agg(nil("recall"), nil("precision")))


def report(errors: DataFrame, network: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: the means over traces of all eight measures."""
    each = errors.join(network, "traj_id", "left").join(scores, "traj_id", "left")
    names = ("recall", "precision", "f1", "accuracy", "mae", "rmse", "rn_mae", "rn_rmse")
    return each.agg(*[F.round(F.avg(n), 4).alias(n) for n in names])
