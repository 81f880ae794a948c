"""Packing of documents into sequences by length patterns.

The histogram of piece lengths has at most as many entries as a sequence has tokens, so the plan is made on the
driver whatever the size of the table: patterns of two to four lengths that fill a sequence exactly are
enumerated, non-negative least squares fits how often to repeat each, counts are rounded down, and what the
patterns leave is packed largest first, each time with the longest length that still fits. A plan says, for each
length, which ranks of its pieces go to which slot; pieces get ranks from per-task counters and running sums, so no
length is ever gathered in one task.

Defined cases: a null text is empty and has the end id only; repeated rows are packed each; an empty table gives an empty
result; only pieces of documents longer than a sequence are cut, the first of them short. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, texts
from .tokenization import tokenizer

#: Lengths used as the third and fourth of a pattern: so many of the most frequent, spread over the range.
PARTNERS = 48
ROUNDS = 300


def cut(docs: DataFrame, vocabulary: str, length: int, end_id: int = 0, space: str = "kept") -> DataFrame:
    """Encodes and cuts: doc_id, piece, start, length, ids_crc32, and task and rank (its number among the task's pieces of that length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = tokenizer(vocabulary, space), TaskContext.get().partitionId()
        end, seen = np.array([end_id], encode.dtype).tobytes(), np.zeros(length + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
        kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]
        for batch in slices(batches, 1024):
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode.encode(texts(batch.column(1))), strict=True):
                ids = np.frombuffer(raw + end, encode.dtype).astype("<u4")
                first = len(ids) % length or length
                bounds = [0, *range(first, len(ids) + 1, length)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), int(seen[b - a])))
                    seen[b - a] += 1
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(out), pa.int64())], names=[*names, "task"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task long")


def patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of four lengths (0: none) that fill a sequence exactly; counts[l] is the number of pieces of length l."""
    full = len(counts) - 1
    have = np.flatnonzero(counts[1:full]) + 1
    if not len(have):
        return np.zeros((0, 4), np.int64)
    present = counts > 0
    weight = counts[have] * have
    edges = np.searchsorted(np.cumsum(weight), np.linspace(0, weight.sum(), PARTNERS, endpoint=False))
    common = np.unique(np.concatenate([have[np.argsort(-counts[have], kind="stable")[: PARTNERS // 2]], have[np.minimum(edges, len(have) - 1)]]))
    found = []
    rest = full - have
    ok = (rest > 0) & present[np.maximum(rest, 0)] & (have >= rest)
    found.append(np.stack([have[ok], rest[ok], 0 * have[ok], 0 * have[ok]], 1))
    a, b = (x.ravel() for x in np.meshgrid(have, common, indexing="ij"))
    c = full - a - b
    ok = (c > 0) & present[np.maximum(c, 0)]
    found.append(np.stack([a, b, c, 0 * a], 1)[ok])
    pairs = np.stack([x.ravel() for x in np.meshgrid(common, common, indexing="ij")], 1)
    pairs = pairs[pairs[:, 0] >= pairs[:, 1]]
    pairs = pairs[:: max(1, len(pairs) // PARTNERS)]
    a, k = (x.ravel() for x in np.meshgrid(have, np.arange(len(pairs)), indexing="ij"))
    d = full - a - pairs[k].sum(1)
    ok = (d > 0) & present[np.maximum(d, 0)]
    found.append(np.stack([a, pairs[k, 0], pairs[k, 1], d], 1)[ok])
    return np.unique(-np.sort(-np.concatenate(found), axis=1), axis=0)


def nnls(columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squares of what ``columns`` use minus ``counts``, by accelerated projected gradient."""
    n, size = len(columns), len(counts)
    used = (columns > 0).astype(float)
    weight = 1 / (counts + 1.0)
    flat = columns.ravel()

    def use(x):
        return np.bincount(flat, (used * x[:, None]).ravel(), size)

    def back(r):
        return (r[columns] * used).sum(1)

    x = np.zeros(n)
    # steps by the row sums of the weighted normal matrix, which bound its curvature coordinate by coordinate
    step = 1 / np.maximum(back(weight * use(np.ones(n))), 1e-12)
    y, t = x.copy(), 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - step * back(weight * (use(y) - counts)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how often) for all pieces; counts[l] is the number of pieces of length l, up to a full sequence."""
    left, full, out = counts.astype(np.int64).copy(), len(counts) - 1, []
    if left[full]:
        out.append(([full], int(left[full])))
        left[full] = 0
    candidates = patterns(left)
    if len(candidates):
        x = nnls(candidates, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            lengths, times = np.unique(candidates[i][candidates[i] > 0], return_counts=True)
            n = int(min(x[i], (left[lengths] // times).min()))
            if n:
                out.append((candidates[i][candidates[i] > 0].tolist(), n))
                left[lengths] -= n * times
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return out
        spare, own = left.copy(), []
        space = full
        while space > 0 and (k := np.searchsorted(have, space, "right")):
            fits = have[:k][spare[have[:k]] > 0]
            if not len(fits):
                break
            own.append(int(fits[-1]))
            spare[own[-1]] -= 1
            space -= own[-1]
        lengths, times = np.unique(own, return_counts=True)
        n = int((left[lengths] // times).min())
        left[lengths] -= n * times
        out.append((own, n))


def slots(sequences: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows length, first rank, first sequence, offset: ranks from there on, up to the next row of that length, go to following sequences."""
    taken: dict[int, int] = {}
    rows, number = [], 0
    for lengths, n in sequences:
        at = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), number, at))
            taken[length] = taken.get(length, 0) + n
            at += length
        number += n
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(pieces: DataFrame, length: int) -> DataFrame:
    """Adds sequence_id and offset to what ``cut`` made; ``pieces`` is read twice and must be a stored table."""
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row for each length, 2048 at most
    counts = np.zeros(length + 1, np.int64)
    for row in totals:
        counts[row["length"]] = row["n"]
    table = slots(plan(counts))
    order = table[:, 0] * (1 << 40) + table[:, 1]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_task.select("task", "length", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            row = table[np.searchsorted(order, size * (1 << 40) + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(materialise(cut(docs, vocabulary, length, end_id), "pieces"), length)
