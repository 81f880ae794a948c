"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over the statistics of a text. Each task sums the normal
equations of its labelled rows; the sums (of fixed size) are added in two steps and solved on the driver. The raw scores
of labelled rows kept apart from the ridge fit are calibrated by isotonic regression on a histogram of fixed size.

All labelled rows are learned from. Defined cases: null text is the empty text; rows of null or other than 0/1 labels are not
learned from; an id labelled more than once counts each time; without labelled rows every score is 0.5; repeated rows repeat; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, materialise, slices, texts

FEATURES = 160  # random ones
RIDGE = 1e-3
BINS, LOW, HIGH = 2048, -0.5, 1.5
GROUPS = 32  # of tasks, whose sums are added before the driver adds theirs
SENTENCE = re.compile(r"[.!?]")

_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 full stop or comma, 7 other mark, 8 beyond ASCII
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = 8 if _c > 127 else 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 5 if _s in "\n\r" else 4 if _s.isspace() else 6 if _s in ".,;:'\"-()" else 7 if _c > 32 else 0
STATISTICS = 20


def statistics(text: str) -> list[float]:
    """``STATISTICS`` numbers for one text, whatever its length."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    by = np.bincount(_CLASS[raw], minlength=9) / max(1, n)
    words = text.split()
    nw = len(words)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, nw) if nw else np.zeros(1, np.int64)
    ends = max(1, len(SENTENCE.findall(text)))
    marks = np.bincount(raw, minlength=128)
    return [
        np.log1p(n), np.log1p(nw), float(lengths.mean()), float(np.log1p(lengths.max())), float((lengths <= 3).mean()),
        len(set(words)) / max(1, nw), len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(nw / ends), float(lengths.std()),
        by[1], by[2], by[3], by[4], by[6], by[7], by[8], marks[33] / max(1, nw), marks[124] / max(1, nw), float(raw.max(initial=0) > 127),
    ]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in texts(batch.column(1))], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, STATISTICS)


def sum_of(rows: DataFrame, size: int, part) -> np.ndarray:
    """The sum over all rows of ``part(batch)``, an array of ``size`` doubles: by task, by group of tasks, on the driver."""

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["grp", "sums"])

    def by_group(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for data in table.column("sums").to_pylist():
            total += np.frombuffer(data)
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(by_task, "grp int, sums binary").groupBy("grp").applyInArrow(by_group, "sums binary").collect()
    return np.sum([np.frombuffer(bytes(r["sums"])) for r in sums] or [np.zeros(size)], axis=0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    calibrated: np.ndarray | None = None  # by bin of the raw score

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), np.linspace(LOW, HIGH, BINS), self.calibrated)


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing shares that fit ``positive / total`` best, by pooling neighbours; bins without rows are interpolated."""
    at = np.flatnonzero(total)
    blocks: list[list[float]] = []  # rows, positives, bins
    for i in at:
        blocks.append([total[i], positive[i], 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # a row of each class is added, so that no share is 0 or 1
    shares = np.repeat([(p + 0.5) / (n + 1) for n, p, _ in blocks], [int(k) for *_, k in blocks])
    return np.interp(np.arange(len(total)), at, np.maximum.accumulate(shares))


def fit(described: DataFrame, labels: DataFrame, fold: int = 5, out: int = 0) -> Model:
    """Learns ``quality`` of the labelled rows but for those whose crc32 of the id modulo ``fold`` is ``out``; the last remainder calibrates."""
    y = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    part = crc32_mod("doc_id", fold)
    rows = described.join(y.where(part != out), "doc_id").select("x", "y", (part == (out - 1) % fold).alias("apart"))
    rows = materialise(rows, "labelled")
    k = STATISTICS

    def moments(batch):
        x = matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = sum_of(rows, 1 + 2 * k, moments)
    n = max(1.0, sums[0])
    mean = sums[1 : 1 + k] / n
    scale = np.sqrt(np.maximum(sums[1 + k :] / n - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(7)
    model = Model(mean, scale, rng.normal(size=(k, FEATURES)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, FEATURES))
    if not sums[0]:
        return model
    d = FEATURES + 1

    def equations(batch):
        ours = ~np.asarray(batch.column(2).to_pylist(), bool)
        z, target = model.features(matrix(batch.column(0))[ours]), np.asarray(batch.column(1))[ours]
        return np.concatenate([(z.T @ z).ravel(), z.T @ target, [len(z)]])

    sums = sum_of(rows, d * d + d + 1, equations)
    gram = sums[: d * d].reshape(d, d) + RIDGE * max(1.0, sums[-1]) / FEATURES * np.eye(d)
    model.weights = np.linalg.solve(gram, sums[d * d : -1])
    every = not sums[-1] or sums[-1] == n  # too few rows to keep some apart

    def histogram(batch):
        apart = np.asarray(batch.column(2).to_pylist(), bool) | every
        at = np.clip(np.rint((model.raw(matrix(batch.column(0))[apart]) - LOW) / (HIGH - LOW) * (BINS - 1)), 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, np.asarray(batch.column(1))[apart], BINS)])

    sums = sum_of(rows, 2 * BINS, histogram)
    model.calibrated = isotonic(sums[:BINS], sums[BINS:])
    return model


def score(described: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return described.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, that score ``threshold`` or more; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in texts(batch.column(batch.schema.get_field_index("text")))]).reshape(-1, STATISTICS)
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
