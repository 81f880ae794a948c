"""A log-bilinear language model, trained in numpy with noise-contrastive estimation.

Tokens are grouped in classes: each of the ``HEAD`` most frequent training tokens is one, all others fall in
``TAIL`` classes by their last byte. The model predicts the class of a token from the two before it, as a product of
context and target vectors; a token of a tail class then has its smoothed share of the class. So

    P(token | context) = softmax(h(context) Q' + b)[class] * share(token in class)

sums to one over all tokens, one for the unseen included. Training covers every training document: each task runs
noise-contrastive steps over its documents from the same start, and the results are averaged by tokens, for ``ROUNDS`` rounds.
Normalising terms of all pairs of context classes come from batched matrix products, on the driver, and have a fixed size.

Counts of all training tokens are kept in a table. The ``KNOWN`` most frequent (a fixed number) are sent to every
task; other tokens of a document are looked up by a join, which no frequent token takes part in.

Words are lower-cased in A-Z and separated by ASCII white space; each document ends with one end token. Defined
cases: null text is the empty text, one end token; without training documents N is 0 and every token is unseen; a null doc_id
is held out; repeated rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter  # noqa: F401 - tests count with it
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, materialise, slices

END = b"\n"  # no word holds white space
HEAD, KNOWN = 384, 1 << 17
TAIL = 36
DIMENSIONS, BATCH, NOISE, ROUNDS, RATE = 20, 4096, 48, 2, 0.15
GROUPS = 32
FLUSH = 400_000
UNSEEN = -1

_TAIL_OF = np.zeros(256, np.int64)  # by last byte: letters, digits, full stop, comma, other marks; beyond ASCII by its low bits
for _c in range(256):
    _TAIL_OF[_c] = _c - 97 if 97 <= _c <= 122 else 26 if 48 <= _c <= 57 else 27 if _c == 46 else 28 if _c == 44 else 29 if _c < 128 else 30 + _c % 6


@dataclass
class Tokens:
    """The tokens of some documents one after another, each with its end token: places in ``distinct``, and where documents begin."""

    distinct: pa.Array  # binary, the end token last
    at: np.ndarray
    bounds: np.ndarray  # one more than there are documents


_BYTES = pa.array([bytes([c]) for c in range(256)], pa.binary())


def tokenised(column: pa.Array) -> Tokens:
    """The lower-cased words of each text, and ends, found in Arrow: Python holds no string of them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    encoded = lists.flatten().dictionary_encode()
    place, owner = encoded.indices.to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy()
    distinct = encoded.dictionary.cast(pa.binary())
    inside = (pc.binary_length(distinct).to_numpy(zero_copy_only=False) > 0)[place]  # white space at the ends of a text leaves empty words
    place, owner = place[inside], owner[inside]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(column)) + 1)])
    at = np.full(bounds[-1], len(distinct), np.int64)
    at[np.arange(len(place)) + owner] = place
    return Tokens(pa.concat_arrays([distinct, pa.array([END], pa.binary())]), at, bounds)


def count_tokens(training: DataFrame) -> DataFrame:
    """word (binary) and n of every token of the training texts: counted in tasks first, then summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> pa.Table:
            made = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return made.select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in slices(batches, 512):
            t = tokenised(batch.column(0))
            times = np.bincount(t.at, minlength=len(t.distinct))
            used = pa.array(np.flatnonzero(times))
            held.append(pa.table({"word": t.distinct.take(used), "n": pa.array(times).take(used)}))
            rows += len(used)
            if rows > 2 * FLUSH:
                held = [summed()]
                rows = held[0].num_rows
                if rows > FLUSH:
                    yield from held.pop().to_batches()
                    rows = 0
        if held:
            yield from summed().to_batches()

    return training.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows: the most frequent tokens, and totals."""

    known: dict  # token: number, by falling count
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    class_tokens: np.ndarray  # of all training tokens, by class
    class_distinct: np.ndarray
    least: int  # count of known tokens but for the end token: all others have less
    classes: np.ndarray = field(default=None)  # of known tokens
    keys: pa.Array = field(default=None)  # known tokens in Arrow, made where they are looked up

    @property
    def end(self) -> int:
        return HEAD + TAIL  # the end token's own class

    def numbers(self, found: pa.Array) -> np.ndarray:
        """A number for each word: of a known token, or -1 - class of its tail (of any, if the word is empty)."""
        if self.keys is None:
            self.keys = pa.array(list(self.known), pa.binary())
        number = pc.fill_null(pc.index_in(found, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        others = np.flatnonzero(number < 0)
        last = pc.fill_null(pc.index_in(pc.binary_slice(found.take(pa.array(others)), -1), value_set=_BYTES), 0)
        number[others] = -1 - (HEAD + _TAIL_OF[last.to_numpy(zero_copy_only=False)])
        return number


def summarise(counted: DataFrame) -> Vocabulary:
    """From the stored table of counts. What reaches the driver has a fixed bound: ``KNOWN`` tokens, the end token, and a row for each class.

    The least count of a known token is read off a histogram of counts by steps of an eighth of a power of two, and where a
    step would hold too many, off the counts of that step, so nothing is sorted. Tokens of one count are all known or none.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    by_step = {r["step"]: r["k"] for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 8 * 64 rows at most
    held, least = 0, 1
    for at in sorted(by_step, reverse=True):
        if held + by_step[at] > KNOWN:
            w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
            counts = counted.where(step == at).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
            # a step of counts up to 2**20 has under 100,000 different ones; beyond, KNOWN tokens of such counts would make 2**37 in all
            least = counts.withColumn("upto", F.sum("k").over(w)).where(F.col("upto") <= KNOWN - held).agg(F.min("n")).first()[0]
            if least is None:  # no count of this step fits: what lies above it
                least = counted.where(step > at).agg(F.min("n")).first()[0]
            if least is None:
                least = 1 << 62
            break
        held += by_step[at]
    top = sorted(counted.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    known = {bytes(r["word"]): i for i, r in enumerate(top)}
    counts = np.array([r["n"] for r in top], np.int64)
    if END not in known:  # nothing to learn from
        known[END], counts = len(known), np.append(counts, 0)
    classes, heads = np.zeros(len(known), np.int64), 0
    for word, i in known.items():
        if word == END:
            classes[i] = HEAD + TAIL
        elif heads < HEAD:
            classes[i], heads = heads, heads + 1
        else:
            classes[i] = HEAD + _TAIL_OF[word[-1]]
    size = HEAD + TAIL + 1
    tokens, distinct = np.zeros(size), np.zeros(size)
    last = F.expr("CAST(conv(hex(substring(word, -1, 1)), 16, 10) AS INT)")
    for r in counted.groupBy(last.alias("last")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        tokens[HEAD + _TAIL_OF[r["last"]]] += r["n"]
        distinct[HEAD + _TAIL_OF[r["last"]]] += r["k"]
    total, v = int(tokens.sum()), int(distinct.sum())
    for word, i in known.items():  # heads and the end token leave the class of their last byte
        if counts[i] and (classes[i] < HEAD or classes[i] == HEAD + TAIL):
            old = HEAD + _TAIL_OF[word[-1]]
            tokens[old] -= counts[i]
            distinct[old] -= 1
            tokens[classes[i]], distinct[classes[i]] = counts[i], 1
    return Vocabulary(known, counts, total, v, tokens, distinct, least, classes)


def class_stream(t: Tokens, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents one after another: token numbers, their classes, and the classes one and two tokens before (end before a start)."""
    own = v.numbers(t.distinct)
    number, classes = own[t.at], np.where(own >= 0, v.classes[np.maximum(own, 0)], -1 - own)[t.at]
    classes[t.bounds[1:] - 1] = v.end
    one = np.concatenate([[v.end], classes[:-1]])
    two = np.concatenate([[v.end], one[:-1]])
    two[one == v.end] = v.end
    return number, classes, one, two


class Model:
    """Vectors of contexts (two places) and targets, and biases."""

    def __init__(self, size: int, bias: np.ndarray):
        rng = np.random.default_rng(11)
        self.near, self.far = (rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32) for _ in range(2))
        self.target, self.bias = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32), bias.astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.near, self.far, self.target, self.bias)]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Model:
        out, at = object.__new__(Model), 0
        for name in ("near", "far", "target", "bias"):
            shape = getattr(self, name).shape
            n = int(np.prod(shape))
            setattr(out, name, flat[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return out

    def log_normalisers(self) -> np.ndarray:
        """log of the sum over all classes, for every pair (near, far) of context classes: one matrix product for each far class."""
        table = np.empty((len(self.bias), len(self.bias)), np.float32)
        for far in range(len(self.bias)):
            s = (self.near + self.far[far]) @ self.target.T + self.bias
            top = s.max(1, keepdims=True)
            table[:, far] = np.log(np.exp(s - top).sum(1)) + top[:, 0]
        return table

    def log_probability(self, word, one, two, normalisers) -> np.ndarray:
        h = self.near[one] + self.far[two]
        return np.einsum("ij,ij->i", h, self.target[word]) + self.bias[word] - normalisers[one, two]


class Trainer:
    """Noise-contrastive steps with a rate that adapts to each parameter."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.noise, self.log_noise = noise, np.log(noise * NOISE).astype(np.float32)
        self.cumulated = np.cumsum(noise)
        self.space = np.empty((0, NOISE), np.float32)  # kept from step to step: large arrays made anew cost more than what is done in them
        self.squares = {k: np.full(getattr(model, k).shape, 1e-4, np.float32) for k in ("near", "far", "target", "bias")}

    def add(self, name: str, at: np.ndarray, rows: np.ndarray) -> None:
        """One adaptive step by gradients ``rows`` of the parameters ``at``, summed where they repeat."""
        values = getattr(self.m, name)
        if rows.ndim == 1:
            g = np.bincount(at, rows, len(values)).astype(np.float32)
        else:
            d = rows.shape[1]
            g = np.bincount((at[:, None] * d + np.arange(d)).ravel(), rows.ravel(), values.size).reshape(values.shape).astype(np.float32)
        self.squares[name] += g * g
        values -= RATE * g / np.sqrt(self.squares[name])

    def step(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.m, np.float32(1 / len(word))
        drawn = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1]), len(self.noise) - 1)
        h = m.near.take(one, 0)
        h += m.far.take(two, 0)
        own, other = m.target.take(word, 0), m.target[drawn]
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, own) + m.bias[word] - self.log_noise[word]))  # 1 - P(data)
        if len(self.space) < len(word):
            self.space = np.empty((len(word), NOISE), np.float32)
        down = np.matmul(h, other.T, out=self.space[: len(word)])
        down += m.bias[drawn]
        down -= self.log_noise[drawn]
        np.exp(np.negative(down, out=down), out=down)
        down += 1
        np.divide(1, down, out=down)  # P(data) of noise
        gh = (down @ other - up[:, None] * own) * n
        at = np.concatenate([word, drawn])
        self.add("target", at, np.concatenate([-up[:, None] * h, down.T @ h]) * n)
        self.add("bias", at, np.concatenate([-up, down.sum(0)]) * n)
        self.add("near", one, gh)
        self.add("far", two, gh)


def train(training: DataFrame, v: Vocabulary) -> Model:
    """Rounds of local training on every task's documents and averaging, weighted by tokens, in groups of tasks and then here."""
    noise = (v.class_tokens + 1) / (v.class_tokens + 1).sum()
    model = Model(len(noise), np.log(noise))
    if not v.total:
        return model
    spark, size = training.sparkSession, len(model.flat())
    shared = spark.sparkContext.broadcast(v)

    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(model.flat())

        def local(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            vocabulary, task = shared.value, TaskContext.get().partitionId()
            trainer = Trainer(model.load(start.value), noise, 1000 * turn + task)
            tokens = 0
            for batch in slices(batches, 512):
                _, word, one, two = class_stream(tokenised(batch.column(0)), vocabulary)
                order = trainer.rng.permutation(len(word))
                for part in np.array_split(order, max(1, len(word) // BATCH)):
                    trainer.step(word[part], one[part], two[part])
                tokens += len(word)
            sums = np.append(trainer.m.flat() * tokens, tokens)
            yield pa.RecordBatch.from_arrays([pa.array([task % GROUPS], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["grp", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(size + 1)
            for data in table.column("sums").to_pylist():
                total += np.frombuffer(data)
            return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

        made = training.select(F.col("text").cast("string")).mapInArrow(local, "grp int, sums binary").groupBy("grp").applyInArrow(add, "sums binary").collect()
        total = np.sum([np.frombuffer(bytes(r["sums"])) for r in made], axis=0)
        model = model.load(total[:-1] / max(1.0, total[-1]))
    return model


def score(docs: DataFrame, v: Vocabulary, counted: DataFrame, model: Model, held: str = "held_out") -> DataFrame:
    """Each row of doc_id, text, held_out with n_tokens, n_known, train_tokens, base_score, score.

    A task emits a row for each document and one for each of its rarer words; the latter meet their counts in a join on the
    word and everything meets again by document. Rows of documents carry a key that no word can be, so they spread evenly.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((v, model, model.log_normalisers()))
    base_total = np.log10(v.total + 0.5 * (v.distinct + 1))
    tail_total = np.log10(v.class_tokens + 0.5 * (v.class_distinct + 1))
    size = HEAD + TAIL + 1
    fields = [("word", pa.binary()), ("key", pa.int64()), ("times", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, m, normalisers = shared.value
        key = TaskContext.get().partitionId() << 33
        log_counts, seen = np.log10(vocabulary.counts + 0.5), (vocabulary.counts > 0).astype(np.int64)
        tailed = (np.arange(size) >= HEAD) & (np.arange(size) != vocabulary.end)
        for batch in slices(batches):
            t = tokenised(batch.column(1))
            number, word, one, two = class_stream(t, vocabulary)
            inside = number >= 0
            own = np.where(inside, log_counts[np.maximum(number, 0)], 0.0)
            within = np.where(tailed[word], own - tail_total[word], 0.0)
            logs = m.log_probability(word, one, two, normalisers) / np.log(10) + within
            sums = [np.add.reduceat(x, t.bounds[:-1]) for x in (seen[np.maximum(number, 0)] * inside, own - base_total, logs)]
            rare = np.flatnonzero(~inside)
            owner = np.searchsorted(t.bounds, rare, "right") - 1
            pairs, times = np.unique(owner * len(t.distinct) + t.at[rare], return_counts=True)
            n, k = batch.num_rows, len(pairs)
            keys = key + np.arange(n)
            marks = pa.array([b"\xff" + i.to_bytes(8, "big") for i in keys.tolist()], pa.binary())
            columns = [
                pa.concat_arrays([marks, t.distinct.take(pa.array(pairs % len(t.distinct)))]),
                pa.array(np.concatenate([keys, key + pairs // len(t.distinct)])),
                pa.array(np.concatenate([np.zeros(n, np.int64), times])),
            ]
            whole = [batch.column(0), batch.column(2), pa.array(np.diff(t.bounds)), *map(pa.array, sums)]
            columns += [pa.concat_arrays([x.cast(kind), pa.nulls(k, kind)]) for x, (_, kind) in zip(whole, fields[3:], strict=True)]
            key += n
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])

    schema = "word binary, key long, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(held).alias("held_out")).mapInArrow(run, schema)
    joined = rows.join(counted.where(F.col("n") < v.least), "word", "left")
    gain = F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5))
    seen = F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))
    first = {name: F.max(name).alias(name) for name in ("doc_id", "held_out", "n_tokens", "n_known", "base", "score")}
    whole = joined.groupBy("key").agg(*first.values(), gain.alias("gain"), seen.alias("seen"))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("seen")).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("gain")).alias("base_score"),
        (F.col("score") + F.col("gain")).alias("score"),
    )


def score_documents(docs: DataFrame, fold: int = 5, out: int = 1) -> DataFrame:
    """Learns from the documents whose crc32 of the id modulo ``fold`` isn't ``out``, and scores all."""
    marked = docs.select("doc_id", "text", held_out("doc_id", fold, out).alias("held_out"))
    training = marked.where(~F.col("held_out")).select("text")
    counted = materialise(count_tokens(training), "token-counts")
    v = summarise(counted)
    return score(marked, v, counted, train(training, v))
