"""Near-duplicates by 64-bit fingerprints, with pivot distance tables.

Fingerprints of equal value become one class. Two classes that differ in few bits agree on at least ``AGREE`` of
``BLOCKS`` blocks of bits, so for each choice of blocks the classes that agree on them form a bucket; nothing is lost and
random classes hardly meet. In a bucket, a table holds each member's Hamming distances to many reference
fingerprints (the pivots). By the triangle inequality two members whose entries differ by more than the limit at any
pivot cannot link; what the table leaves is verified bit by bit. A bucket yields its connected groups as stars, one row
for a member, never its pairs. Components come from alternating large and small stars over tables in the shared folder.

Defined cases: null text is the empty text; a text without words has fingerprint zero and links like any other; a
null doc_id gets its component's smallest id, null if it has none; repeated rows repeat; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices, with_rows

BLOCKS, AGREE = 6, 3
WIDTHS = (11, 11, 11, 11, 10, 10)
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(24)], np.uint64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)  # by byte, lowest bit first


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one whole text, unsigned."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[min(words, len(found)) - 1 :], strict=False)]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((raw + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row, and the column ``key`` if named."""
    kept = [] if key is None else [key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *kept])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {k} long" for k in kept))


def masks(limit: int) -> list[int]:
    """One mask for each choice of blocks that must agree, as signed longs."""
    if limit > BLOCKS - AGREE:
        raise ValueError(f"links of at most {BLOCKS - AGREE} differing bits are found by these blocks")
    at = [sum(WIDTHS[:i]) for i in range(BLOCKS)]
    whole = [((1 << w) - 1) << a for w, a in zip(WIDTHS, at, strict=True)]
    return [int(np.array(sum(whole[i] for i in c), np.uint64).view(np.int64)) for c in combinations(range(BLOCKS), AGREE)]


def stars(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """(member, head) for every member of a bucket that links to others in it; heads are the smallest of their group."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        group, ahead, left = [int(left[0])], [int(left[0])], left[1:]
        while ahead and len(left):
            i = ahead.pop()
            near = left[np.abs(table[left, 0] - table[i, 0]) <= limit]
            near = near[(np.abs(table[near] - table[i]) <= limit).all(1)]
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= limit]
            if len(near):
                group += near.tolist()
                ahead += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
        if len(group) > 1:
            own = fps[group].view(np.int64)
            head = int(own.min())
            out += [(int(x), head) for x in own if x != head]
    return out


def links(classes: DataFrame, limit: int = 3) -> DataFrame:
    """u, v (u > v): stars that connect what links, from a table of distinct fingerprints ``fp``."""
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(limit)])).alias("choice", "key"))
    ordered = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp").select("choice", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def emit(choice, key, fp, last: bool):
            """Links of the runs that are complete, and what is kept for the next batch."""
            cut = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate([[0], cut, [len(fp)]])
            if not last:
                bounds = bounds[:-1]
            begin, size = bounds[:-1], np.diff(bounds)
            out = []
            two = begin[size == 2]
            a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            near = np.ones(len(two), bool)
            for pivot in PIVOTS:
                near &= np.abs(np.bitwise_count(a ^ pivot).astype(np.int8) - np.bitwise_count(b ^ pivot).astype(np.int8)) <= limit
            a, b = a[near], b[near]
            near = np.bitwise_count(a ^ b) <= limit
            out += zip(b[near].view(np.int64).tolist(), a[near].view(np.int64).tolist(), strict=True)  # sorted: a < b
            for i, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                out += stars(fp[i : i + n].view(np.uint64), limit)
            keep = 0 if last else int(bounds[-1])
            made = pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["u", "v"])
            return made, [x[keep:] for x in (choice, key, fp)]

        for batch in batches:
            now = [np.concatenate([h, np.asarray(batch.column(i)).astype(np.int64)]) for i, h in enumerate(held)]
            if len(now[0]):
                made, held = emit(*now, last=False)
                yield made
        if len(held[0]):
            yield emit(*held, last=True)[0]

    return ordered.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node that is no root, from edges u, v."""
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v")))
        before, now = now, materialise(small.distinct(), "edges")
        discard(before)
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = sums
    raise RuntimeError(f"components didn't settle in {rounds} rounds")  # they take about log(n) squared rounds; nothing is returned, so nothing is lost


def cluster(docs: DataFrame, limit: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row."""
    prints = materialise(fingerprints(docs), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes.select("fp"), limit))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(grouped.join(smallest, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, limit: int = 3) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id (if rows repeat it, the one whose text sorts first).

    Rows are told apart by a key of their own, not by doc_id: rows that share an id, or have none, stay if their texts
    aren't linked. A group without any id keeps the row whose text sorts first. What is compared, joined and
    shuffled are keys and fingerprints; texts are read once for the fingerprints, once for ties, and once for the result.
    """
    keyed, row = with_rows(docs, "rows")
    prints = materialise(fingerprints(keyed, row).withColumnRenamed(row, "_row"), "fingerprints")
    classes = materialise(prints.select("fp").distinct(), "classes")
    roots = components(links(classes, limit)).withColumnRenamed("node", "fp")
    member = materialise(prints.join(roots, "fp", "left").select("_row", "doc_id", F.coalesce("root", "fp").alias("root")), "members")
    by_id = member.groupBy("root", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_row"))
    head = by_id.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "n", "_row")).alias("h"))
    head = materialise(head.select("root", "h.*"), "heads")
    kept, tied = head.where("n = 1").select("_row"), head.where("n > 1").select("root", F.col("doc_id").alias("_id"))
    if tied.limit(1).count():
        # only the rows that share the smallest id of their group need their texts
        own = member.join(tied, "root").where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("root", "_row")
        texts = own.join(keyed.select(F.col(row).alias("_row"), "text"), "_row")
        kept = kept.unionByName(texts.groupBy("root").agg(F.min(F.struct("text", "_row")).alias("m")).select("m._row"))
    kept = materialise(kept.withColumnRenamed("_row", row), "kept")
    # keys are hashed, so texts are dealt but not sorted
    return keyed.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
