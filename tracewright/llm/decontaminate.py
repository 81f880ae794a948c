"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Test items are short and documents long, so a signature of fixed length would miss what they share. Documents are
therefore partitioned by size, and partition p (up to 2**p shingles) gets 2**p bins: one-permutation MinHash keeps the
smallest shingle hash of each bin. A shared shingle is its bin's smallest with a chance of 0.63 or more, whatever
the document's length. Items that may be found by fewer than ``EXACT`` shared shingles would be missed by chance (one
of a single shingle in a third of all cases), so they are looked up among all of the document's shingle hashes, and none is
lost. For the others the bins' minima are enough: all of 32 shared shingles miss them once in 10**13 pairs.
Candidates are verified by counting their distinct shingles in the document, exactly, as strings.

Shingles that many items hold (a phrase that opens each of them) would bring every such item to every document with the
phrase. Of an item of n shingles, k of which must be found, any n - k + 1 hold one that is found, so an item of few shingles is
looked up by its n - k + 1 rarest alone, and nothing is lost; rare means in few items. A larger one leaves out half as many
of its most frequent, which still leaves dozens that must be shared.

Everything is DataFrame expressions: hashes, bins and minima are array functions on each row, so no document's shingle is
shuffled. A table is broadcast if it has ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` or less, measured first, and else
joined by shuffles.

Words are what white space separates, in lower case; a shingle is five words, a shorter text is one shingle. Defined cases:
a null or wordless text or item matches nothing; an item of under five words matches only a document that is the same
words; repeated rows count once in results, the best for an id that has several texts; rows of a null doc_id or item_id are found under null; empty tables give an empty result;
other columns are ignored, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, with_rows

WORDS, THRESHOLD = 5, 0.8
EXACT = 32
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
WHITE = "\t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Array of words; empty for null and wordless texts. White space becomes spaces first: splitting at one character needs no pattern."""
    bare = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for c in WHITE:
        bare = F.replace(bare, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(bare, " "), "")


def shingle_hashes(words: Column) -> Column:
    """Hashes of all shingles of an array of words, by hashes of the words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get("_hashed", i + k) for k in range(WORDS)]))
    return hashed, F.when(n >= WORDS, each).when(n > 0, F.array(F.xxhash64("_hashed"))).otherwise(F.array().cast("array<bigint>"))


def with_hashes(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``_words`` and ``_hashes`` (of all shingles, repeats included)."""
    rows = rows.withColumn("_words", words_of(F.col(text)))
    hashed, shingles = shingle_hashes(F.col("_words"))
    return rows.withColumn("_hashed", hashed).withColumn("_hashes", shingles).drop("_hashed")


def shingles_of(words: Column) -> Column:
    """The distinct shingles themselves."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(1), n - WORDS + 1), lambda i: F.array_join(F.slice(words, i, WORDS), " "))
    return F.when(n >= WORDS, F.array_distinct(each)).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def signature(hashes: Column) -> Column:
    """One-permutation MinHash: of the sorted hashes, the first of each bin, bins being the highest bits.

    The number of bits is the partition: the logarithm of the number of shingles, rounded up.
    """
    ordered = F.sort_array(hashes)
    bits = F.greatest(F.ceil(F.log2(F.greatest(F.size(hashes), F.lit(1)))), F.lit(1)).cast("int")
    return ordered, bits


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast, if a stored table is small: its rows are counted, and the bytes of its arrays."""
    wide = [c for c, kind in df.dtypes if kind.startswith("array<string")]
    size = sum((F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x) + 16) for c in wide), F.lit(64))
    held = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if held["n"] <= BROADCAST_ROWS and held["bytes"] <= BROADCAST_BYTES else df


def probes_of(items: DataFrame, threshold: float) -> DataFrame:
    """_key, _few, h: the hashes by which each item is looked up, the rarest among items first."""
    own = F.array_distinct("_hashes")
    rows = items.select("_key", F.size(own).alias("_n"), F.explode(own).alias("h"))
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("_c"))
    need = F.ceil(F.lit(threshold) * F.col("_n") - 1e-9)
    few = need <= EXACT - 1
    spare = F.when(few, need - 1).otherwise(F.floor((F.col("_n") - need) / 2))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_c", "h"))
    ranked = rows.join(common, "h").withColumn("_place", place).where(F.col("_place") <= F.col("_n") - spare)
    return ranked.select("_key", few.alias("_few"), "h")


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct doc_id, _key by MinHash, and by all hashes for items of few shingles; ``items`` has _key and _hashes."""
    probes = materialise(probes_of(items, threshold), "probes")
    rows = with_hashes(docs.select("doc_id", "text"), "text").select("doc_id", "_hashes")
    ordered, bits = signature(F.col("_hashes"))
    rows = rows.select("doc_id", ordered.alias("_h"), bits.alias("_bits"))
    shift = F.lit(64) - F.col("_bits")
    bin_of = lambda x: F.call_function("shiftright", x, shift)
    smallest = lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get("_h", i - 1)))
    if probes.where("_few").limit(1).count():
        kept = F.transform("_h", lambda x, i: F.struct(x.alias("h"), smallest(x, i).alias("least")))
    else:
        kept = F.transform(F.filter("_h", smallest), lambda x: F.struct(x.alias("h"), F.lit(True).alias("least")))
    # an outer explode: the inner one comes with a filter on the array's size, which would be pushed below the hashes and repeat them
    rows = rows.select("doc_id", F.explode_outer(kept).alias("_at")).select("doc_id", "_at.h", "_at.least")
    return rows.join(_small(probes), "h").where("_few OR least").select("doc_id", "_key").distinct()


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every pair that reaches the threshold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = with_hashes(items, "text").select("item_id", "_hashes", shingles_of(F.col("_words")).alias("_item")).where(F.size("_item") > 0)
    items = materialise(items.withColumn("_key", F.monotonically_increasing_id()), "items")  # ids may be null or repeated
    pairs = materialise(candidates(docs, items, threshold).groupBy("doc_id").agg(F.collect_set("_key").alias("_items")), "candidates").withColumnRenamed("doc_id", "_id")
    found = docs.join(_small(pairs), F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "_items", words_of(F.col("text")).alias("_words"))
    found = found.select("doc_id", "_items", shingles_of(F.col("_words")).alias("_doc"))
    each = found.select("doc_id", "_doc", F.explode("_items").alias("_key")).join(_small(items.select("_key", "item_id", "_item")), "_key")
    counted = each.select("doc_id", "item_id", F.size(F.array_intersect("_item", "_doc")).cast("long").alias("n_shared"), F.size("_item").cast("long").alias("n_shingles"))
    kept = counted.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles"))
    best = kept.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shared", "n_shingles"), F.col("n_shared") / F.col("n_shingles")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_shingles", F.round(F.col("m.n_shared") / F.col("m.n_shingles"), 6).alias("containment"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that contain no item. Each row is judged by its own text, whatever other rows of its id hold."""
    keyed, row = with_rows(docs, "rows")
    found = find(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, threshold)
    bad = materialise(found.select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return keyed.join(_small(bad), row, "left_anti").select(*docs.columns)


def oracle(threshold: float = THRESHOLD) -> str:
    """The pairs in DuckDB SQL, by all shingles of all documents."""
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
bs AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, round(count(*)::DOUBLE / n_shingles, 6) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= {threshold} * n_shingles"""
