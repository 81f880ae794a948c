"""Language identification by compression.

For each language a raw-content zstandard dictionary is taken from a bounded sample of labelled texts. A text is
encoded with each dictionary, in blocks so that the dictionary stays useful to the end of a long text, and the language
of the smallest encoding wins. ``accepted`` is false where the margin over the second best is narrow, and for
``und``.

Bound of the fit: about ``SAMPLE_DOCS`` documents a language, by a hash of id and text (rows that repeat both are drawn
once), and of each no more than a dictionary holds, ``DICTIONARY_BYTES``.
Defined cases: null or letterless text is ``und`` with score 0; rows without a language aren't learned from;
ties go to the first language by name, with score 0; one language only: score 1; none: ``und``. Repeated rows repeat; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE_DOCS = 64
DICTIONARY_BYTES = 112 << 10
BLOCK = 4096
LEVEL = 6  # of compression, for every text
#: A margin is narrow under this share of the second best size, or under so many bytes.
NARROW, NARROW_BYTES = 0.003, 1
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case, a space apart: marks and digits are of no language."""
    return OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language from rows with doc_id, text and a non-null lang."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * SAMPLE_DOCS / n)))])
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text", F.lit("dictionary")), F.lit(1 << 30))
    drawn = rows.select("lang", draw.alias("draw"), "doc_id", F.substring("text", 1, DICTIONARY_BYTES).alias("text")).where(F.col("draw") < F.try_element_at(share, "lang") * (1 << 30))
    picked = drawn.groupBy("lang", "draw").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("lang", "draw", "r.*").collect()
    out: dict[str, bytes] = {}
    for row in sorted(picked, key=lambda r: (r["lang"], r["draw"], r["doc_id"] or 0)):
        known = out.get(row["lang"], b"")
        if len(known) < DICTIONARY_BYTES:
            out[row["lang"]] = (known + b" " + letters(row["text"]))[:DICTIONARY_BYTES]
    return {k: v for k, v in sorted(out.items()) if len(v) >= 8}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.coders = [self.coder(dictionaries[name], LEVEL) for name in self.names]

    @staticmethod
    def coder(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1, from the margin) and whether the margin is wide enough."""
        if text is None or not self.names or not LETTER.search(text):
            return UNDETERMINED, 0.0, False
        raw = letters(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), i) for i, c in enumerate(self.coders))
        if len(sizes) == 1:
            return self.names[0], 1.0, True
        best, second = sizes[0][0], sizes[1][0]
        margin = (second - best) / second
        return self.names[sizes[0][1]], margin / (margin + 0.02), margin >= NARROW and second - best >= NARROW_BYTES


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(dictionaries)
        for batch in slices(batches):
            found = [c.judge(x) for x in batch.column(1).to_pylist()]
            kinds = [pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows, with all their columns, whose language is accepted."""

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(dictionaries)
        for batch in slices(batches):
            text = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([c.judge(x)[2] for x in text], pa.bool_()))

    return docs.mapInArrow(verdicts, docs.schema)
