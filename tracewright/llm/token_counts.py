"""Exact token counts at every prefix of a text, by dynamic programming, stored and then asked.

For a byte-pair encoding whose merges are ordered by priority, the encoding of a prefix is fixed by its last
token: the longest piece ``t`` that ends the prefix such that the last token before it and ``t``, merged
on their own, stay as they are. So ``count[i] = count[i - len(t)] + 1``, and ``last[i] = t``. Pieces of this
vocabulary never hold a space mark after another character, so a text falls into units (a run of spaces
and what follows up to the next space) that are encoded apart; tables of units are kept. A unit that ends in punctuation goes on
from the table of the word before it where no piece spans both.

A text's table is stored as ``steps``, a byte for each character: by how much its count differs from that of the prefix before
(a merge can lower it). Counts, limits and truncations are read off the stored steps, without the text.

Defined cases: null is the empty text, with no token and no steps; repeated rows get a row each; an empty table gives an
empty result; other columns are not touched. A unit of any length takes time in proportion to it.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, texts

UNIT = re.compile(" +[^ ]*")
MARK = "▁"
CACHED_UNITS, CACHED_WORDS, CACHED_CHARS = 600_000, 400_000, 40


class PrefixCounter:
    """Prefix tables under one sentencepiece BPE model; the model file gives the pieces and their priorities."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.priority = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.joined: dict[tuple[str, str], bool] = {}
        self.units: dict[str, bytes] = {}  # steps of units
        self.words: dict[str, tuple[bytes, str]] = {}  # steps of words and the last token
        #: pieces that their own text is encoded as; only these can be tokens
        self.whole = {p for p in self.priority if len(p) == 1 or self.merge(p) == [p]}
        tails: dict[str, set[int]] = {}
        for piece in self.whole:
            if len(piece) > 1:
                tails.setdefault(piece[-2:], set()).add(len(piece))
        self.tails = {c: tuple(sorted(n, reverse=True)) for c, n in tails.items()}  # lengths of pieces by their last two characters
        self.pairs = {p[i : i + 2] for p in self.whole for i in range(len(p) - 1)}

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text (spaces written as marks), by its definition: best pair first, leftmost among equals."""
        pieces = list(text)
        while True:
            best, at = None, -1
            for i in range(len(pieces) - 1):
                score = self.priority.get(pieces[i] + pieces[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return pieces
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]

    def stays(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay as they are when both are encoded together."""
        key = (left, right)
        known = self.joined.get(key)
        if known is None:
            if len(self.joined) > 400_000:
                self.joined.clear()
            known = self.joined[key] = self.merge(left + right) == [left, right]
        return known

    def extend(self, text: str, before: str = "") -> tuple[bytes, str]:
        """Steps of a text that is encoded after the token ``before`` (no piece spans both), and its last token. A character without a piece costs its bytes."""
        whole, tails, joined = self.whole, self.tails.get, self.joined
        count, last, steps = [0], [before], bytearray()
        for end, final in enumerate(text, 1):
            for n in tails(text[end - 2 : end], ()):  # none at the first character
                if n <= end and (piece := text[end - n : end]) in whole:
                    left = last[end - n]
                    if not left or (joined[left, piece] if (left, piece) in joined else self.stays(left, piece)):
                        now = count[end - n] + 1
                        break
            else:
                piece = final
                now = count[-1] + (1 if final in whole else len(final.encode("utf-8", "surrogatepass")))
            steps.append((now - count[-1]) & 255)
            count.append(now)
            last.append(piece)
        return bytes(steps), last[-1]

    def word(self, word: str) -> tuple[bytes, str]:
        """Steps of a space and a word, and the last token."""
        found = self.words.get(word)
        if found is None:
            found = self.extend((" " + word).replace(" ", MARK))
            if len(word) <= CACHED_CHARS and len(self.words) < CACHED_WORDS:
                self.words[word] = found
        return found

    def unit(self, unit: str) -> bytes:
        """Steps of a space and a unit (given without it). Once the table is full, units new to it are worked out each time."""
        steps = self.units.get(unit)
        if steps is None:
            word = unit.rstrip(string.punctuation)
            if word and word[-1] != " " and len(word) < len(unit) and word[-1] + unit[len(word)] not in self.pairs:
                steps, last = self.word(word)
                steps += self.extend(unit[len(word) :], last)[0]
            else:
                steps = self.word(unit)[0]
            if len(unit) <= CACHED_CHARS and len(self.units) < CACHED_UNITS:
                self.units[unit] = steps
        return steps

    def steps(self, text: str) -> bytes:
        """Signed bytes: one for the space mark that is put before a text, and one for each character. Empty for the empty text."""
        if not text:
            return b""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join([self.unit(x[1:]) for x in UNIT.findall(" " + text)])
        parts = text.split(" ")  # the same units; single spaces need no pattern
        known = list(map(self.units.get, parts))
        if None in known:
            known = [self.unit(p) if s is None else s for p, s in zip(parts, known, strict=True)]
        return b"".join(known)

    def table(self, text: str) -> np.ndarray:
        """Token counts of ``text[:i]`` for every i from 0 to its length."""
        return counts(self.steps(text))


def counts(steps: bytes) -> np.ndarray:
    """The table that steps stand for: 0 for the empty prefix, then the count at every character."""
    made = np.cumsum(np.frombuffer(steps or b"\0", np.int8), dtype=np.int64)
    made[0] = 0  # the mark alone is no prefix of the text
    return made


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_tables(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and ``steps`` of every row; one pass, no shuffle."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in slices(batches, 2000):
            found = texts(batch.column(1))
            columns = [batch.column(0), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in found], pa.int64()), pa.array([c.steps(x) for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "steps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(fill, "doc_id long, n_bytes long, steps binary")


def ask(tables: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_chars_kept (the longest prefix of at most ``limit`` tokens), read off stored tables."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            total, kept = [], []
            for steps in batch.column(2).to_pylist():
                n = int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))
                total.append(n)
                kept.append(max(0, len(steps) - 1) if n <= limit else int(np.flatnonzero(counts(steps) <= limit)[-1]))
            columns = [batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_()), pa.array(kept, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars_kept"])

    return tables.select("doc_id", "n_bytes", "steps").mapInArrow(answer, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chars_kept long")


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Stores the prefix tables of all rows in the shared folder and asks them."""
    return ask(materialise(prefix_tables(docs, model_path), "prefix-tables", compression="zstd"), limit)
