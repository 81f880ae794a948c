"""Token ids of whole texts by the tokenizers library, with a table of units that recur.

Encoding is the costly step, and most of a text is units seen before. Where a text is plain (no character
outside Latin letters, ASCII and a few signs, no special string), it falls apart at single spaces or
white space into units that this library's own pattern never joins. Splitting texts, numbering the distinct units of a batch and
putting their ids in the place of numbers are array operations; only distinct units are looked up in a table, one by one. A unit is
encoded once and its ids are kept; a new one is split by the vocabulary's pattern and its pieces are kept as well. New pieces go to
the library many at once, as one text that it splits at a mark which no piece can hold. Any other text goes to the
library whole. Ids come out the same; tests hold both ways together.
"""

from __future__ import annotations

import gc
import os
import re
import string
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: Anything else (other scripts, rare white space, combining marks, special strings) is encoded whole.
UNUSUAL = re.compile(r"[^\t\n\r -~¡-¬®-įı-ž]|<\|")
#: Bytes of texts that are plain for sure: ASCII, and letters of two bytes.
PLAIN = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
# The patterns by which the two kinds of vocabulary split text before merging.
PATTERNS = {
    "kept": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "dropped": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
CACHED_UNITS, CACHED_PIECES, CACHED_CHARS = 500_000, 350_000, 40
#: Parts new pieces, and says that a unit has no space before it: not a plain character, so no unit holds it.
MARK = "\0"
PIECES_AT_ONCE = 20_000
#: How byte-level vocabularies spell bytes: printable ones as themselves, others from 256 on, in order.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SELF)}
#: Line ends beside other white space belong to runs that must not be split.
RUNS = ("\n\n", "\n\t", "\n\r", "\t\n", "\r\n")


class UnitTokenizer:
    """``encode(texts)`` gives for each text its ids as little-endian unsigned 16- or 32-bit bytes.

    ``space`` says what the vocabulary does with white space: ``dropped`` (and letters in lower case) or ``kept``
    (a single space belongs to the word after it).
    """

    def __init__(self, path: str, space: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.space = space
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(PATTERNS[space]).findall
        self.merges = Tokenizer.from_file(path)  # the same model, for pieces that are split, in lower case and spelled already
        self.merges.no_padding()
        self.merges.no_truncation()
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Split(SPELLED[0], "isolated")
        (self.mark,) = self.merges.encode(SPELLED[0], add_special_tokens=False).ids
        self.pieces: dict[str, bytes] = {}

    def prepared(self, text: str) -> str | None:
        """A text that falls apart into units at spaces (or white space), or None for one that is encoded whole."""
        if "<|" in text or text.encode("utf-8", "surrogatepass").translate(None, PLAIN) and UNUSUAL.search(text) or not text.isascii() and ("\u0130" in text or "\u017f" in text):
            return None
        if self.space == "dropped":
            return text.lower()
        # a space before other white space belongs to a run that must not be split
        if not text or "  " in text or " \n" in text or " \t" in text or " \r" in text:
            return None
        if "\n" in text and not any(x in text for x in RUNS):
            text = text.replace("\n", " \n " + MARK)  # a single line end is a piece of its own
        return MARK + text

    def bare(self, unit: str) -> list[str]:
        """The pieces of a unit. Letters with marks after them, as most units are, need no pattern."""
        if unit == "\n":
            return [unit]
        space = ""
        if self.space == "kept":
            space, unit = ("", unit[1:]) if unit[:1] == MARK else (" ", unit)
        word = unit.rstrip(string.punctuation)
        if word.isalpha():
            return [space + word] if len(word) == len(unit) else [space + word, unit[len(word) :]]
        return self.split(space + unit)

    def raw(self, found: list[str]) -> list[bytes]:
        return self.packed(self.library.encode_batch_fast(found, add_special_tokens=False)) if found else []

    def packed(self, encoded: list) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        made = [array(kind, e.ids) for e in encoded]
        if sys.byteorder != "little":
            for a in made:
                a.byteswap()
        return [a.tobytes() for a in made]

    def merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of some pieces."""
        out: list[bytes] = []
        width = self.dtype.itemsize
        for i in range(0, len(pieces), PIECES_AT_ONCE):
            text = MARK.join(pieces[i : i + PIECES_AT_ONCE]).encode("utf-8", "surrogatepass").decode("latin-1").translate(SPELLED)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = [*(np.flatnonzero(ids == self.mark) * width).tolist(), len(ids) * width]
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(e + width for e in ends)], ends, strict=False)]
        return out

    def fresh(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units that aren't known yet; pieces and units are kept as long as there is room."""
        gc.disable()  # a great many short lists, none in a cycle
        try:
            parts = {u: self.bare(u) for u in units}
            pieces = self.pieces
            missing = list({p for own in parts.values() for p in own if p not in pieces})
            pieces.update(zip(missing, self.merged(missing), strict=True))
            out = {u: pieces[own[0]] if len(own) == 1 else b"".join([pieces[p] for p in own]) for u, own in parts.items()}
        finally:
            gc.enable()
        full = len(pieces) > CACHED_PIECES
        for p in missing:
            if full or len(p) > CACHED_CHARS:
                del pieces[p]
        if len(self.known) < CACHED_UNITS:
            self.known.update((u, b) for u, b in out.items() if len(u) <= CACHED_CHARS)
        return out

    def encode(self, found: list[str]) -> list[bytes]:
        ready = [self.prepared(x) for x in found]
        whole = iter(self.raw([x for x, p in zip(found, ready, strict=True) if p is None]))
        plain = iter(self.joined([p for p in ready if p is not None]))
        return [next(whole if p is None else plain) for p in ready]

    def joined(self, ready: list[str]) -> list[bytes]:
        """Ids of prepared texts: those of their units, one after another."""
        if not ready:
            return []
        texts = pa.array(ready, pa.large_string())
        parts = pc.split_pattern(texts, " ") if self.space == "kept" else pc.ascii_split_whitespace(texts)
        numbered = parts.flatten().dictionary_encode()
        units, number = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        own = list(map(self.known.get, units))
        missing = [u for u, b in zip(units, own, strict=True) if b is None]
        if missing:
            made = self.fresh(missing)
            own = [made[u] if b is None else b for u, b in zip(units, own, strict=True)]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // self.dtype.itemsize
        begins = np.cumsum(sizes) - sizes
        size = sizes[number]
        ends = np.cumsum(size)
        ids = np.frombuffer(b"".join(own), self.dtype)
        ids = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[number] - (ends - size), size)]
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(2)
def tokenizer(path: str, space: str) -> UnitTokenizer:
    """One for each worker process; it uses the worker's own core alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitTokenizer(path, space)
