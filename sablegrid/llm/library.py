"""Token ids as the tokenizers library gives them, at the speed of a cache of pieces.

The library encodes every distinct piece of a block once, as one pre-tokenized input; texts that
hold one of its special strings go to it whole. Pieces are what its own splitter makes of a text.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .bpe import PieceCache
from .flat import Texts
from .pretoken import chunks, spaced_pieces, word_pieces


class LibraryTokens:
    """Ids of whole texts by a tokenizers file of one of the two known splitters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = spec["pre_tokenizer"]["type"] == "Sequence"
        self.split = word_pieces if self.words else spaced_pieces
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cache = PieceCache(self._encode, self.dtype)
        self.plain: np.ndarray | None = None

    def _encode(self, pieces: Texts) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = pieces.bytes[: pieces.size].tobytes(), pieces.offsets.tolist()
        found = self.library.encode([raw[a:b].decode("utf-8") for a, b in zip(ends[:-1], ends[1:], strict=True)], is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.int64), np.bincount(np.array(found.word_ids, np.int64), minlength=pieces.rows)

    def _lowered(self) -> np.ndarray:
        """Of each code point, whether ``str.lower`` does what the library's normalizer does wherever it stands.

        The library is asked for each one by itself. Marks and jamo, which combine with their neighbours,
        the sigma, whose form depends on them, and what is beyond the tables are left to the library.
        """
        if self.plain is None:
            points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000 and not chr(c).isspace() and unicodedata.category(chr(c))[0] != "M"]
            chars = list(map(chr, points))
            found = self.library.normalizer.normalize_str(" ".join(chars)).split(" ")
            self.plain = np.zeros(0x110000, bool)
            if len(found) == len(chars):
                self.plain[[c for c, x, y in zip(points, chars, found, strict=True) if x.lower() == y]] = True
            for a, b in ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF), (0x3A3, 0x3A3)):
                self.plain[a : b + 1] = False
            self.plain[[9, 10, 11, 12, 13, 32]] = True  # white space ends a word however it is written
        return self.plain

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and each text's bounds among them."""
        texts = Texts(column)
        raw = texts.bytes[: texts.size].tobytes()
        odd: dict[int, np.ndarray] = {}
        if any(s.encode() in raw for s in self.special):
            listed = ["" if t is None else t for t in column.to_pylist()]
            for i, text in enumerate(listed):
                if any(s in text for s in self.special):
                    odd[i], listed[i] = self._whole(text), ""
            texts = Texts(listed)
        if self.words:
            normal = []
            for part in chunks(texts):  # parts of one long text, or all texts
                listed, ends = part.bytes[: part.size].tobytes(), part.offsets.tolist()
                points, _, bounds = part.code_points()
                plain = np.append(0, np.cumsum(self._lowered()[points]))[bounds]
                plain = np.diff(plain) == np.diff(bounds)
                given = (listed[a:b].decode("utf-8") for a, b in zip(ends[:-1], ends[1:], strict=True))
                normal += [t.lower() if own else self.library.normalizer.normalize_str(t) for t, own in zip(given, plain.tolist(), strict=True)]
            texts = Texts(normal if texts.rows == len(normal) else ["".join(normal)])
        ids, bounds = self.cache.tokens(texts, self.split)
        if odd:
            parts = [odd.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


@cache
def library_tokens(path: str) -> LibraryTokens:
    """One per worker and file."""
    return LibraryTokens(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append one id to every text's ids."""
    return np.insert(ids, bounds[1:], ids.dtype.type(end)), bounds + np.arange(len(bounds))
