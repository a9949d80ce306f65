"""Columnar text kernels: whole Arrow batches of strings handled as flat byte and code-point arrays.

Every kernel works on arrays over all texts of a batch at once, so the Python cost is per batch
and not per word. Batches are cut to a few MB, which bounds a worker's memory whatever a text's
neighbours are; a single longer text forms a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

BLOCK_BYTES = 2 << 20
U64 = np.uint64
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes at most in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


class Texts:
    """The texts of a batch as one buffer; nulls count as empty."""

    def __init__(self, column: pa.Array | list):
        if not isinstance(column, pa.Array):
            column = pa.array(column, pa.string())
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
        self.rows = len(column)
        self.offsets = off - off[0]
        self.size = int(self.offsets[-1])
        self.bytes = np.zeros(self.size + 32, np.uint8)
        self.bytes[: self.size] = raw

    @property
    def words8(self) -> np.ndarray:
        """The eight bytes from each position on, as one little-endian integer."""
        return np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))

    def code_points(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, each one's byte position (with the end), and each text's first code point."""
        data = self.bytes[: self.size]
        if not self.size or data.max() < 128:
            return data, np.arange(self.size + 1), self.offsets
        first = (data & 0xC0) != 0x80
        at = np.append(np.flatnonzero(first), self.size)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        return points, at, np.searchsorted(at, self.offsets)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0x9FB21C651E98DF25)
    return h ^ (h >> U64(32))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def hash_ranges(words8: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges; eight bytes a step."""
    left = lengths.astype(np.int64)
    h = _mix(left.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    h = _mix(h ^ (words8[starts] & _MASK[np.minimum(left, 8)]))
    more = np.flatnonzero(left > 8)
    step = 8
    while len(more):
        part = words8[starts[more] + step] & _MASK[np.minimum(left[more] - step, 8)]
        h[more] = _mix((h[more] * U64(0xFF51AFD7ED558CCD)) ^ part)
        step += 8
        more = more[left[more] > step]
    return h


def ascii_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and each text's first word."""
    data = texts.bytes[: texts.size]
    inside = np.zeros(texts.size + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    change = inside[1:] != inside[:-1]
    cut = np.zeros(texts.size + 1, bool)
    cut[texts.offsets] = True
    begins = np.flatnonzero(inside[1:] & (change | cut))
    ends = np.flatnonzero(inside[:-1] & (change | cut))
    return begins, ends, np.searchsorted(begins, texts.offsets)


def line_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines and each text's first line; an empty text has one empty line."""
    feeds = np.flatnonzero(texts.bytes[: texts.size] == 10)
    starts = np.concatenate([texts.offsets[:-1], feeds + 1])
    owner = np.concatenate([np.arange(texts.rows), np.searchsorted(texts.offsets, feeds, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.append(starts[1:] - 1, texts.size)
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = texts.offsets[1:][owner[last]]
    return starts, ends, np.searchsorted(owner, np.arange(texts.rows + 1))


@cache
def char_groups() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER of every code point, as the tokenizer libraries class it.

    Their Unicode tables are older than those of other packages, so the library itself is asked: an
    encoding of single bytes whose pattern is the class gives back the bytes of what it matches.
    """
    table = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    for pattern, group in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        matched = bytes(tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(everything))
        table[np.frombuffer(matched.decode("utf-8").encode("utf-32-le"), np.uint32)] = group
    return table


def expand(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``first, first+1, ...`` of the given counts."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(firsts - (ends - counts), counts)


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
