"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a block of documents form the corpus. An inverted index holds, for every
mergeable token pair, the positions where it stands. Merges are replayed in rank order: each takes
all its positions at once, rewrites them, and looks up only the pairs with the touched neighbours,
which enter the index in turn. Pieces met before come from a bounded cache, so the corpus of a task
is what its documents add to it. Documents stay where they are: nothing is shuffled, and memory is
bounded by a block and the cache, whatever the input's size or skew. A text longer than a block is
cut where a piece surely begins; only a piece that is itself longer is held whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .flat import BLOCK_BYTES, U64, Texts, _mix, blocks, expand, hash_ranges
from .pretoken import chunks, spaced_pieces

NONE = 1 << 40
CACHE_PIECES = 1_500_000
DECODED = 1 << 20  # ids that are decoded at a time


class PairTable:
    """Open-addressing table from a token pair to (rank, merged token), looked up for whole arrays."""

    BITS = 20

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        size = 1 << self.BITS
        if 2 * len(left) > size:
            raise ValueError(f"{len(left)} pairs are too many for the table")
        self.keys = np.full(size, np.uint64(2**64 - 1), U64)
        self.rank = np.full(size, NONE, np.int64)
        self.merged = np.full(size, -1, np.int64)
        keys = (left.astype(U64) << U64(32)) | right.astype(U64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.rank[slots], self.merged[slots] = keys[put], rank[put], merged[put]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs, -1 where a pair never merges."""
        keys = (left.astype(U64) << U64(32)) | right.astype(U64)
        at = self._slot(keys)
        seen = self.keys[at]
        todo = np.flatnonzero((seen != keys) & (seen != np.uint64(2**64 - 1)))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.BITS) - 1)
            seen[todo] = self.keys[at[todo]]
            todo = todo[(seen[todo] != keys[todo]) & (seen[todo] != np.uint64(2**64 - 1))]
        return np.where(seen == keys, at, -1)


class Ranks:
    """A vocabulary of byte strings whose rank is their id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank, rank)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.of_byte < 0).any():
            raise ValueError("a byte-level vocabulary needs all 256 bytes")

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as file:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})

    def one(self, piece: bytes) -> list[int]:
        """The plain definition, for one piece: merge the leftmost pair of lowest rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, pieces: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct pieces: all ids, and each piece's number of them."""
        n, table = pieces.size, self.pairs
        token = self.of_byte[pieces.bytes[:n]]
        owner = np.repeat(np.arange(pieces.rows), np.diff(pieces.offsets))
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        full = np.diff(pieces.offsets) > 0
        after[pieces.offsets[1:][full] - 1] = -1
        before[pieces.offsets[:-1][full]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int64)
        merged = np.full(n, -1, np.int64)
        odd: set[int] = set()
        touched = np.zeros(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def look(at: np.ndarray, done: int) -> None:
            """Find the pairs that begin at these positions and enter them into the index."""
            rank[at] = NONE
            at = at[after[at] >= 0]
            slot = table.find(token[at], token[after[at]])
            at, slot = at[slot >= 0], slot[slot >= 0]
            ranks = table.rank[slot]
            rank[at], merged[at] = ranks, table.merged[slot]
            if done >= 0 and len(ranks) and ranks.min() < done:
                odd.update(owner[at[ranks < done]].tolist())
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for positions in np.split(at, cuts) if len(at) else []:
                r = int(rank[positions[0]])
                if r not in index:
                    heapq.heappush(queue, r)
                    index[r] = []
                index[r].append(positions)

        look(np.arange(n), -1)
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            at = at[alive[at] & (rank[at] == r)]
            if len(lists) > 1:
                at = at[np.append(True, at[1:] != at[:-1])[: len(at)]]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # runs of one token: every second pair
                keep, last = np.ones(len(at), bool), -1
                for i in np.flatnonzero(np.isin(at, right)).tolist():
                    keep[i] = not (at[i] == right[i - 1] and keep[i - 1])
                at, right = at[keep], right[keep]
            token[at] = merged[at]
            alive[right] = False
            rank[right] = NONE
            far = after[right]
            after[at] = far
            before[far[far >= 0]] = at[far >= 0]
            left = before[at]
            touched[at] = True
            left = left[(left >= 0) & ~touched[left]]
            touched[at] = False
            look(np.sort(np.concatenate([at, left])), r)
        ids, counts = token[alive], np.bincount(owner[alive], minlength=pieces.rows)
        if odd:  # a later merge has a lower rank than one before it: those pieces by the definition
            starts = np.cumsum(counts) - counts
            parts = np.split(ids, starts[1:])
            raw = pieces.bytes.tobytes()
            for k in odd:
                parts[k] = np.array(self.one(raw[pieces.offsets[k] : pieces.offsets[k + 1]]), np.int64)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts


class PieceCache:
    """Ids of pieces by two 64-bit hashes; what is new in a block is encoded together.

    The first hash finds a piece, the second tells whether it is that piece; one that is not goes on to
    a key made of both.
    """

    def __init__(self, encode: Callable[[Texts], tuple[np.ndarray, np.ndarray]], dtype, limit: int = CACHE_PIECES):
        self.encode, self.dtype, self.limit = encode, dtype, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.checks, self.slots = np.empty(0, U64), np.empty(0, U64), np.empty(0, np.int64)
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, self.dtype)

    def find(self, texts: Texts, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the place of its ids in ``self.ids`` and their number."""
        hashes = hash_ranges(texts.words8, starts, lengths)
        checks = hash_ranges(texts.words8, starts, lengths, 1)
        if len(self.keys) + len(starts) > self.limit and len(self.keys) + len(np.unique(hashes)) > self.limit:
            self._clear()
        while True:
            unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
            known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), bool)
            check = np.where(known, self.checks[at], checks[first]) if len(self.keys) else checks[first]
            other = np.flatnonzero(check[inverse] != checks)
            if not len(other):
                break
            hashes[other] = _mix(hashes[other] ^ checks[other])
        if not known.all():
            new = first[~known]
            parts = Texts([])
            parts.rows, parts.offsets = len(new), np.concatenate([[0], np.cumsum(lengths[new])])
            parts.size = int(parts.offsets[-1])
            parts.bytes = np.zeros(parts.size + 32, np.uint8)
            parts.bytes[: parts.size] = texts.bytes[expand(starts[new], lengths[new])]
            ids, counts = self.encode(parts)
            begin = len(self.ids) + np.cumsum(counts) - counts
            slots = len(self.counts) + np.arange(len(new))
            self.ids = np.concatenate([self.ids, ids.astype(self.dtype)])
            self.starts, self.counts = np.concatenate([self.starts, begin]), np.concatenate([self.counts, counts])
            where = np.searchsorted(self.keys, unique[~known])
            self.keys, self.slots = np.insert(self.keys, where, unique[~known]), np.insert(self.slots, where, slots)
            self.checks = np.insert(self.checks, where, checks[new])
            at = np.searchsorted(self.keys, unique)
        slot = self.slots[at][inverse]
        return self.starts[slot], self.counts[slot]

    def tokens(self, texts: Texts, split: Callable) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and each text's bounds among them."""
        found, bounds = [], np.zeros(texts.rows + 1, np.int64)
        for part in chunks(texts):
            starts, lengths, firsts = split(part)
            if len(starts):
                begin, counts = self.find(part, starts, lengths)
                bounds += np.concatenate([[0], np.cumsum(counts)])[firsts]
                found.append(self.ids[expand(begin, counts)])
        return np.concatenate(found) if found else np.empty(0, self.dtype), bounds


@cache
def _encoder(path: str) -> tuple[Ranks, PieceCache]:
    ranks = Ranks.load(path)
    return ranks, PieceCache(ranks.replay, np.uint32)


def decode(ids: np.ndarray, ranks: Ranks) -> bytes:
    """The bytes of token ids."""
    return b"".join(map(ranks.tokens.__getitem__, ids.tolist()))


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every text by the ranks file at ``path`` and decode the ids again.

    Returns one row per input row: ``id_col``, ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256`` and, with ``keep_ids``, the binary
    columns ``ids`` and ``decoded``. Null and empty texts have no ids; repeated rows and null
    ids stay as they are; only the two named columns are read, so other columns cannot clash.
    An empty table gives an empty result.
    """
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cached = _encoder(path)
        for batch in blocks(batches, text_col, 4 * BLOCK_BYTES):
            ids, bounds = cached.tokens(Texts(batch.column(text_col)), spaced_pieces)
            sha, back, raw_ids, raw = [], [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                one = ids[a:b]
                sha.append(hashlib.sha256(one).hexdigest())
                decoded, whole = hashlib.sha256(), []
                for k in range(0, len(one), DECODED):
                    text = decode(one[k : k + DECODED], ranks)
                    decoded.update(text)
                    if keep_ids:
                        whole.append(text)
                back.append(decoded.hexdigest())
                if keep_ids:
                    raw_ids.append(one.tobytes())
                    raw.append(b"".join(whole))
            columns = [batch.column(id_col), pa.array(np.diff(bounds)), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if keep_ids:
                columns += [pa.array(raw_ids, pa.binary()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
