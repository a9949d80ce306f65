"""Token counts by a tokenizer compiled into finite-state transducers.

Two deterministic transducers make the count. The splitter reads character classes and annotates its
transitions with the piece boundaries they prove (at the character, or at the one before it where a
rule looks ahead). Texts are cut into chunks; each chunk's map from every entry state to its exit
state is computed side by side, the maps are composed by a parallel prefix scan, and so every chunk
knows its entry state without reading what comes before it. The merge transducer reads bytes and
annotates its transitions with token counts. A piece boundary resets it, so its maps over pieces are
constant: pieces run side by side, equal ones once, and a prefix sum joins their counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import NONE, PairTable, PieceCache
from .flat import LETTER, NUMBER, SPACE, U64, Texts, blocks, char_groups, sums_by
from .pretoken import chunks

# Character classes and states of the splitter.
BLANK, WHITE, OTHER_LETTER, STMD, RV, E, L, DIGIT, APOSTROPHE, SIGN, END = range(11)
CLASSES = 11
BEGIN, IN_LETTERS, IN_NUMBERS, IN_SIGNS, ONE_BLANK, BLANKS, ONE_WHITE, WHITES, QUOTE, SHORT, QUOTE_RV, QUOTE_L = range(12)
STATES = 12
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary flags of every (state, class)."""
    letters = (OTHER_LETTER, STMD, RV, E, L)
    opening = {BLANK: ONE_BLANK, WHITE: ONE_WHITE, DIGIT: IN_NUMBERS, APOSTROPHE: QUOTE, SIGN: IN_SIGNS} | dict.fromkeys(letters, IN_LETTERS)
    goes = {(s, c): (opening[c], HERE) for s in range(STATES) for c in opening}
    goes |= {(IN_LETTERS, c): (IN_LETTERS, 0) for c in letters}
    goes[IN_NUMBERS, DIGIT] = (IN_NUMBERS, 0)
    for s in (IN_SIGNS, QUOTE):
        goes |= {(s, c): (IN_SIGNS, 0) for c in (SIGN, APOSTROPHE)}
    goes |= {(QUOTE, STMD): (SHORT, 0), (QUOTE, RV): (QUOTE_RV, 0), (QUOTE, L): (QUOTE_L, 0)}
    for s, second in ((QUOTE_RV, E), (QUOTE_L, L)):
        goes |= {(s, c): (to, flag | BEFORE) for c in opening for to, flag in [goes[s, c]]}
        goes |= {(s, c): (IN_LETTERS, BEFORE) for c in letters}
        goes[s, second] = (SHORT, 0)
    for s, many in ((ONE_BLANK, BLANKS), (BLANKS, BLANKS), (ONE_WHITE, BLANKS), (WHITES, BLANKS)):
        goes |= {(s, BLANK): (many, 0), (s, WHITE): (WHITES, 0)}
    visible = [c for c in opening if c not in (BLANK, WHITE)]
    for c in visible:
        joined = (IN_SIGNS if c in (SIGN, APOSTROPHE) else opening[c], 0)
        goes[ONE_BLANK, c] = joined
        goes[BLANKS, c] = (joined[0], BEFORE)
        goes[WHITES, c] = (opening[c], HERE | BEFORE)
    goes |= {(s, END): (BEGIN, BEFORE if s in (QUOTE_RV, QUOTE_L) else 0) for s in range(STATES)}
    to, flags = np.zeros((2, STATES * CLASSES), np.uint8)
    for (s, c), (t, f) in goes.items():
        to[s * CLASSES + c], flags[s * CLASSES + c] = t, f
    return to, flags


@cache
def _classes() -> np.ndarray:
    group = char_groups()
    table = np.full(len(group), SIGN, np.uint8)
    table[group == SPACE], table[group == LETTER], table[group == NUMBER] = WHITE, OTHER_LETTER, DIGIT
    for chars, kind in ((" ", BLANK), ("stmd", STMD), ("rv", RV), ("e", E), ("l", L), ("'", APOSTROPHE)):
        table[[ord(c) for c in chars]] = kind
    return table


NEXT, FLAGS = _splitter()
CHUNK = 256


def entry_states(classes: np.ndarray) -> np.ndarray:
    """The splitter's state at the start of each chunk; ``classes`` is (chunk length, chunks)."""
    chunks = classes.shape[1]
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for row in classes:
        maps = NEXT[maps.astype(np.intp) * CLASSES + row[:, None]]
    step = 1
    while step < chunks:  # after it, map k leads from the start of the input through chunk k
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    return np.append(np.uint8(BEGIN), maps[:-1, BEGIN])


def piece_boundaries(texts: Texts) -> np.ndarray:
    """For each byte whether a piece begins there."""
    points, at, bounds = texts.code_points()
    n = len(points)
    place = np.arange(n) + np.repeat(np.arange(texts.rows), np.diff(bounds))
    length = -(-(n + texts.rows) // CHUNK) * CHUNK
    stream = np.full(length, END, np.uint8)
    stream[place] = _classes()[points]
    stream = np.ascontiguousarray(stream.reshape(-1, CHUNK).T)
    state = entry_states(stream)
    flags = np.empty_like(stream)
    for t, row in enumerate(stream):
        go = state.astype(np.intp) * CLASSES + row
        flags[t], state = FLAGS[go], NEXT[go]
    flags = flags.T.ravel()
    begins = (flags & HERE) > 0
    begins[:-1] |= (flags[1:] & BEFORE) > 0
    out = np.zeros(texts.size + 1, bool)
    out[at[:-1][begins[place]]] = True
    return out


class PairMemo:
    """Known answers for pairs of tokens, by open addressing, for whole arrays; begun anew when half full."""

    BITS = 20

    def __init__(self):
        self.keys = np.zeros(1 << self.BITS, U64)
        self.values = np.zeros(1 << self.BITS, bool)
        self.used = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key or the free slot for it, and whether it is there. Keys are over 0."""
        at = ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.BITS)).astype(np.int64)
        seen = self.keys[at]
        todo = np.flatnonzero((seen != keys) & (seen != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.BITS) - 1)
            seen[todo] = self.keys[at[todo]]
            todo = todo[(seen[todo] != keys[todo]) & (seen[todo] != 0)]
        return at, seen == keys

    def look(self, keys: np.ndarray, decide) -> np.ndarray:
        """Answers of the keys; ``decide`` is asked for one that is new."""
        at, there = self.find(keys)
        if not there.all():
            new = np.unique(keys[~there]).tolist()
            if self.used + len(new) > 1 << (self.BITS - 1):
                self.__init__()
                new = np.unique(keys).tolist()
            self.used += len(new)
            answers = [decide(k) for k in new]
            for key, answer in zip(new, answers, strict=True):
                (slot,), _ = self.find(np.array([key], U64))
                self.keys[slot], self.values[slot] = key, answer
            at, _ = self.find(keys)
        return self.values[at]


class MergeTransducer:
    """Bytes of a piece in, its token count out.

    The state is the longest suffix that begins a token (a node of the token trie), with registers
    for the tokens that end at the positions within it. A transition reads a byte, moves along the
    trie and its failure links, takes the one token that may end here, and is annotated with the
    count at that token's begin plus one. Pieces run side by side.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_of = _byte_alphabet()
        as_bytes = lambda text: bytes(byte_of[c] for c in text)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        self.halves = {a + b: (a, b) for a, b in self.merges}
        if len(self.halves) != len(self.merges):
            raise ValueError("two merges make the same token")
        tokens = [t for t in map(as_bytes, spec["model"]["vocab"]) if len(t) == 1 or self.encode(t) == [t]]
        nodes = sorted({t[:k] for t in tokens for k in range(len(t) + 1)}, key=lambda p: (len(p), p))
        number = {p: k for k, p in enumerate(nodes)}
        self.nodes = nodes
        children = np.array([(number[p[:-1]], p[-1], k) for p, k in number.items() if p]).T
        self.child = PairTable(children[0], children[1], children[2], children[2])
        self.fail = np.array([0] + [next(number[p[k:]] for k in range(1, len(p) + 1) if p[k:] in number) for p in nodes[1:]])
        self.length = np.array([len(p) for p in nodes])
        is_token = np.zeros(len(nodes), bool)
        is_token[[number[t] for t in tokens]] = True
        self.token = np.zeros(len(nodes), np.int64)  # the longest token that ends a node's string
        self.shorter = np.zeros(len(nodes), np.int64)
        for k in range(1, len(nodes)):  # a failure link leads to a shorter string, so to a smaller number
            self.shorter[k] = self.token[self.fail[k]]
            self.token[k] = k if is_token[k] else self.shorter[k]
        self.pairs = PairMemo()
        self.edges: tuple[dict, dict] = ({}, {})
        self.cache = PieceCache(lambda pieces: (np.empty(0, np.uint8), self.run(pieces)), np.uint8)

    def encode(self, piece: bytes) -> list[bytes]:
        """Merge by the list of merges, the earliest first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.merges.get((parts[i], parts[i + 1]), NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, node: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at a token's left (0) or right (1) edge while it is merged, each until which merge."""
        if node not in self.edges[side]:
            found, until, part = [], NONE, self.nodes[node]
            while part:
                found.append((part, until))
                halves = self.halves.get(part)
                until = self.merges[halves] if halves else 0
                part = halves[side] if halves else b""
            self.edges[side][node] = found
        return self.edges[side][node]

    def _stay(self, pair: int) -> bool:
        """Whether two tokens stay as they are next to each other.

        They do unless a merge across their border comes while both its sides stand there; of
        equal merges the left one comes first.
        """
        before, token = divmod(pair, 1 << 32)
        right, left = self._edge(before, 1), self._edge(token, 0)
        return not any((m := self.merges.get((a, b))) is not None and m < ends and m <= stops for a, ends in right for b, stops in left)

    def run(self, pieces: Texts) -> np.ndarray:
        """Token counts of pieces."""
        lengths = np.diff(pieces.offsets)
        order = np.argsort(-lengths, kind="stable")
        first = pieces.offsets[:-1][order]
        active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
        last, count = np.zeros((2, pieces.size), np.int64)
        node = np.zeros(len(first), np.int64)
        for t, n in enumerate(active.tolist()):
            at, byte = first[:n] + t, pieces.bytes[first[:n] + t]
            state = node[:n]
            slot = self.child.find(state, byte)
            todo = np.flatnonzero(slot < 0)
            while len(todo):
                state[todo] = self.fail[state[todo]]
                slot[todo] = self.child.find(state[todo], byte[todo])
                todo = todo[slot[todo] < 0]
            state[:] = self.child.rank[slot]
            token = self.token[state]
            todo = np.flatnonzero(self.length[token] <= t)  # a token from the piece's begin needs no other
            while len(todo):
                before = last[at[todo] - self.length[token[todo]]]
                stays = self.pairs.look((before.astype(U64) << U64(32)) | token[todo].astype(U64), self._stay)
                todo = todo[~stays]
                token[todo] = self.shorter[token[todo]]
                todo = todo[self.length[token[todo]] <= t]
            last[at] = token
            long = self.length[token]
            count[at] = np.where(long <= t, count[np.maximum(at - long, 0)], 0) + 1
        out = np.zeros(pieces.rows, np.int64)
        out[lengths > 0] = count[(pieces.offsets[1:] - 1)[lengths > 0]]
        return out

    def counts(self, column: pa.Array) -> np.ndarray:
        """Token counts of the texts."""
        texts = Texts(column)
        raw = texts.bytes[: texts.size].tobytes()
        extra, owner = 0, None
        if any(s.encode() in raw for s in self.special):  # each special string is one token and cuts its text
            parts, owner, extra = [], [], np.zeros(len(column), np.int64)
            for i, text in enumerate(column.to_pylist()):
                rest = [text or ""]
                for s in self.special:
                    rest = [p for r in rest for p in r.split(s)]
                parts += rest
                owner += [i] * len(rest)
                extra[i] = len(rest) - 1
            texts = Texts(parts)
        counts = np.zeros(texts.rows, np.int64)
        for part in chunks(texts):
            starts = np.flatnonzero(piece_boundaries(part)[: part.size])
            if len(starts):
                _, found = self.cache.find(part, starts, np.diff(np.append(starts, part.size)))
                counts += sums_by(found, np.searchsorted(starts, part.offsets))
        if owner is not None:
            counts = np.bincount(owner, counts, len(column)).astype(np.int64)
        return counts + extra


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = (b for b in range(256) if b not in plain)
    return {c: b for b, c in plain.items()} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def _transducer(path: str) -> MergeTransducer:
    return MergeTransducer(path)


def count_tokens(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text without making them.

    Returns one row per input row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (more than ``limit`` tokens). A special string inside a text is one token. Null and empty texts
    have 0 of both; repeated rows and null ids stay; other columns are not read; an empty table
    gives an empty result. Memory is bounded by a block and the table of states; a longer text is cut
    where a piece surely begins.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(path)
        for batch in blocks(batches, text_col):
            column = batch.column(text_col)
            counts = transducer.counts(column)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.diff(Texts(column).offsets)), pa.array(counts), pa.array(counts > limit)], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
