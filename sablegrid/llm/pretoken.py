"""Splitting texts before byte-pair merging, by runs of letters, numbers, spaces and other signs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .flat import LETTER, NUMBER, OTHER, SPACE, Texts, char_groups

CHUNK = 4 << 20  # bytes of a long text that are split at a time
#: Code points of signs that never combine with what stands before them.
PUNCTUATION = ((0x21, 0x7E), (0x2010, 0x2027), (0x3001, 0x3029), (0xFF01, 0xFF0F))
WINDOW = 1 << 16  # bytes before a chunk's end in which a cut is looked for first


def _runs(points: np.ndarray, bounds: np.ndarray):
    group = char_groups()[points]
    n = len(points)
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True
    change = np.ones(n, bool)
    change[1:] = group[1:] != group[:-1]
    starts = np.flatnonzero(change | opens[:n])
    ends = np.append(starts[1:], n)
    closed = opens[ends]  # the run ends its text
    closed[-1:] = True
    return group[starts], starts, ends, closed


def _contractions(points, kind, starts, ends, closed, blocked):
    """Of each run that is one apostrophe: how many letters after it belong to it ('s 't 'm 'd 're 've 'll)."""
    taken = np.zeros(len(starts), np.int64)
    at = np.flatnonzero((kind == OTHER) & (ends - starts == 1) & ~closed & ~blocked)
    at = at[points[starts[at]] == 39]
    at = at[kind[at + 1] == LETTER]
    if len(at):
        a = points[starts[at] + 1]
        b = np.where(ends[at + 1] - starts[at + 1] > 1, points[np.minimum(starts[at] + 2, len(points) - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        taken[at] = np.where(one, 1, np.where(two, 2, 0))
    return taken


def spaced_pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of ``public_tokenizers.PATTERN``: byte starts, byte lengths, each text's first piece.

    A space belongs to the run after it; of longer white space all but the last sign is one piece.
    """
    points, at, bounds = texts.code_points()
    n = len(points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(texts.rows + 1, np.int64)
    kind, starts, ends, closed = _runs(points, bounds)
    begin = np.zeros(n + 1, bool)
    space = kind == SPACE
    leads = space & ~closed
    joins = leads & (points[ends - 1] == 32)
    joined = np.append(False, joins[:-1])
    begin[starts[space & ~(joins & (ends - starts == 1))]] = True
    begin[ends[leads] - 1] = True
    taken = _contractions(points, kind, starts, ends, closed, joined)
    after = np.append(0, taken[:-1])
    plain = ~space & ~joined
    begin[starts[plain & (after == 0)]] = True
    rest = np.flatnonzero((after > 0) & (starts + after < ends))
    begin[starts[rest] + after[rest]] = True
    pieces = np.flatnonzero(begin[:n])
    byte = at[pieces]
    return byte, np.diff(np.append(byte, texts.size)), np.searchsorted(pieces, bounds)


def word_pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the word vocabulary: runs of letters, single numbers, runs of other signs; white space goes."""
    points, at, bounds = texts.code_points()
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(texts.rows + 1, np.int64)
    kind, starts, ends, closed = _runs(points, bounds)
    taken = _contractions(points, kind, starts, ends, closed, np.zeros(len(starts), bool))
    after = np.append(0, taken[:-1])
    first, last = starts + after, ends + taken
    whole = ((kind == LETTER) | (kind == OTHER)) & (first < last)
    single = np.flatnonzero(char_groups()[points] == NUMBER)
    first, last = np.concatenate([first[whole], single]), np.concatenate([last[whole], single + 1])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    return at[first], at[last] - at[first], np.searchsorted(first, bounds)


def _cut(data: np.ndarray, low: int, high: int) -> int:
    """The last place in (low, high) where both splitters begin a piece whatever stands around; 0 if there is none.

    That is a blank between two visible ASCII signs, or a letter's end before a number or punctuation.
    What follows joins with nothing before it, so texts may be cut there before they are normalized.
    """
    part = data[low:high]
    seen = (part > 32) & (part < 128)
    at = np.flatnonzero((part[1:-1] == 32) & seen[:-2] & seen[2:])
    if len(at):
        return low + int(at[-1]) + 1
    first = np.flatnonzero((part & 0xC0) != 0x80)
    if len(first) < 3:
        return 0
    points = np.frombuffer(part[first[0] : first[-1]].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    group = char_groups()[points]
    plain = np.zeros(len(points), bool)
    for a, b in PUNCTUATION:
        plain |= (points >= a) & (points <= b)
    at = np.flatnonzero((group[:-1] == LETTER) & plain[1:] & ((group[1:] == OTHER) | (group[1:] == NUMBER)))
    return low + int(first[at[-1] + 1]) if len(at) else 0


def chunks(texts: Texts, size: int = CHUNK) -> Iterator[Texts]:
    """The texts themselves, or where they are one long text its parts, cut where a piece begins."""
    if texts.rows != 1 or texts.size <= 2 * size:
        yield texts
        return
    begin, data = 0, texts.bytes[: texts.size]
    while begin < texts.size:
        end = begin + size
        cut = texts.size
        while end < texts.size:
            found = _cut(data, max(begin, end - WINDOW), end) or _cut(data, begin, end)
            if found > begin:
                cut = found
                break
            end += size  # one piece goes through the whole chunk
        part = Texts([])
        part.rows, part.size = 1, cut - begin
        part.offsets = np.array([0, part.size])
        part.bytes = np.zeros(part.size + 32, np.uint8)
        part.bytes[: part.size] = data[begin:cut]
        yield part
        begin = cut
