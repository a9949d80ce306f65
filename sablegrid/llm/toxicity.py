"""Toxicity by a weighted finite-state grammar over clauses.

A word transducer maps words to signs: insult and threat stems, targets (whom it is said of),
negations and reported speech; other words to a plain sign. Stems and their weights are learned from
labelled documents. Four clause transducers rewrite signs, each a table of (state, sign) to (state,
sign): a negation erases the matches that it governs, a reporting verb those that follow it in the
clause, a target near a match aims it, and a match that stands among other words is asserted. They are
composed into one table that reads clauses from left to right, and the last two into one that reads
them from right to left, for targets and words that come after. What is neither aimed nor asserted at
the end, a word that is a clause by itself, counts nothing. A document's score is the logistic value of
its clauses' matches by form and of its length, with weights fitted to the labels.

Texts are read as one stream of signs with an end after each clause, cut into chunks that run side by
side. An end brings every state back to the first, so only chunks without one need a map of all states;
a prefix scan composes these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import LETTER, Texts, blocks, char_groups, hash_ranges
from .langid import held_out, sample_rows

SAMPLE = 4000  # labelled documents that the grammar is fitted on, as many of each label, the first by a hash of the id
SAMPLE_CHARS = 20_000  # of a sampled text that are read; SAMPLE and this bound what the driver holds
STEM = 10  # longest stem in letters
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_ODDS = 3, 0.01, 20.0  # a stem's toxic documents, their share, and its odds
# Seed words of the grammar, in the corpus's four languages.
THREATS = "kill killing hurt destroy beat burn stab shoot strangle punish töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yourself he she they them him her his their this that these those who du dich dein ihr euch euer sie er dieser diese tu te toi ton vous votre il elle ils cette ce tú usted ustedes él ella ellos este esta".split()
NEGATIONS = "not no never neither nor without nicht kein keine nie niemals ohne ne pas jamais aucun sans nunca ni tampoco sin".split()
REPORTS = "said says say told tells wrote writes claimed claims quoted quotes reported reports called sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió afirma".split()
# Signs of words, of a clause's end, and of what the clause transducers make of matches.
PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT, END, ASSERTED_INSULT, AIMED_INSULT, ASSERTED_THREAT, AIMED_THREAT = range(11)
SIGNS = 11
FORMS = {"asserted": ASSERTED_INSULT, "aimed": AIMED_INSULT, "asserted_threat": ASSERTED_THREAT, "aimed_threat": AIMED_THREAT}
#: What the fitted weights of the forms, of the text's length and the bias are drawn to where labels say little.
PRIOR = np.array([3.0, 0.5, 1.0, 3.0, 0.0, -4.0])
LOWEST, HIGHEST = np.array([0.0] * 4 + [-np.inf] * 2), np.array([np.inf] * 4 + [0.0, np.inf])
THREAT_WEIGHT = 4.0
REACH = 3  # words that a negation governs, and that a target may stand away
CHUNK = 128  # signs that a chunk of the stream holds


@dataclass
class Transducer:
    """A deterministic transducer over signs: the next state and the sign written, by (state, sign)."""

    to: np.ndarray
    out: np.ndarray

    @classmethod
    def of(cls, states: int, step, rewrite: dict[int, int]) -> Transducer:
        """From ``step(state, sign)``; a clause's end leads to state 0, and in other states ``rewrite`` holds."""
        to = np.array([[0 if x == END else step(s, x) for x in range(SIGNS)] for s in range(states)], np.uint8)
        out = np.array([[rewrite.get(x, x) if s else x for x in range(SIGNS)] for s in range(states)], np.uint8)
        return cls(to, out)

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""
        n = len(other.to)
        a, b = np.divmod(np.arange(len(self.to) * n), n)
        written = self.out[a]
        return Transducer((self.to[a].astype(np.int64) * n + other.to[b[:, None], written]).astype(np.uint8), other.out[b[:, None], written])

    def read(self, signs: np.ndarray) -> np.ndarray:
        """What is written for a stream of signs from state 0."""
        n = len(signs)
        stream = np.full(-(-max(n, 1) // CHUNK) * CHUNK, END, np.uint8)
        stream[:n] = signs
        rows = np.ascontiguousarray(stream.reshape(-1, CHUNK).T)
        chunks = rows.shape[1]
        state = np.zeros(chunks, np.uint8)
        for row in rows:
            state = self.to[state, row]
        maps = np.repeat(state[:, None], len(self.to), 1)  # right for chunks with an end, whatever the state before
        through = np.flatnonzero(~(rows == END).any(0))
        if len(through):
            all_states = np.tile(np.arange(len(self.to), dtype=np.uint8), (len(through), 1))
            for row in rows:
                all_states = self.to[all_states, row[through, None]]
            maps[through] = all_states
            step = 1
            while step < chunks:  # after it, map k leads from the start of the stream through chunk k
                maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
                step *= 2
        state = np.append(np.uint8(0), maps[:-1, 0])
        written = np.empty_like(rows)
        for t, row in enumerate(rows):
            written[t], state = self.out[state, row], self.to[state, row]
        return written.T.ravel()[:n]


def _since(sign: int, reach: int, rewrite: dict[int, int]) -> Transducer:
    """Rewrites within ``reach`` words after a sign."""
    return Transducer.of(reach + 1, lambda s, x: reach if x == sign else max(s - 1, 0), rewrite)


ERASED = dict.fromkeys((INSULT, THREAT), PLAIN)
AIMED = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT, ASSERTED_INSULT: AIMED_INSULT, ASSERTED_THREAT: AIMED_THREAT}
ASSERTED = {INSULT: ASSERTED_INSULT, THREAT: ASSERTED_THREAT}
NEGATED = _since(NEGATION, REACH, ERASED)
REPORTED = Transducer.of(2, lambda s, x: int(s or x == REPORT), ERASED)
NEAR_TARGET = _since(TARGET, REACH, AIMED)
AMONG_WORDS = Transducer.of(2, lambda s, x: 1, ASSERTED)
FORWARD = NEGATED.then(REPORTED).then(NEAR_TARGET).then(AMONG_WORDS)
BACKWARD = NEAR_TARGET.then(AMONG_WORDS)


@dataclass
class Clauses:
    """The words of a block: the stems of each distinct one, and number, text and place of every one."""

    stems: np.ndarray  # (STEM + 1, distinct words): hashes of the stems of every length; the last row is the whole word
    number: np.ndarray
    row: np.ndarray
    place: np.ndarray  # in the stream of signs, where an end follows each clause
    length: int
    rows: int


_CLAUSE_END = [ord(c) for c in ".!?;:\n。！？"]


def clauses(column: pa.Array | list) -> Clauses:
    """Letter runs in lower case; a clause ends at . ! ? ; : or a line's end."""
    given = Texts(column)
    raw, ends = given.bytes[: given.size].tobytes(), given.offsets.tolist()
    texts = Texts([raw[a:b].decode("utf-8").lower() for a, b in zip(ends[:-1], ends[1:], strict=True)])
    points, at, bounds = texts.code_points()
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = char_groups()[points] == LETTER
    cut = np.zeros(len(points) + 1, bool)
    cut[bounds] = True
    change = (inside[1:] != inside[:-1]) | cut
    first, last = np.flatnonzero(inside[1:] & change), np.flatnonzero(inside[:-1] & change)
    stops = cut.astype(np.int64)
    stops[:-1] += np.isin(points, _CLAUSE_END)
    clause = np.cumsum(stops)[first]
    place = np.arange(len(first)) + np.cumsum(np.append(0, clause[1:] != clause[:-1]))[: len(first)]
    whole = hash_ranges(texts.words8, at[first], at[last] - at[first])
    _, of, number = np.unique(whole, return_index=True, return_inverse=True)
    row = np.searchsorted(bounds, first, "right") - 1
    first, last = first[of], last[of]
    stems = [hash_ranges(texts.words8, at[first], at[np.minimum(first + k, last)] - at[first], k) for k in range(1, STEM + 1)]
    for k, h in enumerate(stems):
        h[last - first < k + 1] = 0
    return Clauses(np.stack([*stems, whole[of]]), number, row, place, int(place[-1]) + 2 if len(place) else 0, texts.rows)


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Values of the keys, 0 where there is none."""
    known, values = table
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0.0)


def _table(values: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(sorted(values), np.uint64)
    return keys, np.array([values[k] for k in sorted(values)], np.float64)


def _seed_table() -> tuple[np.ndarray, np.ndarray]:
    signs = {}
    for words, sign in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
        t = Texts(words)
        signs |= dict.fromkeys(hash_ranges(t.words8, t.offsets[:-1], np.diff(t.offsets)).tolist(), float(sign))
    return _table(signs)


class Grammar:
    """The word transducer's stems, and the weights of the forms, of the length and the bias."""

    def __init__(self, stems: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
        self.stems, self.weights, self.seeds = stems, weights, _seed_table()

    def signs(self, c: Clauses) -> tuple[np.ndarray, np.ndarray]:
        """The sign of every word and the weight of its stem."""
        weight = np.zeros(c.stems.shape[1])
        for table, keys in zip(self.stems, c.stems, strict=True):
            weight = np.maximum(weight, _lookup(table, keys))
        sign = _lookup(self.seeds, c.stems[STEM]).astype(np.uint8)
        sign[weight > 0] = INSULT
        weight[sign == THREAT] = THREAT_WEIGHT
        return sign[c.number], weight[c.number]

    def forms(self, c: Clauses) -> np.ndarray:
        """Sums of the matches' weights by text and form."""
        sign, weight = self.signs(c)
        stream = np.full(c.length, END, np.uint8)
        stream[c.place] = sign
        written = BACKWARD.read(FORWARD.read(stream)[::-1])[::-1][c.place]
        out = np.zeros((c.rows, len(FORMS)))
        for k, form in enumerate(FORMS.values()):
            hit = np.flatnonzero(written == form)
            out[:, k] = np.bincount(c.row[hit], weight[hit], c.rows)
        return out

    def scores(self, c: Clauses) -> np.ndarray:
        """Scores from 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(_features(self.forms(c), c) @ self.weights, -30, 30)))


def _features(forms: np.ndarray, *blocks_of: Clauses) -> np.ndarray:
    """What the clauses of a text say together by form, and its length, on logarithmic scales, and a one for the bias.

    Aimed matches count as asserted ones too, so that aiming adds to a match. Long texts hold more matches
    by chance.
    """
    both = forms.copy()
    both[:, 0] += forms[:, 1]
    both[:, 2] += forms[:, 3]
    words = np.concatenate([np.bincount(c.row, minlength=c.rows) for c in blocks_of])
    return np.c_[np.log1p(both), np.log1p(words / 100), np.ones(len(forms))]


FOLDS = 4


class _Counts:
    """Of every stem of toxic documents: how many toxic and other documents of each fold hold it."""

    def __init__(self, parts: list[Clauses], toxic: np.ndarray, fold: np.ndarray):
        self.total = np.stack([np.bincount(fold[toxic == y], minlength=FOLDS) for y in (0, 1)])
        self.least = max(LEAST_DOCUMENTS, LEAST_SHARE * int(self.total[1].sum()))
        self.keys, self.held = [], []
        base = np.cumsum([0, *(c.rows for c in parts)])[:-1].tolist()
        # Each distinct word of each document once.
        held_words = []
        for c, first in zip(parts, base, strict=True):
            words = max(c.stems.shape[1], 1)
            row, number = np.divmod(np.unique(c.row * words + c.number), words)
            held_words.append((row + first, number))
        for k in range(STEM + 1):
            keys = []
            for (row, number), c in zip(held_words, parts, strict=True):
                stems, of = np.unique(c.stems[k], return_inverse=True)
                ill = (toxic[row] == 1) & (c.stems[k][number] != 0)
                keys.append(stems[np.unique(row[ill] * len(stems) + of[number[ill]]) % len(stems)] if ill.any() else stems[:0])
            known, n = np.unique(np.concatenate(keys), return_counts=True)
            known = known[n >= LEAST_DOCUMENTS]
            held = np.zeros((2, FOLDS, len(known)), np.int64)
            for (row, number), c in zip(held_words, parts, strict=True) if len(known) else []:
                stem = c.stems[k][number]
                at = np.minimum(np.searchsorted(known, stem), len(known) - 1)
                hit = known[at] == stem
                once, at = np.divmod(np.unique(row[hit] * len(known) + at[hit]), len(known))
                np.add.at(held, (toxic[once], fold[once], at), 1)
            self.keys.append(known)
            self.held.append(held)

    def stems(self, without: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Stems far more frequent in toxic documents than in others, with their log odds, leaving out a fold."""
        use = [f for f in range(FOLDS) if f != without]
        total = self.total[:, use].sum(1) + 1.0
        found = []
        for keys, held in zip(self.keys, self.held, strict=True):
            other, ill = held[:, use].sum(1)
            odds = np.log((ill + 0.5) / total[1]) - np.log((other + 0.5) / total[0])
            good = (ill >= self.least * len(use) / FOLDS) & (odds >= np.log(LEAST_ODDS))
            found.append((keys[good], odds[good]))
        return found


def fit(texts: list[str], labels: list[int], weights: list[float] | None = None) -> Grammar:
    """Learn the stems and the weights of the forms; without both labels every score is 0.

    ``weights`` say how many documents each one stands for.
    """
    toxic = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Grammar([_table({})] * (STEM + 1), np.array([0.0] * (len(FORMS) + 1) + [-30.0]))
    parts = [clauses(pa.array(texts[i : i + 200], pa.large_string())) for i in range(0, len(texts), 200)]
    fold = np.arange(len(texts)) % FOLDS
    counts = _Counts(parts, toxic, fold)
    forms = np.zeros((len(texts), len(FORMS)))
    for k in range(FOLDS):  # the weights are fitted on documents whose stems were learned from others
        grammar = Grammar(counts.stems(k), PRIOR)
        own = np.concatenate([grammar.forms(c) for c in parts])
        forms[fold == k] = own[fold == k]
    a, w = _features(forms, *parts), PRIOR.copy()
    stands = np.ones(len(texts)) if weights is None else np.array(weights) / np.mean(weights)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(stands @ (np.logaddexp(0, z) - toxic * z)) + float((w - PRIOR) @ (w - PRIOR)) / 2

    for _ in range(60):  # Newton steps of a logistic fit drawn to the prior; no match speaks against toxicity, and no length for it
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (stands * p * (1 - p))[:, None]) + np.eye(len(w)), a.T @ (stands * (p - toxic)) + w - PRIOR)
        now = loss(w)
        for _ in range(30):  # halved until the loss falls
            new = np.clip(w - step, LOWEST, HIGHEST)
            if loss(new) < now:
                break
            step /= 2
        else:
            break
        w = new
    return Grammar(counts.stems(), w)


def fit_grammar(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = SAMPLE) -> Grammar:
    """Fit on about ``size`` labelled documents that are not held out (crc32 of the id mod 5 is 0).

    Both labels share the sample; an id with both labels is toxic. Of each text the first
    ``SAMPLE_CHARS`` characters are read, of rows that repeat a sampled id at most as many as the sample.
    """
    train = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, 5, 0)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    ids = {r[0]: (int(r[1]), r[2]) for r in sample_rows(train, label_col, [id_col], size).select(id_col, label_col, "_weight").collect()}
    text = F.substring(text_col, 1, SAMPLE_CHARS).alias(text_col)
    rows = df.where(F.col(id_col).isin(list(ids))).select(id_col, text).limit(2 * len(ids)).collect() if ids else []
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return fit([r[1] or "" for r in rows], [ids[r[0]][0] for r in rows], [ids[r[0]][1] for r in rows])


def score_documents(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, held_out, score, predicted) of every text.

    Null and empty texts score as a text without a match, however long ones are read whole. Null ids (not held out) and repeated rows
    stay; other columns are not read; an empty table gives an empty result.
    """
    schema = T.StructType([df.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(grammar)  # a fixed-size table, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in blocks(batches, text_col):
            score = grammar.scores(clauses(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return df.select(id_col, text_col, held_out(id_col, 5, 0).alias("held_out")).mapInArrow(run, schema)
