"""Language identification of mixed text: script ranges, word scores, and a Viterbi path over the words.

A model holds for each learned language the scripts its words use and scores of hashed letter
sequences of one to four bytes, fitted on a bounded sample of labelled documents. In a text, the
script of a word narrows the candidates to the languages that use it; the others cannot hold the word.
Each candidate's score is the word's log likelihood, computed once for each distinct word of a block.
The best path through the words, which pays a penalty for each change of language, labels every word,
and so spans of mixed text; the language of most letters is the text's. Long texts are cut into chunks
whose best-path maps are computed side by side and then composed, so a text of a million words takes
no more steps than many short ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import LETTER, U64, Texts, _mix, blocks, char_groups, hash_ranges, sums_by

SAMPLE = 3000  # labelled documents that the model is fitted on, as many of each language, the first by a hash
SAMPLE_CHARS = 20_000  # of a sampled text that are read; SAMPLE and this bound what the driver holds
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SWITCH = 8.0  # penalty of a change of language, in nats
CLIP = 6.0  # most that one word may count for one language against another, in nats
NEVER = -1e6  # score of a language that does not use the word's script
CHUNK = 128  # words of a text that are labelled in one go
#: First code points of script ranges, in order; what lies between two belongs to the first of them.
SCRIPTS = {"latin": 0x0, "greek": 0x370, "cyrillic": 0x400, "armenian": 0x530, "hebrew": 0x590, "arabic": 0x600, "syriac": 0x700, "indic": 0x900, "thai": 0xE00, "lao": 0xE80, "tibetan": 0xF00, "burmese": 0x1000, "georgian": 0x10A0, "jamo": 0x1100, "ethiopic": 0x1200, "other": 0x1380, "latin ": 0x1E00, "greek ": 0x1F00, "other ": 0x2000, "kana": 0x3040, "han": 0x3400, "other  ": 0xA000, "hangul": 0xAC00, "other   ": 0xD7B0, "han ": 0xF900, "other    ": 0xFB00, "han  ": 0x20000, "other     ": 0x30000}
_NAMES = sorted({s.strip() for s in SCRIPTS})
_STARTS = np.array(list(SCRIPTS.values()))
_SCRIPT = np.array([_NAMES.index(s.strip()) for s in SCRIPTS])


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


class Words:
    """The letter runs of a block of texts in lower case."""

    def __init__(self, column: pa.Array):
        self.given = Texts(column)
        raw, ends = self.given.bytes[: self.given.size].tobytes(), self.given.offsets.tolist()
        lower = [raw[a:b].decode("utf-8").lower() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        texts = Texts([unicodedata.normalize("NFC", t) if not t.isascii() else t for t in lower])
        points, at, bounds = texts.code_points()
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = char_groups()[points] == LETTER
        cut = np.zeros(len(points) + 1, bool)
        cut[bounds] = True
        change = (inside[1:] != inside[:-1]) | cut
        first, last = np.flatnonzero(inside[1:] & change), np.flatnonzero(inside[:-1] & change)
        self.letters = last - first
        self.starts, self.ends = at[first], at[last]
        self.bounds = np.searchsorted(first, bounds)
        self.script = _SCRIPT[np.searchsorted(_STARTS, points[first], "right") - 1] if len(first) else np.empty(0, np.int64)
        self.texts, self.rows = texts, texts.rows
        self.bytes = np.full(texts.size + 40, 32, np.uint8)  # other signs are blanks
        mask = np.repeat(inside[1:-1], np.diff(at)) if len(points) else np.empty(0, bool)
        self.bytes[1 : texts.size + 1][mask] = texts.bytes[: texts.size][mask]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first place of every distinct word, by a 64-bit hash within the block, and of each word its number."""
        hashes = hash_ranges(self.texts.words8, self.starts, self.ends - self.starts)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        return first, inverse

    def features(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed sequences at every byte from the blank before a word to its last, one column an order; and words' bounds."""
        starts, ends = self.starts[of], self.ends[of]
        sizes = ends - starts + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)  # shifted by the leading blank
        left = np.repeat(ends + 2, sizes) - at
        eight = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))[at]
        columns = []
        for k in ORDERS:
            h = _mix((eight & U64((1 << 8 * k) - 1)) + U64(k << 40)) % U64(BUCKETS)
            columns.append(np.where(left >= k, h, BUCKETS).astype(np.int32))
        return np.stack(columns), bounds


class Model:
    """Word scores of the learned languages."""

    def __init__(self, languages: list[str], weights: np.ndarray, scripts: np.ndarray):
        self.languages, self.weights, self.scripts = languages, weights, scripts

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> Model:
        """Counts of the sequences by language, smoothed; the scripts of at least a hundredth of a language's words."""
        languages = sorted(set(langs))
        counts = np.zeros((len(languages), BUCKETS))
        scripts = np.zeros((len(languages), len(_NAMES)))
        for k, lang in enumerate(languages):
            own = [t for t, g in zip(texts, langs, strict=True) if g == lang]
            for part in (own[i : i + 200] for i in range(0, len(own), 200)):
                words = Words(pa.array(part, pa.large_string()))
                features, _ = words.features(np.arange(len(words.starts)))
                counts[k] += np.bincount(features.ravel(), minlength=BUCKETS + 1)[:BUCKETS]
                scripts[k] += np.bincount(words.script, minlength=len(_NAMES))
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
        weights = np.zeros((BUCKETS + 1, len(languages)), np.float32)
        weights[:BUCKETS] = np.log(share).T / len(ORDERS)
        return cls(languages, weights, scripts >= 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1))

    def word_scores(self, words: Words) -> np.ndarray:
        """Log likelihoods of the words, at most ``CLIP`` below the best; ``NEVER`` for languages without the script."""
        if not len(words.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        of, number = words.distinct()
        features, bounds = words.features(of)
        scores = np.zeros((len(of), len(self.languages)), np.float32)
        for row in features:
            scores += np.add.reduceat(self.weights[row], bounds[:-1], axis=0)
        allowed = self.scripts.T[words.script[of]]
        known = allowed.any(1)
        scores[known[:, None] & ~allowed] = NEVER
        scores -= scores.max(1, keepdims=True)
        scores[scores > NEVER / 2] = np.maximum(scores[scores > NEVER / 2], -CLIP)
        scores[~known] = 0
        return scores[number]

    def path(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best label of every word.

        Chunks go side by side, word by word. First each chunk that another one follows gets its map from
        the label before it to the best score of each label at its end; a scan over a text's chunks
        composes them to the scores before each chunk. Then all chunks run forward from these, and back
        from every label at their end; a scan from the last chunk on tells which of them holds.
        """
        k = scores.shape[1]
        chunks = np.maximum(-(-np.diff(bounds) // CHUNK), 0)
        n = int(chunks.sum())
        text = np.repeat(np.arange(len(chunks)), chunks)
        place = np.arange(n) - np.repeat(np.cumsum(chunks) - chunks, chunks)  # of a chunk in its text
        first = bounds[:-1][text] + CHUNK * place
        length = np.minimum(CHUNK, bounds[1:][text] - first)
        entry = np.zeros((n, k), np.float32)
        followed = np.flatnonzero(place < chunks[text] - 1)  # all of full length
        if len(followed):
            maps = np.full((k, k, len(followed)), NEVER, np.float32)  # from a label, to a label, of a chunk
            maps[np.arange(k), np.arange(k)] = 0
            for t in range(CHUNK):
                maps = np.maximum(maps, maps.max(1, keepdims=True) - SWITCH) + scores[first[followed] + t].T[None]
            order = np.argsort(place[followed], kind="stable")
            cuts = np.searchsorted(place[followed][order], np.arange(int(place.max()) + 1)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[a:b]
                after = (entry[followed[at]].T[:, None, :] + maps[:, :, at]).max(0).T
                entry[followed[at] + 1] = after - after.max(1, keepdims=True)
        order = np.argsort(-length, kind="stable")
        begin, best = first[order], entry[order]
        active = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left").tolist()
        stay, top = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int8)  # top: the best label before each word
        for t, m in enumerate(active):
            now = best[:m]
            top[begin[:m] + t] = which = now.argmax(1)
            peak = now[np.arange(m), which][:, None]
            keep = now >= peak - SWITCH
            stay[begin[:m] + t] = keep
            best[:m] = np.where(keep, now, peak - SWITCH) - peak + scores[begin[:m] + t]
        back = np.tile(np.arange(k, dtype=np.int8), (n, 1))  # the label at this place for each label at the chunk's end
        labels = np.zeros((len(scores), k), np.int8)
        for t in range(len(active) - 1, -1, -1):
            at, now = begin[: active[t]] + t, back[: active[t]]
            labels[at] = now
            back[: active[t]] = np.where(np.take_along_axis(stay[at], now.astype(np.intp), 1), now, top[at][:, None])
        where = np.argsort(order)
        back, last = back[where], best[where].argmax(1)
        deep = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[deep], np.arange(int(place.max(initial=0)) + 2)).tolist()
        for depth in range(len(cuts) - 2, 0, -1):  # the label before a chunk is the last one of the chunk before
            at = deep[cuts[depth] : cuts[depth + 1]]
            last[at - 1] = back[at, last[at]]
        return labels[np.arange(len(scores)), np.repeat(last, length)]


def sample_rows(df: DataFrame, label_col: str, by: list[str], size: int) -> DataFrame:
    """At most about ``size`` rows, as many of each label, the first by a hash of the columns ``by``.

    Labels are counted, and a row is taken when its hash lies below its label's share, so that rare
    labels are taken whole. Adds ``_weight``, the rows that a taken one stands for.
    """
    counts = df.groupBy(label_col).count().collect()  # one row a label
    quota = max(1, size // max(1, len(counts)))
    shares = {r[0]: min(1.0, quota / r[1]) for r in counts}
    share = F.lit(0.0)
    for value, s in shares.items():
        share = F.when(F.col(label_col) == value, F.lit(s)).otherwise(share)
    part = F.pmod(F.xxhash64(*by), F.lit(1 << 30)) / float(1 << 30)
    return df.withColumn("_share", share).where(part < F.col("_share")).withColumn("_weight", F.try_divide(F.lit(1.0), F.col("_share"))).drop("_share").limit(2 * size + 100)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SAMPLE) -> Model:
    """Fit on about ``size`` documents that are not held out and have a text and a language.

    Languages share the sample equally; of each text the first ``SAMPLE_CHARS`` characters are read.
    """
    train = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    rows = sample_rows(train.select(id_col, F.substring(text_col, 1, SAMPLE_CHARS).alias(text_col), lang_col), lang_col, [id_col, text_col], size).select(text_col, lang_col).collect()
    return Model.fit([r[0] for r in rows], [r[1] for r in rows])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, keep: bool = False) -> DataFrame:
    """Label every text; rows (id_col, held_out, lang_pred, score) and, with ``spans``, the label of each span.

    ``score`` is the share of the letters that the predicted language holds. A text that is null or
    has no letter, or any text where nothing was learned, is ``und`` with score 0; a text whose
    scripts no learned language uses gets the first language with score 0. ``spans`` are structs of
    the language, the first word and the number of words. Ties go to the first language by name.
    With ``keep`` all columns of ``df`` come too, the results with the prefix ``_l_``. Null ids and
    repeated rows stay; an empty table gives an empty result.
    """
    carried = df.columns if keep else [id_col]
    mark = "_l_" if keep else ""
    span = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.LongType()), T.StructField("words", T.LongType())]))
    schema = T.StructType([*(df.schema[c] for c in carried), T.StructField("_l_out", T.BooleanType()), T.StructField(f"{mark}lang_pred", T.StringType()), T.StructField(f"{mark}score", T.DoubleType()), *([T.StructField(f"{mark}spans", span)] if spans else [])])
    names = np.array([*model.languages, "und"], object)
    k = len(model.languages)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a fixed-size table, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in blocks(batches, text_col):
            words = Words(batch.column(text_col))
            letters = np.diff(words.bounds)
            pred, score = np.full(words.rows, k), np.zeros(words.rows)
            label = np.zeros(len(words.starts), np.int8)
            if k and len(words.starts):
                scores = model.word_scores(words)
                label = model.path(scores, words.bounds)
                told = np.where(model.scripts.T[words.script].any(1), words.letters, 0)
                held = np.stack([sums_by(np.where(label == g, told, 0), words.bounds) for g in range(k)])
                some = letters > 0
                pred[some] = held.argmax(0)[some]
                score = np.where(some, held.max(0) / np.maximum(sums_by(words.letters, words.bounds), 1), 0.0)
            columns = [*(batch.column(c) for c in carried), batch.column("_l_out"), pa.array(names[pred], pa.string()), pa.array(score)]
            if spans:
                rows = []
                for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                    cuts = [0, *(np.flatnonzero(np.diff(label[a:b])) + 1).tolist(), b - a] if b > a and k else [0]
                    rows.append([{"lang": model.languages[label[a + p]], "word": p, "words": q - p} for p, q in zip(cuts[:-1], cuts[1:], strict=True)])
                columns.append(pa.array(rows, pa.list_(pa.struct([("lang", pa.string()), ("word", pa.int64()), ("words", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    marked = df.select(*([*df.columns] if keep else [id_col, text_col]), held_out(id_col).alias("_l_out"))
    out = marked.mapInArrow(run, schema)
    rest = [f"{mark}lang_pred", f"{mark}score", *([f"{mark}spans"] if spans else [])]
    return out.select(*carried, *([] if keep else [F.col("_l_out").alias("held_out")]), *rest)
