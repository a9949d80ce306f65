"""Quality rules: cross-document line frequency within a host.

One pass reads each whole text and keeps figures only: the base counts, and a 64-bit hash and the
number of words of every normalised line. A line's frequency at a host is the number of different
documents there that hold it; equal texts count as one document, so copying a page does not turn it
into boilerplate. Lines above the limits are removed, and a document that loses too much of its
words is rejected. Counts are combined before they are shuffled, so a hot host or line costs each
task one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import U64, Texts, _mix, ascii_words, blocks, hash_ranges, line_spans, sums_by
from .session import stage

#: A line is above the limits when more different documents of its host hold it than the first says, or
#: more than this share of them, at least the third: large and small hosts are judged alike.
MIN_DOCUMENTS, HOST_SHARE, SHARE_FROM = 20, 0.05, 3
#: A document is depleted when less than this share of its words is left.
LEAST_LEFT = 0.3

_NORMAL = np.arange(256, dtype=np.uint8)  # letters in lower case, every number as 0
_NORMAL[ord("A") : ord("Z") + 1] += 32
_NORMAL[ord("0") : ord("9") + 1] = ord("0")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeats(keys: np.ndarray) -> np.ndarray:
    """For each key whether it comes twice or more."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def text_figures(texts: Texts) -> dict[str, np.ndarray]:
    """The base counts of each text, and of each line with words its key and its number of words."""
    begins, ends, firsts = ascii_words(texts)
    data, rows = texts.bytes[: texts.size], np.arange(texts.rows)
    n_words = np.diff(firsts)
    word_row = np.repeat(rows, n_words)
    visible = (data & 0xC0) != 0x80
    visible &= (data != 32) & ((data < 9) | (data > 13))
    hashes = hash_ranges(texts.words8, begins, ends - begins)

    whole = np.flatnonzero(word_row[2:] == word_row[:-2])
    windows = _mix(hashes[whole] * U64(3) ^ _mix(hashes[whole + 1] * U64(5) ^ _mix(hashes[whole + 2] + word_row[whole].astype(U64))))
    twice = whole[_repeats(windows)] if len(whole) else whole
    in_repeat = np.zeros(len(begins), bool)
    for k in range(3):
        in_repeat[twice + k] = True

    starts, stops, line_firsts = line_spans(texts)
    first_word = np.searchsorted(begins, starts)
    words = np.searchsorted(begins, stops) - first_word
    filled = np.flatnonzero(words)
    line_row = np.repeat(rows, np.diff(line_firsts))[filled]
    raw = hash_ranges(texts.words8, starts[filled], (stops - starts)[filled])
    own = _mix(raw ^ _mix(line_row.astype(U64) + U64(1)))
    _, first_seen = np.unique(own, return_index=True)
    again = np.ones(len(filled), bool)
    again[first_seen] = False

    normal = Texts([])
    normal.bytes, normal.size = _NORMAL[texts.bytes], texts.size
    plain = hash_ranges(normal.words8, begins, ends - begins)
    place = np.arange(len(begins)) - np.repeat(first_word[filled], words[filled])
    total = np.concatenate([np.zeros(1, U64), np.cumsum(_mix(plain + _mix(place.astype(U64) + U64(7))))])
    keys = _mix(total[first_word[filled] + words[filled]] - total[first_word[filled]])
    bounds = np.searchsorted(line_row, np.arange(texts.rows + 1))
    return {
        "n_words": n_words,
        "word_chars": sums_by(visible, texts.offsets),
        "n_symbols": sums_by(_SYMBOL[data], texts.offsets),
        "n_dup_lines": sums_by(again, bounds),
        "n_repeat_words": sums_by(in_repeat, firsts),
        "line_bounds": bounds,
        "line_keys": keys.view(np.int64),
        "line_words": words[filled],
        "line_places": filled - line_firsts[line_row],
    }


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: bool = False) -> DataFrame:
    """Judge every document by the lines that its host repeats.

    Returns one row per input row: ``id_col``, the base counts, ``base_failed``, ``n_removed_words``
    (in lines above the limits) and ``kept``. With ``keep`` all columns of ``df`` come instead, the text
    without the removed lines, and the results with the prefix ``_q_``. Null and empty texts have no
    words and fail the base rules. Documents without a host form one host. Repeated rows are judged
    alike; ids may be null or repeat; only three columns are read, and own ones carry the prefix
    ``_q_``, so that others cannot clash; an empty table gives an empty result.
    """
    lists = ("_q_keys", "_q_words", "_q_places")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("_q_host", T.StringType()), T.StructField("_q_hash", T.LongType()), T.StructField("_q_id", T.LongType()), *(T.StructField(f"_q_{c}", T.LongType()) for c in BASE), *(T.StructField(c, T.ArrayType(T.LongType())) for c in lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, part = 0, TaskContext.get().partitionId() << 40
        for batch in blocks(batches, text_col):
            f = text_figures(Texts(batch.column(text_col)))
            arrays = [pa.ListArray.from_arrays(pa.array(f["line_bounds"], pa.int32()), pa.array(f[k], pa.int64())) for k in ("line_keys", "line_words", "line_places")]
            columns = [*(batch.column(c) for c in (id_col, "_q_host", "_q_hash")), pa.array(part + row + np.arange(batch.num_rows)), *(pa.array(f[c], pa.int64()) for c in BASE), *arrays]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            row += batch.num_rows

    host_of = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("_q_host")
    text_hash = F.xxhash64(text_col).alias("_q_hash")
    judged = stage(df.select(id_col, text_col, host_of, text_hash).mapInArrow(run, schema), "quality")
    line = F.explode(F.arrays_zip(*(F.col(c).alias(n) for c, n in zip(lists, ("key", "words", "place"), strict=True)))).alias("line")
    lines = judged.select("_q_id", F.col("_q_host").alias("host"), "_q_hash", line).select("_q_id", "host", "_q_hash", "line.*")
    # Distinct documents of a line: texts are made distinct first, then counted; both are combined in the tasks.
    many, least = F.col("documents") > MIN_DOCUMENTS, F.col("documents") >= SHARE_FROM
    held = lines.groupBy("host", "key", "_q_hash").agg(F.lit(1).alias("one")).groupBy("host", "key").agg(F.count("one").alias("documents")).where(many | least)
    hosts = judged.select(F.col("_q_host").alias("host"), "_q_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    share = F.col("documents") > HOST_SHARE * F.col("of")
    frequent = stage(held.join(hosts, "host").where(many | (least & share)).select("host", "key"), "quality-lines")
    hit = lines.select("_q_id", "host", "key", "words", "place").join(frequent, ["host", "key"])
    removed = hit.groupBy("_q_id").agg(F.sum("words").alias("_q_removed"), F.collect_set("place").alias("_q_gone"))
    out = judged.drop(*lists).join(removed, "_q_id", "left")
    gone = F.coalesce("_q_removed", F.lit(0))
    failed = (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))
    verdict = {**{c: F.col(f"_q_{c}") for c in BASE}, "base_failed": failed, "n_removed_words": gone, "kept": ~failed & (F.col("_q_n_words") - gone >= LEAST_LEFT * F.col("_q_n_words"))}
    if not keep:
        return out.select(id_col, *(v.alias(n) for n, v in verdict.items()))
    # Rows are found again by id, host and text; those that share all three share their verdict.
    key = ["_q_doc", "_q_host", "_q_hash"]
    told = out.select(F.col(id_col).alias("_q_doc"), "_q_host", "_q_hash", "_q_gone", *(v.alias(f"_q_{n}") for n, v in verdict.items()))
    told = told.groupBy(*key).agg(*(F.first(c).alias(c) for c in told.columns if c not in key)).select("*", F.col("_q_host").alias("_q_at"), F.col("_q_hash").alias("_q_of")).drop("_q_host", "_q_hash")
    rows = df.select("*", host_of, text_hash)
    whole = rows.join(told.hint("merge"), rows[id_col].eqNullSafe(told["_q_doc"]) & (F.col("_q_host") == F.col("_q_at")) & (F.col("_q_hash") == F.col("_q_of")), "left")
    split = whole.select("*", F.explode(F.array(F.split(text_col, "\n"))).alias("_q_lines"))
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("_q_lines").cast("long") - 1), F.col("_q_gone"))
    rest = F.array_join(F.transform(left, lambda i: F.get("_q_lines", i.cast("int"))), "\n")
    text = F.when(F.col("_q_gone").isNull(), F.col(text_col)).otherwise(rest).alias(text_col)
    return split.select(*(text if c == text_col else F.col(c) for c in df.columns), *(f"_q_{n}" for n in verdict))


#: The rows of ``line_quality`` in DuckDB SQL.
SQL = rf"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, source, t, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
  FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM words)),
filled AS (SELECT * FROM lines WHERE n > 0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS d FROM filled GROUP BY r),
spans AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM spans) WHERE n > 1),
reps AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
held AS (SELECT source, k, count(DISTINCT t) AS n FROM filled GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM words GROUP BY ALL),
frequent AS (SELECT held.source, k FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE held.n > {MIN_DOCUMENTS} OR (held.n >= {SHARE_FROM} AND held.n > {HOST_SHARE} * hosts.n)),
gone AS (SELECT r, sum(n)::BIGINT AS n FROM filled f JOIN frequent q ON f.k = q.k AND f.source IS NOT DISTINCT FROM q.source GROUP BY r),
figures AS (
  SELECT doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d, 0) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words,
         coalesce(gone.n, 0) AS n_removed_words
  FROM words LEFT JOIN dups USING (r) LEFT JOIN reps USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {LEAST_LEFT} * n_words AS kept
FROM figures
"""
