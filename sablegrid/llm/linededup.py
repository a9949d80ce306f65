"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

Lines with something on them are hashed three at a time. A window's occurrences are counted and its
first one found by an aggregation that combines in the tasks; windows seen once drop out there. The
others go to the shared folder, so that the join back to the occurrences has a plain exchange on
either side and a very common window is split by adaptive execution. Occurrences after the first
cover their three lines; overlapping ones merge, and the covered lines go. Both joins are sort-merge
joins at every size: what they would broadcast grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import stage

_END = 1 << 30


def _once(df: DataFrame, *values: tuple[str, Column]) -> DataFrame:
    """Add columns that are computed once a row and not again wherever a lambda names them."""
    for name, value in values:
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def _windows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (_d_id, _d_hash, _d_window, _d_check, _d_a, _d_b, _d_c): two hashes and the lines of every window."""
    filled = F.transform(F.split(text_col, "\n"), lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"), i.alias("p"))))
    docs = df.select(F.col(id_col).alias("_d_id"), F.xxhash64(text_col).alias("_d_hash"), F.explode(F.array(F.filter(filled, lambda x: x.isNotNull()))).alias("_d_lines"))
    p = F.col("_d_lines.p")

    def windows(h: Column) -> Column:
        two = F.zip_with(h, F.slice(h, 2, _END), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(two, F.slice(h, 3, _END), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab, c)))

    zipped = F.arrays_zip(windows(F.col("_d_lines.h")).alias("_d_window"), windows(F.col("_d_lines.g")).alias("_d_check"), p.alias("_d_a"), F.slice(p, 2, _END).alias("_d_b"), F.slice(p, 3, _END).alias("_d_c"))
    return docs.select("_d_id", "_d_hash", F.inline(zipped)).where("_d_c is not null")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every later occurrence of three consecutive lines.

    Occurrences are ordered by (``id_col``, hash of the text, line), null ids first. Returns all
    columns of ``df``, the text without the covered lines, and ``n_lines`` and ``n_removed_lines``
    (replacing columns of these names). Empty lines neither form windows nor go. Null texts stay
    null with 0 lines; an empty text is one line. Rows equal in id and text are one document: each
    keeps or loses the same lines. Other columns may have any names but those of the prefix ``_d_``;
    an empty table gives an empty result. Windows are told apart by two 64-bit hashes, texts of one id by
    one.
    """
    text = F.col(text_col)
    windows = _windows(df, id_col, text_col)
    here = F.struct("_d_id", "_d_hash", "_d_a")
    seen = windows.groupBy("_d_window", "_d_check").agg(F.count(F.lit(1)).alias("_d_count"), F.min(here).alias("_d_first"))
    repeated = stage(seen.where("_d_count > 1").select("_d_window", "_d_check", "_d_first"), "line-windows")
    later = windows.join(repeated.hint("merge"), ["_d_window", "_d_check"]).where(~here.eqNullSafe(F.col("_d_first")))
    merged = later.groupBy("_d_id", "_d_hash").agg(F.array_distinct(F.flatten(F.collect_set(F.array("_d_a", "_d_b", "_d_c")))).alias("_d_covered"))
    merged = stage(merged.select(F.col("_d_id").alias("_d_key"), F.col("_d_hash").alias("_d_key_hash"), "_d_covered"), "line-covers")
    rows = df.withColumn("_d_hash", F.xxhash64(text))
    joined = rows.join(merged.hint("merge"), rows[id_col].eqNullSafe(merged["_d_key"]) & (F.col("_d_hash") == F.col("_d_key_hash")), "left")
    joined = _once(joined, ("_d_lines", F.split(text, "\n")))
    hit = F.col("_d_covered").isNotNull()
    left = F.array_except(F.sequence(F.lit(0), F.size("_d_lines") - 1), F.col("_d_covered"))
    rest = F.array_join(F.transform(left, lambda i: F.get("_d_lines", i)), "\n")
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed_lines")]
    return joined.select(
        *(F.when(hit, rest).otherwise(text).alias(c) if c == text_col else F.col(c) for c in kept),
        F.when(text.isNull(), 0).otherwise(F.size("_d_lines")).cast("long").alias("n_lines"),
        F.when(hit, F.size("_d_covered")).otherwise(0).cast("long").alias("n_removed_lines"),
    )


#: ``doc_id, text, n_lines, n_removed_lines`` of ``dedup_lines`` in DuckDB SQL, for ids without repeats.
SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM split WHERE trim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g'), ' ') <> ''),
spans AS (
  SELECT doc_id, p, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM spans WHERE c IS NOT NULL) WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM later),
gone AS (SELECT f.doc_id, f.i FROM filled f JOIN covered USING (doc_id, p)),
rest AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.i) FILTER (WHERE g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed_lines
  FROM split s LEFT JOIN gone g USING (doc_id, i) GROUP BY s.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines
FROM documents d LEFT JOIN rest r USING (doc_id)
"""
