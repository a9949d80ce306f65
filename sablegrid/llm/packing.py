"""Packing documents into fixed-length token sequences: concatenate and cut.

Pass one tokenizes each document where it lies and writes its ids with its offset inside the
partition. The partitions' totals, one number each, are prefix-summed to bases. Pass two reads the
ids and cuts every document at the global multiples of the window; a document that crosses such a
boundary gives one record for each side. Nothing is shuffled, no window is gathered anywhere, and
only the last sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import blocks, expand
from .library import library_tokens, with_end
from .session import stage


def tokenize(df: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, part, start, n, ids): ids as binary, start counts ids before it in its partition."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, before = library_tokens(path), TaskContext.get().partitionId(), 0
        for batch in blocks(batches, text_col):
            ids, bounds = with_end(*library.tokens(batch.column(text_col)), end)
            width = ids.dtype.itemsize
            binary = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), binary.cast(pa.binary())], names=schema.names)
            before += int(bounds[-1])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def pack(df: DataFrame, path: str, end: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of ``window`` ids.

    Returns one row per piece: ``id_col``, ``start`` (the document's ids before the piece),
    ``length``, ``ids_crc32`` (of the piece's ids as little-endian unsigned 32-bit integers),
    ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (in the sequence),
    ``sequence_length`` (ids in the sequence), ``padded_length`` (``window``, or the sequence's own
    length where that is a power of two) and, with ``keep_ids``, binary ``ids``. A null or empty
    text is its end id alone. Repeated rows are packed as often as they come; null ids stay; other
    columns are not read; an empty table gives no pieces.
    """
    tokens = stage(tokenize(df, path, end, id_col, text_col), "packing")
    totals = sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each scan partition
    ends = np.cumsum([r["n"] for r in totals]) if totals else np.zeros(0, np.int64)
    # One entry for each scan partition.
    shared = df.sparkSession.sparkContext.broadcast({r["part"]: int(e - r["n"]) for r, e in zip(totals, ends, strict=True)})
    total = int(ends[-1]) if len(ends) else 0
    long = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "padded_length")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in long), *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    tail = total % window
    padded = tail if tail and tail & (tail - 1) == 0 else window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, bases = library_tokens(path).dtype, shared.value
        for batch in blocks(batches, "ids"):
            base = np.array([bases[p] for p in batch.column("part").to_pylist()], np.int64)
            n = batch.column("n").to_numpy()
            first = base + batch.column("start").to_numpy()
            sequence = first // window
            cuts = (first + n - 1) // window - sequence + 1
            row = np.repeat(np.arange(batch.num_rows), cuts)
            sequence = expand(sequence, cuts)
            begin = np.maximum(sequence * window, first[row])
            stop = np.minimum((sequence + 1) * window, first[row] + n[row])
            start = begin - first[row]
            ids = [np.frombuffer(x, dtype).astype("<u4") for x in batch.column("ids").to_pylist()]
            pieces = [ids[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), (stop - first[row]).tolist(), strict=True)]
            full = np.minimum((sequence + 1) * window, total) - sequence * window
            columns = [batch.column(id_col).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, stop - begin, [zlib.crc32(x) for x in pieces], n[row], sequence, begin - sequence * window, full, np.where(full == window, window, padded)))]
            if keep_ids:
                columns.append(pa.array([x.tobytes() for x in pieces], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return tokens.mapInArrow(run, schema)
