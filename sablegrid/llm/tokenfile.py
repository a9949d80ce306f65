"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

A range partition of the documents by id becomes one triple of files in the shared folder: ``.ids``
(flat little-endian unsigned 16-bit integers, 32-bit for vocabularies beyond 65,536 ids), ``.off``
(64-bit offsets of the documents and the end) and ``.doc`` (an Arrow file with the document ids).
The partitions' totals, prefix-summed, are the bases of the global order. A task writes under a name
of its own attempt and then renames, so a task that is run again leaves whole files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import blocks
from .library import library_tokens, with_end
from .session import new_path, stage

KINDS = ("ids", "off", "doc")


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _map(files: pafs.FileSystem, path: str, dtype) -> np.ndarray:
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if files.get_file_info(path).size else np.empty(0, dtype)
    with files.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def write_token_files(df: DataFrame, path: str, folder: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every text, append ``end``, and write the files in ascending order of ``id_col``.

    ``folder`` is a URI that driver and executors share. Returns the index: ``dtype``, ``parts`` as
    [part, documents, tokens, base], ``tokens`` and ``documents``; it is also written as
    ``index.json``. Null and empty texts are their end id alone; null ids come first; repeated ids
    stand beside each other by the text's hash; an empty table makes an index without parts.
    """
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, task = library_tokens(path), TaskContext.get()
        files, root = _file_system(folder)
        name, own = f"{root}/part-{task.partitionId():05d}", f"{root}/.attempt-{task.taskAttemptId()}"
        try:
            yield from attempt(batches, library, files, name, own, task.partitionId())
        finally:  # what a failed attempt left
            for kind in KINDS:
                if files.get_file_info(f"{own}.{kind}").type == pafs.FileType.File:
                    files.delete_file(f"{own}.{kind}")

    def attempt(batches, library, files, name: str, own: str, part: int) -> Iterator[pa.RecordBatch]:
        offsets, docs, total = [np.zeros(1, "<i8")], [], 0
        with files.open_output_stream(f"{own}.ids") as out:
            for batch in blocks(batches, text_col):
                ids, bounds = with_end(*library.tokens(batch.column(text_col)), end)
                out.write(np.ascontiguousarray(ids, library.dtype))
                offsets.append(bounds[1:] + total)
                docs.append(batch.select([id_col]))
                total += int(bounds[-1])
        if not docs:
            return
        with files.open_output_stream(f"{own}.off") as out:
            out.write(np.concatenate(offsets).astype("<i8"))
        with files.open_output_stream(f"{own}.doc") as out, pa.ipc.new_file(out, docs[0].schema) as writer:
            for d in docs:
                writer.write_batch(d)
        for kind in KINDS:  # every attempt writes the same files, so it does not matter whose stands there
            files.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sum(len(d) for d in docs)]), pa.array([total])], names=schema.names)

    files, root = _file_system(folder)
    files.create_dir(root)
    ordered = df.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, F.xxhash64(text_col), text_col)
    written = sorted(map(tuple, stage(ordered.mapInArrow(run, schema), "token-files").collect()))  # one row for each file
    bases = np.cumsum([0, *(tokens for _, _, tokens in written)]).tolist()
    index = {"dtype": library_tokens(path).dtype.str, "parts": [[*w, b] for w, b in zip(written, bases, strict=False)], "tokens": bases[-1], "documents": sum(w[1] for w in written)}
    with files.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def read_token_files(spark: SparkSession, folder: str, index: dict, id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """The documents of the files: ``id_col``, ``start``, ``n_tokens``, ``ids_crc32`` (of the ids as 32-bit integers)."""
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])
    parts, dtype = index["parts"], index["dtype"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                part, _, _, base = parts[k]
                name = f"{root}/part-{part:05d}"
                ids, offsets = _map(files, f"{name}.ids", dtype), _map(files, f"{name}.off", "<i8")
                with files.open_input_file(f"{name}.doc") as file:
                    docs = pa.ipc.open_file(file).read_all().column(0).combine_chunks()
                ends = offsets.tolist()
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([docs, pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=schema.names)

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, schema)


def token_files(df: DataFrame, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files to a new folder of the shared directory and read the documents back."""
    folder = new_path(df.sparkSession, "token-ids")
    index = write_token_files(df, path, folder, end, id_col, text_col)
    return read_token_files(df.sparkSession, folder, index, df.schema[id_col].dataType, id_col)
