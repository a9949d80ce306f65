"""Session helpers shared by the corpus operators: worker import path, stage tables and their end."""

from __future__ import annotations

import os
import threading
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import delete, shared_dir, spread  # noqa: F401
from ..session import new_path as _new_path

ROOT = str(Path(__file__).resolve().parents[2])
_OWN = threading.local()  # paths of each thread's stage tables that still stand, the oldest first


def _made() -> list[str]:
    if not hasattr(_OWN, "paths"):
        _OWN.paths = []
    return _OWN.paths


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver imported it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; what is there goes when the driver ends, as results are lazy."""
    path = _new_path(spark, what)
    _made().append(path)
    return path


def made() -> int:
    """A mark for ``sweep``."""
    return len(_made())


def sweep(since: int, *kept: DataFrame) -> None:
    """Remove the tables that this thread made since a mark, but those that the ``kept`` ones are read from."""
    names = {f.rsplit("/", 2)[-2] for df in kept for f in df.inputFiles()}  # a table's folder has a name of its own
    for path in _made()[since:]:
        if path.rsplit("/", 1)[-1] not in names:
            delete(kept[0].sparkSession, path)
            _made().remove(path)


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Cuts the lineage, so that a lost executor costs a reread and not a recomputation, and
    gives the next plan true sizes.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """The whole ``documents`` table, ``dealt`` over all cores if it is in few files."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(table) if dealt else table


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Plan what is run inside with at most so many rows in an Arrow batch: rows that are large need few."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
