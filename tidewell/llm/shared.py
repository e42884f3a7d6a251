"""Shared-folder tables, checked inputs and crc folds used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, and that in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidewell/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts lineage in a form that outlives any executor; so the shuffles of
    the write are dropped when it has ended, not when the driver next collects
    garbage.
    """
    path, spark = new_path(df.sparkSession, name), df.sparkSession
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id as long and text as bytes, then more columns: all an operator reads of its input."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), *more)


def filtered(docs: DataFrame, text: str, keep: Callable[[pa.Array], Iterable[tuple[int, int, np.ndarray]]]) -> DataFrame:
    """The rows of docs for which `keep` holds; of a batch's texts it gives (low, high, booleans) by ranges of rows.

    The rows themselves are what crosses to Python, once and with no copy of the
    text beside them; they return in ranges as small as `keep` makes them.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
                column = column.cast(pa.string())
            for low, high, good in keep(column):
                if good.any():
                    yield batch.slice(low, high - low).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
