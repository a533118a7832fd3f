"""What the operators of this subpackage share.

A document row is identified by ``rid``, a 64-bit hash of its doc_id and text:
rows that are equal in both count as one document wherever rows are joined.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.runtime import ship

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rid(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, rid and text of the rows that have a text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").select("doc_id", rid().alias("rid"), "text")


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors.

    Batches end at ``BATCH_BYTES``, unless the session has a bound of its own, as
    10,000 texts may be of any size. Python workers outlive their tasks, so each
    gives back the free memory it holds when a task ends.
    """
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_CONF, None) is None:
        df.sparkSession.conf.set(BATCH_CONF, str(BATCH_BYTES))

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(g, schema)


def release() -> None:
    """Return the free memory of Arrow's pool and of the C heap to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def text_column(b: pa.RecordBatch, name: str = "text") -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their keys; the input is sorted by
    ``key``, so only one key's rows wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = [b.slice(cut)]
        elif held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    c = t.column(name) if isinstance(t, pa.Table) else t.column(t.schema.get_field_index(name))
    return c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
