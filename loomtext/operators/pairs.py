"""Searches: every query with every row of its key, spread over tasks.

A key may have any number of rows. Its queries and rows are dealt into chunks by
their hashes, and each chunk of queries meets each chunk of rows in a group of
its own, so neither a task's memory nor its time grows with a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomtext.functions.similarity import Block, blocks
from loomtext.runtime import ship

#: queries and rows that a group has, about
QUERIES, ROWS = 128, 16384


def met(queries: DataFrame, rows: DataFrame, f: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, *, most_queries: int = QUERIES, most_rows: int = ROWS) -> DataFrame:
    """What ``f`` gives for chunks of queries and of rows (key, id, value) of one
    key. Each query meets each row of its key in one call, and in no other."""
    ship(rows.sparkSession)
    count = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    n = count(queries, "queries").join(count(rows, "rows"), "key")
    chunks = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    n = n.select("key", chunks("queries", most_queries).alias("q"), chunks("rows", most_rows).alias("r"), (F.col("queries") * F.col("rows")).alias("pairs"))
    whole = n.agg(F.sum(F.col("q").cast("long") * F.col("r")).alias("groups"), F.sum("pairs").alias("pairs")).first()
    # twice as many tasks as there are full groups, so that these spread evenly
    least = 2 * rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(whole.groups or 1, least + 2 * (whole.pairs or 0) // (most_queries * most_rows)))

    def dealt(df: DataFrame, own: str, other: str, row: bool) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return df.join(n, "key").select("key", F.pmod(F.xxhash64("id", "value"), F.col(own)).cast("int").alias(own), each, F.lit(row).alias("row"), "id", "value").select("key", "q", "r", "row", "id", "value")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        row = t.column("row")
        yield from f(t.filter(pc.invert(row)).select(["id", "value"]), t.filter(row).select(["id", "value"]))

    both = dealt(queries, "q", "r", False).unionByName(dealt(rows, "r", "q", True))
    return both.repartition(tasks, "key", "q", "r").groupBy("key", "q", "r").applyInArrow(group, schema)


def text_search(queries: DataFrame, rows: DataFrame, values: Callable[[Block], list[np.ndarray]], schema: str, **most: int) -> DataFrame:
    """(a, b, values): what ``values`` has of the texts of each query a and each row
    b (key, id, value) of its key, but those of the same id. ``values`` gives
    matrices of a block's texts and those of its tree; ``schema`` names their columns."""

    def f(q: pa.Table, r: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = (t.column("id").to_numpy() for t in (q, r))
        for mine, others, which, block in blocks(q.column("value").to_pylist(), r.column("value").to_pylist()):
            x, y = np.repeat(a[mine], len(others)), np.tile(b[others], len(mine))
            kept = x != y
            columns = [x, y, *(np.asarray(v)[:, which].ravel() for v in values(block))]
            yield pa.RecordBatch.from_arrays([pa.array(c if kept.all() else c[kept], t) for c, t in zip(columns, types.types)], schema=types)

    ddl = f"a long, b long, {schema}"
    types = to_arrow_schema(StructType.fromDDL(ddl))
    clean = lambda df: df.where(F.col("id").isNotNull() & F.col("value").isNotNull())
    return met(clean(queries), clean(rows), f, ddl, **most)
