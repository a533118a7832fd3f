"""Arrow-batched functions that run with this package on the executors."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from loomtext.runtime import ship


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def attempted(df: DataFrame, one: Callable[[dict], dict], schema: str) -> DataFrame:
    """``df`` with the columns that ``one`` gives for each row, and ``error``.

    A row on which it fails has null in them and the kind and text of the error;
    the executor's log has it as a warning. The rest of the job goes on."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), schema, "error string"])
    empty = df.sparkSession.createDataFrame([], schema).schema
    types = to_arrow_schema(empty)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = logging.getLogger("loomtext")
        for b in batches:
            out: list[dict] = []
            errors: list[str | None] = []
            for row in b.to_pylist():
                try:
                    out.append(one(row))
                    errors.append(None)
                except Exception as e:  # any: that is what this is for
                    log.warning("row failed: %s: %s", type(e).__name__, e)
                    out.append({})
                    errors.append(f"{type(e).__name__}: {e}")
            new = [pa.array([r.get(t.name) for r in out], t.type) for t in types]
            yield pa.RecordBatch.from_arrays([*b.columns, *new, pa.array(errors, pa.string())], names=[*b.schema.names, *types.names, "error"])

    return mapped(df, f, ddl)
