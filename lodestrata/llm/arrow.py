"""Small helpers for Arrow batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lodestrata.session import spread


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string; needs a running session."""
    kind = _parse_datatype_string(ddl)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], ddl: str, flush: int = 4096) -> DataFrame:
    """Call a row function in Arrow batches: positional values of `df` in, any number of tuples of `ddl` out.

    `make` runs once per task, so that automata, grammars and vocabularies are built once per worker; output is
    flushed every `flush` rows, so that a batch that fans out doesn't grow without bound.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(call(*row))
                if len(out) >= flush:
                    yield to_batch(out, schema)
                    out = []
        if out:
            yield to_batch(out, schema)

    return spread(df).mapInArrow(run, ddl)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
