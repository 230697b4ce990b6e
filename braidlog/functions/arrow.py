"""Row functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MOST_CHARS = 8_000_000


def safe(text: str) -> str:
    """``text`` without lone surrogates, which no UTF-8 can hold."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, at_once: int = 10_000) -> DataFrame:
    """``make()`` runs once a task and gives a function of one row's values, which yields output rows.

    Output leaves in batches of about ``at_once`` rows or ``MOST_CHARS`` characters, so that a task's memory doesn't
    follow its input.
    """
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct, prefers_large_types=False)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in each(*values):
                    rows.append(row)
                    for x in row:
                        if type(x) is str:
                            size += len(x)
                if len(rows) >= at_once or size >= MOST_CHARS:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return df.mapInArrow(run, struct)


def replace_columns(df: DataFrame, columns: list[str], make: Callable[[], Callable[[object], object]]) -> DataFrame:
    """``df`` with the values of some columns replaced, row by row; all other columns pass through, without a shuffle.

    ``make()`` runs once a task and gives a function of one value.
    """
    arrow = to_arrow_schema(df.schema, prefers_large_types=False)
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            arrays = list(batch.columns)
            for i in at:
                arrays[i] = pa.array([each(x) for x in arrays[i].to_pylist()], arrow.field(i).type)
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, df.schema)
