"""Rows of a stream by key, before they reach an operator with state, and what waits there as one value.

Such an operator gets its rows one by one from the JVM, which costs more than
what it does with most of them. As arrays, neighbours of one key are one row.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T


def gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a key and Arrow batch, with an array for each of the other columns. Nothing is shuffled or sorted: values keep their order."""
    others = [c for c in rows.columns if c not in keys]

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(list(keys), use_threads=False).aggregate([(c, "list") for c in others])
            yield from found.select([*keys, *(f"{c}_list" for c in others)]).rename_columns([*keys, *others]).to_batches()

    schema = T.StructType([T.StructField(c, rows.schema[c].dataType if c in keys else T.ArrayType(rows.schema[c].dataType)) for c in (*keys, *others)])
    return rows.mapInArrow(gather, schema)


def spread(rows: Iterable[Row], *columns: str) -> list[tuple]:
    """The ``gathered`` rows of one key as tuples of these columns."""
    found: list[tuple] = []
    for r in rows:
        found.extend(zip(*itemgetter(*map(r.__fields__.index, columns))(r), strict=True))
    return found


def packed(rows: Iterable[tuple]) -> bytes:
    """Rows of whole numbers (or booleans) as longs, one after the other."""
    return array("q", chain.from_iterable(rows)).tobytes()


def unpacked(value: bytes, width: int) -> Iterator[tuple]:
    """The rows that were ``packed``."""
    longs = iter(array("q", bytes(value)))
    return zip(*[longs] * width, strict=True)
