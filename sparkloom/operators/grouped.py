"""Sequential scans of bounded groups without a Python call for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scan_groups(df: DataFrame, key: str, order: str, columns: list[str], scan: Callable[[list[dict]], Iterable[tuple]], fields: str) -> DataFrame:
    """``key`` and ``fields`` from a scan of each key's rows in order.

    A group travels as one sorted array and many groups as one Arrow batch; calling Python once for each
    group would cost more than the scan. Groups must fit in memory, as those of one conversation do.
    """
    names = [order, *(c for c in columns if c != order)]
    groups = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__rows"))
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {fields}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [(k, *row) for k, rows in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for row in scan(rows)]
                columns = list(zip(*found, strict=True)) if found else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return groups.mapInArrow(run, schema)
