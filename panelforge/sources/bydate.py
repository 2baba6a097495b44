"""Tables laid out by date: Arrow tasks see whole dates without a shuffle.

Files are range partitions of dates with one row group each. Readers assign a row group to one task
whatever size they cut files to, so a date never lies in two tasks.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame

from panelforge.session import table_at, work_folder

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells of 8 bytes that a file should hold at most, and that a date may have.
FILE_CELLS = 16_000_000
DATE_CELLS = 32_000_000


class DateTable(NamedTuple):
    """Rows of a table written by :func:`lay_by_date`; narrow operations keep the layout."""

    rows: DataFrame

    def where(self, condition: Column | str) -> DateTable:
        return DateTable(self.rows.where(condition))


def write_whole(rows: DataFrame) -> str:
    """Writes one row group per file, so that no reader cuts a file's rows in two tasks."""
    path = f"{work_folder(rows.sparkSession)}/panelforge-{uuid.uuid4().hex}"
    rows.write.option("parquet.block.size", 2**30).parquet(path)
    return path


def lay_by_date(df: DataFrame, *, rows: int, dates: int, order: Sequence[str] = ("trade_date", "entity")) -> DateTable:
    """Writes ``df`` by date, sorted by ``order``; ``rows`` and ``dates`` are its measured size."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows * len(df.columns) / FILE_CELLS))
    laid = df.repartitionByRange(max(1, min(tasks, dates)), "trade_date").sortWithinPartitions(*order)
    return DateTable(table_at(laid, write_whole(laid)))


def fits(widest: int, columns: int) -> bool:
    """Whether the widest date can be read by one task."""
    return widest * columns <= DATE_CELLS


def whole_dates(batches: Iterator[pa.RecordBatch], column: str = "trade_date") -> Iterator[pa.Table]:
    """Batches joined and cut so that no date is in two of them; rows of a date follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(column).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(at != at[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and at[0] != held[-1].column(column)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def each_date(batches: Iterator[pa.RecordBatch], column: str = "trade_date") -> Iterator[pa.Table]:
    """One table per date."""
    for table in whole_dates(batches, column):
        at = table.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
