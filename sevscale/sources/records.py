"""Records of quoted text files, one file read by many tasks.

Spark splits a text file at line breaks, and a line break inside quotes does not end a record.
Whether a range of a file starts inside quotes follows from the number of quotes before it: each
range counts its quotes, the counts are added up along the file, and the parity says how the
range's first line is to be read.  Every range then cuts its own records; only the pieces of
records that run across ranges, at most two a range, are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, OPENS, GOES_ON = 0, 1, 2  # a record; the first piece of one; a later piece
PIECES = "file string, start long, kind int, first boolean, record string"


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): lines and the range of a file they were read from, in file order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def range_parities(lines: DataFrame) -> DataFrame:
    """(file, start, odd): whether a range starts inside quotes; one row per range."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("file")
    counted = lines.groupBy("file", "start").agg(F.sum(quotes).alias("n"))
    unclosed = F.raise_error(F.concat(F.lit("a quote is never closed in "), F.col("file"))).cast("boolean")
    return counted.select(
        F.col("file").alias("in_file"), F.col("start").alias("at"),
        F.when(F.sum("n").over(along) % 2 == 1, unclosed)
        .otherwise(F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("odd"),
    )


class _Range:
    """Cuts the lines of one range, given in order, into records and border pieces."""

    def __init__(self, file: str, start: int, odd: bool):
        self.file, self.start, self.odd = file, start, odd
        self.waiting: list[str] = []  # lines of the record that is still open
        self.began = not odd  # whether that record began in this range
        self.fresh = start == 0  # no record was given out yet and the file starts here

    def _row(self, kind: int, record: str) -> tuple[int, bool, str]:
        first = self.fresh
        if first:
            record = record.removeprefix("\ufeff")
            first = record not in ("", "\r") or kind != WHOLE
            self.fresh = not first
        return kind, first, record

    def add(self, values: pa.Array) -> pa.RecordBatch:
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.odd) % 2 == 1
        before = np.concatenate(([self.odd], after[:-1]))
        self.odd = bool(after[-1])
        starts = np.flatnonzero(~before)
        rows, records = [], values.slice(0, 0)
        if not len(starts):
            self.waiting += values.to_pylist()
        else:
            self.waiting += values.slice(0, starts[0]).to_pylist()
            if self.waiting:
                rows.append(self._row(WHOLE if self.began else GOES_ON, "\n".join(self.waiting)))
            last = int(starts[-1])
            if len(starts) > 1:
                while self.fresh and len(starts) > 1:  # alone, until a record with text has come
                    rows.append(self._row(WHOLE, "\n".join(values.slice(starts[0], starts[1] - starts[0]).to_pylist())))
                    starts = starts[1:]
                ends = pa.array((starts - starts[0]).astype(np.int32))
                held = pa.ListArray.from_arrays(ends, values.slice(starts[0], last - starts[0]))
                records = pc.binary_join(held, "\n")
            self.began, self.waiting = True, values.slice(last).to_pylist()
        return self._batch(rows, records)

    def finish(self) -> pa.RecordBatch:
        if not self.waiting:
            return self._batch([], pa.array([], pa.string()))
        kind = (OPENS if self.odd else WHOLE) if self.began else GOES_ON
        return self._batch([self._row(kind, "\n".join(self.waiting))], pa.array([], pa.string()))

    def _batch(self, rows: list[tuple[int, bool, str]], records: pa.Array) -> pa.RecordBatch:
        n, m = len(rows), len(records)
        return pa.RecordBatch.from_arrays([
            pa.array([self.file] * (n + m), pa.string()), pa.array([self.start] * (n + m), pa.int64()),
            pa.array([r[0] for r in rows] + [WHOLE] * m, pa.int32()), pa.array([r[1] for r in rows] + [False] * m, pa.bool_()),
            pa.concat_arrays([pa.array([r[2] for r in rows], pa.string()), records.cast(pa.string())]),
        ], names=["file", "start", "kind", "first", "record"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_range = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column("start").to_numpy()
        files = batch.column("file").dictionary_encode().indices.to_numpy()
        change = np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1
        for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            file, start, odd = (batch.column(c)[low].as_py() for c in ("file", "start", "odd"))
            if open_range is None or (open_range.file, open_range.start) != (file, start):
                if open_range is not None:
                    yield open_range.finish()
                if odd is None:
                    raise RuntimeError(f"{file} was split differently while it was read")
                open_range = _Range(file, start, odd)
            yield open_range.add(batch.column("value").slice(low, high - low))
    if open_range is not None:
        yield open_range.finish()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(first, record): each record's text; ``first`` marks the first of each file.

    Line breaks are a line feed, or carriage return and line feed.  Empty lines between
    records are left out.  The parities, one row per range, are broadcast.
    """
    lines = file_lines(spark, path)
    parities = F.broadcast(range_parities(lines))
    same = (F.col("file") == F.col("in_file")) & (F.col("start") == F.col("at"))
    placed = lines.join(parities, same, "left").select("value", "file", "start", "odd")
    pieces = placed.mapInArrow(_cut, PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("first", "record")
    # within a range the later piece of an old record comes before the first piece of a new one
    line = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    parts = pieces.where(F.col("kind") != WHOLE)
    numbered = parts.withColumn("n", F.sum((F.col("kind") == OPENS).cast("int")).over(line))
    piece = F.struct("start", "record")
    joined = numbered.groupBy("file", "n").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["record"]), "\n").alias("record"),
    ).select("first", "record")
    ended = F.regexp_replace("record", "\\r\\z", "")
    return whole.unionByName(joined).select("first", ended.alias("record")).where(F.col("record") != "")
