"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sevscale.sources.staging import stage, staged_path


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def per_batch(
    df: DataFrame, schema: str, rows: Callable[[dict[str, list]], dict[str, object]]
) -> DataFrame:
    """Apply a function from column lists to column lists to each Arrow batch."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


def count_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space, natively."""
    return F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("bigint")


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def row_key(id_: Column, digest: Column) -> Column:
    """One string for an id, which may be null, and the digest of its text."""
    return F.concat(F.coalesce(F.concat(F.lit("i"), id_.cast("string")), F.lit("n")), F.lit(":"), digest)


def orderable(df: DataFrame, *without: str) -> list[Column]:
    """The other columns, in a form that orders rows; maps are written out."""
    return [
        F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in df.dtypes if c not in without
    ]


def numbered(df: DataFrame) -> DataFrame:
    """The rows, staged with a number each (``__row``), so that rows alike can be told apart."""
    return stage(df.withColumn("__row", F.monotonically_increasing_id()), "numbered")


class Scratch:
    """Staged tables of one call, removed once what is built on them has been written."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = staged_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """Stage the result and remove the tables it was made from."""
        out = stage(df, name)
        jvm = self.spark._jvm
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []
        return out
