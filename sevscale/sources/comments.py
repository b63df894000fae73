"""Comment files in and result files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from sevscale.sources.records import csv_records

# Input layouts.
FLAG_SCHEMA = (
    "id string, comment_text string, toxic int, severe_toxic int, obscene int, "
    "threat int, insult int, identity_hate int"
)
TEXT_SCHEMA = "id string, comment_text string"
FLAG_LABEL_SCHEMA = (
    "id string, toxic int, severe_toxic int, obscene int, threat int, insult int, "
    "identity_hate int"
)
SCORE_SCHEMA = (
    "id long, comment_text string, toxicity double, severe_toxicity double, obscene double, "
    "threat double, insult double, identity_attack double, sexual_explicit double, "
    "toxicity_annotator_count int"
)
OFFENCE_SCHEMA = "txt string, offensiveness_score double"
PAIR_SCHEMA = "less_toxic string, more_toxic string"
FOLDED_PAIR_SCHEMA = "less_toxic string, more_toxic string, kfold int"
TO_SCORE_SCHEMA = "comment_id long, text string"


def _typed(field: StructField) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, IntegralType):
        # "1.0" is a whole number too
        return F.coalesce(
            value.try_cast(field.dataType), value.cast("double").cast(field.dataType)
        )
    return value.cast(field.dataType)


def read_comments(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Read headered CSV whose texts may hold quoted line breaks and doubled quotes.

    One large file is read by many tasks: see ``sevscale.sources.records``.  Quotes must stand
    around whole fields, doubled inside them; a file that ends inside quotes fails.  The columns
    are found by name, so a file may hold them in any order and hold more than the schema asks
    for; files of one folder must agree, or reading fails.  Texts such as ``NA`` stay texts.
    """
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.options(header=True, **options).csv(path).columns
    options["lineSep"] = "\n"  # carriage returns in texts stay
    text = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    records = csv_records(spark, path)
    parsed = records.select("first", F.from_csv("record", text, options).alias("r"))
    agrees = F.lit(True)
    for i, n in enumerate(names):
        # Spark names a column without a name after its place and adds the place to repeated names
        value = F.coalesce(F.col("r").getField(n), F.lit("_c"))
        agrees = agrees & ((value == n) | (F.concat(value, F.lit(str(i))) == n))
    odd = F.raise_error(F.lit(f"a file of {path} has another header than {','.join(names)}")).cast("boolean")
    rows = parsed.where(~F.when(F.col("first"), F.when(agrees, True).otherwise(odd)).otherwise(False)).select("r.*")
    return rows.select(*[_typed(f).alias(f.name) for f in wanted.fields])


def comments_to_parquet(spark: SparkSession, path: str, schema: str, out: str) -> DataFrame:
    """One-time conversion, so that later reads prune columns and push filters down."""
    read_comments(spark, path, schema).write.parquet(out)
    return spark.read.parquet(out)


def _csv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).option("quote", '"').option("escape", '"').csv(path, header=True)


def write_comments(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a frame in the layout ``read_comments`` reads back unchanged."""
    _csv(df, path, mode)


def write_submission(
    df: DataFrame, path: str, id_col: str = "comment_id", rank_col: str = "score",
    mode: str = "error",
) -> None:
    """Two columns, id and rank, as headered CSV; one file per partition."""
    _csv(df.select(F.col(id_col), F.col(rank_col)), path, mode)


def write_scored_pairs(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """The pair table with its scores, gap and verdict."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        _csv(df, path, mode)
    else:
        raise ValueError(f"fmt must be 'parquet' or 'csv', not {fmt!r}")
