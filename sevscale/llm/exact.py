"""Exact deduplication by recipes of content-defined chunks.

A text is cut where its own content says so: at the first full stop, line end or space-led
sentence break after at least 512 characters, and after 4,096 at the latest.  Every distinct
chunk is checked once: its 64-bit identifier counts as verified if all chunks that have it
agree in SHA-256 and length.  Texts are then compared as ordered lists of identifiers; the
texts themselves never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sevscale.llm.frames import orderable, row_key, text_digest

CHUNK = r"(?s).{512,4095}?[.\n!?;]|.{1,4096}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def colliding_identifiers(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Identifiers that stand for more than one chunk; none, unless 64 bits collide."""
    pieces = df.select(F.explode(F.array_distinct(chunks(F.coalesce(F.col(text_col), F.lit(""))))).alias("chunk"))
    # The content is told apart by its lowest and highest value: both combine before the shuffle.
    told = F.sha2(F.col("chunk"), 256)
    return (
        pieces.select(F.xxhash64("chunk").alias("identifier"), F.length("chunk").alias("n"), told.alias("content"))
        .groupBy("identifier")
        .agg(F.min("content").alias("low"), F.max("content").alias("high"),
             F.min("n").alias("short"), F.max("n").alias("long"))
        .where((F.col("low") != F.col("high")) | (F.col("short") != F.col("long")))
        .select("identifier")
    )


def with_recipe(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``recipe``, the ordered chunk identifiers; null text counts as empty.

    Should identifiers collide, all of them are replaced by the chunks' SHA-256 values.
    """
    collided = colliding_identifiers(df, text_col).agg(F.count("*")).scalar()
    pieces = chunks(F.coalesce(F.col(text_col), F.lit("")))
    short = F.transform(pieces, lambda c: F.xxhash64(c).cast("string"))
    return df.withColumn(
        "recipe", F.when(collided == 0, short).otherwise(F.transform(pieces, lambda c: F.sha2(c, 256)))
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical; null counts as empty.  The largest id of a group stays.
    Rows that repeat an id together with its text: one of them stays.  A null id stays only
    where its whole group has none, and then once.  Other columns are neither read nor
    returned, so their names cannot clash.  No rows in, no rows out.
    """
    rows = with_recipe(
        df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text"
    ).select("doc_id", "recipe", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    groups = rows.groupBy(F.col("recipe").alias("group")).agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    again = Window.partitionBy("recipe", "doc_id").orderBy("text_sha256")
    return (
        rows.withColumn("__again", F.row_number().over(again))
        .join(groups, F.col("recipe") == F.col("group"))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__again") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    Rows are found by id and text.  Of rows that repeat both, the first by the other columns
    stays; all but one per task go before the shuffle.
    """
    stays = exact_groups(df, id_col, text_col).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("__key"))
    keyed = df.withColumn("__key", row_key(F.col(id_col), text_digest(F.col(text_col))))
    again = Window.partitionBy("__key").orderBy(*orderable(df, id_col, text_col) or ["__key"])
    once = keyed.withColumn("__again", F.row_number().over(again)).where(F.col("__again") == 1)
    return once.join(stays, "__key", "left_semi").select(*df.columns)
