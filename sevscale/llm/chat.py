"""Chat formatting after collapsing logged snapshots of growing conversations.

A conversation logged after every turn appears as many rows, each a prefix of the next.  The
rolling hash of a prefix is the exclusive or of its turns' hashes, each salted with its place,
so hashes of prefixes roll along in buckets of turns.  Conversations whose whole hash is a
proper prefix of another, or which repeat another, are removed by anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = 1024  # turn numbers per bucket


def _turn_hashes(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("__place"), F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0")))


def placed_turns(df: DataFrame) -> DataFrame:
    """Turns with their place (from 1) in the conversation and the prefix hash up to them.

    Order is by turn, then role and text.  A row that repeats another's turn, role and text
    is the same turn and counts once.  Two levels (buckets of turn numbers, then turns)
    keep a very long conversation out of a single task.
    """
    turns = df.distinct().withColumn("__bucket", F.floor(F.col("turn") / TURNS))
    by_bucket = Window.partitionBy("conv_id").orderBy(F.col("__bucket").asc_nulls_first())
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)

    def joined(rows: DataFrame, totals: DataFrame) -> DataFrame:
        totals = totals.withColumnsRenamed({"conv_id": "__c", "__bucket": "__b"})
        same = F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("__bucket").eqNullSafe(F.col("__b"))
        return rows.join(totals, same).drop("__c", "__b")

    sizes = turns.groupBy("conv_id", "__bucket").agg(F.count("*").alias("__n")).select(
        "conv_id", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("conv_id", "__bucket").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    placed = joined(turns.withColumn("__row", F.row_number().over(inside)), sizes).withColumn(
        "__place", F.col("__before") + F.col("__row")
    ).withColumn("__h1", _turn_hashes(1)).withColumn("__h2", _turn_hashes(2))
    mixed = placed.groupBy("conv_id", "__bucket").agg(
        F.bit_xor("__h1").alias("__x1"), F.bit_xor("__h2").alias("__x2")
    ).select("conv_id", "__bucket",
             F.coalesce(F.bit_xor("__x1").over(earlier), F.lit(0)).alias("__p1"),
             F.coalesce(F.bit_xor("__x2").over(earlier), F.lit(0)).alias("__p2"))
    along = Window.partitionBy("conv_id", "__bucket").orderBy("__place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return joined(placed, mixed).select(
        "conv_id", "turn", "role", "text", F.col("__place").alias("place"),
        F.bit_xor("__h1").over(along).bitwiseXOR(F.col("__p1")).alias("prefix1"),
        F.bit_xor("__h2").over(along).bitwiseXOR(F.col("__p2")).alias("prefix2"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """Ids of the conversations that no other one continues or, with a smaller id, repeats.

    ``turns`` is the result of ``placed_turns``.
    """
    whole = turns.groupBy("conv_id").agg(
        F.max(F.struct("place", "prefix1", "prefix2")).alias("w")
    ).select("conv_id", "w.*")
    longest = turns.select("conv_id", "place", "prefix1", "prefix2").join(
        whole.select(F.col("conv_id").alias("__c"), F.col("place").alias("__n")),
        F.col("conv_id").eqNullSafe(F.col("__c")),
    )
    inner = longest.where(F.col("place") < F.col("__n")).select("place", "prefix1", "prefix2").distinct()
    key = ["place", "prefix1", "prefix2"]
    return whole.join(inner, key, "left_anti").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.min(F.col("conv_id").isNull()).alias("null_id")
    ).select("conv_id", "copies", F.col("place").alias("n_turns"))


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies and the rendered text.

    A turn renders as ``<|role|>``, a line end, its text and a line end; turns follow in
    order.  A null role renders as ``unknown``, a null text as empty, and null differs from
    empty when conversations are compared.  All rows without a conversation id form one
    conversation.  Of equal conversations the smallest id stays (null only if it is alone);
    ``copies`` counts them.  Of other columns none is read.
    """
    turns = placed_turns(df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    ))
    stays = maximal_conversations(turns).withColumnRenamed("conv_id", "__c")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"),
                    F.coalesce("text", F.lit("")), F.lit("\n"))
    return (
        turns.join(stays, F.col("conv_id").eqNullSafe(F.col("__c")))
        .groupBy("conv_id", "n_turns", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
        .select("conv_id", "n_turns", "copies", F.array_join(F.col("lines.line"), "").alias("rendered"))
    )
