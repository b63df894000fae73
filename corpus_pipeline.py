"""A corpus pipeline: filter, deduplicate twice, mix and pack the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sevscale.llm.exact import exact_dedup
from sevscale.llm.frames import numbered, orderable, row_key, text_digest
from sevscale.llm.jaccard import similar_groups
from sevscale.llm.mixing import mixed_rows
from sevscale.llm.packing import pack
from sevscale.llm.quality import fit_rules, quality_verdicts, text_statistics
from sevscale.llm.queries import VOCABULARY
from sevscale.sources.staging import stage
from sevscale.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list accept."""
    statistics = stage(text_statistics(docs, digest=True), "statistics")
    rules = fit_rules(statistics, read_table(spark, sf_dir, "labels"))
    kept = quality_verdicts(statistics, rules).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("__key"))
    keyed = docs.withColumn("__key", row_key(F.col("doc_id"), text_digest(F.col("text"))))
    return keyed.join(kept, "__key", "left_semi").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity: the one with the smallest id.

    Rows are told apart by a staged number.  A null id comes last; of rows of one id in a
    group, the first by text digest and the other columns stays.
    """
    rows = numbered(docs)
    groups = similar_groups(rows, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = [F.col("doc_id").isNull(), F.col("doc_id"), text_digest(F.col("text")), *orderable(docs, "doc_id", "text"), F.col("__row")]
    ranked = rows.select("__row", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]).alias("__order"))
    first = ranked.join(groups, "__row").groupBy("component_id").agg(F.min_by("__row", "__order").alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target uses them."""
    return mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2,048."""
    return pack(docs, VOCABULARY, added=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near duplicates", near),
          ("mixing", mix), ("packing", packed)]

# Learned rules and token ids are not expressible; tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that the stages keep, each stage staged before the next.

    Null and empty texts fail the base rules and go; so do texts under 20 words.  Repeated rows
    come down to one by their text.  Texts are read whole.  No documents in, no pieces out.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
