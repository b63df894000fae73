"""Line deduplication in built-in functions: repeated lines stay in one document only.

Lines explode with their positions and a 128-bit hash of their normalised form.  Counting
combines before the shuffle, so a line that a third of all documents hold is one row per task.
Only the places of dropped lines travel back to the documents, which are put together again by
position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sevscale.llm.frames import Scratch, text_digest

LEAST_CHARS = 40
LEAST_DOCS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\f\r"


def text_lines(text: Column) -> Column:
    """The lines between line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare_line(line: Column) -> Column:
    """ASCII white space off both ends."""
    return F.btrim(line, F.lit(_BLANK))


def line_key(line: Column) -> Column:
    """The bare line with A-Z lowered."""
    bare = bare_line(line)
    plain = F.octet_length(bare) == F.char_length(bare)  # ASCII alone, where Spark's quicker function does the same
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _short_hash(digest: Column) -> Column:
    return F.substring(F.unhex(digest), 1, 16)


def keyed_lines(df: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(id, text_hash, pos, hash) of every line long enough to count."""
    # the text's digest is taken below the explosion, once per text
    rows = df.select(F.col(id_col).alias("id"), _short_hash(text_digest(F.col(text_col))).alias("text_hash"),
                     text_lines(F.col(text_col)).alias("lines"))
    # lowering A-Z keeps the length
    long = rows.select("id", "text_hash", F.posexplode("lines").alias("pos", "line")).where(
        F.char_length(bare_line(F.col("line"))) >= least_chars)
    return long.select("id", "text_hash", "pos", _short_hash(F.sha2(line_key(F.col("line")), 256)).alias("hash"))


def dropped_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """(id, text_hash, places): the places of lines to drop, for every row that loses any.

    Plain counts come first and combine per task.  Ids are told apart only for hashes that
    occur often enough: one row per hash and id, then one per hash.  Hot hashes meet a side on
    which they are unique, which Spark's skew-join splitting handles.
    """
    scratch = Scratch(df.sparkSession)
    lines = keyed_lines(df, id_col, text_col, least_chars)
    often = scratch.keep(
        lines.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("hash"), "often")
    hits = scratch.keep(lines.join(often, "hash"), "line_hits")
    per_line = hits.groupBy("hash", "id").agg(F.count("*").alias("n")).groupBy("hash").agg(
        F.count("*").alias("n_ids"), F.max("id").alias("keep"))
    repeated = scratch.keep(per_line.where(F.col("n_ids") >= least_docs).select("hash", "keep"), "repeated_lines")
    gone = hits.join(repeated, "hash").where(~F.col("id").eqNullSafe(F.col("keep")))
    return scratch.finish(gone.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("places")), "dropped_lines")


def without_repeated_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """The rows with the text that is left, ``n_lines`` before dropping and ``n_dropped``.

    A line whose key has at least ``least_chars`` code points and is found under at least
    ``least_docs`` ids is dropped, except under the largest id that holds it, where all its
    occurrences stay.  Kept lines are joined as they were written.  A null or empty text is one
    empty line and becomes the empty text.  Rows of one id are one document: a line counts once
    for them and is kept or dropped in all of them.  A null id is one id, smaller than all
    others.  Columns named ``n_lines`` or ``n_dropped`` are replaced; all others come along.  An
    empty table gives no rows; texts of any length are read whole.
    """
    dropped = dropped_lines(df, id_col, text_col, least_chars, least_docs)
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"),
                     _short_hash(text_digest(F.col(text_col))).alias("doc_hash"))
    same = F.col(f"doc.`{id_col}`").eqNullSafe(F.col("id")) & (F.col("doc_hash") == F.col("text_hash"))
    joined = docs.join(dropped, same, "left").withColumn("lines", text_lines(F.col(f"doc.`{text_col}`")))
    # a set difference of places is linear, unlike looking each place up in a list
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    text = F.when(F.col("places").isNull(), F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        *[(text if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in names],
        F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("bigint").alias("n_dropped"),
    )


def line_digests(kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of rows made by ``without_repeated_lines``."""
    return kept.select(F.col(id_col).alias("doc_id"), "n_lines", "n_dropped", F.sha2(text_col, 256).alias("kept_sha256"))
