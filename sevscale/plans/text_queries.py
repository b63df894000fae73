"""Queries that clean text and markup."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from sevscale.functions import text as T
from sevscale.plans.catalog import query
from sevscale.sources.tables import read_table, spread

# What the cleaners delete, stated for the SQL.
URL = r"https?://\S+|www\.\S+"
MARKUP = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[a-z/!?][^>]*>"
)
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)


def replaced(text: str, pattern: str, by: str) -> str:
    quoted = [part.replace("'", "''") for part in (pattern, by)]
    return f"regexp_replace({text}, '{quoted[0]}', '{quoted[1]}', 'g')"


# References the SQL decodes, the ampersand last.  With and without semicolon where
# HTML allows both; these are the ones that occur in the given pages, and the basic ones.
REFERENCES = (
    ("&copy;?", "\u00a9"), ("&middot;?", "\u00b7"), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'),
    ("&#39;?", "'"), ("&nbsp;?", "\u00a0"), ("&amp;?", "&"),
)


def decoded(text: str) -> str:
    for reference, char in REFERENCES:
        text = replaced(text, reference, char)
    return text


def cleaned(text: str) -> str:
    bare = decoded(replaced(replaced(text, URL, ""), MARKUP, ""))
    spaced = replaced(replaced(bare, EMOJI, ""), r"[^a-zA-Z\p{Nd}]", " ")
    return f"trim({replaced(spaced, ' +', ' ')})"


def punct_normalized(text: str) -> str:
    """The punctuation rules without back references: one replacement per character."""
    text = f"replace({text}, chr(10), ' ' || chr(10) || ' ')"
    text = replaced(text, r"([a-zA-Z]+)([/!?.])([a-zA-Z]+)", r"\1 \2 \3")
    for c in "*!?'":
        text = replaced(text, "\\" + c + "{4,}" if c != "'" else "'{4,}", c * 3)
    text = replaced(text, r"([*!?']+)", r" \1 ")
    for c in string.ascii_letters:
        text = replaced(text, c + r"{3,}($|[^\p{L}\p{N}_])", c * 2 + r"\1")
    for c in string.ascii_letters:
        text = replaced(text, c + "{4,}", c * 3)
    return replaced(replaced(text, "[ ]{2,}", " "), r"^\s+|\s+$", "")


def documents(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def pages(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


@query("clean_text", f"SELECT doc_id, {cleaned('text')} AS text FROM documents")
def clean_text(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("text", T.clean_text(F.col("text")))


@query("clean_pages", f"SELECT page_id, {cleaned('html')} AS text FROM pages")
def clean_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.clean_text(F.col("html")).alias("text"))


@query("strip_urls", f"SELECT page_id, {replaced('html', URL, '')} AS text FROM pages")
def strip_urls(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.strip_urls(F.col("html")).alias("text"))


@query("strip_html", f"SELECT page_id, {decoded(replaced('html', MARKUP, ''))} AS text FROM pages")
def strip_html(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("strip_emoji", f"SELECT doc_id, {replaced('text', EMOJI, '')} AS text FROM documents")
def strip_emoji(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("text", T.strip_emoji(F.col("text")))


@query("strip_specials", "SELECT doc_id, "
       + replaced("text", r"[^a-zA-Z\p{Nd}]", " ") + " AS text FROM documents")
def strip_specials(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("text", T.strip_specials(F.col("text")))


@query("normalize_punct", f"SELECT doc_id, {punct_normalized('text')} AS text FROM documents")
def normalize_punct(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("text", T.normalize_punct(F.col("text")))


@query("as_text", "SELECT user_id::VARCHAR AS user_text, count(*) AS n FROM events GROUP BY 1")
def as_text(spark, sf_dir):
    ids = read_table(spark, sf_dir, "events").select(T.as_text(F.col("user_id")).alias("user_text"))
    return ids.groupBy("user_text").agg(F.count("*").alias("n"))
