"""The operators over the given tables, and the SQL that answers them where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sevscale.llm.chat import format_chats
from sevscale.llm.collocations import mine_collocations
from sevscale.llm.exact import exact_groups
from sevscale.llm.jaccard import similar_groups
from sevscale.llm.langid import fit_profiles, identify
from sevscale.llm.lines import line_digests, without_repeated_lines
from sevscale.llm.mixing import by_position, curriculum
from sevscale.llm.packing import pack
from sevscale.llm.quality import fit_rules, quality_verdicts, text_statistics
from sevscale.llm.resampling import importance_resample
from sevscale.llm.secrets import digest_spans, find_secrets
from sevscale.llm.substring import deduplicated_words
from sevscale.llm.urls import url_verdicts
from sevscale.sources.staging import stage
from sevscale.sources.tables import read_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document, learned from those not held out; edges as in ``fit_profiles`` and ``identify``."""
    docs = read_table(spark, sf_dir, "documents")
    profiles = fit_profiles(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; edges as in ``similar_groups``."""
    return similar_groups(read_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places; edges as in ``pack``."""
    return pack(read_table(spark, sf_dir, "documents"), VOCABULARY, added=True)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document; edges as in ``find_secrets``."""
    return digest_spans(find_secrets(read_table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and fate of every document; edges as in ``exact_groups``."""
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of what is left of every document; edges as in ``deduplicated_words``."""
    docs = read_table(spark, sf_dir, "documents")
    return deduplicated_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; edges as in ``text_statistics`` and ``fit_rules``."""
    statistics = stage(text_statistics(read_table(spark, sf_dir, "documents")), "statistics")
    rules = fit_rules(statistics, read_table(spark, sf_dir, "labels"))
    return quality_verdicts(statistics, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document and its first position; edges as in ``curriculum``."""
    return by_position(curriculum(read_table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered; edges as in ``format_chats``."""
    return format_chats(read_table(spark, sf_dir, "conversations"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; edges as in ``url_verdicts``."""
    return url_verdicts(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents against the benchmark, and the rank of those drawn; edges as in ``importance_resample``."""
    return importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is left of every document; edges as in ``without_repeated_lines``."""
    return line_digests(without_repeated_lines(read_table(spark, sf_dir, "documents")))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language; edges as in ``mine_collocations``."""
    return mine_collocations(read_table(spark, sf_dir, "documents"))


# Words as the operators take them: runs of characters other than ASCII white space.
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^ \t\n\x0B\f\r]+')"

OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s
  FROM w
), classes AS (SELECT list_sort(s) AS s, min(doc_id) AS node FROM s WHERE len(s) > 0 GROUP BY 1
), t AS (SELECT node, len(s) AS n, unnest(s) AS t FROM classes
), links AS (
  SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON a.t = b.t AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT node AS a, node AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN least ON least.node = c.node
"""

OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP6_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents
), e AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS e
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY e) AS low FROM e) WHERE low < doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit
), g AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
), k AS (
  SELECT doc_id, w, len(coalesce(g, [])) AS n,
    CASE WHEN g IS NULL THEN w ELSE list_transform(
      list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS kept
  FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format(text="text")})::BIGINT AS size FROM documents
), per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [5.0, 2.0, 1.0][pos % 3 + 1]::DOUBLE AS weight, [1.5, 1.0, 0.5][pos % 3 + 1]::DOUBLE AS u,
    [0.5, 1.0, 1.5][pos % 3 + 1]::DOUBLE AS v
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM per)
), f AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER p, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS share
  FROM r WINDOW p AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least(3.0::DOUBLE * source_size, coalesce(s * weight, 3.0::DOUBLE * source_size)) AS target FROM (
    SELECT *, arg_min(share, source_size / weight) FILTER (WHERE 3 * source_size > share * weight) OVER () AS s FROM f)
), l AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, t.v, floor(t.target)::BIGINT AS wanted,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || d.doc_id), d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, coalesce(wanted // nullif(source_size, 0), 0) AS rounds FROM l
), y AS (
  SELECT *, least(greatest(wanted - rounds * source_size - start, 0), size) AS part FROM x
), z AS (SELECT *, least((start + size / 2) / target, 1.0) AS q FROM y)
SELECT doc_id, size, source_size, target, (rounds * size + part)::BIGINT AS taken,
  CASE WHEN size > 0 AND (rounds > 0 OR part > 0) THEN round(CASE WHEN abs(v - u) < 1e-12 THEN q
    ELSE (sqrt(greatest(u * u + 2 * (v - u) * q * (u + v) / 2, 0)) - u) / (v - u) END, 9) END AS position
FROM z
"""

OP9_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations
), c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS l,
    string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
      ORDER BY turn, role, text) AS rendered
  FROM t GROUP BY conv_id
)
SELECT min(conv_id) AS conv_id, len(l)::BIGINT AS n_turns, count(*) AS copies, any_value(rendered) AS rendered
FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE len(d.l) > len(c.l) AND list_slice(d.l, 1, len(c.l)) = c.l)
GROUP BY l
"""

# The table-driven form of the 32-bit checksum; its table is computed from the polynomial.
OP11_SQL = r"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8
), texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM texts
), features AS (
  SELECT side, id, unnest(w) AS f FROM words UNION ALL
  SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
), forms AS (SELECT DISTINCT f FROM features
), bytes AS (
  SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i:
    ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS b FROM forms
), placed AS (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM bytes, crc
), counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM features JOIN placed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), weights AS (
  SELECT id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM features JOIN placed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w.w) AS n_words,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM documents d LEFT JOIN weights x ON x.id = d.doc_id JOIN words w ON w.side = 0 AND w.id = d.doc_id
), lined_up AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM lined_up
"""

OP12_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), k AS (
  SELECT *, translate(regexp_replace(line, '^[ 	

]+|[ 	

]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL AND keep <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (r.key IS NULL OR keep = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""

OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?

]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p
), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase
    FROM w, range(1, 6) t(m)) GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.f AS l, y.f AS r, n.n,
    (1000::HUGEINT * c.a * n.n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN range(1, 5) t(k) ON k < c.m JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(ws, 1, k), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(ws, k + 1, c.m), ' ')
), s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT DISTINCT lang, a, array_to_string(list_slice(ws, i, i + q - 1), ' ') AS part
  FROM c JOIN range(2, 5) t(q) ON q < c.m JOIN range(1, 5) u(i) ON i + q - 1 <= c.m
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s WHERE NOT EXISTS (
  SELECT 1 FROM inner_parts i WHERE i.lang = s.lang AND i.part = s.phrase AND 100 * i.a >= 100 * s.a)
QUALIFY rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_jaccard_join, op3_best_fit_packing, op4_secret_scan, op5_exact_dedup,
    op6_substring_dedup, op7_quality_rules, op8_source_mixing, op9_chat_format, op10_url_filter,
    op11_importance_resampling, op12_line_dedup, op13_phrase_collocations,
)}
ORACLES: dict[str, str] = {
    "op2_jaccard_join": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL,
    "op8_source_mixing": OP8_SQL, "op9_chat_format": OP9_SQL,
    "op11_importance_resampling": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_phrase_collocations": OP13_SQL,
}
