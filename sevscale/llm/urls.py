"""URL filters: host and path rules first, boosted trees on lexical features for the rest.

URLs that a rule decides are the labelled ones.  The trees are fitted by Spark ML on a bounded
sample of them, spread evenly over both verdicts, and judge every URL without a rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sevscale.sources.staging import stage

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SAMPLE_ROWS = 20_000  # labelled URLs the trees are fitted on, at most
TREES, DEPTH = 12, 4
FOLDS = 5  # of sites, for suffix shares that leave out a URL's own site
PRIOR = 20.0  # URLs of average standing added to each suffix
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEXICAL = (
    "url_length host_length path_length depth labels digit_ratio host_digit_ratio entropy "
    "host_entropy parameters hyphens longest_label"
).split()
SUFFIX = ["suffix_share", "suffix_count", "suffix_length"]


def url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host``, ``path`` and ``query``; a null url or one without ``://`` has empty ones."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (
        df.withColumn("__rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
        .withColumn("query", F.regexp_extract("__rest", r"\?([^#]*)", 1))
        .drop("__rest")
    )


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    on_host = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
    return on_host & F.startswith(F.col("path"), F.lit(slash + path))


def rule_of(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The rule that decides and its verdict; the longest that fits, the earlier of equals."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name in sorted(reversed(rules), key=lambda r: len(r[1])):
        rule = F.when(_fits(name), name).otherwise(rule)
        verdict = F.when(_fits(name), says).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character, from each distinct character's share."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    return F.when(size > 0, F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0),
        lambda total, c: total - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))),
    )).otherwise(0.0)


def _share(text: Column, pattern: str) -> Column:
    size = F.length(text)
    return F.when(size > 0, F.length(F.regexp_replace(text, pattern, "")) / size).otherwise(0.0)


def with_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    return df.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.length(F.regexp_replace(path, "[^/]", "")).cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        _share(url, "[^0-9]").alias("digit_ratio"),
        _share(host, "[^0-9]").alias("host_digit_ratio"),
        _entropy(url).alias("entropy"),
        _entropy(host).alias("host_entropy"),
        F.size(F.filter(F.split("query", "&"), lambda x: x != "")).cast("double").alias("parameters"),
        F.length(F.regexp_replace(host, "[^-]", "")).cast("double").alias("hyphens"),
        F.array_max(F.transform(labels, F.length)).cast("double").alias("longest_label"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )


def _site() -> Column:
    """The fold of a URL: hosts of one site (their last two labels) fall together."""
    return F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(FOLDS)).cast("int")


def suffix_counts(df: DataFrame) -> DataFrame:
    """(suffix, per_fold): per last host label, each fold's rows, ruled and blocked ones, over all rows."""
    blocked = F.count_if(F.col("verdict") == "block")
    cells = df.groupBy("suffix", "fold").agg(
        F.count("*").alias("n"), F.count("verdict").alias("ruled"), blocked.alias("blocked"))
    return cells.groupBy("suffix").agg(F.collect_list(F.struct("fold", "n", "ruled", "blocked")).alias("per_fold"))


def with_suffix_statistics(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Add what is known of each URL's suffix: how often it occurs and its share of blocked ones.

    The share leaves out the URL's own fold, so a labelled URL never sees its own verdict or
    that of its site; it leans to one half by a fixed prior.
    """
    def total(name: str, others: bool) -> Column:
        cells = F.filter("per_fold", lambda c: c["fold"] != F.col("fold")) if others else F.col("per_fold")
        return F.aggregate(cells, F.lit(0).cast("bigint"), lambda a, c: a + c[name])

    return df.join(counts, "suffix").select(
        *df.columns,
        ((total("blocked", True) + PRIOR / 2) / (total("ruled", True) + PRIOR)).alias("suffix_share"),
        F.log1p(total("n", False).cast("double")).alias("suffix_count"),
        F.length("suffix").cast("double").alias("suffix_length"),
    )


def _sample(df: DataFrame, ruled: dict[str, int], rows: int, seed: int) -> DataFrame:
    """Labelled rows, about half per verdict where both have enough, by hash; never more than ``rows``."""
    key = F.xxhash64(F.lit(seed), "page_id", "url")
    draw = F.pmod(key, F.lit(1 << 40)) / (1 << 40)
    wanted = F.lit(False)
    for verdict, n in ruled.items():
        wanted = wanted | ((F.col("verdict") == verdict) & (draw < rows / 2 / n))
    return df.where(wanted).orderBy(key, "page_id", "url").limit(rows)


def fit_trees(
    df: DataFrame, ruled: dict[str, int], sample_rows: int = SAMPLE_ROWS, seed: int = 0
) -> GBTClassificationModel | None:
    """Trees for the verdict of labelled rows, ``ruled`` of each; None unless both verdicts occur.

    The sample is staged, so fitting reads its few rows again and not the URLs.
    """
    if len(ruled) < 2:
        return None
    rows = stage(_sample(df, ruled, sample_rows, seed).select(
        (F.col("verdict") == "block").cast("double").alias("label"), *LEXICAL, *SUFFIX), "url_sample")
    features = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, cacheNodeIds=False,
                         checkpointInterval=-1).fit(features.transform(rows).select("features", "label"))


def _scored(df: DataFrame, model: GBTClassificationModel | None) -> DataFrame:
    if model is None:
        return df.withColumn("block_score", F.lit(None).cast("double"))
    features = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features")
    return model.transform(features.transform(df)).withColumn("block_score", vector_to_array("probability")[1])


def _prepared(df: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str]]):
    """URLs with parts, rule, fold and features; the labelled ones per fold and verdict."""
    rule, verdict = rule_of(rules)
    parts = url_parts(df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    rows = with_features(parts.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("fold", _site()))
    counts = stage(suffix_counts(rows.select("suffix", "fold", "verdict")), "suffix_counts")
    cell = F.col("x")
    per_fold = counts.select(F.explode("per_fold").alias("x")).groupBy(cell["fold"].alias("fold")).agg(
        F.sum(cell["blocked"]).alias("block"), (F.sum(cell["ruled"]) - F.sum(cell["blocked"])).alias("allow"))
    return with_suffix_statistics(rows, counts), {r["fold"]: r for r in per_fold.collect()}


def _ruled(per_fold: dict, folds: Sequence[int]) -> dict[str, int]:
    total = {v: sum(per_fold[f][v] for f in folds if f in per_fold) for v in ("allow", "block")}
    return {v: n for v, n in total.items() if n}


def url_verdicts(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and the trees' ``block_score``.

    A rule decides wherever one fits.  Elsewhere the trees do: blocked at a score above one
    half.  If the rules give only one verdict or none, nothing can be learned and URLs
    without a rule are allowed, with a null score.  Repeated rows are judged alike; null
    URLs have empty parts and are judged by the trees.  No rows in, no rows out; URLs of any
    length are read whole.  Only the two named columns are read, in three scans: counts, sample
    and verdicts.
    """
    rows, per_fold = _prepared(df, id_col, url_col, rules)
    scored = _scored(rows, fit_trees(rows, _ruled(per_fold, range(FOLDS)), sample_rows))
    learned = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "block_score"
    )


def held_out_verdicts(
    df: DataFrame, fold: int = 0, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(page_id, verdict, block_score) of the ruled URLs of one fold, by trees that saw only other sites."""
    rows, per_fold = _prepared(df, id_col, url_col, rules)
    others = [f for f in range(FOLDS) if f != fold]
    model = fit_trees(rows.where(F.col("fold") != fold), _ruled(per_fold, others), sample_rows)
    judged = rows.where((F.col("fold") == fold) & F.col("verdict").isNotNull())
    return _scored(judged, model).select("page_id", "verdict", "block_score")
