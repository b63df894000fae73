"""Quality rules: text statistics and a decision list learned from labels.

Sequential covering: a conjunction of thresholds is grown on two thirds of the labelled rows by
information gain, pruned on the other third, and kept if it is precise enough; the rows it
covers are set aside and the next one is grown.  The list becomes one Spark conditional.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sevscale.llm.frames import as_bytes, per_batch, text_digest
from sevscale.llm.words import _SPACE, covered, sequence_numbers, word_numbers

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 30  # fewest words; repeated words, in percent
SAMPLE_ROWS = 20_000  # labelled rows a list is learned from, at most
CUTS = 32  # thresholds tried per statistic
MAX_RULES, MAX_CONDITIONS = 12, 4
PRECISION = 0.9  # share of bad rows a rule must reach on both parts
LEAST_COVER = 5

COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_digits n_punct n_distinct n_chars".split()
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"),
    "punct": ("n_punct", "word_chars"), "distinct": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
STATISTICS = ["n_words", *RATIOS]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _class(SYMBOLS), _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_PUNCT = _class(b"!\"'(),-./:;?@[\\]^_`{}~+=")
_FIRST = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, as listed in COUNTS."""
    data = as_bytes(text)
    words = word_numbers(data)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = lambda kind: int(by_byte[kind].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    runs = sequence_numbers(words, WINDOW)
    repeated = 0
    if len(runs) > 1:
        _, back, n = np.unique(runs, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(n[back] > 1)
        repeated = int(covered(starts, WINDOW, len(words)).sum()) if len(starts) else 0
    return (
        len(words), total(_FIRST & ~_SPACE), total(_SYMBOL), len(lines) - len(set(lines)), repeated,
        len(lines), total(_UPPER), total(_DIGIT), total(_PUNCT), len(np.unique(words)), total(_FIRST),
    )


def text_statistics(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """Counts per row, ``base_failed``, and the ratios rules are made of.

    A null text counts as empty and fails the base rules, as every text under 20 words does.
    A ratio over nothing is 0.  With ``digest``, the text's SHA-256 comes along as ``text_sha256``.
    """
    digests = ["text_sha256"] if digest else []

    def rows(batch: dict[str, list]) -> dict[str, object]:
        counts = list(zip(*map(measure, batch["text"]))) or [()] * len(COUNTS)
        return {c: batch[c] for c in ["doc_id", *digests]} | dict(zip(COUNTS, counts))

    schema = ", ".join(["doc_id long", *[f"{c} string" for c in digests], *[f"{c} long" for c in COUNTS]])
    out = per_batch(df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        *[text_digest(F.col(text_col)).alias(c) for c in digests],
    ), schema, rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select("*", failed.alias("base_failed"), *[
        F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0).alias(name) for name, (a, b) in RATIOS.items()
    ])


Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold


def _holds(x: np.ndarray, names: Sequence[str], rule: Sequence[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, side, cut in rule:
        column = x[:, names.index(name)]
        out &= column <= cut if side == "<=" else column > cut
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> list[Condition]:
    """Add the condition of highest gain until no good row is left or nothing gains."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p, n = int((inside & bad).sum()), int(inside.sum())
        best, found = 1e-9, None
        for j, name in enumerate(names):
            column = x[inside, j]
            for cut in np.unique(np.quantile(column, np.linspace(0, 1, CUTS), method="lower")).tolist():
                for side, mask in (("<=", column <= cut), (">", column > cut)):
                    p1, n1 = int(bad[inside][mask].sum()), int(mask.sum())
                    if p1 >= LEAST_COVER and n1 < n:
                        gain = p1 * (np.log2(p1 / n1) - np.log2(p / n))
                        if gain > best:
                            best, found = gain, (name, side, float(cut))
        if found is None:
            break
        rule.append(found)
        inside = _holds(x, names, rule)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> list[Condition]:
    """Drop final conditions while (bad - good) / covered does not fall on the other rows."""

    def worth(r: Sequence[Condition]) -> float:
        inside = _holds(x, names, r)
        n = int(inside.sum())
        return (2 * int((inside & bad).sum()) - n) / n if n else -1.0

    best = rule
    for end in range(len(rule) - 1, 0, -1):
        if worth(rule[:end]) >= worth(best):
            best = rule[:end]
    return best


def learn_rules(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> list[list[Condition]]:
    """Ordered conjunctions that reject; rows none of them covers are kept.  Deterministic."""
    rules: list[list[Condition]] = []
    third = np.arange(len(x)) % 3 == 2
    open_rows = np.ones(len(x), bool)
    while len(rules) < MAX_RULES:
        grow, prune = open_rows & ~third, open_rows & third
        if (bad & grow).sum() < LEAST_COVER:
            break
        rule = _grow(x[grow], bad[grow], names)
        if not rule:
            break
        rule = _prune(rule, x[prune], bad[prune], names)
        inside = _holds(x, names, rule) & open_rows
        precise = all(
            not (inside & part).any() or bad[inside & part].mean() >= PRECISION for part in (third, ~third)
        )
        if not precise or inside.sum() < LEAST_COVER:
            break
        rules.append(rule)
        open_rows &= ~inside
    return rules


def fit_rules(
    statistics: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, names: Sequence[str] = STATISTICS
) -> list[list[Condition]]:
    """Learn from labelled rows that pass the base rules; at most ``sample_rows``, by hash.

    ``labels`` has doc_id and quality (0 bad).  A document labelled twice counts as good if
    any label says so; null labels and ids are left out.  Without bad rows the list is empty.
    """
    one = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(
        F.max("quality").alias("__quality")
    )
    labelled = (
        statistics.where(~F.col("base_failed")).join(one, F.col("doc_id") == F.col("__id"))
        .select(F.xxhash64("doc_id").alias("__draw"), "doc_id", "__quality", *names)
    )
    total = labelled.count()
    if not total:
        return []
    # Every task would offer its first rows to the driver, so rows far beyond the cut stay where they are.
    share = 1.0
    if total > sample_rows:
        share = 1.1 * (sample_rows + 100) / total
    while True:
        offered = labelled if share >= 1 else labelled.where(F.col("__draw") <= int(-(1 << 63) + share * ((1 << 64) - 1)))
        rows = offered.orderBy("__draw", "doc_id", *names).limit(sample_rows).collect()
        if share >= 1 or len(rows) == min(sample_rows, total):
            break
        share *= 2
    x = np.array([[float(r[n]) for n in names] for r in rows])
    return learn_rules(x, np.array([r["__quality"] == 0 for r in rows]), names)


def verdict(rules: Sequence[Sequence[Condition]]) -> Column:
    """True where no rule of the list rejects: one ordered conditional expression."""
    out = None
    for rule in rules:
        fits = F.lit(True)
        for name, side, cut in rule:
            fits = fits & (F.col(name) <= cut if side == "<=" else F.col(name) > cut)
        out = F.when(fits, False) if out is None else out.when(fits, False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_verdicts(statistics: DataFrame, rules: Sequence[Sequence[Condition]]) -> DataFrame:
    return statistics.withColumn("kept", ~F.col("base_failed") & verdict(rules))
