"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranking of its most frequent n-grams (1 to 3 letters, words
padded by blanks).  A document is ranked the same way and goes to the language with the
smallest out-of-place distance: the sum, over the document's n-grams, of how far each one's
rank is from its rank in the profile, or the profile's length where it is missing there.
Only n-grams of some profile are ranked: any other is as far from every language.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sevscale.llm.frames import per_batch

SAMPLE_DOCS = 1_500  # labelled documents per language that profiles are learned from, at most
PROFILE = 400  # n-grams per profile
LONGEST = 3
BUCKETS = 50
BLANK = 32
SLICE = 1 << 21  # characters ranked at once


@lru_cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(text: str) -> np.ndarray:
    """Lower-case letters with one blank before, between and after words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, BLANK)
    points = np.concatenate(([BLANK], points, [BLANK]))
    return points[np.concatenate(([True], (points[1:] != BLANK) | (points[:-1] != BLANK)))]


def _grams(points: np.ndarray) -> np.ndarray:
    """All n-grams inside padded words, 21 bits a letter."""
    out = [points[points != BLANK]]
    two = points[:-1] << 21 | points[1:]
    out.append(two)
    if len(points) > 2:
        out.append((two[:-1] << 21 | points[2:])[points[1:-1] != BLANK])
    return np.concatenate(out)


def training_ids(df: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``sample_docs`` ids per language, by hash; each hash bucket gives its share."""
    share = max(sample_docs // BUCKETS, 1)
    draw = F.xxhash64("doc_id")
    first = Window.partitionBy("lang", "__bucket").orderBy(draw, "doc_id")
    return (
        df.select("doc_id", "lang").withColumn("__bucket", F.pmod(draw, F.lit(BUCKETS)))
        .withColumn("__row", F.row_number().over(first)).where(F.col("__row") <= share)
        .select("doc_id", "lang")
    )


def fit_profiles(
    df: DataFrame, sample_docs: int = SAMPLE_DOCS, profile: int = PROFILE
) -> dict[str, list[int]]:
    """Ranked n-grams of each language, from rows (doc_id, text, lang) with text and lang.

    The driver receives ``profile`` numbers per language, nothing per document.
    """
    labelled = df.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = training_ids(labelled, sample_docs).select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"))
    texts = labelled.join(chosen, (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")), "left_semi")

    def count(batch: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        lang, text = np.array(batch["lang"], object), batch["text"]
        for one in sorted(set(batch["lang"])):
            seen = [_grams(_points(text[i])) for i in np.flatnonzero(lang == one)]
            grams, n = np.unique(np.concatenate(seen), return_counts=True)
            out["lang"] += [one] * len(grams)
            out["gram"] += grams.tolist()
            out["n"] += n.tolist()
        return out

    most = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram"))
    ranked = (
        per_batch(texts.select("lang", "text"), "lang string, gram long, n long", count)
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= profile)
    )
    out: dict[str, list[int]] = {}
    for r in ranked.select("lang", "gram").orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranker:
    """Profiles as lookup tables; made once per task from the profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.most = max((len(p) for p in profiles.values()), default=0)
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))
        self._tables()

    def _tables(self) -> None:
        """From letters to codes (0: in no profile), from codes to n-grams (-1: in no profile)."""
        mask = (1 << 21) - 1
        parts = [[g >> s & mask for s in (42, 21, 0) if g >> s] for g in self.grams.tolist()]
        known = sorted({p for g in parts for p in g} | {BLANK})
        self.code = np.zeros(0x110000, np.int32)
        self.code[known] = np.arange(1, len(known) + 1)
        size = len(known) + 1
        pairs = sorted({(self.code[g[0]], self.code[g[1]]) for g in parts if len(g) == 3})
        self.one = np.full(size, -1, np.int32)
        self.two = np.full((size, size), -1, np.int32)
        self.pair = np.zeros((size, size), np.int32)
        self.three = np.full((len(pairs) + 1, size), -1, np.int32)
        for i, (a, b) in enumerate(pairs):
            self.pair[a, b] = i + 1
        for i, g in enumerate(parts):
            at = self.code[g]
            if len(g) == 1:
                self.one[at[0]] = i
            elif len(g) == 2:
                self.two[at[0], at[1]] = i
            else:
                self.three[self.pair[at[0], at[1]], at[2]] = i

    def counts(self, texts: list[str]) -> np.ndarray:
        """Texts by n-grams."""
        size = len(self.grams)
        points = [_points(t) for t in texts]
        lengths = np.array([len(p) for p in points])
        code = self.code[np.concatenate(points)]
        row = np.repeat(np.arange(len(texts)), lengths)
        total = np.zeros(len(texts) * size, np.int64)
        same2 = row[:-1] == row[1:]
        ids = [self.one[code], np.where(same2, self.two[code[:-1], code[1:]], -1)]
        if len(code) > 2:
            three = self.three[self.pair[code[:-2], code[1:-1]], code[2:]]
            ids.append(np.where(row[:-2] == row[2:], three, -1))
        for found in ids:
            hit = found >= 0
            total += np.bincount(row[: len(found)][hit] * size + found[hit], minlength=len(total))
        return total.reshape(len(texts), size)

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of texts that have letters.

        The score is one minus the distance over the largest possible one.  Equal distances
        go to the language that sorts first.
        """
        counts = self.counts(texts)
        out = []
        for row in counts:
            seen = np.flatnonzero(row)
            top = seen[np.argsort(-row[seen], kind="stable")][: self.most]
            rank = self.ranks[:, top]
            far = np.where(rank < 0, self.most, np.abs(rank - np.arange(len(top)))).sum(axis=1)
            best = int(far.argmin())
            worst = self.most * len(top)
            out.append((self.langs[best], 1.0 - far[best] / worst if worst else 0.0))
        return out


def identify(df: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """Per row (doc_id, text): ``lang_pred`` and ``score``.

    Null texts and texts without letters, and all texts if nothing was learned, are ``und``
    with score 0.  A text with letters of no profile goes to the first language, score 0.
    Repeated rows and null ids are judged like any other; long texts are read whole.
    """

    def judge(batch: dict[str, list]) -> dict[str, object]:
        ranker = _ranker(tuple((k, tuple(v)) for k, v in profiles.items()))
        lang, score = ["und"] * len(batch["text"]), [0.0] * len(batch["text"])
        todo = [i for i, t in enumerate(batch["text"]) if ranker.langs and t and any(map(str.isalpha, t))]
        rows = max(1, SLICE // max(len(ranker.grams), 1))
        while todo:
            size, n = 0, 0
            while n < min(len(todo), rows) and (n == 0 or size + len(batch["text"][todo[n]]) <= SLICE):
                size += len(batch["text"][todo[n]])
                n += 1
            for i, (one, s) in zip(todo[:n], ranker.judge([batch["text"][i] for i in todo[:n]])):
                lang[i], score[i] = one, float(s)
            todo = todo[n:]
        return {"doc_id": batch["doc_id"], "lang_pred": lang, "score": score}

    return per_batch(df.select("doc_id", "text"), "doc_id long, lang_pred string, score double", judge)


@lru_cache(maxsize=1)
def _ranker(profiles: tuple) -> Ranker:
    return Ranker({k: list(v) for k, v in profiles})
