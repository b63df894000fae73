"""Importance resampling, line dedup and phrase collocations against brute force, and their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sevscale.llm import collocations, resampling
from sevscale.llm.collocations import mine_collocations
from sevscale.llm.lines import line_digests, without_repeated_lines
from sevscale.llm.resampling import importance_resample

LONG = "Some words, again and again. " * 20_000


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_resample(pairs, target, buckets=10_000, percent=25, least=20, seed=7):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in pairs for f in features(t)[1])
    t = Counter(place(f) for x in target for f in features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (n + buckets)) / ((s[b] + 1) * (m + buckets))))
    rows = []
    for i, text in pairs:
        words, all_features = features(text)
        weight = sum(gain(place(f)) for f in all_features) // len(all_features) if all_features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(all_features), weight, weight + noise, None, len(words)])
    pool = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place_, row in enumerate(pool[:percent * len(pool) // 100], 1):
        row[4] = place_
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_words_and_offsets():
    data, offsets = resampling.word_offsets("Ab-ÉÈ_9z\x00x日本 K")
    assert [data[a:b].decode() for a, b in offsets] == ["ab", "ÉÈ", "9z", "x日本", "k"]
    assert resampling.feature_crcs(data, offsets)[5] == zlib.crc32("ab ÉÈ".encode())
    assert resampling.word_offsets(None) == (b"", [])
    data, offsets = resampling.word_offsets("İKK")  # letters whose lower case is longer, or ASCII
    assert [data[a:b].decode() for a, b in offsets] == ["İkK"]


def test_resampling_equals_brute_force(docs):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本"]
    pairs = [(i, draw.choice([" ", ", ", "\n"]).join(draw.choices(vocabulary, k=draw.randrange(0, 60)))) for i in range(80)]
    pairs += [(100, None), (101, ""), (102, "--- \n"), (103, LONG), (7, pairs[7][1]), (None, "a b " * 30)]
    target = [" ".join(draw.choices(vocabulary[:20], k=40)) for _ in range(9)] + [None, "", LONG]
    wanted = docs(*enumerate(target)).withColumnRenamed("text", "features").withColumnRenamed("doc_id", "score")
    got = importance_resample(docs(*pairs), wanted, target_col="features")
    rows = sorted((tuple(r)[:5] for r in got.collect()), key=str)
    assert rows == brute_resample(pairs, target)
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, 1 + max(r[4] or 0 for r in rows)))


def test_resampling_ties_and_empty_tables(docs):
    same = "one text of words " * 10
    got = importance_resample(docs(*[(3, same)] * 4, *[(5, same)] * 4), docs(), percent=50)
    ranks = sorted((r["rank"] or 0, r["doc_id"]) for r in got.collect())
    assert [r for r, _ in ranks] == [0, 0, 0, 0, 1, 2, 3, 4]
    assert len({i for r, i in ranks if r}) == 1  # one id has the higher noise
    assert importance_resample(docs(), docs((1, same))).collect() == []
    assert importance_resample(docs(), docs()).collect() == []


def test_buckets_beyond_two_bytes(docs):
    few = docs((1, "a b c " * 20), (2, "c d " * 20))
    got = {r["doc_id"]: r["weight"] for r in importance_resample(few, few.limit(1), buckets=100_003).collect()}
    expected = {r[0]: r[2] for r in brute_resample([(1, "a b c " * 20), (2, "c d " * 20)], ["a b c " * 20], 100_003)}
    assert got == expected


def brute_lines(pairs, least_chars=40, least_docs=5):
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, text in pairs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held.setdefault(key(line), set()).add(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, text in pairs:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_pairs():
    draw = random.Random(12)
    common = ["x" * 39, "y" * 40, "É" * 40, "Some Line of more than Forty characters in all.", "z " * 30]
    pad = lambda x: draw.choice(["", " ", "\t \r", "\x0b\x0c"]) + draw.choice([x, x.upper()]) + draw.choice(["", "  ", "\r"])
    pairs = []
    for i in range(40):
        body = [pad(draw.choice(common)) if draw.random() < .2 else f"line {draw.random()} " + "own " * draw.randrange(20)
                for _ in range(draw.randrange(0, 12))]
        pairs.append((i, "\n".join(body)))
    return pairs + [(50, None), (51, ""), (52, "\n\n"), (53, "\n".join([common[3]] * 3)), (53, common[3] + "\nother"),
                    (53, common[3] + "\nother"), (None, common[3]), (54, LONG), (55, "\n".join([" " * 50_000 + "a" * 45, common[1]] * 40))]


def test_lines_equal_brute_force(docs):
    pairs = line_pairs()
    got = sorted((tuple(r) for r in line_digests(without_repeated_lines(docs(*pairs))).collect()), key=str)
    assert got == brute_lines(pairs)
    assert sum(r[2] for r in got) > 20


@pytest.mark.parametrize("least_docs", [1, 2])
def test_lines_with_other_thresholds(docs, least_docs):
    pairs = line_pairs()
    kept = without_repeated_lines(docs(*pairs), least_chars=10, least_docs=least_docs)
    got = sorted((tuple(r) for r in line_digests(kept).collect()), key=str)
    assert got == brute_lines(pairs, 10, least_docs)


def test_lines_columns_and_empty_table(docs):
    clash = docs((1, "a"), (2, "b")).withColumnsRenamed({"label": "places", "source": "lines", "lang": "hash", "n_chars": "n_lines"})
    kept = without_repeated_lines(clash)
    assert kept.columns == ["doc_id", "text", "hash", "lines", "places", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a", "en", "s", 7, 1, 0), (2, "b", "en", "s", 7, 1, 0)]
    assert without_repeated_lines(docs()).collect() == []


def test_line_stays_in_the_largest_id(docs):
    line = "The same line of forty characters or more"
    kept = without_repeated_lines(docs(*[(i, f"{i}\n {line} ") for i in range(6)]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(i, str(i)) for i in range(5)] + [(5, f"5\n {line} ")]


def brute_phrases(rows, width=5, min_count=100, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + m])) for m in range(1, width + 1) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    absorbed = set()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                if 100 * a >= 100 * f[lang, words[i:i + m]]:
                    absorbed.add((lang, words[i:i + m]))
    out = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in absorbed:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                    for k in range(1, len(words))]
            score, _, l, r = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, place, p.decode(), -a, l, r, n[lang], -score)
                  for lang, found in out.items() for place, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.fixture(scope="module")
def phrase_rows():
    draw = random.Random(13)
    stock = [["New", "York"], ["new", "york", "city"], ["a", "b", "c", "d", "e", "f"], ["é\x00", "日本"], ["of", "the"], ["x"] * 7]
    rows = []
    for i in range(120):
        words = []
        for _ in range(draw.randrange(0, 30)):
            words += draw.choice(stock) if draw.random() < .6 else [f"w{draw.randrange(30)}"]
            if draw.random() < .15:
                words[-1] += draw.choice([".", ",", "!?", "\n", "\x0b", " :"])
        rows.append((draw.choice(["en", "de", None, "und"]), draw.choice([" ", "\t", "  "]).join(words)))
    return rows + [("en", None), ("fr", None), ("en", ""), ("en", " . "), ("de", LONG), rows[3], rows[3]]


def phrase_table(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "w") for lang, text in rows], "lang string, text string, n int, phrase string")


@pytest.mark.parametrize("min_count, width, top", [(3, 5, 2000), (8, 5, 7), (2, 3, 50), (1, 2, 40)])
def test_phrases_equal_brute_force(spark, phrase_rows, min_count, width, top):
    got = mine_collocations(phrase_table(spark, phrase_rows), max_words=width, min_count=min_count, top=top)
    rows = sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    expected = brute_phrases(phrase_rows, width, min_count, top)
    assert rows == expected and len(rows) > 10


def test_phrases_do_not_depend_on_the_bitmaps(spark, phrase_rows, monkeypatch):
    """Windows that run on past rare pairs and triples change no row."""
    everything = lambda hashes, n: np.full(1 << 15, 255, np.uint8)
    few = phrase_rows[:40]
    expected = brute_phrases(few, 5, 3)
    monkeypatch.setattr(collocations, "hash_bitmap", everything)
    monkeypatch.setattr(collocations, "BATCH_BYTES", 50)  # and texts of their own batches
    got = mine_collocations(phrase_table(spark, few).repartition(3), min_count=3)
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_phrase_scores_beyond_64_bits(spark):
    a, l, r, n = 3 * 10**12 + 1, 7 * 10**12, 5 * 10**12 + 3, 9 * 10**14 + 7
    counts = spark.createDataFrame(
        [("x", 0, "", n), ("x", 1, "p", l), ("x", 1, "q", r), ("x", 2, "p q", a)], "lang string, size int, phrase string, f long")
    row = collocations.score_phrases(counts).first()
    assert 1000 * a * n > 2**63
    assert (row["a"], row["l"], row["r"], row["n"], row["score"]) == (a, l, r, n, 1000 * a * n // (l * r))


def test_phrases_of_empty_and_plain_tables(spark):
    assert mine_collocations(phrase_table(spark, [])).collect() == []
    assert mine_collocations(phrase_table(spark, [(None, None), ("en", ""), ("en", "one. two")]), min_count=1).collect() == []

