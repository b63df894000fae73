"""Stages of the pipeline against plain loops over their input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from sevscale.llm.mixing import mixed_rows
from sevscale.llm.packing import pack, token_ids
from sevscale.llm.quality import fit_rules, quality_verdicts, text_statistics
from sevscale.llm.queries import VOCABULARY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_learned_list_row_by_row(spark, docs):
    draw = random.Random(4)
    pairs, labels = [], []
    for i in range(120):
        bad = i % 3 == 0
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.randrange(25, 60))]
        if bad:
            words += ["#$%"] * draw.randrange(4, 9)
        pairs.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    pairs += [(200, None), (201, ""), (202, "few words"), (203, "again " * 40), (None, "x " * 5)]
    statistics = text_statistics(docs(*pairs))
    rules = fit_rules(statistics, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules
    rejected = 0
    for r in quality_verdicts(statistics, rules).collect():
        kept = not r["base_failed"]
        for rule in rules:
            if all(r[n] <= cut if side == "<=" else r[n] > cut for n, side, cut in rule):
                kept = False
        assert r["kept"] == kept
        rejected += not r["base_failed"] and not kept
    assert rejected >= 30


def plain_uses(rows):
    """How often the mix takes at least half of each row (doc_id, text, source), by walking through the sources."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    target, rest, open_ = {}, float(sum(total.values())), list(sources)
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > 3 * total[s]]
        for s in full or open_:
            target[s] = 3 * total[s] if full else weight[s] * share
        rest -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    uses = Counter()
    for s in sources:
        left = int(target[s])
        order = sorted((i for i, _, x in rows if x == s), key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())
        while left > 0 and total[s]:
            for i in order:
                uses[i] += size[i] > 0 and 2 * min(left, size[i]) >= size[i]
                left -= min(left, size[i])
    return +uses


def test_mix_uses_equal_a_plain_walk(docs):
    draw = random.Random(8)
    rows = []
    for source, n in (("a", 40), ("b", 200), ("c", 5), (None, 30), ("d", 1)):
        rows += [(len(rows) + k, draw.choice([None, "", "w " * draw.randrange(1, 50)]), source) for k in range(n)]
    table = None
    for source in ("a", "b", "c", None, "d"):
        part = docs(*[(i, t) for i, t, s in rows if s == source], source=source)
        table = part if table is None else table.union(part)
    got = mixed_rows(table)
    assert got.columns == table.columns
    assert Counter(r["doc_id"] for r in got.collect()) == plain_uses(rows)


def test_sequences_rebuild_every_text(docs):
    draw = random.Random(9)
    texts = {i: draw.choice(["", "<|endoftext|>", "a b c "]) + "word é " * draw.randrange(0, 4000) for i in range(25)}
    texts[25] = None
    pieces = pack(docs(*texts.items()), VOCABULARY, added=True).collect()
    places = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for i, text in texts.items():
        ids = token_ids(text or "", VOCABULARY, added=True)
        assert ids[-1] == 0
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == i)
        assert own[0][0] == 0 and sum(n for _, n, _ in own) == len(ids)
        for start, length, crc in own:
            assert zlib.crc32(np.asarray(ids[start:start + length], "<u4").tobytes()) == crc
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:]))


def test_stages_take_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs().write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
