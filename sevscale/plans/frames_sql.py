"""The derived frames as SQL, for checking every query against another engine."""

from __future__ import annotations

FRAMES = {
    "flags": """
        SELECT d.doc_id AS id, d.text AS comment_text, coalesce(l.toxic, -1) AS toxic,
          CASE WHEN l.toxic IS NULL THEN -1
               WHEN l.toxic = 1 AND d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS severe_toxic,
          CASE WHEN l.toxic IS NULL THEN -1
               WHEN l.toxic = 1 AND d.doc_id % 2 = 0 THEN 1 ELSE 0 END AS obscene,
          CASE WHEN l.toxic IS NULL THEN -1
               WHEN l.toxic = 1 AND d.doc_id % 7 = 0 THEN 1 ELSE 0 END AS threat,
          CASE WHEN l.toxic IS NULL THEN -1
               WHEN (l.toxic = 1 AND d.doc_id % 3 = 0)
                 OR (l.toxic = 0 AND l.quality = 0 AND d.doc_id % 4 = 0) THEN 1 ELSE 0 END AS insult,
          CASE WHEN l.toxic IS NULL THEN -1
               WHEN l.toxic = 1 AND d.doc_id % 11 = 0 THEN 1 ELSE 0 END AS identity_hate
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "rated": "SELECT * FROM flags WHERE toxic <> -1",
    "severity": """
        SELECT *, greatest(toxic, severe_toxic, obscene, threat, insult, identity_hate)
            + 2.0::DOUBLE * severe_toxic + obscene + threat + insult + 2 * identity_hate AS y
        FROM rated""",
    "summed": """
        SELECT *, (toxic + 2 * severe_toxic + obscene + threat + insult + identity_hate)::BIGINT
            AS y FROM rated""",
    "rates": """
        SELECT doc_id AS id, text AS comment_text,
          (CAST(doc_id * 37 % 101 AS DOUBLE) / 100) * (CAST(doc_id * 37 % 101 AS DOUBLE) / 100)
            AS toxicity,
          CAST(doc_id * 13 % 53 AS DOUBLE) / 100 AS severe_toxicity,
          CAST(doc_id * 29 % 71 AS DOUBLE) / 100 AS obscene,
          CAST(doc_id * 17 % 31 AS DOUBLE) / 100 AS sexual_explicit,
          CAST(doc_id * 41 % 43 AS DOUBLE) / 100 AS identity_attack,
          CASE WHEN doc_id % 9 = 0 THEN NULL
               ELSE CAST(doc_id * 7 % 61 AS DOUBLE) / 100 END AS insult,
          CAST(doc_id * 19 % 37 AS DOUBLE) / 100 AS threat,
          doc_id % 12 AS toxicity_annotator_count
        FROM documents""",
    "gated": """
        SELECT id, comment_text, toxicity, CASE WHEN toxicity <= 0.5 THEN toxicity
          ELSE coalesce(severe_toxicity, 0) + coalesce(obscene, 0) + coalesce(sexual_explicit, 0)
             + coalesce(identity_attack, 0) + coalesce(insult, 0) + coalesce(threat, 0) END AS y
        FROM rates WHERE toxicity_annotator_count > 5""",
    "offences": """
        SELECT conv_id * 100 + turn AS id, text AS txt,
          CAST((conv_id * 31 + turn * 17) % 201 - 100 AS DOUBLE) / 100 AS offensiveness_score
        FROM conversations""",
    "pairs": """
        SELECT l.rn AS pair_id, l.doc_id AS less_id, m.doc_id AS more_id,
          l.text AS less_toxic, m.text AS more_toxic, l.rn % 5 AS kfold
        FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rn
              FROM documents JOIN labels USING (doc_id) WHERE toxic = 0) l
        JOIN (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rn,
                count(*) OVER () AS n
              FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) m
          ON l.rn % m.n = m.rn""",
    "to_score": "SELECT id AS comment_id, comment_text AS text FROM flags WHERE toxic = -1",
    "preds": """
        SELECT doc_id AS id, f.fold AS fold,
          CAST((doc_id * 7919 + f.fold * 104729) % 10007 AS DOUBLE) / 10007 AS pred
        FROM documents, (SELECT unnest(range(5)) AS fold) f""",
    "all_preds": """
        SELECT * FROM preds
        UNION ALL SELECT id, 5, 2 * pred + 1 FROM preds WHERE fold = 0
        UNION ALL SELECT id, 6, 0.5 FROM preds WHERE fold = 0""",
    "mean_preds": "SELECT id, avg(pred) AS pred FROM preds GROUP BY id",
    "scored": """
        SELECT p.pair_id, p.less_id, p.more_id, p.kfold, a.pred AS p1, b.pred AS p2
        FROM pairs p JOIN mean_preds a ON p.less_id = a.id JOIN mean_preds b ON p.more_id = b.id""",
    "fold_scored": """
        SELECT p.pair_id, a.fold, a.pred AS p1, b.pred AS p2
        FROM pairs p JOIN preds a ON p.less_id = a.id
        JOIN preds b ON p.more_id = b.id AND a.fold = b.fold""",
    "metric_log": """
        SELECT user_id % 3 AS run, user_id % 5 AS fold,
          CAST(floor(event_id / 1000) AS BIGINT) AS epoch, event_id AS step,
          event_type AS metric, value FROM events""",
    "epochs": """
        SELECT run, fold, metric, epoch, avg(value) AS value FROM metric_log
        GROUP BY run, fold, metric, epoch""",
    "sizes": "SELECT 4 AS k UNION ALL SELECT 5 UNION ALL SELECT 6",
    "vocab": """
        SELECT gram, count(*) AS df FROM gram_counts GROUP BY gram
        HAVING count(*) >= 3 AND count(*) <= 0.5 * (SELECT count(*) FROM documents)""",
    "idf": """
        SELECT gram, df, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf
        FROM vocab""",
}


def _gram_chain(prefix: str, source: str) -> None:
    """Words, padded words, grams and gram counts of a (id, text) query."""
    FRAMES[f"{prefix}words"] = rf"""
        SELECT id, w AS word FROM (
          SELECT id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM ({source}))
        WHERE w <> ''"""
    FRAMES[f"{prefix}padded"] = f"""
        SELECT id, ' ' || word || ' ' AS w, length(word) + 2 AS len, count(*) AS n
        FROM {prefix}words GROUP BY id, word"""
    FRAMES[f"{prefix}grams"] = f"""
        SELECT id, n, substr(w, CAST(i AS INT), k) AS gram FROM (
          SELECT id, n, w, k, unnest(range(1, greatest(len - k + 1, 1) + 1)) AS i
          FROM {prefix}padded, sizes WHERE k <= least(6, greatest(4, len)))"""
    FRAMES[f"{prefix}gram_counts"] = f"""
        SELECT id, gram, sum(n)::BIGINT AS tf FROM {prefix}grams GROUP BY id, gram"""
    NEEDS[f"{prefix}padded"] = [f"{prefix}words"]
    NEEDS[f"{prefix}grams"] = [f"{prefix}padded", "sizes"]
    NEEDS[f"{prefix}gram_counts"] = [f"{prefix}grams"]
    ONCE.add(f"{prefix}gram_counts")


def _weight_chain(prefix: str) -> None:
    """Unit-length weights of a text set under the model of all documents."""
    FRAMES[f"{prefix}raw_weights"] = f"""
        SELECT c.id, c.gram, v.df, c.tf * v.idf AS w
        FROM {prefix}gram_counts c JOIN idf v USING (gram)"""
    FRAMES[f"{prefix}weights"] = f"""
        SELECT id, gram, df, w / norm AS weight FROM {prefix}raw_weights
        JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM {prefix}raw_weights GROUP BY id)
        USING (id)"""
    NEEDS[f"{prefix}raw_weights"] = [f"{prefix}gram_counts", "idf"]
    NEEDS[f"{prefix}weights"] = [f"{prefix}raw_weights"]
    ONCE.add(f"{prefix}raw_weights")


NEEDS = {
    "rated": ["flags"],
    "severity": ["rated"],
    "summed": ["rated"],
    "gated": ["rates"],
    "to_score": ["flags"],
    "all_preds": ["preds"],
    "mean_preds": ["preds"],
    "scored": ["pairs", "mean_preds"],
    "fold_scored": ["pairs", "preds"],
    "epochs": ["metric_log"],
    "vocab": ["gram_counts"],
    "idf": ["vocab"],
}
# computed once although read twice
ONCE = {"idf"}

_gram_chain("", "SELECT doc_id AS id, text FROM documents")
_gram_chain("turn_", "SELECT conv_id * 100 + turn AS id, text FROM conversations")
_weight_chain("")
_weight_chain("turn_")


def add_texts(prefix: str, source: str) -> None:
    """Gram and weight frames of one more (id, text) query."""
    _gram_chain(prefix, source)
    _weight_chain(prefix)



def over(frames: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named frames (and what they need) in a WITH clause before it."""
    start = "WITH RECURSIVE " if recursive else "WITH "
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in frames.split():
        add(name)
    clauses = [
        f"{name} AS {'MATERIALIZED ' if name in ONCE else ''}({FRAMES[name]})" for name in wanted
    ]
    if body.lstrip().upper().startswith("WITH "):
        return start + ", ".join(clauses) + ", " + body.lstrip()[5:]
    return start + ", ".join(clauses) + " " + body
