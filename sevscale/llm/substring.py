"""Substring deduplication over a compacted De Bruijn graph of word windows.

Edges are windows of k words, joined where one window follows another by one word.  Only
repeated edges matter:

1. Each text selects anchors, the lowest of every k/2 consecutive runs of about k/2 words.
   Two equal windows select the same anchor at the same place, so a window can only repeat
   around an anchor that repeats in another text.  Texts of equal words count once.
2. Windows around repeated anchors become edges with their source coordinates, a second
   number of their words, and short marks of the edges before and after.  Where many texts of
   a batch have an edge, two of them stand for it; the others become runs on the text that has
   it first there.  Edges found in two documents are kept.
3. An edge whose sources name different edges before (after) it is where paths join (part).
   A path is a chain of edges, consecutive in their first source, without such a branch:
   pieces of at most ``PIECE`` edges, joined end to start, heads found by pointer doubling.
4. Windows find their place on a path by their edge and are verified at the path's source
   coordinates: their second, independent number must equal that of the words there.  Those on
   a path with an earlier source go, and the words under them are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sevscale.llm.frames import Scratch, as_bytes, per_batch
from sevscale.llm.words import covered, scramble, sequence_numbers, word_numbers

SPAN = 50  # words a repeated passage has at least
PIECE = 128  # edges that are put in a row at once; longer paths are joined from pieces
SECOND = np.uint64(0xA0761D6478BD642F)


def anchors(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the selected runs: every k consecutive words hold one whole."""
    width = k // 2
    runs = sequence_numbers(words, k - width + 1)
    if len(runs) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    views = np.lib.stride_tricks.sliding_window_view(runs, width)
    places = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return places, runs[places]


def settled(sames: list[int], runs: list[np.ndarray]) -> list[np.ndarray]:
    """Per text: which of its anchors this batch settles (1), leaves open (0) or makes superfluous (-1).

    Of texts with equal words the first speaks for all.  An anchor that several texts of the
    batch have repeats for certain: two of its rows, of different texts, stay open to tell
    other batches so, the rest are settled.  So a common anchor sends two rows per batch.
    """
    state = [np.full(len(r), -1, np.int8) for r in runs]
    first = list({same: i for i, same in reversed(list(enumerate(sames)))}.values())
    if not first:
        return state
    sizes = [len(runs[i]) for i in first]
    run, text = np.concatenate([runs[i] for i in first]), np.repeat(np.array(first), sizes)
    flat = np.zeros(len(run), np.int8)
    if len(run):
        order = np.lexsort((text, run))
        starts = np.flatnonzero(np.concatenate(([True], run[order][1:] != run[order][:-1])))
        ends = np.append(starts[1:], len(run)) - 1
        repeats = text[order][starts] != text[order][ends]
        by_order = np.repeat(repeats, ends - starts + 1).astype(np.int8)
        by_order[starts], by_order[ends] = 0, 0
        flat[order] = by_order
    for i, part in zip(first, np.split(flat, np.cumsum(sizes)[:-1])):
        state[i] = part
    return state


def outline(df: DataFrame, k: int) -> DataFrame:
    """Per row: number and joined hash of its words, a number for equal words; the anchors that
    are to be compared with other batches and their places; places of anchors known to repeat."""

    def rows(batch: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("n_words", "sha", "same", "anchors", "places")}
        for text in batch["text"]:
            data = as_bytes(text)
            numbers = word_numbers(data)
            places, runs = anchors(numbers, k)
            sha = hashlib.sha256(b" ".join(data.split()))
            same = int.from_bytes(sha.digest()[:8], "little", signed=True)
            for c, v in zip(out, (len(numbers), sha.hexdigest(), same, runs.view(np.int64), places.astype(np.int32))):
                out[c].append(v)
        state = settled(out["same"], out["anchors"])
        sure = [p[s == 1] for p, s in zip(out["places"], state)]
        for c in ("anchors", "places"):
            out[c] = [v[s == 0] for v, s in zip(out[c], state)]
        return {"doc_id": batch["doc_id"], "key": batch["key"], "sure": sure} | out

    schema = ("doc_id long, key long, n_words long, sha string, same long, anchors array<long>, "
              "places array<int>, sure array<int>")
    return per_batch(df, schema, rows)


def repeated_places(outlines: DataFrame) -> DataFrame:
    """(same, places) of anchors that other texts have too."""
    each = outlines.select("same", F.explode(F.arrays_zip("anchors", "places")).alias("z")).select(
        F.col("z.anchors").alias("anchor"), "same", F.col("z.places").alias("place")).where("anchor IS NOT NULL AND same IS NOT NULL").repartition("anchor")
    twice = each.groupBy("anchor").agg(F.min("same").alias("low"), F.max("same").alias("high"), F.count("place").alias("n")
    ).where((F.col("low") != F.col("high")) & (F.col("n") > 1)).select("anchor")
    sure = outlines.where(F.size("sure") > 0).select("same", F.explode("sure").alias("place"))
    return each.join(twice, "anchor").select("same", "place").unionByName(sure).groupBy("same").agg(
        F.collect_set("place").alias("places"))


def second_numbers(words: np.ndarray, k: int) -> np.ndarray:
    """Another number per run of k words, independent of the first."""
    return sequence_numbers(scramble(words ^ SECOND), k)


def edges_around(texts: DataFrame, k: int) -> DataFrame:
    """Windows that hold a place, from rows (doc_id, text, places), as ``combined`` leaves them.

    Rows with n = 0 are single windows (edge, doc, at, marks), those with n > 0 runs of n windows
    of ``doc`` from ``at`` that equal those of ``source`` from ``source_at``.
    ``marks``: 32 bits of the second number, 16 each of the edges before and after (0: none).
    """

    def rows(batch: dict[str, list]) -> dict[str, object]:
        found: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64, np.uint64)]
        width = k // 2
        for doc, text, places in sorted(zip(batch["doc_id"], batch["text"], batch["places"]), key=lambda r: r[0]):
            words = word_numbers(as_bytes(text))
            edges = sequence_numbers(words, k)
            checks = second_numbers(words, k) >> np.uint64(32) << np.uint64(32)
            short = np.concatenate(([0], edges % np.uint64(65535) + np.uint64(1), [0])).astype(np.uint64)
            marks = checks | short[:-2] << np.uint64(16) | short[2:]
            # An anchor at p lies in the windows that start at p - width + 1 .. p.
            first = np.maximum(np.array(places, np.int64) - width + 1, 0)
            at = np.flatnonzero(_ranges(first, np.array(places, np.int64) + 1, len(edges)))
            for out, v in zip(found, (edges[at], np.full(len(at), doc, np.int64), at, marks[at])):
                out.append(v)
        return combined(*map(np.concatenate, found))

    return per_batch(texts, "edge long, doc long, at int, marks long, n int, source long, source_at int", rows)


def combined(edge: np.ndarray, doc: np.ndarray, at: np.ndarray, marks: np.ndarray) -> dict[str, np.ndarray]:
    """A batch's windows, given by (doc, at), with at most two rows of an edge.

    An edge's first and last window of the batch stay and carry the lowest and highest marks of
    all.  Others are known to repeat: the first of each later text becomes part of a run on the
    first text; further ones of a text share its first one's fate, told by one row (doc, n = -1).
    """
    order = np.argsort(edge, kind="stable")
    e, d, a, m = edge[order], doc[order], at[order], marks[order]
    starts = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1]))) if len(e) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(e))[: len(starts)] - 1
    first, last = np.repeat(starts, ends - starts + 1), np.repeat(ends, ends - starts + 1)
    place = np.arange(len(e))
    other = np.ones(len(e), bool)
    other[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    own = np.maximum.accumulate(np.where(other, place, 0))
    check = m >> np.uint64(32)
    echo = ~other & (place != last) & (check == check[own])
    again = other & (place != first) & (place != last) & (check == check[first])
    echoing = np.unique(d[echo])
    if len(e):
        before, after = m >> np.uint64(16) & np.uint64(65535), m & np.uint64(65535)
        low, high = [], []
        for mark in (before, after):
            least = np.minimum.reduceat(np.where(mark == 0, np.uint64(65536), mark), starts)
            low.append(np.where(least == 65536, np.uint64(0), least))
            high.append(np.maximum.reduceat(mark, starts))
        m = m.copy()
        m[starts] = check[starts] << np.uint64(32) | low[0] << np.uint64(16) | low[1]
        more = ends > starts
        m[ends[more]] = (check[ends] << np.uint64(32) | high[0] << np.uint64(16) | high[1])[more]
    lone = np.flatnonzero(~again & ~echo)
    runs = np.flatnonzero(again)
    runs = runs[np.argsort(order[runs], kind="stable")]
    whose, where, source, source_at = d[runs], a[runs], d[first[runs]], a[first[runs]]
    breaks = np.ones(len(runs), bool)
    breaks[1:] = ((np.diff(whose) != 0) | (np.diff(where) != 1) | (np.diff(source) != 0) | (np.diff(source_at) != 1))
    begin = np.flatnonzero(breaks)
    none, blank, void = (np.zeros(len(x), np.int64) for x in (lone, begin, echoing))
    parts = {
        "edge": (e[lone].view(np.int64), blank, void), "doc": (d[lone], whose[begin], echoing),
        "at": (a[lone], where[begin], void), "marks": (m[lone].view(np.int64), blank, void),
        "n": (none, np.diff(np.append(begin, len(runs))), void - 1),
        "source": (none, source[begin], void), "source_at": (none, source_at[begin], void),
    }
    return {c: np.concatenate(v) for c, v in parts.items()}


def _ranges(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the half-open ranges."""
    end = np.minimum(end, n)
    good = start < end
    change = np.bincount(start[good], minlength=n + 1)[: n + 1] - np.bincount(end[good], minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def compact(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(edge, check, path_doc, path_at, offset): each repeated edge's place on its path.

    ``edges`` has one row per repeated edge: its first source (doc, at), the second number of
    its words there, and whether paths join before it or part after it.
    """
    along = Window.partitionBy("doc", F.shiftright("at", PIECE.bit_length() - 1)).orderBy("at")
    follows = (F.lag("at").over(along) == F.col("at") - 1) & ~F.col("joins") & ~F.lag("parts").over(along)
    placed = scratch.keep(edges.withColumn("begins", F.when(follows, None).otherwise(F.col("at"))).withColumn(
        "piece", F.last("begins", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).drop("begins"), "pieces")
    pieces = placed.groupBy("doc", "piece").agg(
        (F.max("at") + 1).alias("end"), F.min_by("joins", "at").alias("joins"), F.max_by("parts", "at").alias("parts"))
    ahead = pieces.where(~F.col("parts")).select("doc", F.col("end").alias("piece"), F.col("piece").alias("ahead"))
    heads = scratch.keep(pieces.join(ahead, ["doc", "piece"], "left").select(
        "doc", "piece", F.when(F.col("joins"), F.col("piece")).otherwise(F.coalesce("ahead", "piece")).alias("head")), "heads")
    while True:
        further = heads.select("doc", F.col("piece").alias("head"), F.col("head").alias("further"))
        following = scratch.keep(heads.join(further, ["doc", "head"]).select(
            "doc", "piece", F.col("further").alias("head"), (F.col("further") != F.col("head")).alias("moved")), "heads")
        heads = following.select("doc", "piece", "head")
        if not following.where("moved").limit(1).count():
            break
    return placed.join(heads, ["doc", "piece"]).select(
        "edge", "check", F.col("doc").alias("path_doc"), F.col("head").alias("path_at"), (F.col("at") - F.col("head")).alias("offset"))


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Windows (edge, doc, at, check) whose edge two documents have; ``leads`` at its first
    source, with whether paths join before the edge or part after it."""
    of = Window.partitionBy("edge")
    check = F.shiftrightunsigned("marks", 32)
    before = F.nullif(F.shiftrightunsigned("marks", 16).bitwiseAND(65535), F.lit(0))
    after = F.nullif(F.col("marks").bitwiseAND(65535), F.lit(0))
    return windows.where("n = 0").select("edge", "doc", "at", check.alias("check"), before.alias("before"), after.alias("after")).select(
        "edge", "doc", "at", "check", F.min(F.struct("doc", "at")).over(of).alias("first"), F.max("doc").over(of).alias("last"),
        F.coalesce(F.min("before").over(of) != F.max("before").over(of), F.lit(False)).alias("joins"),
        F.coalesce(F.min("after").over(of) != F.max("after").over(of), F.lit(False)).alias("parts"),
    ).where("last <> first.doc").select(
        "edge", "doc", "at", "check", ((F.col("doc") == F.col("first.doc")) & (F.col("at") == F.col("first.at"))).alias("leads"), "joins", "parts")


def repeated_spans(texts: DataFrame, k: int) -> DataFrame:
    """(doc, spans, echoes): per document its verified windows on paths with an earlier source,
    as (at, n, path_doc, path_at), n windows from ``at``; and whether windows of the document
    that equal these are left out.  From rows (doc_id, text, places)."""
    scratch = Scratch(texts.sparkSession)
    windows = scratch.keep(edges_around(texts, k), "windows")
    repeated = scratch.keep(repeated_windows(windows), "repeated")
    paths = compact(repeated.where("leads").select("edge", "check", "doc", "at", "joins", "parts"), scratch)
    lone = (
        repeated.select("edge", F.col("doc").alias("own"), "at", F.col("check").alias("own_check")).join(paths, "edge")
        # The difference is no join key: windows stay placed by their edge alone.
        .where(F.col("own_check") - F.col("check") == 0)
        .select("own", "at", F.lit(1).alias("n"), "path_doc", "path_at")
    )
    runs = windows.where("n > 0").select(
        F.col("doc").alias("own"), "at", "n", F.col("source").alias("path_doc"), F.col("source_at").alias("path_at"))
    span = F.struct("at", "n", "path_doc", "path_at")
    found = lone.unionByName(runs).where(F.col("path_doc") < F.col("own")).select(F.col("own").alias("doc"), span.alias("span"))
    echoing = windows.where("n < 0").select("doc", F.lit(None).cast(found.schema["span"].dataType).alias("span"))
    spans = found.unionByName(echoing).groupBy("doc").agg(
        F.collect_list("span").alias("spans"), F.max(F.col("span").isNull()).alias("echoes")).where(F.size("spans") > 0)
    return scratch.finish(spans, "spans")


def remove_spans(texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, n_removed, kept_text) of rows (doc_id, key, text, ats, ns, echoes): words under windows go."""

    def rows(batch: dict[str, list]) -> dict[str, object]:
        removed, kept = [], []
        for text, ats, ns, echoes in zip(batch["text"], batch["ats"], batch["ns"], batch["echoes"]):
            data = as_bytes(text)
            words = data.split()
            ats, ns = np.array(ats, np.int64), np.array(ns, np.int64)
            # Each run of n windows from a place, as the n places.
            starts = np.repeat(ats - np.cumsum(ns) + ns, ns) + np.arange(ns.sum())
            if echoes:
                numbers = word_numbers(data)
                windows = sequence_numbers(numbers, k) ^ scramble(second_numbers(numbers, k))
                starts = np.flatnonzero(np.isin(windows, windows[starts]))
            gone = covered(starts, k, len(words))
            removed.append(int(gone.sum()))
            kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
        return {"doc_id": batch["doc_id"], "key": batch["key"], "n_removed": removed, "kept_text": kept}

    return per_batch(texts, "doc_id long, key long, n_removed long, kept_text string", rows)


def deduplicated_words(
    df: DataFrame, k: int = SPAN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, ``kept_text`` (null: all words stay), kept_sha256.

    A word is removed if a window of k consecutive words that covers it also starts in a
    document with a smaller id; windows are judged on the input.  Null and empty texts have
    no words.  Windows that repeat inside one document only are kept.  Rows without id
    neither lose words nor make others lose any.  Of rows that repeat an id with other texts
    one (by hash of the text) is judged, the others keep all words unless they equal an
    earlier document.  Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    outlines = scratch.keep(outline(docs, k), "outlines")
    rows = outlines.drop("anchors", "places", "sure")
    whole = rows.where("doc_id IS NOT NULL").groupBy(F.col("sha").alias("__sha")).agg(F.min("doc_id").alias("first"))
    rows = rows.join(whole, F.col("sha") == F.col("__sha"), "left")
    # Texts with the same words as an earlier one need no windows: all of them are repeated.
    judged = scratch.keep(
        rows.where(F.col("first") == F.col("doc_id")).groupBy("doc_id").agg(
            F.min(F.struct("key", "same")).alias("j")).select("doc_id", "j.*"), "judged"
    )
    wanted = judged.join(repeated_places(outlines), "same").select("doc_id", "key", "places")
    spans = repeated_spans(_texts_of(docs, wanted), k).select(F.col("doc").alias("doc_id"), F.col("spans.at").alias("ats"), F.col("spans.n").alias("ns"), "echoes")
    cut = remove_spans(_texts_of(docs, judged.select("doc_id", "key").join(spans, "doc_id")), k).select(
        "doc_id", "key", "n_removed", "kept_text", F.sha2("kept_text", 256).alias("cut_sha"))
    gone = F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= k), F.lit(False))
    return rows.withColumn("gone", gone).join(cut, ["doc_id", "key"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("gone"), "").otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(F.col("gone"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted columns with the text of each (doc_id, key), once."""
    return docs.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
