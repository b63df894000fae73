"""N-gram Jaccard join with filters under several global token orders.

Sets of n-gram numbers are compared.  Sets that reach the threshold share a token among the
first ``p = n - ceil(t n) + 1`` of each of them, under any order of all tokens that is the same
for all sets.  Candidates must do so under several orders at once; only then are they verified.

1. Equal sets become one class (digest of the set), so copies are never paired.
2. A third of all tokens, chosen by hash, travels as packed 32-bit numbers to be told apart
   into rare and shared ones.  A class whose prefix under "chosen tokens first, rare ones before
   shared ones" holds rare tokens only has no partner.  This leaves the few classes that might.
3. These classes' prefixes are cut under orders that put rare tokens first and break ties by
   different hashes.  A pair's common tokens must lie where both sizes leave room for the
   overlap they need.  In each group that shares a prefix token of the first order, members
   are compared with one pivot, so a group of near copies takes as many comparisons as it
   has members; further rounds take other pivots between different components.
4. Only groups that still span several components then give further pairs: members outside
   the group's main component with all others, so no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sevscale.llm.components import components
from sevscale.llm.frames import Scratch, as_bytes, per_batch
from sevscale.llm.words import sequence_numbers, word_numbers

SHINGLE = 5
PERCENT = 80  # least similarity, in percent
CHOSEN = 3  # one token in three serves for the first filter
ORDERS = 3
STARS = 2  # rounds of pivots before the remaining pairs are made
FILTER_IDS = 2_000_000  # ids (8 bytes each) that are broadcast at most to find the texts in question
PACKETS = 256  # packets the chosen tokens are dealt to, by hash


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct numbers of the runs of k words, lower-cased in ASCII.

    Fewer words make one run of them all; none make none.
    """
    words = word_numbers(as_bytes(text).lower())
    return np.unique(sequence_numbers(words, min(k, len(words)))) if len(words) else words


def is_chosen(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)) % np.uint64(CHOSEN) == 0


def digests(tokens: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return tuple(np.frombuffer(raw, "<i8").tolist())


def set_classes(df: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, chosen, d1, d2): size and digest of each row's set."""

    def rows(batch: dict[str, list]) -> dict[str, object]:
        sets = [shingle_set(t, k) for t in batch["text"]]
        both = [digests(s) for s in sets]
        return {
            "doc_id": batch["doc_id"], "n": [len(s) for s in sets],
            "chosen": [int(is_chosen(s).sum()) for s in sets],
            "d1": [d[0] for d in both], "d2": [d[1] for d in both],
        }

    return per_batch(df, "doc_id long, n long, chosen long, d1 long, d2 long", rows)


def packets(df: DataFrame, k: int) -> DataFrame:
    """Chosen tokens, packed: per batch and packet their 32 low bits and their sets' digests."""

    def rows(batch: dict[str, list]) -> dict[str, object]:
        seen: dict[int, np.ndarray] = {}
        for text in batch["text"]:
            tokens = shingle_set(text, k)
            if len(tokens):
                seen.setdefault(digests(tokens)[0], tokens[is_chosen(tokens)])
        out: dict[str, list] = {"packet": [], "tokens": [], "sets": []}
        if seen:
            tokens = np.concatenate(list(seen.values()))
            sets = np.repeat(np.array(list(seen), np.int64), [len(v) for v in seen.values()])
            packet = (tokens >> np.uint64(56)).astype(np.int64) % PACKETS
            order = np.argsort(packet, kind="stable")
            tokens, sets, packet = tokens[order].astype(np.uint32), sets[order], packet[order]
            ends = np.searchsorted(packet, np.arange(PACKETS), side="right")
            start = 0
            for i, end in enumerate(ends.tolist()):
                if end > start:
                    out["packet"].append(i)
                    out["tokens"].append(tokens[start:end].tobytes())
                    out["sets"].append(sets[start:end].tobytes())
                start = end
        return out

    return per_batch(df.select("text"), "packet int, tokens binary, sets binary", rows)


def shared_counts(packed: DataFrame) -> DataFrame:
    """(d1, shared): how many chosen tokens of a set occur in other sets too (or seem to)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        for batch in batches:
            for packet, tokens, sets in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held[packet].append((np.frombuffer(tokens, np.uint32), np.frombuffer(sets, np.int64)))
        for packet in list(held):
            pieces = held.pop(packet)
            tokens = np.concatenate([p[0] for p in pieces])
            sets = np.concatenate([p[1] for p in pieces])
            order = np.argsort(tokens, kind="stable")
            tokens, sets = tokens[order], sets[order]
            starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            low, high = np.minimum.reduceat(sets, starts), np.maximum.reduceat(sets, starts)
            shared = np.repeat(low != high, np.diff(np.append(starts, len(tokens))))
            which, n = np.unique(sets[shared], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(n.astype(np.int64))], names=["d1", "shared"])

    parts = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return (
        packed.repartition(min(parts, PACKETS), "packet").mapInArrow(count, "d1 long, shared long")
        .groupBy("d1").agg(F.sum("shared").alias("shared"))
    )


def needed(n: Column, percent: int) -> Column:
    """Length of the prefix among whose tokens every set that reaches the threshold has one."""
    return n - F.ceil(n * percent / 100) + 1


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Tokens that sets of these sizes share at least if they reach the threshold."""
    return F.ceil(percent * (a + b) / (100 + percent))


def prefixes(sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """Sets (node, n, tokens) with ``alone`` and ``prefix``; those without candidates are left out.

    Of ``tokens`` only those stay that other sets have too: no other can be common to a pair.

    Order j: fewer sets first, ties by the j-th hash.  Tokens of one set alone come first in
    every order; they fill the prefix but match nothing, so only their number, ``alone``,
    counts.  ``prefix`` has per order the tokens of the prefix that other sets have too.
    """
    rows = sets.select("node", F.explode("tokens").alias("token"))
    common = rows.groupBy("token").agg(F.count("*").cast("int").alias("sets")).where(F.col("sets") > 1)
    gathered = rows.join(common, "token").groupBy("node").agg(F.collect_list(F.struct("sets", "token")).alias("common"))
    left = needed(F.col("n"), percent) - F.col("alone")

    def cut(j: int) -> Column:
        keyed = F.transform("common", lambda c: F.struct(
            c["sets"].alias("sets"), F.xxhash64(F.lit(j), c["token"]).alias("h"), c["token"].alias("token")))
        return F.slice(F.array_sort(keyed), F.lit(1), left.cast("int"))["token"]

    return (
        sets.select("node", "n").join(gathered, "node").withColumn("alone", F.col("n") - F.size("common")).where(left > 0)
        .select("node", "n", "alone", F.col("common.token").alias("tokens"),
                F.array(*[cut(j) for j in range(orders)]).alias("prefix"))
    )


def in_both_prefixes(a: str, b: str, percent: int) -> Column:
    """Whether a common token's places leave room for the least overlap in both sets."""
    least = least_overlap(F.col(f"n_{a}"), F.col(f"n_{b}"), percent)
    return (F.col(f"at_{a}") <= F.col(f"n_{a}") - least + 1) & (F.col(f"at_{b}") <= F.col(f"n_{b}") - least + 1)


def verified(pairs: DataFrame, cut: DataFrame, percent: int, orders: int) -> DataFrame:
    """Of the pairs (a, b), those that pass the filters of all orders and reach the threshold."""

    def side(name: str) -> DataFrame:
        return cut.select(*[F.col(c).alias(f"{c}_{name}") for c in cut.columns]).withColumnRenamed(f"node_{name}", name)

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    least = least_overlap(F.col("n_a"), F.col("n_b"), percent)

    def first(name: str, j: int) -> Column:
        room = F.col(f"n_{name}") - least + 1 - F.col(f"alone_{name}")
        return F.slice(F.col(f"prefix_{name}")[j], F.lit(1), F.greatest(room, F.lit(0)).cast("int"))

    for j in range(1, orders):
        joined = joined.where(F.arrays_overlap(first("a", j), first("b", j)))
    return joined.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= least).select("a", "b")


def prefix_tokens(cut: DataFrame) -> DataFrame:
    """(token, node, n, alone, at): tokens of the first order's prefixes, their places from 1."""
    return cut.select("node", "n", "alone", F.posexplode(F.col("prefix")[0]).alias("i", "token")).select(
        "token", "node", "n", "alone", (F.col("alone") + F.col("i") + 1).alias("at"))


def with_labels(tokens: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return tokens.withColumn("label", F.col("node"))
    return tokens.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def star_pairs(tokens: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of nodes b with pivots of the main component of groups they are in.

    The main component of a token's group is its most frequent one; its pivot is the member
    with fewest tokens of its own, so the one nearest to the middle of a group of near
    copies, equals by a hash of turn and token.  At first every node is a component and takes
    the pivot it meets most often; later it takes three.
    """
    draw = F.xxhash64(F.lit(turn), F.col("token"), F.col("node"))
    pivots = (
        tokens.groupBy("token", "label").agg(F.count("*").alias("m"), F.min(F.struct("alone", draw, "node", "n", "at")).alias("p"))
        .groupBy("token").agg(F.max(F.struct("m", -F.col("p.alone"), "label", "p")).alias("main"), F.count("*").alias("labels"))
        .where(F.col("labels") > 1)
        .select("token", F.col("main.p.node").alias("a"), F.col("main.p.n").alias("n_a"),
                F.col("main.p.at").alias("at_a"), F.col("main.label").alias("label_a"))
    )
    met = (
        tokens.withColumnsRenamed({"node": "b", "n": "n_b", "at": "at_b"}).join(pivots, "token")
        .where((F.col("label") != F.col("label_a")) & in_both_prefixes("a", "b", percent))
        .groupBy("b", "a").agg(F.count("*").alias("shared"))
    )
    most = Window.partitionBy("b").orderBy(F.col("shared").desc(), "a")
    return met.withColumn("__row", F.row_number().over(most)).where(F.col("__row") <= (3 if turn else 1)).select("a", "b")


def open_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that meet in a group of a first-order token.

    Members of the group's most frequent component are not paired with each other: the
    others are, with all members.
    """
    per_label = tokens.groupBy("token", "label").agg(F.count("*").alias("m"))
    mixed = per_label.groupBy("token").agg(
        F.max(F.struct("m", "label")).alias("most"), F.count("*").alias("labels")
    ).where(F.col("labels") > 1).select("token", F.col("most.label").alias("major"))
    rows = tokens.join(mixed, "token")
    few = rows.where(F.col("label") != F.col("major")).select(
        "token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("label").alias("label_a"))
    return (
        rows.withColumnsRenamed({"node": "b", "n": "n_b", "at": "at_b"}).join(few, "token")
        .where((F.col("label") != F.col("label_a")) & ((F.col("label") == F.col("major")) | (F.col("a") < F.col("b")))
               & in_both_prefixes("a", "b", percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )


def linked_groups(cut: DataFrame, percent: int, orders: int, scratch: Scratch) -> DataFrame:
    """(node, label) of the sets that have a link, as ``components`` gives them."""
    tokens = scratch.keep(prefix_tokens(cut), "tokens")
    links, labels = None, None
    for turn in range(STARS):
        pairs = star_pairs(with_labels(tokens, labels), percent, turn)
        found = scratch.keep(verified(pairs, cut, percent, orders), "links")
        links = found if links is None else links.union(found)
        labels = components(links, scratch)
    pairs = scratch.keep(open_pairs(with_labels(tokens, labels), percent), "pairs")
    return components(links.union(verified(pairs, cut, percent, orders)), scratch)


def similar_groups(
    df: DataFrame, k: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, ``n_shingles``, ``component_id`` (the smallest doc_id linked to it).

    Rows link when 100 * intersection >= percent * union of their sets.  Rows without words
    or text have size 0 and their own id.  Rows with equal sets are linked; a null id takes
    part but is never smallest, unless all linked ids are null.  Rows that repeat an id with
    another text are separate rows.  Only the two named columns are read.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    members = scratch.keep(set_classes(docs, k), "members")
    classes = scratch.keep(
        members.where(F.col("n") > 0).groupBy("d1", "d2", "n", "chosen").agg(F.min("doc_id").alias("first"))
        .withColumn("node", F.monotonically_increasing_id()), "classes",
    )
    rare = F.col("chosen") - F.coalesce("shared", F.lit(0))
    active = scratch.keep(
        classes.join(shared_counts(packets(docs, k)), "d1", "left")
        .where(rare < needed(F.col("n"), percent)).select("node", "d1", "d2", "first"), "active",
    )
    texts = active.join(_among(docs, active), F.col("first").eqNullSafe(F.col("doc_id")))
    sets = _once(scratch.keep(_own_sets(texts, k), "sets"), scratch)
    cut = scratch.keep(prefixes(sets, percent, orders), "prefixes")
    labels = linked_groups(cut, percent, orders, scratch)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_class = named.join(smallest, "label").select("d1", "d2", "n", "component_id")
    result = members.join(by_class, ["d1", "d2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return scratch.finish(result, "groups")


def _among(docs: DataFrame, active: DataFrame) -> DataFrame:
    """The docs, without those whose id is not in question if such ids are few enough to broadcast.

    This only spares moving texts that the join would drop; with more ids it drops them itself.
    """
    if active.count() > FILTER_IDS:
        return docs
    ids = active.select(F.xxhash64("first").alias("__first"))
    return docs.join(F.broadcast(ids), F.xxhash64("doc_id") == F.col("__first"), "left_semi")


def _own_sets(texts: DataFrame, k: int) -> DataFrame:
    """Sets of rows (node, d1, d2, text); a row of the same id with another set is left out."""

    def rows(batch: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {"node": [], "n": [], "tokens": []}
        for node, d1, d2, text in zip(*(batch[c] for c in ("node", "d1", "d2", "text"))):
            tokens = shingle_set(text, k)
            if digests(tokens) == (d1, d2):
                out["node"].append(node)
                out["n"].append(len(tokens))
                out["tokens"].append(tokens.view(np.int64))
        return out

    found = per_batch(texts.select("node", "d1", "d2", "text"), "node long, n long, tokens array<long>", rows)
    return found.withColumn("row", F.monotonically_increasing_id())


def _once(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Sets with one row per node.  Only repeated ids make more, so these are looked for by
    number, and the tokens of the others stay where they are."""
    repeated = scratch.keep(
        sets.groupBy("node").agg(F.min("row").alias("first_row"), F.count("*").alias("rows")).where(F.col("rows") > 1)
        .select("node", "first_row"), "repeated",
    )
    return (
        sets.join(repeated, "node", "left").where(F.col("first_row").isNull() | (F.col("row") == F.col("first_row")))
        .select("node", "n", "tokens")
    )
