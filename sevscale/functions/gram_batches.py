"""Counting and weighing the grams of many texts at once, inside tasks (Arrow in, Arrow out).

Texts come as (id, words).  A batch's different words are cut into grams once; the counts of all
its texts are sums of sorted numbers.  Rows of equal ids must follow each other; their words count
together, also across the borders of incoming batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words taken at once, and rows handed out at once: they bound a task's memory, and change no result.
WORDS, ROWS = 1 << 18, 1 << 16


def cut(word: str, lo: int, hi: int) -> list[str]:
    """All grams of one bare word, repeats included."""
    p = f" {word} "
    size = len(p)
    out = [p[i:i + lo] for i in range(max(1, size - lo + 1))]
    for n in range(lo + 1, min(hi, size) + 1):
        out += [p[i:i + n] for i in range(size - n + 1)]
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _letters(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, a space before and after each, and the padded lengths."""
    every = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    text = pc.binary_join(every, "  ")[0].as_py()
    data = f" {text} ".encode("utf-32-le") if len(words) else b""
    return np.frombuffer(data, np.uint32), pc.utf8_length(words).to_numpy().astype(np.int64) + 2


def _spelled(points: np.ndarray) -> pa.StringArray:
    """Strings from rows of code points, zeros left out."""
    used = points != 0
    flat = points[used]
    size = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(used.sum(1))))]
    data = flat.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data))


def cuts(words: pa.StringArray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """How many grams each word has, repeats included, their numbers one word after the other, and the grams.

    A gram of few different letters fits one whole number, so windows are taken of all words at
    once; blocks of many different letters are cut word by word.
    """
    points, lengths = _letters(words)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters, code = np.flatnonzero(seen).astype(np.uint32), np.cumsum(seen)  # codes from 1
    bits = 63 // hi
    if len(letters) >= 1 << bits or seen[0]:
        parts = [cut(w, lo, hi) for w in words.to_pylist()]
        coded = pa.array([g for p in parts for g in p], pa.string()).dictionary_encode()
        return np.fromiter(map(len, parts), np.int64, len(parts)), coded.indices.to_numpy().astype(np.int64), coded.dictionary
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(points))  # letters from here to the word's end
    many = np.clip(np.minimum(left, hi) - lo + 1, 0, None)
    many[starts[lengths < lo]] = 1
    at = np.cumsum(many) - many
    keys = np.empty(int(many.sum()), np.int64)
    ahead = np.concatenate((code[points], np.zeros(hi, np.int64)))
    key = np.zeros(len(points), np.int64)
    for n in range(1, hi + 1):
        key = np.where(left >= n, key | (ahead[n - 1:n - 1 + len(points)] << (bits * (n - 1))), key)
        if n >= lo:
            here = np.flatnonzero(many > n - lo)
            keys[at[here] + (n - lo)] = key[here]
    coded = pa.array(keys).dictionary_encode()
    found = coded.dictionary.to_numpy()
    table = np.concatenate((np.zeros(1, np.uint32), letters))
    points = np.stack([table[(found >> (bits * i)) & ((1 << bits) - 1)] for i in range(hi)], 1) if len(found) else np.zeros((0, hi), np.uint32)
    sizes = np.add.reduceat(many, starts) if len(starts) else many
    return sizes, coded.indices.to_numpy().astype(np.int64), _spelled(points)


def _summed(pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, ascending, and the sum of each one's times."""
    if not len(pair):
        return pair, times
    bits = int(times.max()).bit_length()
    if int(pair.max()).bit_length() + bits < 64:  # one plain sort carries both
        both = np.sort(pair << bits | times)
        pair, times = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(pair)
        pair, times = pair[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    return pair[first], np.add.reduceat(times, first)


def tally(text: np.ndarray, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """Text number, word number and count of every different word of a text, by text; the words by number."""
    coded = words.dictionary_encode()
    n_words = max(len(coded.dictionary), 1)
    pair, times = np.unique(text * n_words + coded.indices.to_numpy(), return_counts=True)
    text, word = np.divmod(pair, n_words)
    return text, word, times, coded.dictionary


def count(text: np.ndarray, words: pa.StringArray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """Text number, gram number and count of every different gram of a text, by text; the grams by number."""
    return count_grams(*tally(text, words), lo, hi)


def count_grams(
    text: np.ndarray, word: np.ndarray, times: np.ndarray, words: pa.StringArray, lo: int, hi: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """As ``count``, from the words' counts."""
    sizes, gram_of, grams = cuts(words, lo, hi)
    reach = sizes[word]
    pair = np.repeat(text, reach) * len(grams) + gram_of[_spread((np.cumsum(sizes) - sizes)[word], reach)]
    pair, tf = _summed(pair, np.repeat(times, reach))
    text, gram = np.divmod(pair, max(len(grams), 1))
    return text, gram, tf, grams


def _numbered(ids: pa.Array) -> np.ndarray:
    """0, 1, ... along the ids; neighbours that are equal, or both null, share a number."""
    if len(ids) == 0:
        return np.zeros(0, np.int64)
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    differ = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
    return np.concatenate(([0], np.cumsum(differ.to_numpy(zero_copy_only=False))))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.StringArray]]:
    """Ids, and the text number and word of every word, of about ``WORDS`` words each; an id is never divided."""
    held: list[pa.Table] = []
    size = 0

    def block(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.StringArray]:
        ids, words = (table.column(c).combine_chunks() for c in ("id", "words"))
        number = _numbered(ids)
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        start = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        return ids.take(pa.array(start)), np.repeat(number, lengths), words.flatten().cast(pa.string())

    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy())
        at = 0
        while at < batch.num_rows:  # rows up to the wanted number of words, one at least
            before = lengths[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(lengths, before + WORDS - size, "right")))
            held.append(pa.Table.from_batches([batch.slice(at, to - at)]).select(["id", "words"]))
            size, at = size + int(lengths[to - 1] - before), to
            if size < WORDS:
                continue
            table = pa.concat_tables(held).combine_chunks()
            number = _numbered(table.column("id").combine_chunks())
            last = int(np.searchsorted(number, number[-1]))  # the last id may go on
            if last:
                yield block(table.slice(0, last))
            held = [table.slice(last)]
            size = int(pc.sum(pc.list_value_length(held[0].column("words"))).as_py() or 0)
            if size >= WORDS:  # one id fills a block by itself: take in more before looking again
                size = 0
    if held:
        yield block(pa.concat_tables(held).combine_chunks())


def counted(lo: int, hi: int):
    """One (id, grams, tfs) row per id that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text, words in blocks(batches):
            text, gram, tf, grams = count(text, words, lo, hi)
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            a = 0
            while a < len(starts):  # whole ids, about ROWS grams at once
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + ROWS)))
                edges = np.append(starts, len(text))[a:b + 1]
                part = slice(edges[0], edges[-1])
                ends = pa.array((edges - edges[0]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(text[edges[:-1]])), pa.ListArray.from_arrays(ends, grams.take(pa.array(gram[part]))),
                    pa.ListArray.from_arrays(ends, pa.array(tf[part]))], ["id", "grams", "tfs"])
                a = b

    return run


def different(lo: int, hi: int):
    """(batch, gram): every gram of one group of (batch, words) once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, fresh, batch = pa.array([], pa.string()), [], None
        for part in batches:
            batch = part.column("batch")[0]
            words = part.column("words").flatten().cast(pa.string()).unique()
            for a in range(0, len(words), WORDS):
                fresh.append(cuts(words.slice(a, WORDS), lo, hi)[2])
            if sum(map(len, fresh)) > max(len(found), ROWS):
                found, fresh = pa.concat_arrays([found, *fresh]).unique(), []
        found = pa.concat_arrays([found, *fresh]).unique()
        for a in range(0, len(found), ROWS):
            grams = found.slice(a, ROWS)
            yield pa.RecordBatch.from_arrays([pa.repeat(batch, len(grams)), grams], ["batch", "gram"])

    return run


def frequencies(lo: int, hi: int):
    """(gram, n): in how many texts of a block each gram is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text, words in blocks(batches):
            _, gram, _, grams = count(text, words, lo, hi)
            n = np.bincount(gram, minlength=len(grams))
            for a in range(0, len(grams), ROWS):
                yield pa.RecordBatch.from_arrays([grams.slice(a, ROWS), pa.array(n[a:a + ROWS])], ["gram", "n"])

    return run


def _known_blocks(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """Blocks of one group of texts, each with the known grams, which as rows without words come first."""
    known: list[pa.Table] = []
    texts_seen = False

    def texts() -> Iterator[pa.RecordBatch]:
        nonlocal texts_seen
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            n = int(np.count_nonzero(kind == 0))
            if n and (texts_seen or kind[:n].any()):
                raise RuntimeError("known grams must come before the texts")
            if n:
                known.append(pa.Table.from_batches([batch.slice(0, n)]).select(["gram", *columns]))
            if n < batch.num_rows:
                texts_seen = True
                yield batch.slice(n)

    table = None
    for ids, text, words in blocks(texts()):
        if table is None:
            table = pa.concat_tables(known).combine_chunks() if known else None
        if table is None:
            return
        yield table, ids, text, words


def _places(table: pa.Table, grams: pa.StringArray) -> np.ndarray:
    """The row of each gram in the known ones, or -1."""
    place = pc.index_in(grams, value_set=table.column("gram").combine_chunks())
    return pc.fill_null(place, -1).to_numpy()


def weighed(lo: int, hi: int, extra: list[str]):
    """(id, gram, extra..., tf, weight) of one group of texts, whose known grams come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids, text, words in _known_blocks(batches, ["idf", *extra]):
            text, gram, tf, grams = count(text, words, lo, hi)
            at = _places(table, grams)[gram]
            held = at >= 0
            text, gram, tf, at = text[held], gram[held], tf[held], at[held]
            w = tf * table.column("idf").to_numpy()[at]
            norm = np.sqrt(np.bincount(text, w * w, len(ids)))[text]
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = pa.array(w / norm, mask=norm == 0)
            columns = [table.column(c).combine_chunks() for c in extra]
            schema = pa.schema([("id", ids.type), ("gram", pa.string()), *[(c, table.schema.field(c).type) for c in extra],
                                ("tf", pa.int64()), ("weight", pa.float64())])
            for a in range(0, len(text), ROWS):
                part = slice(a, a + ROWS)
                rows = pa.array(at[part])
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(text[part])), grams.take(pa.array(gram[part])), *[c.take(rows) for c in columns],
                    pa.array(tf[part]), weight[part]], schema=schema)

    return run


def scored(lo: int, hi: int, parts: list[tuple[str, list[str]]]):
    """(id, a sum for each column) of one group of texts, whose known grams come first.

    Each part is one model: the column of its idf, null where a gram is not the model's, and the columns
    that are summed over the text's grams, times their weights.  Texts without a known gram get nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c for idf, columns in parts for c in [idf, *columns]]
        for table, ids, text, words in _known_blocks(batches, names):
            text, gram, tf, grams = count(text, words, lo, hi)
            at = _places(table, grams)[gram]
            held = at >= 0
            text, tf, at = text[held], tf[held], at[held]
            known = {c: pc.fill_null(table.column(c), 0.0).to_numpy() for c in names}
            out = []
            for idf, columns in parts:
                w = tf * known[idf][at]
                norm = np.sqrt(np.bincount(text, w * w, len(ids)))
                for c in columns:
                    total = np.bincount(text, w * known[c][at], len(ids))
                    out.append(pa.array(np.divide(total, norm, out=total, where=norm > 0), mask=norm == 0))
            schema = pa.schema([("id", ids.type), *[(c, pa.float64()) for _, columns in parts for c in columns]])
            yield pa.RecordBatch.from_arrays([ids, *out], schema=schema)

    return run
