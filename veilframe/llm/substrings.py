"""Substring deduplication: passages that an earlier document has are removed, by windows of words.

Windows are looked for level by level: of half the length asked for, of that length,
then of twice, four times, ... it.  A window goes to the next level only where the
window that it is extended from occurs in two documents, until none does.  What is
removed is decided at the length asked for; the longer levels, on demand, say how long the
repeated passages are.

The first level is thinned without a loss.  Of the windows inside a window of the next level the
one with the smallest code stands for it (its anchor): equal windows choose the same, so
where no anchor is repeated, no longer window is.  The longer levels come in two kinds.  With
``every`` all windows whose two halves are repeated are looked up, so what survives a level is
all that two documents share there; each level's windows are made from the survivors of the one
before.  Without it, only windows that are the smallest among half a length of neighbours are
looked up: whatever is repeated over one and a half lengths or more has one, a shorter passage
may have none.

What is compared travels as arrays: a task groups its codes by bucket and sends,
per code, only its smallest document.  Documents that share a code with a smaller
one of the same task are answered at once, so a code that a third of all
documents have is one entry per task and bucket.

Texts are looked at in chunks of many documents that lie one after another, so that
the cost of a step is that of its words, not of its calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import new_folder, removed, shuffles_removed, written
from .words import blanked, column, joined_codes, mixed, pair_codes, runs_within, text_chunks, window_checks, window_codes, word_bounds, word_codes, words_within

#: Codes that a task gathers before it sends them, and codes in a row at most.
GATHERED, IN_ROW = 1 << 20, 512
#: Buckets per shuffle partition; a task holds one bucket at a time.
BUCKETS = 16


def text_codes(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    return word_codes(data, *word_bounds(data))


def least_inner(codes: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` codes, the position of its smallest (the first of equals)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, reach = np.arange(len(codes)), 1
    while reach < width:  # runs of one, two, four, ... codes
        step = min(reach, width - reach)
        first, second = best[:len(best) - step], best[step:]
        best = np.where(codes[second] < codes[first], second, first)
        reach += step
    return best


def least_values(codes: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` codes, its smallest."""
    reach = 1
    if len(codes) < width:
        return codes[:0]
    while reach < width:
        step = min(reach, width - reach)
        codes, reach = np.minimum(codes[:len(codes) - step], codes[step:]), reach + step
    return codes


def short_length(window: int) -> int:
    """The first level's length: half the window."""
    return (window + 1) // 2


def seeds_of(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the short windows, and for each long window that of the short one that stands for it, the smallest."""
    short = short_length(window)
    codes = window_codes(words, short)
    return codes, least_values(codes, window - short + 1)


def whole_windows(codes: np.ndarray, window: int) -> np.ndarray:
    """Codes of the windows, from those of the short windows."""
    return joined_codes(codes, window - short_length(window))


def longer_windows(codes: np.ndarray, window: int, among: np.ndarray, docs: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, ...]]:
    """Length, codes and anchors' codes of the windows to look up at twice, four times, ... the window, thinned.

    ``codes`` are those of all windows of texts, ``among`` says which may be repeated; windows
    lie in runs of those, and a run lies in one text.  With ``docs`` (a number per code), also those of the windows.
    """
    starts, ends, _ = runs_within(among, np.zeros(0, np.int64))
    starts, size = starts[ends - starts > window], (ends - starts)[ends - starts > window]
    run = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(run)) + (starts - np.cumsum(size) + size)[run]
    codes, docs, length = codes[at], None if docs is None else docs[at], window
    while len(run):
        half, length = length, 2 * length
        # A longer window is the pair of windows of half its length; of these the smallest inside is its anchor.
        inside = run[:-half] == run[half:]
        own, anchors = joined_codes(codes, half)[inside], least_values(codes, half + 1)[inside]
        run, docs = run[:-half][inside], None if docs is None else docs[:-half][inside]
        if len(run) > half:
            chosen = np.zeros(len(run), bool)
            chosen[least_inner(own, half + 1)[run[:-half] == run[half:]]] = True
            if chosen.any():
                yield (length, own[chosen], anchors[chosen]) if docs is None else (length, own[chosen], anchors[chosen], docs[chosen])
        long = np.bincount(run)[run] > length
        codes, run, docs = own[long], run[long], None if docs is None else docs[long]


class _Sent:
    """Gathers codes (one number each, or one and a half) with their document, and gives rows of arrays."""

    def __init__(self, buckets: int):
        self.buckets = np.uint64(buckets)
        self.h: list[np.ndarray] = []
        self.g: list[np.ndarray] = []
        self.d: list[np.ndarray] = []
        self.n = 0

    def add(self, doc: int | np.ndarray, h: np.ndarray, g: np.ndarray | None = None) -> None:
        self.h.append(h)
        self.g.append(np.zeros(len(h), np.uint32) if g is None else g.astype(np.uint32))
        self.d.append(np.full(len(h), doc, np.int64))
        self.n += len(h)

    def rows(self, all_shared: bool) -> Iterator[pa.RecordBatch]:
        """Rows for the buckets, and rows for documents that are answered already.

        A code that two documents of the task have answers all of these documents
        (``all_shared``), or all but the smallest, which may be the smallest of all.
        """
        if not self.n:
            return
        h, g, d = np.concatenate(self.h), np.concatenate(self.g), np.concatenate(self.d)
        self.h, self.g, self.d, self.n = [], [], [], 0
        order = _by_code(h, g, d)
        h, g, d = h[order], g[order], d[order]
        new = _starts(h, g)
        once = new.copy()
        once[1:] |= d[1:] != d[:-1]
        h, g, d = h[once], g[once], d[once]
        start = np.flatnonzero(new[once])
        size = np.diff(np.append(start, len(h)))
        last = np.append(start[1:], len(h)) - 1
        two = d[start] != d[last]
        answered = np.repeat(two, size) if all_shared else d > np.repeat(d[start], size)
        yield _answers(d[answered], h[answered], self.buckets)
        # One entry a code: its smallest document, and whether another one of the task has it.
        bucket = (mixed(h[start]) % self.buckets).astype(np.int64)
        by = np.argsort(d[start])
        by = by[np.argsort(bucket[by].astype(np.min_scalar_type(int(self.buckets))), kind="stable")]
        start, two, bucket = start[by], two[by], bucket[by]
        high = d[start] >> 31
        cuts = _cuts(bucket, high)
        first = cuts[:-1]
        yield _batch(bucket[first], None, cuts, h[start], high[first] << 31, g[start], (d[start] & 0x7FFFFFFF).astype(np.int32), two)


def _by_code(h: np.ndarray, g: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Order by code, then document: a plain sort, and one of those alone that are equal in the first number."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    tied = np.zeros(len(h), bool)
    tied[1:] |= same
    tied[:-1] |= same
    some = order[tied]
    if not len(some):
        return order
    turns = np.append(False, h[some[1:]] != h[some[:-1]])
    group, least = np.cumsum(turns), int(d[some].min())
    span = int(d[some].max()) - least + 1
    if (g[some[1:]] == g[some[:-1]])[~turns[1:]].all() and (int(group[-1]) + 1) * span < 1 << 62:
        # Code and document in one number, as codes that are equal by half are hardly ever found.
        order[tied] = some[np.argsort(group * span + (d[some] - least))]
    else:
        order[tied] = some[np.lexsort((d[some], g[some], h[some]))]
    return order


def _starts(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    out[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return out


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Ends of rows: a new one per key, and after ``IN_ROW`` entries."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    turns = np.ones(n, bool)
    turns[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    change = np.flatnonzero(turns)
    within = np.arange(n) - np.repeat(change, np.diff(np.append(change, n)))
    return np.append(np.flatnonzero(within % IN_ROW == 0), n)


_ROW = pa.schema([("part", pa.int64()), ("doc", pa.int64()), ("h", pa.list_(pa.int64())), ("base", pa.int64()), ("g", pa.list_(pa.int32())),
                  ("least", pa.list_(pa.int32())), ("two", pa.list_(pa.bool_())), ("length", pa.int32()), ("anchors", pa.list_(pa.int64()))])
ROW_TYPE = ("part bigint, doc bigint, h array<bigint>, base bigint, g array<int>, least array<int>, two array<boolean>, "
            "length int, anchors array<bigint>")


def _lists(cuts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values, kind))


def _batch(part, doc, cuts, h, base=None, g=None, least=None, two=None, length=None, anchors=None) -> pa.RecordBatch:
    """Rows of arrays: for a bucket, codes with their smallest document (above ``base``); for a document, codes that are
    repeated, or the windows of one of the longer levels with their anchors."""
    n = len(cuts) - 1

    def optional(values, kind):
        return pa.nulls(n, kind) if values is None else pa.array(values, kind) if not pa.types.is_list(kind) else _lists(cuts, values, kind.value_type)

    values = (part, doc, h.view(np.int64), base, None if g is None else g.view(np.int32), least, two, length,
              None if anchors is None else anchors.view(np.int64))
    return pa.RecordBatch.from_arrays([optional(v, f.type) for v, f in zip(values, _ROW, strict=True)], schema=_ROW)


def _parts(docs: np.ndarray, buckets) -> np.ndarray:
    """Any part, the same for a document."""
    return (mixed(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _answers(docs: np.ndarray, h: np.ndarray, buckets) -> pa.RecordBatch:
    """Rows that tell a document which of its codes are repeated; they go to any part."""
    order = np.argsort(docs)
    docs, h = docs[order], h[order]
    cuts = _cuts(docs)
    to = docs[cuts[:-1]] if len(docs) else docs
    return _batch(_parts(to, buckets), to, cuts, h)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _buckets(spark: SparkSession) -> int:
    return BUCKETS * _partitions(spark)


_FOUND = pa.schema([("part", pa.int64()), ("first", pa.bool_()), ("docs", pa.list_(pa.int64())), ("codes", pa.list_(pa.int64()))])


def _packed(docs: np.ndarray, codes: np.ndarray, first: bool, n: int) -> pa.RecordBatch:
    """Answers as rows of arrays by the documents' parts, of which there are ``n``: as many rows as the answers fill."""
    order = np.argsort(docs)
    parts = _parts(docs[order], n)
    by = np.argsort(parts.astype(np.min_scalar_type(n)), kind="stable")
    order, parts = order[by], parts[by]
    cuts = _cuts(parts)
    at = cuts[:-1]
    return pa.RecordBatch.from_arrays([pa.array(parts[at]), pa.array(np.full(len(at), first)), _lists(cuts, docs[order], pa.int64()),
                                       _lists(cuts, codes[order].view(np.int64), pa.int64())], schema=_FOUND)


def _met(sent: DataFrame, answer: Callable) -> DataFrame:
    """Entries of a bucket brought together and answered: documents with their codes that ``answer`` chooses, and with those they are the first of."""
    n = _partitions(sent.sparkSession)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, answered = None, [], ([], [])

        def settle() -> None:
            if held:
                for kind, told in zip(answered, answer(*(np.concatenate(x) for x in zip(*held, strict=True)))):
                    kind.append(told)

        def out(least: int) -> Iterator[pa.RecordBatch]:
            # Answers of many buckets together.
            for i, kind in enumerate(answered):
                if sum(len(codes) for _, codes in kind) >= least:
                    yield _packed(*(np.concatenate(x) for x in zip(*kind, strict=True)), i == 1, n)
                    kind.clear()

        for batch in batches:
            asks = ~batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            direct = batch.filter(pa.array(~asks))
            if direct.num_rows:
                codes, row = _flat(direct.column(2))
                answered[0].append((direct.column(1).to_numpy()[row], codes))
            batch = batch.filter(pa.array(asks))
            if not batch.num_rows:
                continue
            (h, row), g, least, two = _flat(batch.column(2)), *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (4, 5, 6))
            least = least + batch.column(3).to_numpy()[row]
            parts = batch.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
            cuts = np.searchsorted(row, np.append(first, len(parts)))
            for i, a, b in zip(parts[first].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i != part:
                    settle()
                    yield from out(GATHERED)
                    part, held = i, []
                held.append((h[a:b], g.view(np.uint32)[a:b], least[a:b], two[a:b]))
        settle()
        yield from out(1)

    return sent.sortWithinPartitions("part").mapInArrow(met, "part bigint, first boolean, docs array<bigint>, codes array<bigint>")


def _groups(h, g, least):
    order = _by_code(h, g, least)
    start = np.flatnonzero(_starts(h[order], g[order]))
    return order, start, np.diff(np.append(start, len(h)))


def _answer_shared(h, g, least, two):
    """All documents of a code that occurs in two; those that met in their task have been answered there."""
    order, start, size = _groups(h, g, least)
    h, least, two = h[order], least[order], two[order]
    if not len(h):
        return [(least, h)]
    last = np.append(start[1:], len(h)) - 1
    shared = (least[start] != least[last]) | np.logical_or.reduceat(two, start)
    chosen = np.repeat(shared, size) & ~two
    return [(least[chosen], h[chosen])]


def _answer_later(h, g, least, two):
    """Documents that are not the smallest of their code; and the smallest, if there is another one."""
    order, start, size = _groups(h, g, least)
    h, least, two = h[order], least[order], two[order]
    if not len(h):
        return [(least, h), (least, h)]
    later = least > np.repeat(least[start], size)
    last = np.append(start[1:], len(h)) - 1
    firsts = start[(least[start] != least[last]) | np.logical_or.reduceat(two, start)]
    return [(least[later], h[later]), (least[firsts], h[firsts])]


def _answer_only_later(h, g, least, two):
    """Documents that are not the smallest of their code."""
    return _answer_later(h, g, least, two)[:1]


def _gathered(answers: DataFrame) -> DataFrame:
    """One row per document with all its codes; no more than its own text has."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            docs, codes, first = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(docs)
            docs, codes, first = docs[order], codes[order], first[order]
            start = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            ends = np.append(start, len(docs))
            firsts = np.append(0, np.cumsum(first))[ends]
            yield pa.RecordBatch.from_arrays([pa.array(docs[start]), _lists(ends - firsts, codes[~first], pa.int64()), _lists(firsts, codes[first], pa.int64())],
                                             names=["doc", "codes", "firsts"])

        for batch in batches:
            (codes, row), docs = _flat(batch.column(3)), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            first, parts = batch.column(1).to_numpy(zero_copy_only=False)[row], batch.column(0).to_numpy()
            at = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
            cuts = np.searchsorted(row, np.append(at, len(parts)))
            for i, a, b in zip(parts[at].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                # A document is of one part, so that parts can go on together.
                if i != part and sum(len(x[0]) for x in held) >= GATHERED >> 2:
                    yield from out()
                part = i
                held.append((docs[a:b], codes[a:b].view(np.int64), first[a:b]))
        yield from out()

    return _dealt(answers).sortWithinPartitions("part").mapInArrow(gather, "doc bigint, codes array<bigint>, firsts array<bigint>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all lists one after another, and the row of each."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(lists)), size)


def among_own(codes: np.ndarray, rows: np.ndarray, known: np.ndarray, known_rows: np.ndarray) -> np.ndarray:
    """Which codes are among those known of their own row."""
    if not len(known) or not len(codes):
        return np.zeros(len(codes), bool)
    # One number for row and code; both sides are looked through in its order, which is far faster than at random.
    key, known_key = codes + mixed(rows.astype(np.uint64)), known + mixed(known_rows.astype(np.uint64))
    order, known_order = np.argsort(key), np.argsort(known_key)
    at = np.searchsorted(known_key[known_order], key[order])
    at[at == len(known)] = 0
    at = known_order[at]
    out = np.empty(len(codes), bool)
    out[order] = (known[at] == codes[order]) & (known_rows[at] == rows[order])
    return out


def _inside(row: np.ndarray, window: int, use: np.ndarray) -> np.ndarray:
    """Which windows of words that lie one after another are of one row, and of one to ``use``."""
    if len(row) < window:
        return np.zeros(0, bool)
    return (row[:len(row) - window + 1] == row[window - 1:]) & use[row[:len(row) - window + 1]]


def _ids(docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and which there are."""
    return docs.fill_null(0).to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the words of a chunk, and the row of each."""
    starts, ends, firsts = words_within(data, offsets)
    return word_codes(data, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))


def _dealt(sent: DataFrame) -> DataFrame:
    return sent.repartition(_partitions(sent.sparkSession), "part")


def repeated_seeds(texts: DataFrame, window: int) -> DataFrame:
    """First level: per document, the codes of its chosen short windows that another document has."""
    buckets = _buckets(texts.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent(buckets)
        for batch in batches:
            ids, use = _ids(batch.column(0))
            for start, end, data, offsets in text_chunks(batch.column(1)):
                words, row = _words(data, offsets)
                _, chosen = seeds_of(words, window)
                inside = _inside(row, window, use[start:end])
                # Neighbours mostly have the same seed.
                inside[1:] &= ~inside[:-1] | (chosen[1:] != chosen[:-1])
                sent.add(ids[start:end][row[:len(inside)][inside]], chosen[inside])
                if sent.n >= GATHERED:
                    yield from sent.rows(True)
        yield from sent.rows(True)

    return _gathered(_met(_dealt(texts.mapInArrow(send, ROW_TYPE)), _answer_shared)).select("doc", "codes")


def extended_windows(texts: DataFrame, seeds: DataFrame, window: int, *, longer: bool, every: bool = False) -> DataFrame:
    """Rows for the second level; with ``longer``, also the windows of all longer ones, each with its anchor.

    Only windows whose short window is repeated are extended and compared, by 96 bits.  With
    ``every`` the longer ones are not made here; there is one row per text of this level's windows
    and their places, which ``doubled_windows`` goes on from.
    """
    buckets = _buckets(texts.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent(buckets)
        for batch in batches:
            ids, use = _ids(batch.column(0))
            for start, end, data, offsets in text_chunks(batch.column(1)):
                some, some_rows = _flat(batch.column(2).slice(start, end - start))
                if not len(some):
                    continue
                words, row = _words(data, offsets)
                codes, chosen = seeds_of(words, window)
                among = _inside(row, window, use[start:end])
                row = row[:len(among)]
                among[among] = among_own(chosen[among], row[among], some, some_rows)
                at = np.flatnonzero(among)
                whole, own = whole_windows(codes, window), ids[start:end]
                sent.add(own[row[at]], whole[at], window_checks(words, window, at) >> np.uint64(32))
                if every and len(at):
                    yield _placed(buckets, row[at], own, whole[at], at, window)
                for length, found, anchors, of in longer_windows(whole, window, among, row) if longer and not every else ():
                    cuts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
                    docs = own[of[cuts[:-1]]]
                    yield _batch(_parts(docs, buckets), docs, cuts, found, length=np.full(len(docs), length, np.int32), anchors=anchors)
                if sent.n >= GATHERED:
                    yield from sent.rows(False)
        yield from sent.rows(False)

    joined = texts.join(seeds, texts["doc_id"] == seeds["doc"], "left").select("doc_id", "text", "codes")
    return joined.mapInArrow(send, ROW_TYPE)


def _placed(buckets: int, row: np.ndarray, docs: np.ndarray, codes: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """One row per text of its windows of a length, with their places; ``row`` has each window's text, ``docs`` each text's document."""
    cuts = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
    of = docs[row[cuts[:-1]]]
    return _batch(_parts(of, buckets), of, cuts, codes, least=at, length=np.full(len(of), length, np.int32))


def doubled(row: np.ndarray, at: np.ndarray, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From windows of a length by text and place, in order, all of twice the length whose two halves are there."""
    if not len(row):
        return row, at, codes
    key = row * (int(at.max()) + length + 1) + at
    second = np.searchsorted(key, key + length)
    second[second == len(key)] = 0
    first = np.flatnonzero(key[second] == key + length)
    return row[first], at[first], pair_codes(codes[first], codes[second[first]])


def doubled_windows(windows: DataFrame, below: DataFrame, length: int) -> DataFrame:
    """Rows of all windows of ``length`` with their places, from those of half of it of which ``below`` has the repeated codes."""
    buckets = _buckets(windows.sparkSession)

    def double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (codes, row), (repeated, repeated_rows) = _flat(batch.column(1)), _flat(batch.column(3))
            live = among_own(codes, row, repeated, repeated_rows)
            at = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row, at, codes = doubled(row[live], at[live], codes[live], length // 2)
            if len(row):
                yield _placed(buckets, row, batch.column(0).to_numpy(), codes, at, length)

    joined = windows.where(F.col("length") == length // 2).join(below, "doc").select("doc", "h", "least", "codes")
    return joined.mapInArrow(double, ROW_TYPE)


def repeated_longer(windows: DataFrame, below: DataFrame | None, length: int) -> DataFrame:
    """One of the longer levels: per document, the codes of its windows of ``length`` that another document has.

    ``windows`` has doc, length, h and anchors; ``below`` the repeated codes of half the length,
    which the anchors are looked up in.  Without ``below`` all windows are looked up.
    """
    buckets = _buckets(windows.sparkSession)
    if below is None:
        def send_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = _Sent(buckets)
            for batch in batches:
                own, row = _flat(batch.column(1))
                sent.add(batch.column(0).to_numpy()[row], own)
                if sent.n >= GATHERED:
                    yield from sent.rows(True)
            yield from sent.rows(True)

        whole = windows.where(F.col("length") == length).select("doc", "h").mapInArrow(send_all, ROW_TYPE)
        return _gathered(_met(_dealt(whole), _answer_shared)).select("doc", "codes")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent(buckets)
        for batch in batches:
            (own, row), (anchors, _), (repeated, repeated_rows) = (_flat(batch.column(c)) for c in (1, 2, 3))
            live = among_own(anchors, row, repeated, repeated_rows)
            sent.add(batch.column(0).to_numpy()[row[live]], own[live])
            if sent.n >= GATHERED:
                yield from sent.rows(True)
        yield from sent.rows(True)

    joined = windows.where(F.col("length") == length).join(below, "doc").select("doc", "h", "anchors", "codes")
    return _gathered(_met(joined.mapInArrow(send, ROW_TYPE).repartition("part"), _answer_shared)).select("doc", "codes")


def longest_levels(windows: DataFrame, answers: DataFrame, window: int) -> DataFrame:
    """Columns doc and longest: levels of twice, four times, ... the window, each over the survivors of the one before, until none is left.

    ``windows`` are the rows of the longer levels in a written table, ``answers`` the gathered ones of the
    window itself.  What is repeated at a level is written, so a lost executor costs one level.
    """
    below = written(answers.select("doc", F.concat("codes", "firsts").alias("codes")).where(F.size("codes") > 0), "repeated-windows")
    reached, length = below.select("doc", F.lit(window).alias("length")), window
    while not below.isEmpty():
        length *= 2
        below = written(repeated_longer(windows, below, length), "repeated-windows")
        reached = reached.unionByName(below.select("doc", F.lit(length).alias("length")))
    return reached.groupBy("doc").agg(F.max("length").cast("long").alias("longest"))


def every_level(windows: DataFrame, folder: str, answers: DataFrame, window: int) -> DataFrame:
    """As ``longest_levels``, every window of a level looked up whose two halves are repeated at the one before.

    ``windows`` are the placed rows of the window itself, in ``folder``.  A level's tables go as
    soon as the next one's are written; which documents reached it stays.
    """
    spark = answers.sparkSession

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        folder = new_folder(spark, name)
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder), folder

    below, old = answers.select("doc", F.concat("codes", "firsts").alias("codes")).where(F.size("codes") > 0), None
    reached, length = [written(below.select("doc", F.lit(window).alias("length")), "reached")], window
    while not reached[-1].isEmpty():
        length *= 2
        windows, new = kept(doubled_windows(windows, below, length), "windows")
        removed(spark, folder)
        if old:
            removed(spark, old)
        folder = new
        below, old = kept(repeated_longer(windows, None, length), "repeated-windows")
        reached.append(written(below.select("doc", F.lit(length).alias("length")), "reached"))
    removed(spark, folder)
    if old:
        removed(spark, old)
    return reduce(DataFrame.unionByName, reached).groupBy("doc").agg(F.max("length").cast("long").alias("longest"))


def covered(repeated: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a repeated window, from the windows' first words."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, repeated, 1)
    np.add.at(edges, np.minimum(repeated + window, n_words), -1)
    return np.cumsum(edges[:-1]) > 0


def kept_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, gone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Per text, its words but those that are gone, joined by one blank, and the number of those; ``firsts`` has each text's first word."""
    stays = np.flatnonzero(~gone)
    starts, ends, firsts_kept = starts[stays], ends[stays], np.searchsorted(stays, firsts)
    # A blank comes from the byte after a word, but for a text's last.
    reach = ends + 1
    lasts = firsts_kept[1:][np.diff(firsts_kept) > 0] - 1
    reach[lasts] -= 1
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[reach] -= 1
    joined = blanked(data)[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
    offsets = np.append(0, np.cumsum(reach - starts))[firsts_kept].astype(np.int32)
    texts = pa.StringArray.from_buffers(len(firsts) - 1, pa.py_buffer(offsets), pa.py_buffer(joined))
    return texts, np.diff(firsts) - np.diff(firsts_kept)


def dedup_substrings(docs: DataFrame, *, window: int = 13, doc_id: str = "doc_id", text: str = "text", longest: bool = False,
                     every: bool = False) -> DataFrame:
    """Columns doc_id, kept_text, n_words, n_removed and spans (start and end word of each removed passage).

    A word goes if it lies in a window of ``window`` words that also starts in a
    document with a smaller id; windows are judged on the input.  Kept words are
    unchanged and joined by one blank.
    Rows with a NULL id lose and take nothing; rows that share an id are one document.
    NULL and empty texts have no words.  Texts are shuffled once, by id, for all uses.
    Other columns are not read.

    With ``longest`` the levels go on, by 2, 4, ... times the window, until no window survives, and
    a column of this name has the length of the last level at which the document shares a
    window with another one, NULL without any.  It costs one more exchange of the texts and a table
    of the windows.  With ``every`` all windows that survive are looked up, and the column is exact;
    without it the longer levels are thinned, so that a passage is surely seen at a level
    only from one and a half times its length on.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    if every and not longest:
        raise ValueError("every window is looked up at the longer levels only")
    # One and the same exchange serves both joins below.
    texts = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    sent = extended_windows(texts, repeated_seeds(texts, window), window, longer=longest, every=every)
    if not longest:
        told = _gathered(_met(_dealt(sent), _answer_only_later)).select("doc", "codes")
    else:
        spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "windows")
        with shuffles_removed(spark):
            sent.write.parquet(folder)
            sent = spark.read.schema(sent.schema).parquet(folder)
            answers = written(_gathered(_met(_dealt(sent.where("length IS NULL")), _answer_later)), "answers")
            windows = sent.where("length IS NOT NULL")
            levels = every_level(windows, folder, answers, window) if every else longest_levels(windows, answers, window)
        told = answers.select("doc", "codes").join(levels, "doc", "left")
        # All that is read of the windows from here on is in tables of its own.
        removed(spark, folder)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_chunks(batch.column(1)):
                starts, ends, firsts = words_within(data, offsets)
                gone = np.zeros(len(starts), bool)
                some, some_rows = _flat(batch.column(2).slice(start, end - start))
                if len(some):
                    row = np.repeat(np.arange(end - start), np.diff(firsts))
                    repeated = _inside(row, window, np.ones(end - start, bool))
                    own = whole_windows(window_codes(word_codes(data, starts, ends), short_length(window)), window)
                    repeated[repeated] = among_own(own[repeated], row[:len(own)][repeated], some, some_rows)
                    gone = covered(np.flatnonzero(repeated), len(starts), window)
                kept, removed = kept_texts(data, starts, ends, firsts, gone)
                a, b, of = runs_within(gone, firsts)
                shift = np.repeat(firsts[:-1], np.diff(of))
                spans = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(a - shift), pa.array(b - shift)], ["start", "end"]))
                rest = [c.slice(start, end - start) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([rest[0], kept, pa.array(np.diff(firsts)), pa.array(removed), spans, *rest[3:]],
                                                 names=["doc_id", "kept_text", "n_words", "n_removed", "spans", *(["longest"] if longest else [])])

    extra = ["longest"] if longest else []
    joined = texts.join(told, texts["doc_id"] == told["doc"], "left").select("doc_id", "text", "codes", *extra)
    return joined.mapInArrow(cut, "doc_id bigint, kept_text string, n_words bigint, n_removed bigint, "
                                  "spans array<struct<start:bigint,end:bigint>>" + ", longest bigint" * longest)
