import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.llm import substrings as S, words as W

from .conftest import WORD

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_text")


def brute(rows, window):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(60)) for _ in range(5)]
    rows = []
    for d in range(60):
        words = rng.choice(base).split()
        cut = rng.randrange(len(words))
        words = words[cut:] + words[:rng.randrange(30)]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"new{d}"
        rows.append((rng.choice([d, d, None]), rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, "a"), (3, base[0]), (3, base[0]), (3, "other text " * 9), (2000, "q " * 500),
             (2001, "q " * 300 + " z"), (2002, "é\x1cà \x0b " + base[1]), (-5, base[1])]
    return rows


@pytest.mark.parametrize("window", [2, 5, 13])
def test_as_plain_search(frame, rows_of, window):
    rows = passages(window)
    out = S.dedup_substrings(frame(rows, "doc_id long, text string"), window=window)
    assert rows_of(out, *COLUMNS) == brute(rows, window)
    assert any(r[2] for r in brute(rows, window))


def test_whole_table(spark, rows_of, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(S.dedup_substrings(docs), *COLUMNS) == brute(rows, 13)


def test_many_small_sendings(frame, rows_of, monkeypatch):
    rows = passages(1)
    sent = S._Sent(8)
    for d, t in rows:
        if d is not None:
            sent.add(d, S.text_codes(t))
    assert sum(b.num_rows for b in sent.rows(True)) > 0 and sent.n == 0


def test_no_rows_and_clashing_columns(frame, rows_of):
    assert S.dedup_substrings(frame([], "doc_id long, text string")).count() == 0
    extra = frame([(1, "a b c", "x", "y", 5)], "doc_id long, text string, codes string, doc string, n_words int")
    assert rows_of(S.dedup_substrings(extra, window=2), *COLUMNS) == [(1, 3, 0, "a b c")]


def test_spans_are_the_removed_words(frame):
    rows = [(1, "a b c d e f"), (2, "x a b c y d e f")]
    spans = S.dedup_substrings(frame(rows, "doc_id long, text string"), window=3).where("doc_id = 2").first().spans
    assert [(s.start, s.end) for s in spans] == [(1, 4), (5, 8)]


def test_least_inner():
    codes = np.random.default_rng(0).integers(0, 9, 50, dtype=np.uint64)
    for width in (1, 2, 3, 7, 50, 51):
        want = [i + int(codes[i:i + width].argmin()) for i in range(len(codes) - width + 1)]
        assert S.least_inner(codes, width).tolist() == want


def test_texts_are_shuffled_once(spark, tmp_path, frame):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = S.dedup_substrings(frame(passages(2), "doc_id long, text string"))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shared_lengths(rows, window):
    """For every document, the words of the longest passage that another document has as well."""
    words = {}
    for d, t in rows:
        words.setdefault(d, []).append(WORD.findall(t or ""))
    best = dict.fromkeys(words, 0)
    places = {}
    for d, texts in words.items():
        for k, own in enumerate(texts):
            for i in range(len(own) - window + 1):
                places.setdefault(tuple(own[i:i + window]), []).append((d, k, i))
    for spots in places.values():
        for d, k, i in spots:
            for e, m, j in spots:
                if d != e:
                    n = window
                    while i + n < len(words[d][k]) and j + n < len(words[e][m]) and words[d][k][i + n] == words[e][m][j + n]:
                        n += 1
                    best[d] = max(best[d], n)
    return best


def test_levels_go_on_until_no_window_survives(spark, frame, rows_of, monkeypatch):
    rng = random.Random(5)

    def fresh(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passages_ = {n: fresh(n) for n in (13, 20, 40, 80, 200, 500, 1700)}
    rows = []
    for n, own in passages_.items():
        for copy in range(3):
            rows.append((len(rows), " ".join(fresh(rng.randrange(30)) + own + fresh(rng.randrange(30)))))
    rows += [(1000, " ".join(fresh(3000))), (1001, None), (-7, " ".join(passages_[200][:100] + fresh(5)))]
    docs = frame(rows, "doc_id long, text string").repartition(5)
    out = S.dedup_substrings(docs, longest=True)
    longest = {r.doc_id: r.longest for r in out.collect()}
    assert rows_of(out, *COLUMNS) == brute(rows, 13) == rows_of(S.dedup_substrings(docs), *COLUMNS)
    real = shared_lengths(rows, 13)
    for d, n in real.items():
        if n < 13:
            assert longest[d] is None
            continue
        assert longest[d] <= n < 3 * longest[d]  # at 1.5 times a level's length, that level is surely reached
    assert [longest[3 * i] for i in range(7)] [:1] == [13] and {longest[3 * i] for i in (4,)} == {104}
    # A repeat of 200 words passes 13, 26, 52 and 104, and the level after finds none.
    seen, level = [], S.repeated_longer

    def spied(windows, below, length):
        seen.append((length, below.count()))
        return level(windows, below, length)
    monkeypatch.setattr(S, "repeated_longer", spied)
    S.dedup_substrings(docs.where("doc_id BETWEEN 12 AND 14"), longest=True).collect()
    assert seen == [(26, 3), (52, 3), (104, 3), (208, 3)]


def test_longer_windows_are_pairs_of_shorter_ones():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 300, dtype=np.uint64)
    among = np.ones(300, bool)
    among[100] = False
    for length, own, anchors in S.longer_windows(codes, 5, among):
        assert len(own) == len(anchors) and length in (10, 20, 40, 80, 160)
        same = {n: (set(o.tolist()), set(a.tolist())) for n, o, a in S.longer_windows(codes[7:], 5, among[7:])}
        if length in same:  # the same windows are chosen wherever a passage begins, but for its ends
            assert len(set(own.tolist()) & same[length][0]) >= 0.6 * len(same[length][0])


def test_large_and_negative_ids(frame, rows_of):
    ids = [-(2**62), -5, 0, 2**31 - 1, 2**31, 2**40 + 3, 2**62]
    rows = [(i, " ".join(f"w{k}" for k in range(20)) + f" x{n}") for n, i in enumerate(ids)]
    assert rows_of(S.dedup_substrings(frame(rows, "doc_id long, text string")), *COLUMNS) == brute(rows, 13)


def test_the_query_goes_through_all_levels(spark, tmp_path, monkeypatch):
    from veilframe.llm.queries import op1_substring_dedup

    long = " ".join(f"w{i}" for i in range(120))
    spark.createDataFrame([(1, long), (2, "x " + long), (3, "y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lengths, level = [], S.repeated_longer
    monkeypatch.setattr(S, "repeated_longer", lambda windows, below, length: lengths.append(length) or level(windows, below, length))
    out = {r.doc_id: (r.n_words, r.n_removed) for r in op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert lengths[:3] == [26, 52, 104] and out == {1: (120, 0), 2: (121, 120), 3: (1, 0)}


def short_texts(seed, n):
    rng = random.Random(seed)
    texts = [rng.choice(["", " ", "a"]).join(rng.choice(["ab", "é", "c\x1cd", " ", "\n\t", "  "]) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [None if rng.random() < 0.1 else t for t in texts]


def test_steps_are_per_chunk_not_per_document(monkeypatch):
    class Texts:
        sparkSession = None

        def mapInArrow(self, fn, _):
            return fn

    for name in ("_dealt", "_gathered"):
        monkeypatch.setattr(S, name, lambda x: x)

    class Sent:
        def __init__(self, fn):
            self.fn = fn

        def select(self, *_):
            return self.fn
    monkeypatch.setattr(S, "_met", lambda fn, _: Sent(fn))
    monkeypatch.setattr(S, "_buckets", lambda _: 64)
    calls, codes = [], S.word_codes
    monkeypatch.setattr(S, "word_codes", lambda *a: calls.append(1) or codes(*a))
    texts = [" ".join(f"w{d % 40}_{i}" for i in range(30)) for d in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = list(S.repeated_seeds(Texts(), 13)(iter([batch])))
    assert sum(b.num_rows for b in rows) and len(calls) <= 2 + sum(map(len, texts)) // W.CHUNK


@pytest.mark.parametrize("size", [1, 60, 1 << 19])
def test_words_of_chunks_are_those_of_texts(monkeypatch, size):
    monkeypatch.setattr(W, "CHUNK", size)
    texts = short_texts(size, 200)
    seen = 0
    for start, end, data, offsets in W.text_chunks(pa.array(["cut off", *texts, "x"]).slice(1, 200)):
        assert start == seen and (end == start + 1 or len(data) <= size)
        seen = end
        starts, ends, firsts = W.words_within(data, offsets)
        codes = W.word_codes(data, starts, ends)
        gone = np.random.default_rng(size).random(len(starts)) < 0.4
        kept, removed = S.kept_texts(data, starts, ends, firsts, gone)
        for i, text in enumerate(texts[start:end]):
            at = slice(firsts[i], firsts[i + 1])
            words = WORD.findall(text or "")
            assert [bytes(data[a:b]).decode() for a, b in zip(starts[at], ends[at])] == words
            assert codes[at].tolist() == S.text_codes(text).tolist()
            assert kept[i].as_py() == " ".join(w for w, g in zip(words, gone[at]) if not g) and removed[i] == gone[at].sum()
    assert seen == 200


def test_windows_of_equal_words_have_equal_codes():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 3_000).astype(np.uint64)
    for window in (2, 3, 5, 7, 8, 13):
        runs = [tuple(words[i:i + window].tolist()) for i in range(3_000 - window + 1)]
        codes, seeds = S.seeds_of(W.mixed(words + np.uint64(1)), window)
        whole = S.whole_windows(codes, window)
        check = W.window_checks(W.mixed(words + np.uint64(1)), window, np.arange(len(runs)))
        assert len(seeds) == len(whole) == len(runs)
        assert len(set(runs)) == len(set(whole.tolist())) == len(set(check.tolist())) == len(set(zip(runs, whole.tolist(), check.tolist())))
        inner = window - S.short_length(window) + 1
        assert seeds.tolist() == [int(codes[i:i + inner].min()) for i in range(len(runs))]


def test_codes_known_of_another_row_do_not_count():
    rng = np.random.default_rng(6)
    codes, rows = rng.integers(0, 30, 400).astype(np.uint64), np.sort(rng.integers(0, 20, 400))
    known, known_rows = rng.integers(0, 40, 60).astype(np.uint64), np.sort(rng.integers(0, 20, 60))
    pairs = set(zip(known_rows.tolist(), known.tolist()))
    assert S.among_own(codes, rows, known, known_rows).tolist() == [p in pairs for p in zip(rows.tolist(), codes.tolist())]
    assert not S.among_own(codes, rows, known[:0], known_rows[:0]).any()


def test_longer_windows_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(7)
    codes, docs, among = rng.integers(0, 2**63, 2_000, dtype=np.uint64), np.repeat(np.arange(8), 250), rng.random(2_000) < 0.99
    among[249::250] = False  # no window goes from one text to the next
    found = {(n, d, int(o), int(a)) for n, own, anchors, of in S.longer_windows(codes, 5, among, docs)
             for o, a, d in zip(own, anchors, of.tolist())}
    alone = {(n, d, int(o), int(a)) for d in range(8) for n, own, anchors in S.longer_windows(codes[docs == d], 5, among[docs == d])
             for o, a in zip(own, anchors)}
    assert found == alone and len({x[0] for x in found}) > 2


def test_a_code_is_sent_once_for_a_document():
    sent = S._Sent(8)
    sent.add(np.array([5, 5, 4, 5]), np.array([9, 9, 9, 7], np.uint64))
    sent.add(5, np.array([9], np.uint64))
    answered, entries = sent.rows(False)
    assert answered.column(2).to_pylist() == [[9]] and answered.column(1).to_pylist() == [5]
    assert sorted(sum(entries.column(2).to_pylist(), [])) == [7, 9]


def test_the_table_of_windows_goes_when_all_levels_are_written(spark, frame):
    from pathlib import Path

    from veilframe.sources.scratch import shared_folder

    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    long = " ".join(f"w{i}" for i in range(120))
    out = S.dedup_substrings(frame([(1, long), (2, long)], "doc_id long, text string"), longest=True)
    new = {p.name.split("-")[0] for p in set(shared.iterdir()) - before}
    assert "windows" not in new and "answers" in new
    assert {r.doc_id: (r.n_removed, r.longest) for r in out.collect()} == {1: (0, 52), 2: (120, 52)}


def test_every_window_of_the_longer_levels_is_looked_up(frame, rows_of):
    rng = random.Random(8)

    def fresh(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for n in (12, 13, 25, 26, 27, 38, 51, 52, 60, 77, 104, 120, 155, 207, 208, 300):
        own = fresh(n)
        for _ in range(2):
            rows.append((len(rows), " ".join(fresh(rng.randrange(40)) + own + fresh(rng.randrange(40)))))
    rows += [(7, rows[40 % len(rows)][1]), (1000, " ".join(fresh(900))), (None, rows[-1][1]), (1001, "q " * 130), (1002, "q " * 70), (1003, None)]
    docs = frame(rows, "doc_id long, text string").repartition(3)
    out = S.dedup_substrings(docs, longest=True, every=True)
    assert rows_of(out, *COLUMNS) == brute(rows, 13)

    def level(n):
        return max((13 << k for k in range(9) if 13 << k <= n), default=None)
    real = shared_lengths([r for r in rows if r[0] is not None], 13)
    assert {(r.doc_id, r.longest) for r in out.where("doc_id IS NOT NULL").collect()} == {(d, level(n)) for d, n in real.items()}


def test_doubled_windows_are_all_with_both_halves():
    rng = np.random.default_rng(11)
    row, at = np.repeat(np.arange(3), 60), np.tile(np.arange(60), 3)
    keep = rng.random(180) < 0.8
    row, at, codes = row[keep], at[keep], rng.integers(0, 2**63, int(keep.sum()), dtype=np.uint64)
    there = dict(zip(zip(row.tolist(), at.tolist()), codes))
    found = list(zip(*(x.tolist() for x in S.doubled(row, at, codes, 7))))
    assert [x[:2] for x in found] == [(r, i) for r, i in there if (r, i + 7) in there]
    assert all(c == int(W.pair_codes(np.array([there[r, i]]), np.array([there[r, i + 7]]))[0]) for r, i, c in found)
    assert [len(x) for x in S.doubled(row[:0], at[:0], codes[:0], 7)] == [0, 0, 0]


def test_the_query_looks_up_every_window(spark, tmp_path, monkeypatch):
    from veilframe.llm.queries import op1_substring_dedup

    shared = " ".join(f"w{i}" for i in range(30))  # over 26, under one and a half times as many
    rows = [(d, f"a{d} {shared} z{d}") for d in range(12)]
    rows += [(100 + 2 * i + j, f"x{i}{j} " + " ".join(f"p{i}_{k}" for k in range(26))) for i in range(12) for j in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    survived, level = {}, S.repeated_longer

    def noted(windows, below, length):
        out = level(windows, below, length)
        survived[length] = out.count()
        return out
    monkeypatch.setattr(S, "repeated_longer", noted)
    op1_substring_dedup(spark, str(tmp_path)).collect()
    assert survived == {26: 36, 52: 0}


@pytest.mark.parametrize("far", [1, 2**50])
def test_order_by_code_then_document(far):
    rng = np.random.default_rng(12)
    h, g = rng.integers(0, 40, 500).astype(np.uint64), rng.integers(0, 2, 500).astype(np.uint32)
    d = rng.integers(-9, 9, 500) * far
    for check in (g, np.zeros(500, np.uint32), (h % np.uint64(2)).astype(np.uint32)):
        order = S._by_code(h, check, d)
        assert sorted(order.tolist()) == list(range(500))
        assert (found := list(zip(h[order].tolist(), check[order].tolist(), d[order].tolist()))) == sorted(found)
    assert len(S._by_code(h[:0], g[:0], d[:0])) == 0 and S._by_code(h[:1], g[:1], d[:1]).tolist() == [0]


def test_answers_are_as_many_rows_as_they_fill(spark, frame):
    texts = frame([(d, " ".join(f"w{i}" for i in range(60))) for d in range(400)], "doc_id long, text string").repartition(2, "doc_id")
    sent = S.extended_windows(texts, S.repeated_seeds(texts, 13), 13, longer=False)
    rows = S._met(S._dealt(sent), S._answer_later).collect()
    told = [(d, r.first) for r in rows for d in r.docs]
    assert set(told) == {(0, True), *((d, False) for d in range(1, 400))} and len(told) == 400 * 48
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(rows) <= len(told) / S.IN_ROW + 2 * parts * parts < 0.01 * len(told)
    one = {r.doc: r for r in S._gathered(S._met(S._dealt(sent), S._answer_later)).collect()}
    assert len(one) == 400 and len(one[0].firsts) == 48 and not one[0].codes
    assert all(sorted(one[d].codes) == sorted(one[0].firsts) and not one[d].firsts for d in range(1, 400))
