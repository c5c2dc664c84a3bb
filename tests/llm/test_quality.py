import re

import numpy as np
import pytest

from veilframe.llm import quality_net as Q, quality_rules as R
from veilframe.llm.labels import labelled_sample
from veilframe.llm.queries import held_out
from pyspark.sql import functions as F

from .conftest import WORD

TEXTS = ["", None, "one", "a b", "a b c a b c a b", "x\ny\nx\n \nx", "# $ * % & | < >", "É\x1cB \x0b c\x0bd", "w " * 500, "a b c d " * 40 + "end\n" * 3]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain_statistics(text):
    text = text or ""
    words, lines, seen, covered = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)], {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            covered.update(i + k for i in starts for k in range(3))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, frame, sf):
    docs = frame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string").select("doc_id", "text", "n_words")
    got = {r.doc_id: tuple(r[c] for c in BASE) for r in R.text_statistics(docs).collect()}
    assert got == {i: plain_statistics(t) for i, t in enumerate(TEXTS)}
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in BASE) for r in R.text_statistics(table).collect()}
    assert got == {r.doc_id: plain_statistics(r.text) for r in table.collect()}
    assert R.text_statistics(docs.limit(0)).count() == 0


def test_rules_are_found_and_ordered(frame):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        v = {f: float(rng.random()) for f in R.FEATURES}
        bad = v["symbol_ratio"] > 0.8 or (v["upper_ratio"] > 0.6 and v["word_length"] <= 0.3)
        rows.append((*v.values(), 0 if bad else 1))
    learned = R.learn_rules(frame(rows, ", ".join(f"{f} double" for f in R.FEATURES) + ", label int"), least_precision=0.85)
    assert any(rule[0].feature == "symbol_ratio" and rule[0].above for rule in learned.rules)
    data = frame(rows, ", ".join(f"{f} double" for f in R.FEATURES) + ", label int")
    wrong = data.withColumn("kept", learned.expression()).where((F.col("label") == 1) != F.col("kept")).count()
    assert wrong < 60 and "reject if" in str(learned) and str(learned).endswith("keep")


def test_nothing_to_learn(frame):
    schema = ", ".join(f"{f} double" for f in R.FEATURES) + ", label int"
    for rows in ([], [(0.5,) * 8 + (1,)] * 5, [(0.5,) * 8 + (None,)]):
        learned = R.learn_rules(frame(rows, schema))
        assert learned.rules == () and frame([(1,)], "x int").select(learned.expression().alias("k")).first().k


def test_rules_run_without_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = R.text_statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_chunks_cover_every_byte():
    for n in (1, 5, 511, 512, 513, 960, 961, 5000, 70_000):
        data = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        rows = np.concatenate(list(Q.chunks(data)))
        seen = np.full(n, -1)
        for i, row in enumerate(rows):
            for k in range(Q.CHUNK):
                if i * Q.STRIDE + k < n:
                    seen[i * Q.STRIDE + k] = row[k] // Q.N_LAGS
        assert bytes(seen.astype(np.uint8)) == data and (seen >= 0).all()
    assert list(Q.chunks(b"")) == []


def test_lags():
    step = Q.lag_steps(np.frombuffer(b"abcdabcdabcd" + bytes(range(100, 200)), np.uint8))
    assert step[:7].tolist() == [0] * 7 and step[7:12].tolist() == [1] * 5 and not step[20:].any()


def test_fast_responses_are_pooled_responses():
    net = Q.Network.new()
    for text in (b"ab", b"hello world " * 60, b"x" * 3000):
        for codes in Q.chunks(text):
            want = np.maximum(net.pooled(codes, net.tables())[0], 0)
            assert np.allclose(np.maximum(net.fast(codes, net.tables()), 0), want, atol=1e-5)


def plain_score(net, text):
    """Every filter at every place of every chunk, by its definition."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    lags = [Q.lag_steps(data[max(0, at - 260):])[min(at, 260):] for at in [0]][0] if len(data) else []
    pooled = []
    for start in range(0, max(1, len(data) - (Q.CHUNK - Q.STRIDE)), Q.STRIDE) if len(data) else []:
        part, own = data[start:start + Q.CHUNK].astype(int), lags[start:start + Q.CHUNK]
        responses = [sum(net.byte[j, part[i + j]] + net.lag[j, own[i + j]] for j in range(Q.WIDTH)) for i in range(len(part) - Q.WIDTH + 1)]
        best = np.max(responses, axis=0) + net.bias if responses else np.full(Q.FILTERS, -1.0)
        pooled.append(np.maximum(best, 0))
    mean, peak = (np.mean(pooled, axis=0), np.max(pooled, axis=0)) if pooled else (np.zeros(Q.FILTERS), np.zeros(Q.FILTERS))
    return 1 / (1 + np.exp(-(mean @ net.mean + peak @ net.peak + net.level[0])))


def test_scores_as_a_plain_convolution():
    net, rng = Q.Network.new(3), np.random.default_rng(4)
    texts = ["", None, "abc", "a" * 511, "hello world " * 90, "".join(rng.choice(list("abcde fg\n"), 3000))]
    for text in texts:
        assert net.score(text, net.tables()) == pytest.approx(plain_score(net, text), abs=1e-4), (text or "")[:20]


def test_training_texts_are_whole_and_bounded(frame, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fit", lambda documents, **_: seen.append(documents) or Q.Network.new())
    rng = np.random.default_rng(2)
    rows = [("".join(rng.choice(list("abcdef "), n)), i % 2) for i, n in enumerate([100, 5000, 40_000, 900, 20_000, 1, 3000])] + [("", 1), (None, 0), ("x", None)]
    docs = frame(rows, "text string, label int")
    Q.learn_network(docs)
    assert sorted(len(c) for c, _ in seen[0]) == sorted(sum(len(x) for x in Q.chunks(t.encode())) for t, y in rows[:7])
    Q.learn_network(docs, most_chunks=30)
    assert 3 <= len(seen[1]) < 7 and sum(len(c) for c, _ in seen[1]) <= 30


def test_network_learns_and_travels(frame):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["red", "green", "blue", "house", "tree", "walk"], 60)) for _ in range(40)]
    bad = [" ".join([w] * 60) for w in rng.choice(["red", "green", "blue", "house", "tree", "walk"], 40)]
    rows = [(t, 1) for t in good] + [(t, 0) for t in bad] + [(None, 1), ("", 0), ("x", None)]
    net = Q.learn_network(frame(rows, "text string, label int"), rounds=8)
    tables = net.tables()
    assert np.mean([net.score(t, tables) >= 0.5 for t in good] + [net.score(t, tables) < 0.5 for t in bad]) > 0.95
    same = Q.Network.from_json(net.to_json())
    assert same.score(good[0], same.tables()) == pytest.approx(net.score(good[0], tables))
    assert 0 <= net.score("", tables) == net.score(None, tables) <= 1
    docs = frame([(1, good[0], 1), (2, None, 1), (3, "", None)], "doc_id long, text string, score int")
    assert {r.doc_id: r.score for r in Q.score_quality(docs, net).collect()}[1] == pytest.approx(net.score(good[0], tables))
    assert Q.score_quality(docs.limit(0), net).count() == 0


def test_one_class_or_none(frame):
    for rows in ([], [("a", 1)], [("a", 0)]):
        net = Q.learn_network(frame(rows, "text string, label int"))
        assert 0 <= net.score("anything", net.tables()) <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    sample = labelled_sample(docs, labels, "quality", learn=~held_out("doc_id", 4, 2), max_rows=800)
    net = Q.learn_network(sample, rounds=8)
    scored = Q.score_quality(docs.join(labels.where(held_out("doc_id", 4, 2)), "doc_id"), net)
    right = scored.agg(F.avg(((F.col("score") >= 0.7) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95
