"""Lattice scores against sums over all segmentations, and the base columns against plain counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import lattice_lm as L

from .conftest import WORD

TOY = L.Pieces((b" ", b"a", b"b", b" a", b"ab", b" ab", b"ba", b"aba", *(bytes([i]) for i in range(256) if i not in b" ab")),
               tuple([0.1, 0.2, 0.1, 0.05, 0.1, 0.05, 0.1, 0.05] + [0.15 / 253] * 253), 0.1)


def segmentations(text, pieces):
    """All ways to spell a text, as lists of piece numbers."""
    if not text:
        yield []
    for number, string in enumerate(pieces.strings):
        if text.startswith(string):
            for rest in segmentations(text[len(string):], pieces):
                yield [number, *rest]


def plain_log(word, pieces):
    return math.log(sum(math.prod(pieces.weights[i] for i in way) for way in segmentations(b" " + word, pieces)))


def some_words():
    rng = random.Random(2)
    return [b"".join(rng.choice([b"a", b"b", b"ab", b"\xc3\xa9", b"z"]) for _ in range(rng.randrange(1, 8))) for _ in range(60)]


def test_forward_sums_all_segmentations():
    words = some_words()
    assert np.allclose(L.log_probabilities(words, TOY), [plain_log(w, TOY) for w in words], rtol=1e-12)
    assert L.log_probabilities([], TOY).shape == (0,)


def test_expected_counts_weigh_all_segmentations():
    words = some_words()
    times = np.arange(1, len(words) + 1, dtype=float)
    want = np.zeros(len(TOY.strings))
    for word, k in zip(words, times):
        ways = [(math.prod(TOY.weights[i] for i in way), way) for way in segmentations(b" " + word, TOY)]
        whole = sum(p for p, _ in ways)
        for p, way in ways:
            for i in way:
                want[i] += k * p / whole
    assert np.allclose(L.expected_counts(words, times, TOY), want, rtol=1e-10)


def test_a_long_word():
    word = b"ab" * 100_000
    assert math.isclose(L.log_probabilities([word, b"a"], TOY)[1], plain_log(b"a", TOY)) and L.log_probabilities([word], TOY)[0] < -1e4


def test_vocabulary():
    pieces = L.vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    assert math.isclose(sum(pieces.weights) + pieces.end, 1) and min(pieces.weights) > 0
    assert {bytes([i]) for i in range(256)} <= set(pieces.strings) and len(set(pieces.strings)) == len(pieces.strings)
    assert not [s for s in pieces.strings if len(s) > 1 and (b" " in s[1:] or s != s.lower())]


def plain_scores(rows, vocab, rounds):
    """doc_id -> the columns, by the contract's words; rows (doc_id, text)."""
    texts = [(i, WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for (_, own), h in zip(texts, held) if not h for w in own)
    ends = held.count(False)
    n, v = counts.total() + ends, len(counts) + (ends > 0)
    pieces = vocab
    for _ in range(rounds if counts else 0):
        found = np.zeros(len(vocab.strings))
        for word, k in counts.items():
            found += L.expected_counts([word.encode()], np.array([float(k)]), pieces)
        whole = found.sum() + ends + L.PRIOR_PIECES
        pieces = L.Pieces(vocab.strings, tuple((found + L.PRIOR_PIECES * np.array(vocab.weights)) / whole), (ends + L.PRIOR_PIECES * vocab.end) / whole)
    out = []
    for (i, own), h in zip(texts, held):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((ends + 1) / (n + v + 1))
        score = (sum(L.log_probabilities([w.encode() for w in own], pieces)) + math.log(pieces.end)) / math.log(10)
        out.append((i, h, len(own) + 1, sum(counts[w] > 0 for w in own) + (ends > 0), n, base, score))
    return out


def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


@pytest.mark.parametrize("size", [1 << 24, 300])
def test_scores(frame, monkeypatch, size):
    monkeypatch.setattr(L, "CHUNK_BYTES", size)
    rng = random.Random(4)
    words = ["ab", "AB", "a", "ba", "é", "zz", "aba" * 30, "b▁a", "Ab", "\xa0"]
    rows = [(i, rng.choice([" ", "\n", "\t\x0b "]).join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    rows += [(None, "a b"), (3, "ab ab"), (3, "ab ab"), (70, None), (71, ""), (72, " \n"), (73, "new " * 2000)]
    docs = frame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, `a.b` string").repartition(3)
    got = sorted(map(tuple, L.score_texts(docs, TOY, held_out=held()).collect()), key=str)
    want = sorted(plain_scores(rows, TOY, 2), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-7)


def test_without_training_texts(frame):
    rows = [(i, "ab") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = L.score_texts(frame(rows, "doc_id long, text string"), TOY, held_out=held()).collect()
    assert {tuple(r)[1:6] for r in got} == {(True, 2, 0, 0, 0.0)}
    assert all(math.isclose(r.score, (plain_log(b"ab", TOY) + math.log(TOY.end)) / math.log(10)) for r in got)
    assert L.score_texts(frame([], "doc_id long, text string"), TOY, held_out=held()).count() == 0


def test_documents(spark, sf):
    from veilframe.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op11_lm_scoring"](spark, sf).collect()))
    want = sorted(plain_scores(rows, L.vocabulary("/opt/tokenizers/piece_bpe_32k.model"), 0))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    # Learned pieces beat the vocabulary's own scores on held-out texts.
    assert sum(g[6] for g in got if g[1]) > sum(w[6] for w in want if w[1])
