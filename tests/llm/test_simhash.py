import re

import numpy as np
import pytest
import xxhash

from veilframe.llm import simhash as S
from veilframe.llm.components import connected_components

from .conftest import WORD


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprint():
    for text in ("", None, " a  B c\nd é X", "one", "a b", "x y z " * 100, "ÀB Ç\x0bd e\x1cf g", "A\xa0b c d"):
        assert S.fingerprint(text) == plain_fingerprint(text), text


def numbers(n, seed=0):
    rng = np.random.default_rng(seed)
    some = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) << np.uint64(1)
    out = [some]
    for _ in range(3):
        flips = np.uint64(1) << rng.integers(0, 64, (2, len(some) // 2)).astype(np.uint64)
        out.append(some[:len(some) // 2] ^ flips[0] ^ flips[1])
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize(("n", "budget"), [(0, 2), (1, 2), (200, 0), (200, 2), (1000, 3)])
def test_trie_pairs(n, budget):
    x = numbers(n)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= budget
    i, j = S.trie_pairs(x, None, budget, most_nodes=300)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(v.tolist() for v in np.nonzero(np.triu(near, 1)))))
    a, b = x[::2], x[1::2]
    i, j = S.trie_pairs(a, b, budget)
    want = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= budget) if len(b) else ((), ())
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(list(map(int, v)) for v in want)))


@pytest.mark.parametrize("leaf", [4096, 8])
def test_near_pairs_with_few_and_many_descents(spark, leaf):
    x = np.unique(np.concatenate([numbers(60), np.arange(70, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(5, dtype=np.uint64)]))
    rows = [(int(v), i) for i, v in enumerate(x.view(np.int64))]
    found = S.near_pairs(spark.createDataFrame(rows, "fp long, node long"), leaf_rows=leaf)
    near = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1))
    got = sorted(tuple(sorted((r.a, r.b))) for r in found.collect())
    assert got == sorted(zip(*(v.tolist() for v in near)))


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(7, 7), (2000, None)]
    out = connected_components(spark.createDataFrame(links, "a long, b long"))
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert {r.node: r.component for r in out.collect()} == groups(real, {n for link in real for n in link})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    long = " ".join(f"word{i}" for i in range(3000))
    rows += [(-3, long + " end"), (5000, long), (5001, long.upper()), (5002, None), (5003, " \n"), (5004, "a b"), (5005, "A b"), (None, long)]
    out = S.near_duplicates(frame([(*r, "x") for r in rows], "doc_id long, text string, fp string")).collect()
    prints = np.array([plain_fingerprint(t) for d, t in rows if d is not None], np.uint64)
    ids = [d for d, _ in rows if d is not None]
    near = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2, 1))
    want = groups([(ids[a], ids[b]) for a, b in zip(*near)], ids)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    assert want[5001] == -3 and want[5003] == 5002 and want[5005] == 5004
    assert [r.component_id for r in out if r.doc_id is None] == [None]


def test_rows_of_one_id_are_one_node(frame):
    rows = [(1, "a b c d"), (2, "x y z w"), (9, "a b c d"), (9, "x y z w")]
    out = S.near_duplicates(frame(rows, "doc_id long, text string"))
    assert {r.component_id for r in out.collect()} == {1}
