"""The Merkle manifest against a plain tree over all rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veilframe.llm import merkle as M

SCHEMA = "doc_id long, lang string, text string, `key` string, `a.b` int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, rank):
    path = []
    for level in levels[:-1]:
        run = level[rank // 2 * 2:rank // 2 * 2 + 2]
        path.append(("".join(run[:rank % 2]), "".join(run[rank % 2 + 1:])))
        rank //= 2
    return path


def plain_proofs(rows):
    """doc_id, leaf, subroot, root and path per row; rows (doc_id, lang, text, ...)."""
    def leaf(row):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[2])))
    langs = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted(((r[0] is not None, r[0] or 0, leaf(r)), r[0]) for r in rows if r[1] == g) for g in langs}
    levels = {g: plain_levels([k[2] for k, _ in own]) for g, own in trees.items()}
    top = plain_levels([levels[g][-1][0] for g in langs])
    return [(doc, k[2], levels[g][-1][0], top[-1][0], plain_path(levels[g], i) + plain_path(top, j))
            for j, g in enumerate(langs) for i, (k, doc) in enumerate(trees[g])]


def cases():
    few = [(1, "en", "a"), (2, "en", None), (None, "en", "b"), (2, "en", "c"), (2, "en", "c"), (4, None, ""), (5, "", "é"), (6, "zz", "x" * 200_000), (7, "é", "y")]
    yield [(*r, "k", 1) for r in few]
    yield [(9, None, None, None, None)]
    yield [(i * 7 % 1000, "de" if i % 3 else "en", f"text {i}", "k", 1) for i in range(1000)]
    yield [(i, f"g{i}", "t", "k", 1) for i in range(40)]


@pytest.mark.parametrize("levels", [10, 2])
@pytest.mark.parametrize("rows", list(cases()))
def test_proofs(frame, monkeypatch, rows, levels):
    monkeypatch.setattr(M, "PAGE_LEVELS", levels)
    leaf = M.digest_of([F.col("doc_id"), F.col("text")])
    out = M.prove_rows(frame(rows, SCHEMA), leaf).withColumn("folded", M.fold_path(F.col("leaf"), F.col("path"))).withColumn(
        "proof", M.siblings_digest(F.col("path"))).collect()
    got = sorted(((r.row.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in out), key=str)
    assert got == sorted(plain_proofs(rows), key=str)
    assert all(r.folded == r.root for r in out)
    assert all(r.proof == h(*(x for p in r.path for x in p)) for r in out)


def test_tampered_rows_do_not_verify(frame):
    rows = [(i, "en", f"text {i}", "k", 1) for i in range(100)]
    leaf = M.digest_of([F.col("doc_id"), F.col("text")])
    out = M.prove_rows(frame(rows, SCHEMA).withColumn("other", M.digest_of([F.col("doc_id"), F.concat("text", F.lit("!"))])), leaf)
    assert not [r for r in out.select((M.fold_path(F.col("row.other"), F.col("path")) == F.col("root")).alias("ok")).collect() if r.ok]


def test_damaged_records_raise():
    top, records = M.folded([bytes([i]) * 32 for i in range(5)], 3)
    known = dict(records)
    for rank in range(5):
        assert M.descended(top, known, rank, 3)[0] == bytes([rank]) * 32
    with pytest.raises(KeyError):
        M.descended(b"x" * 32, known, 0, 3)


def test_empty_table(frame):
    assert M.prove_rows(frame([], SCHEMA), M.digest_of([F.col("doc_id")])).count() == 0
