"""Other columns pass through whatever they are called: names of results, in other case, with dots, with leading underscores."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilframe.llm import decontaminate, quality_net, quality_rules, secret_scan, toxicity

NAMES = ["row", "spans", "found", "c0", "score_", "_scanned", "_searched", "_scored", "_text", "_words", "a.b", "a`b", "é x", "masked", "_toxicity", "_leaks"]
ROWS = [(1, "password=abcdefghijkl you idiot"), (1, "password=abcdefghijkl you idiot"), (None, None), (3, "")]


def operators(frame):
    items = frame([(1, "nothing of this is in any text of the table")], "item_id long, text string")
    return {
        "op2": lambda d: secret_scan.scan_secrets(d, into="secrets"),
        "op3": lambda d: quality_net.score_quality(d, quality_net.Network.new(), into="secrets"),
        "op4": lambda d: quality_rules.text_statistics(d),
        "op5": lambda d: toxicity.score_toxicity(d, toxicity.Lexicon({" idiot ": 4.0}, (), 4.0, 0.5), into="secrets"),
        "op6": lambda d: decontaminate.find_items(d, items, into="secrets")}


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6"])
def test_other_columns_pass_through(frame, name):
    run = operators(frame)[name]
    columns = ["doc_id", "text", *NAMES]
    docs = frame([(*r, *(f"{n}{i}" for n in NAMES)) for i, r in enumerate(ROWS)],
                 ", ".join(["doc_id long", "text string", *(f"`{n.replace('`', '``')}` string" for n in NAMES)]))
    out = run(docs)
    assert out.columns[:len(columns)] == columns
    want = {tuple(r) for r in docs.collect()}
    assert {tuple(r)[:len(columns)] for r in out.collect()} == want and out.count() == 4
    if name == "op4":
        return
    other = frame([(*r, "old") for r in ROWS], "doc_id long, text string, SECRETS string")
    replaced = run(other)
    assert [c.lower() for c in replaced.columns] == ["doc_id", "text", "secrets"]
    assert "old" not in {r[2] for r in replaced.select("doc_id", "text", F.to_json(F.struct("secrets"))).collect()}


def test_pipeline_stages_keep_odd_columns(spark, frame, sf):
    docs = frame([(i, f"some words of text number {i} " * 20, "s", "en", 9, "t", "l", "s", "d") for i in range(5)],
                 "doc_id long, text string, source string, lang string, n_chars long, toxicity string, leaks string, SECRETS string, `a.b` string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert {tuple(r)[5:] for r in out.collect()} == {("t", "l", "s", "d")}, name
