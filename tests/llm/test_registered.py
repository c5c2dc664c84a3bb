"""The registered queries: against their SQL where there is one, the contract's columns, and the pipeline."""

import re

import pytest
from check_queries import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from veilframe.llm import decontaminate, secret_scan
from veilframe.llm.queries import ORACLES, QUERIES
from veilframe.sources.scratch import written

COLUMNS = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                         "base_failed boolean, kept boolean",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op12_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op10_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"}


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, sf, name):
    ok, note = compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, sf, name):
    out = QUERIES[name](spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == COLUMNS[name]
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_base_digest(spark, sf):
    import hashlib
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op2_secret_scans"](spark, sf).collect():
        spans = secret_scan.find_spans(texts[r.doc_id])
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
        base = ",".join(f"{k}:{s}:{e}" for s, k, e in spans if k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert len(kept[name]) == docs.count()
    toxic, near, clean, masked = kept.values()
    assert not [i for i, y in labels.items() if y == 0 and i not in toxic]
    assert len(set(near.values())) == len(near) and set(near) <= set(toxic)
    assert decontaminate.leaks(docs, items).count() == 0 and set(clean) <= set(near)
    assert set(masked) == set(clean) and not any(secret_scan.find_spans(t) for t in masked.values())
    assert all(masked[i] == clean[i] for i in clean if not secret_scan.find_spans(clean[i]))
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in mix.collect()} == set(masked)


def test_near_copies_of_odd_rows(spark, frame):
    rows = [(1, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (2, "a b c d e f g", "de"), (None, "a b c d e f g", None), (3, None, None), (4, "", None)]
    docs = frame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted((r.doc_id or 0) for r in out.select(F.col("doc_id")).collect()) == [0, 1, 3]
