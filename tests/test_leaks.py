"""Ways in which sensitive text could get out."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe import (apply_policy, evaluate_workspace, gitleaks_detector, load_policy, privacy_filter_detector, register_detector,
                       staged_items)
from veilframe.functions.match import found, required_literals
from veilframe.operators.detectors import in_stage_order
from veilframe.operators.rollups import top_findings
from veilframe.operators.rules import text_for_detectors
from veilframe.policy import policy_fingerprint

SCHEMA = "root string, path string, text string, privacy string, leaks string"


def policy(**privacy):
    return load_policy({"version": 1, "detectors": {"secrets": {"enabled": False}, "gitleaks": {"enabled": True, "action": "redact"},
                                                    "privacy_filter": {"enabled": True, "action": "redact", **privacy}},
                        "rules": [{"id": "mail", "match": {"content_regex": ["[a-z]+@[a-z.]+"]},
                                   "action": {"type": "redact", "replacement": "<m>"}}]})


def run(spark, rows, p, **seen):
    detectors = [privacy_filter_detector(p, "privacy", **seen), gitleaks_detector(p, "leaks", **seen)]
    out = apply_policy(spark.createDataFrame([("/w", *r) for r in rows], SCHEMA), p, detectors=detectors)
    return {r.path: (r.disposition, r.sanitized_text, r.detector_status) for r in out.collect()}


def test_redacted_text_does_not_come_back(spark):
    rows = [("stale", "joe@corp.com met John", '{"redacted_text":"joe@corp.com met <p>"}', None),
            ("span", "joe@corp.com met John", '{"detected_spans":[{"start":17,"end":21}]}', None),
            ("fresh", "he met John", '{"redacted_text":"he met <p>"}', "[]"),
            ("broken", "clean", "{oops", "no json"), ("missing", "clean", None, None)]
    out = run(spark, rows, policy())
    assert out["stale"] == ("WRITE_SANITIZED_TEXT", "<m> met John", {"privacy-filter": "stale", "gitleaks": "missing"})
    assert out["span"][1] == "<m> met <redacted>" and out["span"][2]["privacy-filter"] == "stale"
    assert out["fresh"] == ("WRITE_SANITIZED_TEXT", "he met <p>", {"privacy-filter": "ok", "gitleaks": "nothing"})
    assert out["broken"] == ("COPY_ORIGINAL", None, {"privacy-filter": "unparsable", "gitleaks": "unparsable"})
    assert out["missing"] == ("COPY_ORIGINAL", None, {"privacy-filter": "missing", "gitleaks": "missing"})


def test_detectors_can_be_run_on_the_text_of_their_stage(spark):
    p = policy()
    files = spark.createDataFrame([("/w", "a", "joe@corp.com met John"), ("/w", "b", None)], "root string, path string, text string")
    seen = text_for_detectors(files, p)
    assert {r.path: r.detector_text for r in seen.collect()} == {"a": "<m> met John", "b": None}
    json = F.when(F.col("path") == "a", '{"redacted_text":"<m> met <p>"}')
    out = apply_policy(seen.withColumn("privacy", json), p, detectors=[privacy_filter_detector(p, "privacy", "detector_text")])
    row = out.filter("path = 'a'").first()
    assert (row.sanitized_text, row.detector_status) == ("<m> met <p>", {"privacy-filter": "ok"})


def test_stage_order_and_fingerprint():
    p = policy()
    privacy, leaks = privacy_filter_detector(p, "x"), gitleaks_detector(p, "y")
    assert [d.id for d in in_stage_order([privacy, leaks])] == ["gitleaks", "privacy-filter"]
    prints = {policy_fingerprint(p), policy_fingerprint(p, [privacy]), policy_fingerprint(p, [privacy_filter_detector(p, "x", version="2")])}
    assert len(prints) == 3


def test_staged_copy_has_no_original_bytes_beside_a_text(spark):
    rows = [("/w", "a", "joe@corp.com", b"joe@corp.com"), ("/w", "b", None, b"\xff"), ("/w", "c", "plain", b"plain")]
    files = spark.createDataFrame(rows, "root string, path string, text string, content binary")
    staged = {r.path: (r.text, r.content and bytes(r.content)) for r in staged_items(apply_policy(files, policy())).collect()}
    assert staged == {"a": ("<m>", None), "b": (None, b"\xff"), "c": ("plain", None)}


@pytest.mark.parametrize("pattern", [r"\011secret", r"\cAsecret", r"\x09secret", r"\tsecret", r"\N{TAB}secret", r"(\c()secret", r"\ea"])
def test_unusual_escapes_give_no_literal(pattern):
    assert required_literals(pattern) == ()


def test_a_tab_by_its_number_blocks(spark):
    p = load_policy({"version": 1, "rules": [{"id": "b", "match": {"content_regex": [r"\011secret"]}, "action": {"type": "block"}}]})
    files = spark.createDataFrame([("/w", "a", "x\tsecret")], "root string, path string, text string")
    assert apply_policy(files, p).first().disposition == "BLOCKED"


def test_guarded_search_is_plain_search(spark):
    rng = random.Random(4)
    atoms = ["ab", "c", "\\d", "\\w+", "[ab]", "(a|bc)", "x?", "\\.", "\\t", "\\0101", "\\x41", "b{2}", ".", "|", "\\bA", "^a", "$"]
    patterns = []
    while len(patterns) < 60:
        patterns.append("".join(rng.choice(atoms) for _ in range(rng.randint(1, 4))))
    texts = [("".join(rng.choice(["ab", "c", "A", "1", ".", "\t", "bb", "x", " "]) for _ in range(rng.randint(0, 6))),) for _ in range(40)]
    text = F.col("t")
    checks = [found(text, p).eqNullSafe(text.rlike(p)).alias(f"p{i}") for i, p in enumerate(patterns)]
    out = spark.createDataFrame(texts, "t string").select(*checks)
    wrong = out.agg(*[F.count_if(~F.col(c)).alias(c) for c in out.columns]).first().asDict()
    assert [patterns[int(k[1:])] for k, n in wrong.items() if n] == []


def test_top_findings_are_cut_before_the_ranking_of_a_root(spark):
    rows = [("/w", f"d{i % 7}/f{i:03d}", 0, "REDACT", "POLICY_RULE", f"r{i}", "m") for i in range(300)]
    found_ = spark.createDataFrame(rows, "root string, path string, finding_ord int, action string, source string, rule_id string, message string")
    for k in (3, 5000):
        got = [r.path for r in top_findings(found_, k).orderBy("rank").collect()]
        assert got == sorted((r[1] for r in rows), key=lambda p: p.split("/"))[:k]
    plan = top_findings(found_, 5000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(rank#") >= 2 and plan.count("Window [row_number()") == 2


def test_a_detector_that_hangs_does_not_stop_the_batch(spark):
    def sleepy(texts):
        for text in texts:
            if "hang" in text:
                time.sleep(60)
        return pd.DataFrame({"redacted_text": [t.replace("John", "<p>") if "John" in t else None for t in texts],
                             "matched_values": [None] * len(texts), "summary": [None] * len(texts)})

    p = load_policy({"version": 1, "rules": []})
    detector = register_detector("names", sleepy, seconds=0.2)
    rows = [(f"f{i}", "hang John" if i in (3, 11) else f"John {i}" if i % 2 else "clean") for i in range(20)]
    files = spark.createDataFrame([("/w", *r) for r in rows], "root string, path string, text string").coalesce(1)
    begin = time.time()
    out = {r.path: (r.disposition, r.sanitized_text, r.detector_status["names"]) for r in apply_policy(files, p, detectors=[detector]).collect()}
    assert time.time() - begin < 40
    assert {k for k, v in out.items() if v[2] == "timeout"} == {"f3", "f11"} and out["f3"][:2] == ("COPY_ORIGINAL", None)
    assert out["f5"] == ("WRITE_SANITIZED_TEXT", "<p> 5", "ok") and out["f4"] == ("COPY_ORIGINAL", None, "nothing")
    assert evaluate_workspace(files.selectExpr("*", "path AS source_path", "1L AS size", "1L AS mtime_ms"), None, p, detectors=[detector]) \
        .decisions.where("detector_status['names'] = 'timeout'").count() == 2
