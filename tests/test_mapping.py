import random

import pytest

from pyspark.sql import functions as F

from veilframe import external_files, map_paths, nearest_policy, number_externals, validate_policies
from veilframe.sources.tables import RULES_SCHEMA, rules_frame
from veilframe.policy import load_policy


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_external_files(spark):
    candidates = frame(spark, [("s", p) for p in ("/w/a", "/w", "/wide/a", "/ext/d/f", "/ext/df", "/other")], "session string, path string")
    roots = frame(spark, [("s", "/w")], "session string, directory string")
    directories = frame(spark, [("s", "/ext/d"), ("t", "/other")], "session string, directory string")
    out = external_files(candidates.union(candidates), roots, directories).collect()
    assert sorted(r.path for r in out) == ["/ext/df", "/other", "/wide/a"]


def test_map_paths_prefers_project_then_first_directory_then_exact_file(spark):
    mapping = frame(spark, [
        ("s", "PROJECT", 0, "/w", "/stage"), ("s", "DIR", 2, "/e/d", "/stage/_external/2-d"), ("s", "DIR", 1, "/e", "/stage/_external/1-e"),
        ("s", "DIR", 3, "/w/sub", "/never"), ("s", "FILE", 1, "/x/f", "/stage/_external_files/1-f")],
        "session string, kind string, ord long, from_path string, to_path string")
    paths = ["/w/a/b", "/w", "/w/sub/c", "/e/d/g", "/x/f", "/x/f/below", "/nowhere/n"]
    out = map_paths(frame(spark, [("s", p) for p in paths], "session string, path string"), mapping, "/stage")
    assert {r.path: r.staged_path for r in out.collect()} == {
        "/w/a/b": "/stage/a/b", "/w": "/stage", "/w/sub/c": "/stage/sub/c", "/e/d/g": "/stage/_external/1-e/d/g",
        "/x/f": "/stage/_external_files/1-f", "/x/f/below": "/stage/_unmapped/below", "/nowhere/n": "/stage/_unmapped/n"}


def test_nearest_policy(spark):
    directories = frame(spark, [("/p/app/src/main", None, None), ("/p", None, None), ("/q", None, None), ("/p/x", "/e.yaml", "/v.yaml"),
                                ("/q/y", None, "/v.yaml")], "directory string, explicit string, environment string")
    policies = frame(spark, [("/p/llm-policy.yml",), ("/p/app/llm-policy.yaml",), ("/p/app/llm-policy.yml",), ("/p/app/src/readme",)], "path string")
    out = {r.directory: r.policy_path for r in nearest_policy(directories, policies).collect()}
    assert out == {"/p/app/src/main": "/p/app/llm-policy.yaml", "/p": "/p/llm-policy.yml", "/q": None, "/p/x": "/e.yaml", "/q/y": "/v.yaml"}
    rooted = nearest_policy(directories, frame(spark, [("/llm-policy.yaml",)], "path string"))
    assert {r.directory: r.policy_path for r in rooted.collect()}["/q"] == "/llm-policy.yaml"


@pytest.mark.parametrize("place", [lambda i: i, lambda i: i * i * 10**9, lambda i: 7])
def test_numbering_over_ranges(spark, place):
    rng = random.Random(3)
    rows = [(rng.choice(["/hot"] * 9 + ["/cold"]), f"/inc/{rng.randint(0, 150):03}", i) for i in range(1000)]
    seen = {}
    rows = [(root, path, place(seen.setdefault((root, path), i))) for root, path, i in rows]  # close, sparse and tied positions
    if place(0) == place(1):
        rows.sort(key=lambda r: r[1])
    out = number_externals(frame(spark, rows, "root string, path string, position long"), partitions=8).collect()
    for root in ("/hot", "/cold"):
        first = {}
        for r, path, position in rows:
            if r == root:
                first.setdefault(path, position)
        expected = {path: n for n, path in enumerate(sorted(first, key=first.get), 1)}
        assert {r.path: r.number for r in out if r.root == root} == expected
    assert {r.staged_path for r in out if r.root == "/hot" and r.number == 1} == {"_external/1-" + next(
        p for r, p, _ in rows if r == "/hot").rsplit("/", 1)[1]}


def test_rules_frame_and_validation(spark):
    policy = load_policy({"version": 1, "rules": [
        {"id": "a", "match": {"kotlin": {"classes": ["X"]}}, "action": {"type": "redact"}},
        {"id": "b", "match": {"paths": ["*"], "content_regex": ["x", "y"]}, "action": {"type": "block"}}]})
    table = rules_frame(spark, policy)
    assert [r.rule_id for r in table.orderBy("rule_ord").collect()] == ["a", "b"]
    assert validate_policies(table).count() == 0
    bad = spark.createDataFrame([
        ("p", 2, 0, "a", None, ["x"], [], [], None, "BLOCK", None, "<r>"), ("p", 2, 1, "a", None, [], [], [], None, "BLOCK", None, "<r>"),
        ("p", 2, 2, " ", None, ["x"], None, None, None, "redact", " ", "<r>"), ("q", 1, 0, "a", None, None, None, None, ([], [], [], []), "REDACT", None, "")],
        RULES_SCHEMA)
    assert {tuple(r) for r in validate_policies(bad).collect()} == {
        ("p", "a", "duplicate_id"), ("p", "a", "unsupported_version"), ("p", "a", "no_matcher"), ("p", " ", "unsupported_version"),
        ("p", " ", "blank_id"), ("p", " ", "blank_replacement"), ("q", "a", "blank_replacement")}
    assert validate_policies(bad.filter(F.lit(False))).count() == 0
