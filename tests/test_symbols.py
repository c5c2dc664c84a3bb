"""Symbol windows against a line-by-line brute force, on random sources."""

import random
import re

from pyspark.sql import functions as F

from veilframe import apply_policy, load_policy
from veilframe.operators import symbols
from veilframe.policy import SymbolCriteria

KEY = ["root", "path"]
CRITERIA = SymbolCriteria(classes=("A", "B"), functions=("f",), annotations=("x.Hide",))
LINES = ["class A {", "class A", "class Q {", "data class B(val x: Int) {", "fun f() {", "fun f() = 1", "fun g() {",
         "fun <T> f(x: T) {", "@Hide", "@Other", "@x.y.Hide(1)", "}", "} {", "{", "{{", "}}", "x = 1", "", "  ", "\t", "@Hide fun z()",
         "interface B", "fun Int.f() {", "// class A", "override suspend fun f(", ") {", "é = '}'"]


def random_source(rng):
    return "\n".join(rng.choice(["", "", "  ", "    ", "\t"]) + rng.choice(LINES) for _ in range(rng.randint(1, 25)))


def brute_matches(text):
    lines = text.split("\n")
    starts = [sum(len(l) + 1 for l in lines[:i]) for i in range(len(lines) + 1)]
    starts[-1] -= 1
    kind = lambda t: next((k for k, p in (("@", symbols.ANNOTATION_REGEX), ("class", symbols.CLASS_REGEX),
                                          ("fun", symbols.FUNCTION_REGEX)) if re.search(p, t)), None)
    indent = lambda l: len(l) - len(l.lstrip())

    def last_line(d):
        net = [l.count("{") - l.count("}") for l in lines]
        if net[d] > 0:
            closing = [e for e in range(d + 1, len(lines)) if sum(net[d:e + 1]) <= 0]
            return closing[0] if closing else len(lines) - 1
        body = d
        for e in range(d + 1, len(lines)):
            if lines[e].strip():
                level, own = indent(lines[e]), indent(lines[d])
                if level < own or (level == own and (own == 0 or kind(lines[e].strip()))):
                    break
                body = e
        return body

    found, run = [], []
    for i, line in enumerate(lines):
        t = line.strip()
        k = kind(t) if t else None
        if k == "@":
            run.append((i, re.search(symbols.ANNOTATION_REGEX, t)[1].split(".")[-1]))
            continue
        if k:
            name = re.search(symbols.CLASS_REGEX, t)[2] if k == "class" else re.search(symbols.FUNCTION_REGEX, t)[1]
            named = name in (CRITERIA.classes if k == "class" else CRITERIA.functions)
            if named or any(a == "Hide" for _, a in run):
                found.append((k, name, run[0][0] if run else i, last_line(i)))
        run = []
    return [(k, n, a, b, starts[a], starts[b + 1]) for k, n, a, b in found]


def brute_redact(text, matches):
    covered = {}
    for k, n, a, b, start, end in sorted(matches, key=lambda m: m[4]):
        for other in [o for o in covered if o[0] <= end and start <= o[1]]:
            covered_desc = covered.pop(other)
            start, end, n = min(start, other[0]), max(end, other[1]), None
            covered[(start, end)] = covered_desc + [f"{k} {[m[1] for m in matches if m[2:4] == (a, b) and m[0] == k][0]}"]
            break
        else:
            covered[(start, end)] = [f"{k} {n}"]
    for (start, end), names in sorted(covered.items(), reverse=True):
        text = text[:start] + "# // " + ", ".join(names) + text[end:]
    return text


def sources(spark, count=250, seed=5):
    rng = random.Random(seed)
    rows = [("/w", f"s{i}.kt", random_source(rng)) for i in range(count)]
    return rows, spark.createDataFrame(rows, "root string, path string, text string")


def test_symbols_against_brute_force(spark):
    rows, files = sources(spark)
    got = {}
    for r in symbols.kotlin_symbols(files, CRITERIA).collect():
        got.setdefault(r.path, []).append((r.kind, r.name, r.start_line, r.end_line, r.start, r.end))
    total = 0
    for _, path, text in rows:
        expected = brute_matches(text)
        total += len(expected)
        assert sorted(got.get(path, [])) == sorted(expected), text
    assert total > 300


def test_redaction_against_brute_force(spark):
    rows, files = sources(spark, seed=6)
    got = {r.path: r.redacted_text for r in symbols.redact_kotlin(files, CRITERIA, "#").collect()}
    assert len(got) == len(rows)
    for _, path, text in rows:
        assert got[path] == brute_redact(text, brute_matches(text)), text


def test_packages_are_a_gate(spark):
    texts = {"exact": "package a.b\nclass A", "below": "// x\n  package a.b.c\nclass A", "alike": "package a.bc\nclass A",
             "none": "class A"}
    files = spark.createDataFrame([("/w", k + ".kt", t) for k, t in texts.items()], "root string, path string, text string")
    gated = SymbolCriteria(packages=("a.b",), classes=("A",))
    assert {r.path for r in symbols.kotlin_symbols(files, gated).collect()} == {"exact.kt", "below.kt"}
    whole = symbols.kotlin_symbols(files, SymbolCriteria(packages=("a.b",))).collect()
    assert {(r.path, r.name, r.start, r.end) for r in whole} == {
        ("exact.kt", "a.b", 0, 19), ("below.kt", "a.b.c", 0, 28)}


def test_a_multi_line_constructor_leaves_its_body(spark):
    text = "class A(\n    val x: Int,\n) {\n    val y = 1\n}\n"
    row = symbols.kotlin_symbols(spark.createDataFrame([("/w", "a.kt", text)], "root string, path string, text string"), CRITERIA).first()
    assert (row.start_line, row.end_line) == (0, 1)


def test_merge_ranges(spark):
    ranges = [(0, 5, 1, "a"), (5, 9, 2, "b"), (3, 4, 3, "c"), (11, 12, 4, "d")]
    frame = spark.createDataFrame([("k", *r) for r in ranges], "key string, start int, end int, line int, description string")
    assert sorted(tuple(r) for r in symbols.merge_ranges(frame, ["key"]).collect()) == [
        ("k", 0, 9, "a, c, b"), ("k", 11, 12, "d")]


def test_symbol_rules_stay_in_their_row(spark):
    _, files = sources(spark, 20)
    policy = load_policy({"version": 1, "rules": [
        {"id": f"r{i}", "match": {"kotlin": {"classes": [c]}}, "action": {"type": "redact"}} for i, c in enumerate("AB")]})
    for frame in (apply_policy(files, policy), symbols.redact_kotlin(files, CRITERIA, "#"), symbols.kotlin_symbols(files, CRITERIA)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Scan ") == 1


def test_long_files_are_linear(spark):
    nested = "\n".join(["class A {"] * 20_000 + ["}"] * 20_000)
    found = symbols.declared(nested, CRITERIA)
    assert len(found) == 20_000 and all(d["start_line"] + d["end_line"] == 39_999 for d in found)
    deep = "\n".join(" " * i + "class B" for i in range(2000))
    assert {d["end_line"] for d in symbols.declared(deep, CRITERIA)} == {1999}
    assert symbols.merged(found) == [{"start": 0, "end": len(nested), "description": ", ".join(["class A"] * 20_000)}]


def test_rows_and_windows_agree(spark):
    _, files = sources(spark, 120, seed=9)
    lined = symbols.line_kinds(symbols.brace_balance(symbols.line_offsets(symbols.source_lines(files, KEY), KEY), KEY))
    ends = symbols.block_end(lined.withColumn("is_target", (F.col("kind") == "class") & F.col("name").isin("A", "B")), KEY)
    windows = {(r.path, r.line): (r.end_line, r.end_offset) for r in ends.collect()}
    rows = symbols.kotlin_symbols(files, SymbolCriteria(classes=("A", "B"))).collect()
    assert {r.path for r in rows} == {p for p, _ in windows} and len(rows) == len(windows)
    assert sorted((r.path, r.end_line, r.end) for r in rows) == sorted((p, *v) for (p, _), v in windows.items())
