import re

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from veilframe.functions import match, paths as P
from veilframe.functions.match import glob_to_regex, required_literals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("glob, path, expected", [
    ("**/*.jks", "a/release.jks", True), ("**/*.jks", "release.jks", False),  # ** needs its slash
    ("*.jks", "release.jks", True), ("*.jks", "a/release.jks", False),
    ("*", ".env", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("src/[a-c]x", "src/bx", True), ("src/[!a-c]x", "src/bx", False), ("src[!x]y", "src/y", False),
    ("*.{kt,kts}", "a.kts", True), ("*.{kt,kts}", "a.ktx", False), ("a\\*b", "a*b", True), ("a\\*b", "axb", False),
    ("a.b", "axb", False), ("a+(b)", "a+(b)", True), ("A", "a", False), ("x", "x\n", False), ("[*?]z", "*z", True),
])
def test_globs(spark, glob, path, expected):
    assert one(spark, match.glob_match(F.lit(path), [glob])) is expected


@pytest.mark.parametrize("glob", ["[a", "{a", "{a,{b}}", "a\\", "[a/b]"])
def test_bad_globs(glob):
    with pytest.raises(ValueError):
        glob_to_regex(glob)


def test_null_inputs_do_not_match(spark):
    none = F.lit(None).cast("string")
    assert one(spark, match.glob_match(none, ["**"])) is False
    assert one(spark, match.content_regex_match(none, ["a"])) is False
    assert one(spark, match.is_sanitizable_line(none)) is False


PIECES = st.sampled_from(["ab", "c", r"\.", r"\d+", "[ab]", "x*", "y?", "z+", "(?:cd|e)", "(b)+", "q{2}", ".", r"\s*"])


BRANCH = st.lists(PIECES, min_size=1, max_size=5).map("".join)


@given(st.lists(BRANCH, min_size=1, max_size=3), st.text("abcdexyzq. 01", max_size=14))
def test_a_required_literal_is_in_every_match(branches, text):
    pattern = "|".join(branches)
    match_ = re.search(pattern, text)
    literals = required_literals(pattern)
    if match_ and literals:
        assert any(literal in match_.group() for literal in literals)


@pytest.mark.parametrize("pattern, literals", [
    ("ENV_[A-Z]+", ("ENV_",)), ("(?i)abc", ()), ("a|b", ("a", "b")), ("a|[b]", ()), ("ab*c", ("a",)), (r"\Qa.b\E", ()),
    ("[", ()), ("(a", ()), (r"\p{L}ab", ()), (r"\x41b", ()), ("a++b", ("a",)), ("(?=ab)c", ()), ("a&&b", ("a&&b",)),
    ("(a|b)c", ("c",)), ("a||b", ()), (r"x\|y", ("x|y",)), ("Licensed under|Released under", ("Licensed under", "Released under")),
])
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals


@pytest.mark.parametrize("line, expected", [
    ("hello", True), ("  /help", False), ("/x", False), ("   ", False), ("", False), (" \t", False),
    (" /x", False), ("a/b", True), ("\n x", True), ("\u0085", True),
])
def test_sanitizable_lines(spark, line, expected):
    assert one(spark, match.is_sanitizable_line(F.lit(line))) is expected


@pytest.mark.parametrize("root, path, expected", [
    ("/w", "/w/a/b", "a/b"), ("/w", "a/./b", "a/b"), ("/w", "/w/../x/f", "_external/f"), ("/w", "/wide/f", "_external/f"),
    ("/w/", "/w//a/", "a"), ("/", "/a", "a"), ("/w", "../w/a", "a"), ("/w", "/w/a/../../w/b", "b"),
])
def test_relative_path(spark, root, path, expected):
    assert one(spark, P.relative_path(F.lit(root), F.lit(path))) == expected


@pytest.mark.parametrize("path, expected", [
    ("build/x", True), ("a/node_modules/b/c", True), ("build", False), ("a/build", False), ("builds/x", False), (".git/x", True),
])
def test_skipped_directories(spark, path, expected):
    assert one(spark, P.in_skipped_directory(F.lit(path))) is expected


def test_names_and_chains(spark):
    assert one(spark, P.safe_name(F.lit("/a/b c#é.txt"), "file")) == "b_c__.txt"
    assert one(spark, P.safe_name(F.lit("/"), "include")) == "include"
    assert one(spark, P.absolute_chain(F.lit("/a/b"))) == ["/", "/a", "/a/b"]
    assert one(spark, P.absolute_chain(F.lit("/"))) == ["/"]
    assert one(spark, P.directory_chain(F.lit(""))) == [""]
    key = one(spark, P.workspace_key(F.lit("/home/my app")))
    assert re.fullmatch(r"my_app-[0-9a-f]{12}", key)
