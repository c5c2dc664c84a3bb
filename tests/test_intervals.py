"""Directories above paths, against a look at every pair."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators.intervals import with_directories_above


def under(path, directory):
    return path == directory or directory == "/" or path.startswith(directory + "/")


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_against_all_pairs(spark, partitions):
    rng = random.Random(partitions)
    names = ["a", "b", "a-b", "a b", "a.b", "é", "A", "ab", "!"]

    def some(depth):
        return "/" + "/".join(rng.choice(names) for _ in range(rng.randrange(depth)))
    paths = [(rng.choice(["s", "s", "s", "t", None]), some(7), i) for i in range(900)] + [("s", "/", -1), ("s", None, -2), ("u", "/a", -3)]
    directories = sorted({(rng.choice(["s", "s", "t"]), some(5)) for _ in range(150)} | {("s", "/"), ("s", "/a"), ("s", "/a/b")})
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_directories_above(
            spark.createDataFrame(paths, "session string, path string, n int"),
            spark.createDataFrame([(s, d, len(d), "x" + d) for s, d in directories], "session string, directory string, size int, name string"),
            ["session"], "path", ["size", "name"])
        got = {r.n: [(e.directory, e.size, e["name"]) for e in r.above] for r in out.collect()}
        assert "BroadcastNestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(got) == len(paths)
    for session, path, n in paths:
        want = sorted((d for s, d in directories if s == session and path is not None and under(path, d)), key=len)
        assert got[n] == [(d, len(d), "x" + d) for d in want], (session, path)


def test_a_directory_above_everything_is_in_no_join(spark):
    paths = spark.range(20_000).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path"))
    known = spark.createDataFrame([("/",), ("/p",)], "directory string")
    out = with_directories_above(paths, known, [], "path")
    assert out.where("size(above) = 2").count() == 20_000
    assert with_directories_above(paths.limit(0), known, [], "path").count() == 0
    assert with_directories_above(paths, known.limit(0), [], "path").where("size(above) = 0").count() == 20_000
