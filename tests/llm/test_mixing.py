import pytest
from pyspark.sql import functions as F

from veilframe.llm import mixing as M


def level_targets(sizes, share=1.5, most=2.0):
    """Share by weight, cap, and share the rest again, as the words say."""
    names = sorted(n for n in sizes if n is not None) + [n for n in sizes if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    out, open_, total = {}, set(names), share * sum(sizes.values())
    while open_:
        level = (total - sum(out.values())) / sum(weight[n] for n in open_)
        over = [n for n in open_ if level * weight[n] > most * sizes[n]]
        for n in over or open_:
            out[n] = most * sizes[n] if over else level * weight[n]
        open_ -= set(over) if over else open_
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 1000}, {"a": 1}, {None: 5, "é": 50, "z": 50, "": 7, "Z": 900},
                                   {f"s{i}": (i * 37) % 101 for i in range(25)}, {"a": 0, "b": 0}])
def test_targets(frame, sizes):
    out = M.source_targets(frame(list(sizes.items()), "source string, source_size long"))
    got = {r.source: r.target for r in out.collect()}
    assert got == pytest.approx(level_targets(sizes))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = M.mix_sources(docs, fan_in=8).toPandas()
    assert sorted(out.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    sizes = {r.doc_id: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")]) for r in docs.collect()}
    assert dict(zip(out.doc_id, out["size"])) == sizes
    assert (out.taken <= 2 * out["size"]).all()
    sources = out.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"),
                                        taken=("taken", "sum"), largest=("size", "max"))
    assert (sources["size"] == sources.source_size).all()
    assert dict(sources.target) == pytest.approx(level_targets(dict(sources["size"])))
    assert ((sources.taken - sources.target).abs() <= sources.largest).all()
    again = M.mix_sources(docs.repartition(7), fan_in=8).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(out.doc_id, out.taken))


def test_one_hot_source_keeps_its_words(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"),
                                    F.when(F.col("id") < 2900, "big").otherwise("small").alias("source"))
    rows = M.mix_sources(docs, fan_in=16).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 97 for r in rows)


def test_odd_rows(frame):
    rows = [(1, "a b c", "x", 1)] * 7 + [(None, "a b", None, 2)] * 3 + [(2, None, "y", 3), (3, "", "y", 4), (4, "q", "x", 5)]
    docs = frame(rows, "doc_id long, text string, source string, target int")
    out = M.mix_sources(docs).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    assert out[out.source == "y"].taken.tolist() == [0, 0] and out[out.source == "y"].target.tolist() == [0, 0]
    assert (out.taken.where(out["size"] > 0, 0) % out["size"].where(out["size"] > 0, 1) == 0).all()
    assert M.mix_sources(docs.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark, sf):
    plan = M.mix_sources(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
