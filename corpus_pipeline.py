"""From raw documents to a training mix: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import decontaminate, mixing, queries as Q, secret_scan, simhash, toxicity
from veilframe.llm.words import free_name, names, table
from veilframe.sources.scratch import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half, by a lexicon learned from the labelled raw documents."""
    lexicon = Q.toxicity_lexicon(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    scored = toxicity.score_toxicity(docs, lexicon, into=score)
    return scored.where(F.col(score) < 0.5).select(*names(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (three-word shingles, two bits), that of the smallest id.

    Rows that repeat an id are one document, of which the row with the smallest hash stays (of
    equal hashes the smallest row), so reruns agree.  Rows without an id stay.
    """
    marked = written(simhash.near_duplicates(docs, size=3, max_bits=2), "near-groups").where("doc_id IS NOT NULL")
    ids = marked.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    # Most ids stay as they are: only those that go, or need a choice between rows, meet the texts.
    changed = written(ids.where("doc_id <> component_id OR rows > 1"), "changed-ids")
    kept = docs.join(changed.select("doc_id"), "doc_id", "left_anti").select(*names(docs))
    repeated = changed.where("doc_id = component_id").select("doc_id")
    if repeated.isEmpty():
        return kept
    row = F.struct(*names(docs))
    rows = docs.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(F.xxhash64(row).alias("hash"), row.alias("row")).alias("own"))
    return kept.unionByName(rows.groupBy("doc_id").agg(F.min("own").alias("own")).select("own.row.*"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaks = free_name(docs, "leaks")
    searched = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), into=leaks)
    return searched.where(F.size(leaks) == 0).select(*names(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked."""
    return secret_scan.scan_secrets(docs, into=free_name(docs, "secrets"), masked_text="text").select(*names(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left; see ``mixing.mix_sources``."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("source mix", mixed),
]

#: The stages learn and draw, which SQL cannot; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
