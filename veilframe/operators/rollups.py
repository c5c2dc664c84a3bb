"""Decisions and counts per request, workspace, directory and rule.

All of them are partial aggregations before the shuffle, so a request or root
that holds most of the rows costs no more than any other.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import parent_directory
from ..policy import ALLOW, BLOCK, CONFIRM
from .joins import spread_join
from .rules import BLOCKED, COPY_ORIGINAL, SECRET_DETECTOR, TEXT_SANITIZER_BACKEND, WRITE_SANITIZED_TEXT

PASS, GATE_BLOCKED, APPROVAL = 0, 3, 4


def request_decision(findings: DataFrame, request: str = "request_id") -> DataFrame:
    """is_blocked = any BLOCK, requires_approval = any CONFIRM; ``findings`` are rows."""
    return findings.groupBy(request).agg(
        F.bool_or(F.col("action") == BLOCK).alias("is_blocked"),
        F.bool_or(F.col("action") == CONFIRM).alias("requires_approval"))


def request_result(prompts: DataFrame, files: DataFrame, request: str = "request_id") -> DataFrame:
    """Decision of every request, also of those without findings."""
    def flags(df: DataFrame, part: str) -> DataFrame:
        def any_of(action: str) -> Column:
            return F.exists("findings", lambda f: f["action"] == action)
        return df.select(request, F.lit(part).alias("part"), any_of(BLOCK).alias("_block"), any_of(CONFIRM).alias("_confirm"))

    prompt = F.col("part") == "prompt"
    both = flags(prompts, "prompt").unionByName(flags(files, "files"))
    return both.groupBy(request).agg(
        F.bool_or("_block").alias("is_blocked"), F.bool_or("_confirm").alias("requires_approval"),
        F.coalesce(F.bool_or(F.when(prompt, F.col("_block"))), F.lit(False)).alias("prompt_blocked"))


def gate(decisions: DataFrame, *, mode: str = "request", approve: bool = False) -> DataFrame:
    """Adds ``gate``: 0 pass, 3 blocked, 4 approval needed; a block wins.

    Mode ``request`` fails on any block.  Mode ``workspace`` only fails on a
    blocked prompt, as blocked files are left out of the workspace there.
    """
    stops = {"request": "is_blocked", "workspace": "prompt_blocked"}[mode]
    waits = F.lit(False) if approve else F.col("requires_approval")
    return decisions.withColumn("gate", F.when(F.col(stops), GATE_BLOCKED).when(waits, APPROVAL).otherwise(PASS))


def _counts(hits: Column | None) -> list[Column]:
    disposition = F.col("disposition")
    return [F.count_if(disposition != BLOCKED).alias("mirrored"),
            F.count_if(disposition == WRITE_SANITIZED_TEXT).alias("redacted"),
            F.count_if(disposition == BLOCKED).alias("blocked"),
            F.count_if(disposition == COPY_ORIGINAL).alias("pass_through"),
            *([F.count_if(hits).alias("cache_hits")] if hits is not None else [])]


def stage_stats(items: DataFrame, by: Sequence[str] = ("root",)) -> DataFrame:
    """mirrored, redacted, blocked, pass_through and cache_hits per workspace."""
    hits = F.col("cache_hit") if "cache_hit" in items.columns else F.lit(False)
    return items.groupBy(*by).agg(*_counts(hits))


_COUNTED = ("mirrored", "redacted", "blocked", "pass_through")


def directory_rollup(items: DataFrame, path: str = "path") -> DataFrame:
    """The counts for every directory subtree and whether all of it is untouched.

    Files are counted per leaf directory first.  Leaf directories are dealt out by ranges of
    their order, in which a subtree is an interval; one sweep over a range adds a
    directory's counts to the one above it as soon as its interval ends, and gives one row
    per directory.  So counts climb once, whatever the depth; only directories that reach
    over the end of a range have several rows, which are added up last.
    """
    leaves = items.groupBy("root", parent_directory(F.col(path)).alias("directory")).agg(*_counts(None))
    order = F.replace(F.col("directory"), F.lit("/"), F.lit("\0"))  # nothing comes between a directory and what is below it
    dealt = leaves.withColumn("_order", order).repartitionByRange("root", "_order").sortWithinPartitions("root", "_order") \
        .select("root", "directory", *_COUNTED)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, opened, done = None, [], []  # opened: directories from the root's down to the last one, with counts so far

        def close() -> None:
            directory, counts = opened.pop()
            done.append((here, directory, *counts))
            if opened:
                opened[-1][1] = [a + b for a, b in zip(opened[-1][1], counts)]

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), *[pa.int64()] * len(_COUNTED)]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["root", "directory", *_COUNTED])
            done.clear()
            return out

        for batch in batches:
            for root, directory, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if root != here:
                    while opened:
                        close()
                    here = root
                while opened and not (opened[-1][0] in ("", directory) or directory.startswith(opened[-1][0] + "/")):
                    close()
                if not opened:
                    opened.append(["", [0] * len(_COUNTED)])
                top = opened[-1][0]
                for part in directory[len(top) + (top != ""):].split("/") if directory != top else ():
                    top = f"{top}/{part}" if top else part
                    opened.append([top, [0] * len(_COUNTED)])
                opened[-1][1] = [a + b for a, b in zip(opened[-1][1], counts)]
                if len(done) >= 4096:
                    yield batch_of()
        while opened:
            close()
        if done:
            yield batch_of()

    climbed = dealt.mapInArrow(climb, "root string, directory string, " + ", ".join(f"{n} bigint" for n in _COUNTED))
    totals = climbed.groupBy("root", "directory").agg(*(F.sum(n).alias(n) for n in _COUNTED))
    return totals.withColumn("fully_safe", (F.col("mirrored") > 0) & (F.col("redacted") == 0) & (F.col("blocked") == 0))


def safe_subtrees(rollup: DataFrame) -> DataFrame:
    """The highest fully safe directories."""
    safe = rollup.filter("fully_safe")
    parent = safe.select("root", F.col("directory").alias("_parent"))
    candidates = safe.withColumn("_parent", F.when(F.col("directory") != "", parent_directory(F.col("directory"))))
    return spread_join(candidates, parent, ["root", "_parent"], "left_anti", ["directory"]).drop("_parent")


def finding_label() -> Column:
    source, rule = F.col("source"), F.col("rule_id")
    return (F.when(source == SECRET_DETECTOR, "secret-detector")
            .when(source == TEXT_SANITIZER_BACKEND, F.coalesce(rule, F.lit("text-sanitizer")))
            .otherwise(F.coalesce(rule, F.lit("policy"))))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Finding count per action, source and label."""
    return findings.groupBy("action", "source", finding_label().alias("label")).agg(F.count(F.lit(1)).alias("findings"))


def disposition_label(disposition: Column) -> Column:
    return (F.when(disposition == COPY_ORIGINAL, "allowed").when(disposition == WRITE_SANITIZED_TEXT, "redacted")
            .otherwise("blocked"))


def disposition_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(disposition_label(F.col("disposition")).alias("label")).agg(F.count(F.lit(1)).alias("items"))


def sync_status(blocked: Column, redacted: Column) -> Column:
    return F.when(blocked > 0, "blocked").when(redacted > 0, "redacted").otherwise("pass-through")


def top_findings(findings: DataFrame, k: int = 10, path: str = "path", salts: int = 64) -> DataFrame:
    """First k findings per root in traversal order, with the number of others.

    Needs root, path, finding_ord and the finding columns.  Findings are ranked per root
    and salt first, and only k of each go on to the ranking per root, for any k; totals are
    a separate partial aggregation.  Findings are read twice, so pass a stored table.
    """
    notable = findings.filter(F.col("action") != ALLOW).withColumn("_salt", F.pmod(F.xxhash64(path, "finding_ord"), F.lit(salts)))
    order = (F.split(F.col(path), "/"), F.col("finding_ord"))
    some = notable.withColumn("rank", F.row_number().over(Window.partitionBy("root", "_salt").orderBy(*order))).filter(F.col("rank") <= k)
    shown = some.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*order))).filter(F.col("rank") <= k)
    more = findings.groupBy("root").agg((F.count(F.lit(1)) - F.least(
        F.count_if(F.col("action") != ALLOW), F.lit(k))).alias("more"))
    return shown.join(more, "root").select("root", "rank", path, "action", finding_label().alias("label"), "more")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
