"""The two whole flows: a one-shot request and a workspace run."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import in_skipped_directory
from ..functions.text import decode_text
from ..operators import rollups
from ..operators.reuse import DECISION_KEY, reuse_decisions
from ..operators.rules import all_findings, apply_policy, evaluate_prompts, explode_findings
from ..policy import Policy
from ..sources.manifest import (current_manifest, current_staged, delta_number, log_entries, log_removals, manifest_log, short_log, staged_delta,
                                staged_log)
from ..sources.scratch import written
from ..sources.workspace import list_workspace, read_contents


@dataclass(frozen=True)
class RequestRun:
    prompts: DataFrame
    items: DataFrame
    findings: DataFrame
    decisions: DataFrame


def evaluate_requests(prompts: DataFrame, files: DataFrame, policy: Policy, *, mode: str = "request",
                      approve: bool = False, detectors: Sequence = ()) -> RequestRun:
    """Prompts (request_id, source_label, text) and files of many requests at once.

    Findings and decisions are read from a written copy without the original
    texts; ``items`` is left to be evaluated when the files are staged.
    """
    checked = written(evaluate_prompts(prompts, policy, detectors=detectors), "prompts")
    items = apply_policy(files, policy, detectors=detectors)
    verdicts = written(items.drop("text"), "verdicts")
    decisions = rollups.gate(rollups.request_result(checked, verdicts), mode=mode, approve=approve)
    return RequestRun(checked, items, all_findings(checked, verdicts), decisions)


DECISION_COLUMNS = ("root", "source_path", "path", "size", "mtime_ms", "disposition", "sanitized_text", "findings",
                    "detector_status", "cache_hit")


@dataclass(frozen=True)
class WorkspaceRun:
    decisions: DataFrame
    stats: DataFrame
    directories: DataFrame
    safe: DataFrame
    findings: DataFrame


def decoded(files: DataFrame) -> DataFrame:
    """Files with ``text``: strict UTF-8 of the content, NULL for binary files."""
    return files.withColumn("text", decode_text(F.col("content")))


def contents(listed: DataFrame) -> DataFrame:
    """Listed files with bytes and text: each is opened once, here."""
    return decoded(read_contents(listed))


def evaluate_workspace(files: DataFrame, manifest: DataFrame | None, policy: Policy, *, detectors: Sequence = (),
                       read: Callable[[DataFrame], DataFrame] | None = None) -> WorkspaceRun:
    """Evaluate the files of workspaces, reusing what the manifest knows.

    ``files`` have text, or are a listing that ``read`` gives text to (``contents``), of
    misses only.  The decisions (not the original texts) are written to the shared folder, as
    every report of the run reads them.
    """
    kept = files.filter(~in_skipped_directory(F.col("path")))
    if manifest is None:
        decisions = apply_policy(read(kept) if read else kept, policy, detectors=detectors).withColumn("cache_hit", F.lit(False))
    else:
        decisions = reuse_decisions(kept, manifest, policy, carry=("path",), detectors=detectors, read=read)
    return _reports(written(decisions.select(*DECISION_COLUMNS), "decisions"))


def _reports(decisions: DataFrame) -> WorkspaceRun:
    rollup = rollups.directory_rollup(decisions)
    return WorkspaceRun(decisions, rollups.stage_stats(decisions), rollup, rollups.safe_subtrees(rollup),
                        explode_findings(decisions, "root", "path"))


#: Deltas of manifest and staged copy that gather before they are folded.
FOLD_AFTER = 16


def run_workspace(files: DataFrame, policy: Policy, folder: str, *, detectors: Sequence = (),
                  read: Callable[[DataFrame], DataFrame] | None = None, fold_after: int = FOLD_AFTER) -> WorkspaceRun:
    """One run over workspaces: evaluate what has changed, bring the staged copy and the manifest below ``folder`` up to date.

    Files with the size and time that ``folder/manifest`` knows keep their decisions; only the
    others' texts are read, once: ``read`` gives text to the rows of a listing, without it
    ``files`` have it.  What is read is written to the shared folder with its decisions, and
    from there to ``folder/staged``: texts, or bytes of binary files, of what is shared.  Both
    are logs; a run adds the changed items, and the paths that are gone or blocked now.
    """
    spark, run = files.sparkSession, f"run-{uuid.uuid4().hex}"
    manifest, staged = manifest_log(spark, f"{folder}/manifest"), staged_log(spark, f"{folder}/staged")
    name, staged_name = manifest.name(run), staged.name(run)
    kept = files.filter(~in_skipped_directory(F.col("path")))
    known = current_manifest(spark, f"{folder}/manifest", policy, detectors)
    keys = [*DECISION_KEY]
    listed = kept.select(*keys, "path") if read is None else written(kept.select(*keys, "path"), "listed")
    miss_keys = written(listed.join(known.select(*keys), keys, "left_anti"), "misses")
    found = read(miss_keys) if read else kept.join(miss_keys.select(*keys), keys, "left_semi")
    fresh = apply_policy(found, policy, detectors=detectors).withColumn("cache_hit", F.lit(False))
    columns = [*DECISION_COLUMNS, *(c for c in ("text", "content") if c in fresh.columns)]
    fresh = written(fresh.select(*columns), "fresh")
    hits = listed.join(known.select(*keys, "disposition", "sanitized_text", "findings", "detector_status"), keys).withColumn("cache_hit", F.lit(True))
    decisions = written(hits.select(*DECISION_COLUMNS).unionByName(fresh.select(*DECISION_COLUMNS)), "decisions")

    before = manifest.read().where("NOT removed").select("root", "source_path").distinct()
    gone = written(before.join(decisions.select("root", "source_path"), ["root", "source_path"], "left_anti"), "gone")
    number = delta_number(name)
    manifest.append(log_entries(fresh, policy, detectors, name, number, F.lit(0)).unionByName(
        log_removals(gone, name, number, F.lit(0), below=False)), name)
    staged_before = current_staged(staged.read()).select("root", "path")
    left = staged_before.join(decisions.select("root", "path"), ["root", "path"], "left_anti")
    staged.append(staged_delta(fresh, left, staged_name), staged_name)
    manifest.fold(short_log, after=fold_after)
    staged.fold(current_staged, after=fold_after)
    return _reports(decisions)


def run_tree(spark: SparkSession, root: str, policy: Policy, folder: str, *, detectors: Sequence = (), **options) -> WorkspaceRun:
    """``run_workspace`` over a directory tree: listed by its metadata, and only files that have changed are opened, once each."""
    return run_workspace(list_workspace(spark, root), policy, folder, detectors=detectors, read=contents, **options)
