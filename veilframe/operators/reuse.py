"""Reuse of earlier decisions: manifest lookups, removals, invalidation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..policy import Policy, policy_fingerprint
from ..sources.scratch import written
from .intervals import with_directories_above
from .rules import STATUS_TYPE, apply_policy

MANIFEST_VERSION = 1

DECISION_KEY = ("root", "source_path", "size", "mtime_ms")


def valid_entries(manifest: DataFrame, fingerprint: str) -> DataFrame:
    """Entries of the current manifest version and policy."""
    return manifest.filter((F.col("version") == MANIFEST_VERSION) & (F.col("policy_fingerprint") == fingerprint))


def probe_manifest(files: DataFrame, manifest: DataFrame, fingerprint: str) -> DataFrame:
    """File keys with ``cache_hit``; touches no text."""
    known = valid_entries(manifest, fingerprint).select(*DECISION_KEY, F.lit(True).alias("_known"))
    return files.select(*DECISION_KEY).join(known, list(DECISION_KEY), "left").select(
        *DECISION_KEY, F.col("_known").isNotNull().alias("cache_hit"))


def reuse_decisions(files: DataFrame, manifest: DataFrame, policy: Policy, *,
                    carry: Sequence[str] = (), detectors: Sequence = (), read: Callable[[DataFrame], DataFrame] | None = None,
                    live: Column | None = None) -> DataFrame:
    """Decision per file: replayed where path, policy, size and mtime are unchanged.

    Files need root, source_path, path, text, size, mtime_ms; ``carry`` names
    further narrow columns to keep.  Hits are a join of narrow keys with the manifest;
    no text is below them in the plan.  The keys of the misses are written first, so the
    planner knows their size: texts are then read beside a broadcast of few keys, without
    a shuffle, or shuffled once if there are many.  Only the misses' texts are evaluated.
    A table scan still passes over the other texts' pages.  Of a listing (no text), ``read``
    opens the misses: it gets their rows and returns them with text, and with size and time
    as they were when read.

    With ``live`` all files come back with all their columns and with decisions where it holds and
    the key has no NULL; the texts move once, by root and source path, or not at all if they lie so.
    """
    valid = valid_entries(manifest, policy_fingerprint(policy, detectors))
    if "detector_status" not in valid.columns:
        valid = valid.withColumn("detector_status", F.lit(None).cast(STATUS_TYPE))
    if live is not None:
        return _decided_in_place(files, valid, policy, live, detectors)
    if read:
        files = written(files, "listed")
    keys = files.select(*DECISION_KEY, *carry)
    stored = valid.select(*DECISION_KEY, "disposition", "sanitized_text", "findings", "detector_status")
    hits = keys.join(stored, list(DECISION_KEY), "inner").withColumn("cache_hit", F.lit(True))
    miss_keys = written(files.select(*DECISION_KEY).join(valid.select(*DECISION_KEY), list(DECISION_KEY), "left_anti"), "misses")
    found = files.join(miss_keys, list(DECISION_KEY), "left_semi")
    misses = apply_policy(read(found) if read else found, policy, detectors=detectors)
    return hits.unionByName(misses.select(
        *DECISION_KEY, *carry, "disposition", "sanitized_text", "findings", "detector_status", F.lit(False).alias("cache_hit")))


def _decided_in_place(files: DataFrame, valid: DataFrame, policy: Policy, live: Column, detectors: Sequence) -> DataFrame:
    decisions = ("disposition", "sanitized_text", "findings", "detector_status")
    stored = valid.select(*(F.col(c).alias(f"_known_{c}") for c in (*DECISION_KEY, *decisions)), F.lit(True).alias("_known"))
    # Size and time are no keys of the join, so files that lie by root and source path stay where they are.
    same = [F.col(c) == F.col(f"_known_{c}") for c in ("root", "source_path")]
    same += [F.col(c).between(F.col(f"_known_{c}"), F.col(f"_known_{c}")) for c in ("size", "mtime_ms")]
    whole = reduce(and_, (F.col(c).isNotNull() for c in DECISION_KEY))
    joined = files.join(stored, reduce(and_, [*same, live]), "left") \
        .withColumn("_fresh", live & whole & F.col("_known").isNull()).withColumn("_whole", F.col("text"))
    done = apply_policy(joined.withColumn("text", F.when(F.col("_fresh"), F.col("text"))), policy, detectors=detectors)
    return done.select(
        *(c if c != "text" else F.col("_whole").alias(c) for c in files.columns),
        *(F.when(F.col("_known"), F.col(f"_known_{c}")).when(F.col("_fresh"), F.col(c)).alias(c) for c in decisions),
        F.when(F.col("_known"), True).when(F.col("_fresh"), False).alias("cache_hit"))


def removed_paths(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries whose source is gone."""
    return manifest.join(files.select("root", "source_path"), ["root", "source_path"], "left_anti")


def covered_by(paths: DataFrame, directories: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    """Distinct (key, path) equal to or below one of the directories (key, directory)."""
    known = directories.select(*key, "directory").distinct()
    found = with_directories_above(paths.select(*key, path).distinct(), known, key, path)
    return found.where(F.size("above") > 0).select(*key, path)


def invalidate_prefix(manifest: DataFrame, removed: DataFrame) -> DataFrame:
    """Manifest without the removed paths (root, source_path) and all below them."""
    gone = covered_by(manifest, removed.withColumnRenamed("source_path", "directory"), ["root"], "source_path")
    return manifest.join(gone, ["root", "source_path"], "left_anti")
