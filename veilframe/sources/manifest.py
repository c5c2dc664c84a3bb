"""Manifest of decisions, and the sanitised copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import workspace_key
from ..operators.intervals import with_directories_above
from ..operators.reuse import MANIFEST_VERSION, valid_entries
from ..operators.rules import BLOCKED, FINDINGS_TYPE, STATUS_TYPE, WRITE_SANITIZED_TEXT
from ..policy import Policy, policy_fingerprint
from .deltas import DeltaLog

MANIFEST_SCHEMA = ("version int, policy_fingerprint string, root string, source_path string, size long, "
                   f"mtime_ms long, disposition string, sanitized_text string, findings {FINDINGS_TYPE}, "
                   f"detector_status {STATUS_TYPE}")


def manifest_entries(decisions: DataFrame, policy: Policy, detectors: Sequence = (), *, keep: Sequence[str] = ()) -> DataFrame:
    return decisions.select(
        F.lit(MANIFEST_VERSION).alias("version"), F.lit(policy_fingerprint(policy, detectors)).alias("policy_fingerprint"),
        "root", "source_path", "size", "mtime_ms", "disposition", "sanitized_text", "findings", "detector_status", *keep)


def write_manifest(decisions: DataFrame, path: str, policy: Policy, detectors: Sequence = ()) -> None:
    """Write the decisions, spread and sorted by source path.

    Paths are unique, so the hash spreads evenly even if one root holds all
    files, and the sort within a file gives a scan useful min/max statistics.
    """
    manifest_entries(decisions, policy, detectors).repartition("root", "source_path") \
        .sortWithinPartitions("source_path").write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str, policy: Policy, detectors: Sequence = ()) -> DataFrame:
    """Entries of the manifest that still apply to the policy and detectors; none on the first run."""
    try:
        entries = spark.read.schema(MANIFEST_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        entries = spark.createDataFrame([], MANIFEST_SCHEMA)
    return valid_entries(entries, policy_fingerprint(policy, detectors))


#: A manifest as a log: entries and removals with their versions; a removal with ``below`` holds for all paths below as well.
LOG_COLUMNS = "major long, minor long, delta long, removed boolean, below boolean"
MANIFEST_LOG_SCHEMA = f"{MANIFEST_SCHEMA}, {LOG_COLUMNS}"
_VERSION = ("major", "minor", "delta")


def manifest_log(spark: SparkSession, folder: str) -> DeltaLog:
    """A manifest that is written as deltas: a run or a batch adds what it decided anew and what is gone, nothing else.

    Of a path the highest version counts: (major, minor), the modification time and event of a
    stream or the number of a run; of equal ones the later delta's.
    """
    return DeltaLog(spark, folder, MANIFEST_LOG_SCHEMA)


def delta_number(name: str) -> Column:
    return F.lit(int(name.split("-")[1])).cast("long")


def log_entries(decisions: DataFrame, policy: Policy, detectors: Sequence, name: str, major: Column, minor: Column) -> DataFrame:
    """Log rows of decisions (columns of ``manifest_entries``) for the delta of this name."""
    keyed = decisions.withColumn("major", major.cast("long")).withColumn("minor", minor.cast("long"))
    entries = manifest_entries(keyed, policy, detectors, keep=("major", "minor"))
    return entries.select("*", delta_number(name).alias("delta"), F.lit(False).alias("removed"), F.lit(False).alias("below"))


def log_removals(paths: DataFrame, name: str, major: Column, minor: Column, *, below: bool) -> DataFrame:
    """Log rows that remove paths (root, source_path)."""
    own = paths.select("root", "source_path", major.cast("long").alias("major"), minor.cast("long").alias("minor"))
    fields = {f.name: f for f in paths.sparkSession.createDataFrame([], MANIFEST_LOG_SCHEMA).schema}
    known = {"root", "source_path", "major", "minor"}
    given = {"delta": delta_number(name), "removed": F.lit(True), "below": F.lit(below)}
    return own.select(*(F.col(c) if c in known else given.get(c, F.lit(None)).cast(f.dataType).alias(c) for c, f in fields.items()))


def _latest(log: DataFrame) -> DataFrame:
    """The highest version per path, on narrow columns: root, source_path, major, minor, delta, removed."""
    return log.groupBy("root", "source_path").agg(F.max(F.struct(*_VERSION, "removed")).alias("top")).select("root", "source_path", "top.*")


def current_log_entries(log: DataFrame) -> DataFrame:
    """Entries that hold: the latest of their path, with no later removal of the path or of a directory above it."""
    latest = _latest(log).where("NOT removed").drop("removed")
    version = F.struct(*_VERSION)
    gone = log.where("removed AND below").groupBy("root", F.col("source_path").alias("directory")).agg(F.max(version).alias("removed_at"))
    held = with_directories_above(latest, gone, ["root"], "source_path", ["removed_at"]).where(
        ~F.exists("above", lambda e: e["removed_at"] > version)).drop("above")
    key = ["root", "source_path", *_VERSION]
    return log.where("NOT removed").join(held, key, "left_semi")


def short_log(log: DataFrame) -> DataFrame:
    """A shorter log with the same entries, now and after any later row: current entries, the latest removals of every kind."""
    key = ["root", "source_path", *_VERSION]
    last = _latest(log).where("removed").drop("removed")
    below = log.where("removed AND below").groupBy("root", "source_path").agg(F.max(F.struct(*_VERSION)).alias("top")).select("root", "source_path", "top.*")
    removals = log.where("removed").join(last.unionByName(below).distinct(), key, "left_semi")
    return current_log_entries(log).unionByName(removals)


def current_manifest(spark: SparkSession, folder: str, policy: Policy, detectors: Sequence = (), *, before: str | None = None) -> DataFrame:
    """The entries of a manifest log that apply to the policy and detectors; none on the first run."""
    entries = current_log_entries(manifest_log(spark, folder).read(before))
    return valid_entries(entries.drop(*(c.split()[0] for c in LOG_COLUMNS.split(", "))), policy_fingerprint(policy, detectors))


STAGED_SCHEMA = "root string, workspace string, path string, disposition string, text string, content binary, delta long, removed boolean"


def staged_log(spark: SparkSession, folder: str) -> DeltaLog:
    """The staged copy as a log: a run adds what has changed and what may not be shared any more."""
    return DeltaLog(spark, folder, STAGED_SCHEMA)


def staged_delta(changed: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Log rows of changed items (with text, content, disposition) and of paths (root, path) that leave the copy."""
    blank = {"text": "string", "content": "binary", "disposition": "string"}
    items = staged_items(changed.withColumn("content", F.col("content") if "content" in changed.columns else F.lit(None).cast("binary")).drop("cache_hit"))
    left = gone.unionByName(changed.where(F.col("disposition") == BLOCKED).select("root", "path")).select(
        "root", workspace_key(F.col("root")).alias("workspace"), "path", *(F.lit(None).cast(t).alias(c) for c, t in blank.items()))
    rows = items.withColumn("removed", F.lit(False)).unionByName(left.withColumn("removed", F.lit(True)))
    return rows.select(*(c if c != "delta" else delta_number(name).alias("delta") for c in (f.split()[0] for f in STAGED_SCHEMA.split(", "))))


def current_staged(log: DataFrame) -> DataFrame:
    """The staged copy that a log stands for."""
    latest = log.groupBy("root", "path").agg(F.max(F.struct("delta", "removed")).alias("top")).select("root", "path", "top.*").where("NOT removed")
    return log.join(latest, ["root", "path", "delta", "removed"], "left_semi")


def read_staged(spark: SparkSession, folder: str) -> DataFrame:
    """root, workspace, path, disposition, text and content of all items that are shared now."""
    return current_staged(staged_log(spark, folder).read()).drop("delta", "removed")


def staged_items(items: DataFrame) -> DataFrame:
    """What may be shared: blocked items left out, sanitised text where it differs.

    Original bytes go along only where there is no text.
    """
    text = F.when(F.col("disposition") == WRITE_SANITIZED_TEXT, F.col("sanitized_text")).otherwise(F.col("text"))
    return items.filter(F.col("disposition") != BLOCKED).select(
        "root", workspace_key(F.col("root")).alias("workspace"), "path", "disposition", text.alias("text"),
        *[c for c in ("cache_hit",) if c in items.columns],
        *[F.when(text.isNull(), F.col(c)).alias(c) for c in ("content",) if c in items.columns])


def write_staged(items: DataFrame, path: str) -> None:
    """Write the sanitised copy, one folder per workspace."""
    staged_items(items).write.mode("overwrite").partitionBy("workspace").parquet(path)
