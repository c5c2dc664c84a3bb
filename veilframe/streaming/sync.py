"""Keeping the sanitised copy current from a stream of change events.

The staged log grows by deltas (see ``sources.deltas``): every micro-batch writes one
version per changed path into its own folder, once; a replayed batch finds it there.  The
current state is the highest (mtime_ms, event_id) per path, so late and repeated events
change nothing and no merge into existing files is needed.  The stream folds its logs
into bases as they grow.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import in_skipped_directory, is_under, normalize, relative_path
from ..operators.intervals import with_directories_above
from ..operators.reuse import reuse_decisions
from ..operators.rollups import sync_status
from ..operators.rules import BLOCKED, FINDINGS_TYPE, WRITE_SANITIZED_TEXT, apply_policy
from ..policy import Policy
from ..sources.deltas import DeltaLog
from ..sources.manifest import current_manifest, log_entries, log_removals, manifest_log, short_log
from ..sources.scratch import new_folder, removed

UPDATED, REMOVED, IGNORED = "UPDATED", "REMOVED", "IGNORED"

CHANGES_SCHEMA = ("event_id long, root string, path string, op string, text string, size long, mtime_ms long")

LOG_SCHEMA = ("root string, path string, event_id long, mtime_ms long, op string, action string, status string, "
              f"disposition string, sanitized_text string, findings {FINDINGS_TYPE}, cache_hit boolean, batch_id long")


def collapse_changes(events: DataFrame, key: Sequence[str] = ("root", "path"), *,
                     version: Sequence[str] = ("mtime_ms", "event_id")) -> DataFrame:
    """Latest event per path; of events that repeat the latest version, one.

    A partial aggregation leaves one event per path and task, so a hot path costs one row per
    task, and texts move once.
    """
    others = [c for c in events.columns if c not in key]
    latest = events.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("_latest"))
    return latest.select(*(c if c in key else F.col("_latest").getField(c).alias(c) for c in events.columns))


def decide_batch(changes: DataFrame, policy: Policy, *, manifest: DataFrame | None = None,
                 detectors: Sequence = (), collapsed: bool = False) -> DataFrame:
    """Decisions on the latest versions of the changed paths, with ``action`` and ``cache_hit``.

    Paths are normalised first, so different spellings are one path.  Events outside
    the root or under a skipped directory are IGNORED; deleted and blocked files are REMOVED.
    Changes that are ``collapsed`` have one event per normalised path already.
    """
    latest = changes if collapsed else collapse_changes(changes.withColumn("path", normalize(F.col("path"))))
    latest = latest.withColumnRenamed("path", "source_path")
    outside = ~is_under(F.col("source_path"), normalize(F.col("root")))
    rel = relative_path(F.col("root"), F.col("source_path"))
    routed = latest.withColumn("path", rel).withColumn(
        "ignored", outside | F.coalesce(in_skipped_directory(rel), F.lit(False)))
    # Deleted and ignored paths have no text to evaluate.
    gone = F.col("ignored") | (F.col("op") == "DELETE")
    routed = routed.withColumn("gone", gone)
    if manifest is None:
        evaluated = apply_policy(routed.withColumn("text", F.when(~F.col("gone"), F.col("text"))), policy,
                                 detectors=detectors).withColumn("cache_hit", F.lit(False))
    else:
        evaluated = reuse_decisions(routed, manifest, policy, detectors=detectors, live=~F.col("gone"))
    blocked = F.coalesce(F.col("disposition") == BLOCKED, F.lit(False))
    action = F.when(F.col("ignored"), IGNORED).when((F.col("op") == "DELETE") | blocked, REMOVED).otherwise(UPDATED)
    return evaluated.withColumn("blocked", blocked).withColumn("action", action)


def log_rows(decided: DataFrame) -> DataFrame:
    """The rows of the staged log for the decisions of a batch."""
    shared, gone = F.col("action") == UPDATED, F.col("gone")

    def only(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    return decided.select(
        "root", F.col("source_path").alias("path"), "event_id", "mtime_ms", "op", "action",
        F.when(shared, sync_status(F.lit(0), F.when(F.col("disposition") == WRITE_SANITIZED_TEXT, 1).otherwise(0)))
        .when(F.col("blocked") & ~gone, "blocked").alias("status"),
        only(~gone, F.col("disposition")).alias("disposition"),
        only(shared, F.coalesce("sanitized_text", "text")).alias("sanitized_text"),
        F.when(~gone, F.col("findings")).otherwise(F.array().cast(FINDINGS_TYPE)).alias("findings"),
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"))


def sync_batch(changes: DataFrame, policy: Policy, *, manifest: DataFrame | None = None,
               detectors: Sequence = ()) -> DataFrame:
    """New versions of the changed paths as log rows; ``path`` is absolute."""
    return log_rows(decide_batch(changes, policy, manifest=manifest, detectors=detectors))


def manifest_delta(decided: DataFrame, policy: Policy, detectors: Sequence, name: str) -> DataFrame:
    """What a batch adds to the manifest log: new decisions, and removals that hold for all paths below.

    Versions are (mtime_ms, event_id), so events older than what the log has of their path
    change nothing, whenever they are written.
    """
    version = (F.col("mtime_ms"), F.col("event_id"))
    fresh = decided.filter(~F.col("gone") & ~F.coalesce("cache_hit", F.lit(False)))
    deleted = decided.filter((F.col("op") == "DELETE") & (F.col("action") != IGNORED))
    return log_entries(fresh, policy, detectors, name, *version).unionByName(log_removals(deleted, name, *version, below=True))


#: Batches whose deltas gather before a stream folds its logs.
FOLD_AFTER = 16


def sync_stream(changes: DataFrame, policy: Policy, staged_log: str, checkpoint: str, *,
                manifest: Callable[[], DataFrame] | None = None, manifest_folder: str | None = None,
                detectors: Sequence = (), trigger: dict | None = None, fold_after: int = FOLD_AFTER) -> StreamingQuery:
    """Run the synchronisation over a streaming frame of change events.

    With ``manifest_folder`` the stream reads the manifest log there before every batch and
    adds the batch's new decisions after it (see ``sources.manifest``), so unchanged files are
    never evaluated again, by any later stream; ``manifest`` only reads one.  What a batch
    writes depends on its own events.  Once more than ``fold_after`` deltas have gathered, the
    stream folds them.  By default it handles what is there and stops; pass ``trigger`` (say
    ``{"processingTime": "10 seconds"}``) to keep it running.
    """
    DeltaLog(changes.sparkSession, staged_log, LOG_SCHEMA).claim(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, target = batch.sparkSession, f"batch_id={batch_id}"
        staged = DeltaLog(spark, staged_log, LOG_SCHEMA)
        if manifest_folder is None:
            known = None if manifest is None else manifest()
            staged.append(sync_batch(batch, policy, manifest=known, detectors=detectors), target)
        else:
            log = manifest_log(spark, manifest_folder)
            name, working = log.name(f"{checkpoint}:{batch_id}"), new_folder(spark, "sync-batch")
            known = current_manifest(spark, manifest_folder, policy, detectors, before=name)
            decided = decide_batch(batch, policy, manifest=known, detectors=detectors)
            # Both logs are written from this; of a text only what they take is kept.
            text = F.when((F.col("action") == UPDATED) & F.col("sanitized_text").isNull(), F.col("text"))
            decided.withColumn("text", text).write.parquet(working)
            decided = spark.read.parquet(working)
            staged.append(log_rows(decided), target)
            log.append(manifest_delta(decided, policy, detectors, name), name)
            removed(spark, working)
            log.fold(short_log, after=fold_after)
        staged.fold(compacted, after=fold_after)

    return (changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_staged_log(spark: SparkSession, staged_log: str) -> DataFrame:
    """All versions of a staged log: its base and the batches after it, or whatever batches lie below the folder."""
    log = DeltaLog(spark, staged_log, LOG_SCHEMA)
    base, deltas = log.state()
    return log.read() if base or deltas else spark.read.schema(LOG_SCHEMA).parquet(staged_log)


def compacted(log: DataFrame) -> DataFrame:
    """A shorter log with the same current state, now and after any later event.

    Keeps the latest version per path, and the latest removal as well: it also
    rules everything below the path.
    """
    effective = log.filter(F.col("action") != IGNORED)
    removals = collapse_changes(effective.filter((F.col("op") == "DELETE") & (F.col("action") == REMOVED)))
    return collapse_changes(effective).unionByName(removals).distinct()


def current_state(log: DataFrame) -> DataFrame:
    """Latest version per path that is staged now.

    Removing a directory removes everything below it that is not newer.
    """
    latest = collapse_changes(log.filter(F.col("action") != IGNORED))
    staged = latest.filter(F.col("action") == UPDATED)
    version = F.struct("mtime_ms", "event_id")
    removals = log.filter(F.col("op") == "DELETE").filter(F.col("action") == REMOVED) \
        .groupBy("root", F.col("path").alias("directory")).agg(F.max(version).alias("removed_at"))
    overtaken = with_directories_above(staged.select("root", "path", version.alias("version")), removals, ["root"], "path", ["removed_at"]) \
        .where(F.exists("above", lambda e: e["removed_at"] > F.col("version"))).select("root", "path")
    return staged.join(overtaken, ["root", "path"], "left_anti")
