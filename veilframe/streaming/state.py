"""Synchronisation on keyed state: what is known of a path lives in the stream's state store.

Per (root, path) the store has the last version, size, operation and policy.  So late and
repeated events, events of one path in one batch and files that have not changed are
told apart where the event is, without a join with a manifest or with the staged log; only
what is left is evaluated and written.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.paths import normalize
from ..policy import Policy, policy_fingerprint
from ..sources.deltas import DeltaLog
from .sync import CHANGES_SCHEMA, FOLD_AFTER, LOG_SCHEMA, compacted, decide_batch, log_rows

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestChange(StatefulProcessor):
    """Lets the latest event of a path through if it is newer than all before and its file has changed, or the policy has."""

    def __init__(self, fingerprint: str):
        self.fingerprint = fingerprint

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "mtime_ms long, event_id long, op string, size long, policy string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r.mtime_ms, r.event_id))
        known = self.seen.get()
        if known is not None and (known[0], known[1]) >= (last.mtime_ms, last.event_id):
            return
        self.seen.update((last.mtime_ms, last.event_id, last.op, last.size, self.fingerprint))
        same_file = known is not None and (known[0], known[3], known[4]) == (last.mtime_ms, last.size, self.fingerprint)
        if not same_file or "DELETE" in (last.op, known[2]):
            yield last

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state needs this store; the session's own setting comes back once the query has begun."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def latest_changes(changes: DataFrame, policy: Policy, detectors: Sequence = ()) -> DataFrame:
    """The events of a stream (``CHANGES_SCHEMA``) that matter, paths normalised; a file that changed without its time or size is not seen."""
    events = changes.withColumn("path", normalize(F.col("path"))).select(*(f.split()[0] for f in CHANGES_SCHEMA.split(", ")))
    return events.groupBy("root", "path").transformWithState(
        LatestChange(policy_fingerprint(policy, detectors)), CHANGES_SCHEMA, outputMode="Append", timeMode="None")


def sync_state_stream(changes: DataFrame, policy: Policy, staged_log: str, checkpoint: str, *, detectors: Sequence = (),
                      trigger: dict | None = None, fold_after: int = FOLD_AFTER) -> StreamingQuery:
    """``sync_stream`` with its memory in the state store below ``checkpoint``, which a restarted stream goes on with.

    The staged log is the same.  A batch costs a shuffle of its own events and the state of
    their paths; no table of all paths is read.
    """
    DeltaLog(changes.sparkSession, staged_log, LOG_SCHEMA).claim(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        log = DeltaLog(batch.sparkSession, staged_log, LOG_SCHEMA)
        log.append(log_rows(decide_batch(batch, policy, detectors=detectors, collapsed=True)), f"batch_id={batch_id}")
        log.fold(compacted, after=fold_after)

    with _state_store(changes.sparkSession):
        return (latest_changes(changes, policy, detectors).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


# The processor runs in Python workers that may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
