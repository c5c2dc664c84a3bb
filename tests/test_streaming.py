from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilframe import (collapse_changes, current_manifest, current_state, load_policy, read_staged_log, run_lines, sanitize_turns, sync_batch,
                       sync_state_stream, sync_stream)
from veilframe.sources.deltas import DeltaLog
from veilframe.sources.manifest import MANIFEST_SCHEMA, manifest_entries, manifest_log, short_log
from veilframe.sources.scratch import written
from veilframe.streaming.sync import CHANGES_SCHEMA, LOG_SCHEMA, compacted, decide_batch, manifest_delta

POLICY = load_policy({"version": 1, "rules": [
    {"id": "keys", "match": {"paths": ["**/*.jks"]}, "action": {"type": "block"}},
    {"id": "stop", "match": {"content_regex": ["stop"]}, "action": {"type": "block"}},
    {"id": "word", "match": {"content_regex": ["secret"]}, "action": {"type": "redact"}}]})


def event(number, path, text, at, op="MODIFY"):
    return (number, "/w", path, op, text, len(text or ""), at)


BATCHES = [
    [event(1, "/w/a", "clean", 10, "CREATE"), event(2, "/w/b", "secret", 10), event(3, "/w/d/x", "one", 10), event(4, "/w/d/y", "two", 10),
     event(5, "/w/build/o", "no", 10), event(6, "/v/z", "no", 10), event(7, "/w/k/k.jks", "k", 10), event(8, "/w/s", "ok", 10)],
    [event(11, "/w/a", "secret now", 20), event(12, "/w/a", "old", 5), event(13, "/w/b", "clean again", 20), event(14, "/w/s", "stop", 20)],
    [event(21, "/w/d", None, 30, "DELETE"), event(22, "/w/d/y", "later", 40), event(23, "/w/a", "late", 15)],
    [event(22, "/w/d/y", "later", 40)],  # a repeated event
]

EXPECTED = {"/w/a": ("redacted", "<redacted> now"), "/w/b": ("pass-through", "clean again"), "/w/d/y": ("pass-through", "later")}


def write_batches(spark, folder):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, CHANGES_SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")


def states(log):
    return {r.path: (r.status, r.sanitized_text) for r in current_state(log).collect()}


def test_sync_over_batches(spark, tmp_path):
    write_batches(spark, tmp_path / "changes")
    for i in range(len(BATCHES)):
        changes = spark.readStream.schema(CHANGES_SCHEMA).parquet(str(tmp_path / "changes" / str(i)))
        sync_stream(changes, POLICY, str(tmp_path / "log" / f"part={i}"), str(tmp_path / f"checkpoint{i}")).awaitTermination()
    log = read_staged_log(spark, str(tmp_path / "log"))
    assert states(log) == EXPECTED
    short = compacted(log)
    assert states(short) == EXPECTED and short.count() < log.count()
    actions = {(r.path, r.event_id): r.action for r in log.collect()}
    assert actions[("/w/build/o", 5)] == actions[("/v/z", 6)] == "IGNORED"
    assert actions[("/w/k/k.jks", 7)] == actions[("/w/s", 14)] == "REMOVED"
    assert ("/w/a", 12) not in actions  # collapsed within its batch
    assert "no" not in {r.sanitized_text for r in log.collect()}


def test_one_stream_with_many_batches_equals_the_batch(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, CHANGES_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
    changes = spark.readStream.schema(CHANGES_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "changes"))
    sync_stream(changes, POLICY, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    log = read_staged_log(spark, str(tmp_path / "log"))
    assert log.select("batch_id").distinct().count() == len(BATCHES)
    assert states(log) == EXPECTED
    # a replayed batch overwrites its own folder
    again = spark.createDataFrame(BATCHES[1], CHANGES_SCHEMA)
    sync_batch(again, POLICY).write.mode("overwrite").parquet(str(tmp_path / "log" / "batch_id=1"))
    assert states(read_staged_log(spark, str(tmp_path / "log"))) == EXPECTED


def test_compaction_keeps_the_removal_of_a_path_that_became_a_file(spark):
    rows = [event(1, "/w/d/x", "one", 10), event(2, "/w/d", None, 30, "DELETE"), event(3, "/w/d", "file", 50)]
    log = None
    for row in rows:
        version = sync_batch(spark.createDataFrame([row], CHANGES_SCHEMA), POLICY).withColumn("batch_id", F.lit(row[0]))
        log = version if log is None else log.unionByName(version)
    log = written(log, "log")  # a staged log is a table
    late = sync_batch(spark.createDataFrame([event(4, "/w/d/y", "late", 20)], CHANGES_SCHEMA), POLICY).withColumn("batch_id", F.lit(9))
    expected = {"/w/d": ("pass-through", "file")}
    assert states(log) == states(compacted(log)) == expected
    assert states(compacted(log).unionByName(late)) == expected


def test_sync_reuses_the_manifest(spark):
    from veilframe.policy import policy_fingerprint
    changes = spark.createDataFrame(BATCHES[0], CHANGES_SCHEMA)
    known = spark.createDataFrame([("/w", "/w/a", 5, 10)], "root string, source_path string, size long, mtime_ms long").select(
        F.lit(1).alias("version"), F.lit(policy_fingerprint(POLICY)).alias("policy_fingerprint"), "*",
        F.lit("WRITE_SANITIZED_TEXT").alias("disposition"), F.lit("stored").alias("sanitized_text"),
        F.array().cast("array<struct<target:string,action:string,source:string,message:string,rule_id:string>>").alias("findings"))
    out = {r.path: (r.action, r.sanitized_text) for r in sync_batch(changes, POLICY, manifest=known).collect()}
    assert out["/w/a"] == ("UPDATED", "stored") and out["/w/b"] == ("UPDATED", "<redacted>")
    assert out["/w/k/k.jks"][0] == "REMOVED" and out["/w/build/o"][0] == "IGNORED"


def test_collapse(spark):
    rows = [event(1, "a", "x", 5), event(3, "a", "y", 5), event(2, "a", "z", 4), event(9, "b", None, 1)]
    out = {r.path: r.event_id for r in collapse_changes(spark.createDataFrame(rows, CHANGES_SCHEMA)).collect()}
    assert out == {"a": 3, "b": 9}


def test_lines_stream_equals_batch(spark, tmp_path):
    lines = spark.createDataFrame([("a secret",), ("/cmd secret",), ("  ",), ("stop",), ("fine",)], "text string")
    lines.repartition(3).write.parquet(str(tmp_path / "in"))
    typed = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_lines(typed, POLICY, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(sanitize_turns(lines, POLICY).collect())


def test_keyed_state_ignores_what_is_known(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for i, rows in enumerate(BATCHES + [[event(30, "/w/b", "clean again", 20), event(31, "/w/./s", "ok now", 50)]]):
        spark.createDataFrame(rows, CHANGES_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        # Each run goes on with the state of the one before.
        changes = spark.readStream.schema(CHANGES_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "changes"))
        sync_state_stream(changes, POLICY, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    log = read_staged_log(spark, str(tmp_path / "log"))
    assert states(log) == EXPECTED | {"/w/s": ("pass-through", "ok now")}
    passed = sorted(r.event_id for r in log.collect())
    # 12: older than 11; 23: late; the second 22: repeated; 30: the file is as it was.
    assert passed == [1, 2, 3, 4, 5, 6, 7, 8, 11, 13, 14, 21, 22, 31]


def test_another_policy_is_not_what_is_known(spark, tmp_path):
    def run(policy, row):
        spark.createDataFrame([row], CHANGES_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        changes = spark.readStream.schema(CHANGES_SCHEMA).parquet(str(tmp_path / "changes"))
        sync_state_stream(changes, policy, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    run(POLICY, event(1, "/w/a", "a secret", 10))
    run(load_policy({"version": 1, "rules": []}), event(2, "/w/a", "a secret", 10))
    assert states(read_staged_log(spark, str(tmp_path / "log"))) == {"/w/a": ("pass-through", "a secret")}


def data(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_a_batch_writes_its_own_changes(spark, tmp_path):
    many = [event(i, f"/w/m{i}", f"text {i} secret", 10) for i in range(300)]
    rounds = [many, [event(1000, "/w/m7", "new", 20)], [event(1001, "/w/m8", None, 30, "DELETE"), event(1002, "/w/m9", "text 9 secret", 10)]]
    written_rows = []
    for rows in rounds:
        spark.createDataFrame(rows, CHANGES_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        before = data(tmp_path / "manifest") | data(tmp_path / "log")
        changes = spark.readStream.schema(CHANGES_SCHEMA).parquet(str(tmp_path / "changes"))
        sync_stream(changes, POLICY, str(tmp_path / "log"), str(tmp_path / "checkpoint"), manifest_folder=str(tmp_path / "manifest")).awaitTermination()
        after = data(tmp_path / "manifest") | data(tmp_path / "log")
        assert all(after[p] == t for p, t in before.items())
        new = [p for p in after if p not in before]
        written_rows.append([sum(spark.read.parquet(str(p)).count() for p in new if part in str(p)) for part in ("/manifest/", "/log/")])
    assert written_rows == [[300, 300], [1, 1], [1, 2]]  # an unchanged file is in the log of the batch, not in the manifest's
    known = current_manifest(spark, str(tmp_path / "manifest"), POLICY)
    assert known.count() == 299 and known.where("source_path = '/w/m8'").isEmpty()
    assert [r.sanitized_text for r in known.where("source_path = '/w/m9'").collect()] == ["text 9 <redacted>"]


def test_a_repeated_batch_leaves_its_readers_alone(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path / "log"), LOG_SCHEMA)
    rows = sync_batch(spark.createDataFrame(BATCHES[0], CHANGES_SCHEMA), POLICY)
    assert log.append(rows, "batch_id=0")
    reader, files = read_staged_log(spark, str(tmp_path / "log")), data(tmp_path / "log")
    assert not log.append(rows, "batch_id=0")
    assert data(tmp_path / "log") == files and reader.count() == 8


def test_a_stream_folds_its_logs(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, CHANGES_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
    changes = spark.readStream.schema(CHANGES_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "changes"))
    sync_stream(changes, POLICY, str(tmp_path / "log"), str(tmp_path / "checkpoint"), manifest_folder=str(tmp_path / "manifest"), fold_after=1).awaitTermination()
    assert states(read_staged_log(spark, str(tmp_path / "log"))) == EXPECTED
    base, deltas = DeltaLog(spark, str(tmp_path / "log"), LOG_SCHEMA).state()
    assert base and len(deltas) <= 1
    known = {r.source_path: r.mtime_ms for r in current_manifest(spark, str(tmp_path / "manifest"), POLICY).collect()}
    assert known == {"/w/a": 20, "/w/b": 20, "/w/d/y": 40, "/w/k/k.jks": 10, "/w/s": 20}


def test_late_events_after_a_fold_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "m")
    for n, rows in enumerate([BATCHES[0], BATCHES[2], [event(40, "/w/d/x", "late", 20)]]):
        log = manifest_log(spark, folder)
        name = log.name(str(n))
        decided = decide_batch(spark.createDataFrame(rows, CHANGES_SCHEMA), POLICY, manifest=current_manifest(spark, folder, POLICY))
        log.append(manifest_delta(decided, POLICY, (), name), name)
        log.fold(short_log)
    known = {r.source_path for r in current_manifest(spark, folder, POLICY).collect()}
    assert "/w/d/x" not in known and {"/w/d/y", "/w/a"} <= known


def test_a_log_has_one_stream(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame(BATCHES[i], CHANGES_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        changes = spark.readStream.schema(CHANGES_SCHEMA).parquet(str(tmp_path / "changes"))
        sync_stream(changes, POLICY, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    assert read_staged_log(spark, str(tmp_path / "log")).select("batch_id").distinct().count() == 2
    for start in (sync_stream, sync_state_stream):
        with pytest.raises(ValueError, match="is the log of"):
            start(changes, POLICY, str(tmp_path / "log"), str(tmp_path / "another"))


def test_texts_of_a_batch_move_once(spark):
    rows = [(i, "/w", f"/w/{i % 7}", "CREATE", f"text {i}", 5, i) for i in range(30)]
    changes = spark.createDataFrame(rows, CHANGES_SCHEMA)
    known = spark.createDataFrame([], MANIFEST_SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame, most in ((collapse_changes(changes), 1), (decide_batch(changes, POLICY, manifest=known), 2)):
            plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert plan.count("Exchange hashpartitioning") <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decisions_beside_deleted_and_unknown_files(spark):
    rows = [(1, "/w", "/w/a", "CREATE", "one", 3, 10), (2, "/w", "/w/b", "DELETE", None, None, 20), (3, "/w", "/w/c", "CREATE", "x", 9, 30), (4, "/w", "/w/d", "CREATE", "y", 1, 40)]
    first = decide_batch(spark.createDataFrame(rows, CHANGES_SCHEMA), POLICY, manifest=spark.createDataFrame([], MANIFEST_SCHEMA))
    known = manifest_entries(first.filter("NOT gone"), POLICY).cache()
    rows[2], rows[3] = (5, "/w", "/w/c", "CREATE", "xx", 10, 30), (6, "/w", "/w/d", "CREATE", "y", 1, 41)
    rows += [(7, "/w", "/w/e", "CREATE", "z", 1, 50), (8, "/w", "/w/f", "CREATE", None, None, 60)]
    again = {r.source_path: r for r in decide_batch(spark.createDataFrame(rows, CHANGES_SCHEMA), POLICY, manifest=known).collect()}
    assert {p: r.cache_hit for p, r in again.items()} == {"/w/a": True, "/w/b": None, "/w/c": False, "/w/d": False, "/w/e": False, "/w/f": None}
    assert {p: (r.text, r.disposition is None) for p, r in again.items()} == {
        "/w/a": ("one", False), "/w/b": (None, True), "/w/c": ("xx", False), "/w/d": ("y", False), "/w/e": ("z", False), "/w/f": (None, True)}
