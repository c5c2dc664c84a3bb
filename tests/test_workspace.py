import ctypes
import os
import random
import struct
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilframe import (apply_policy, evaluate_workspace, invalidate_prefix, list_workspace, load_policy, read_contents, read_manifest, read_staged,
                       read_workspace, removed_paths, reuse_decisions, run_tree, write_manifest, write_staged)
from veilframe.operators import reuse
from veilframe.plans.flows import contents, decoded
from veilframe.policy import policy_fingerprint
from veilframe.sources import workspace
from veilframe.sources.deltas import DeltaLog
from veilframe.sources.manifest import current_manifest, manifest_log
from veilframe.sources.scratch import new_folder, shared_folder, written

POLICY = load_policy({"version": 1, "rules": [
    {"id": "keys", "match": {"paths": ["**/*.jks"]}, "action": {"type": "block"}},
    {"id": "word", "match": {"content_regex": ["secret"]}, "action": {"type": "redact"}}]})


def write(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())


@pytest.mark.parametrize("a_round", [1, 3, 256])
def test_listing(spark, tmp_path, a_round):
    files = {f"d{i}/e{i % 3}/f{i}.txt": f"text {i}" for i in range(12)} | {
        ".env": "A=1", ".hidden/x": "y", "_under/z": "z", "src/build/no": "", "node_modules/no": "", ".git/no": "",
        "build.txt": "kept", "src/out.kt": "kept", "bin": b"\xff\x00"}
    write(tmp_path / "w", files)
    write(tmp_path / "outside", {"linked.txt": "no"})
    os.symlink(tmp_path / "outside", tmp_path / "w" / "link")
    os.symlink(tmp_path / "outside" / "linked.txt", tmp_path / "w" / "file-link")
    listed = list_workspace(spark, str(tmp_path / "w"), directories_a_round=a_round)
    frame = read_contents(listed)
    rows = {r.path: r for r in frame.collect()}
    assert len(rows) == frame.count()
    assert set(rows) == {f for f in files if not f.endswith("/no")}
    assert bytes(rows["bin"].content) == b"\xff\x00"
    stat = (tmp_path / "w" / ".env").stat()
    assert (rows[".env"].size, rows[".env"].mtime_ms) == (3, stat.st_mtime_ns // 1_000_000)
    assert rows[".env"].source_path == str(tmp_path / "w" / ".env")
    big = b"x" * (1 << 20)
    write(tmp_path / "big", {f"b{i}": big for i in range(40)})  # more than one Arrow batch
    assert read_workspace(spark, str(tmp_path / "big")).filter(F.length("content") == 1 << 20).count() == 40
    names = read_workspace(spark, str(tmp_path / "w"), content=False)
    assert names.filter("content is not null").count() == 0 and names.count() == len(rows)


def test_deep_and_wide_trees_are_listed_in_rounds(spark, tmp_path):
    deep = tmp_path / "w" / "/".join("d" * 1 for _ in range(60))
    deep.mkdir(parents=True)
    (deep / "end").write_text("x")
    write(tmp_path / "w", {f"wide/{i}/f": "y" for i in range(70)})
    for a_round in (16, 1000):
        listed = list_workspace(spark, str(tmp_path / "w"), directories_a_round=a_round)
        assert listed.count() == listed.select("path").distinct().count() == 71
    with pytest.raises(NotADirectoryError):
        list_workspace(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert read_workspace(spark, str(tmp_path / "empty")).count() == 0


def test_files_are_packed_by_size_and_large_ones_read_in_ranges(spark, tmp_path):
    rng = random.Random(1)
    files = {f"f{i}": rng.randbytes(rng.choice([0, 1, 999, 1000, 1001, 5000])) for i in range(60)}
    write(tmp_path / "w", files)
    listed = list_workspace(spark, str(tmp_path / "w"))
    out = read_contents(listed, pack_bytes=4000, range_bytes=1000)
    assert {r.path: bytes(r.content) for r in out.collect()} == files
    packs = workspace._packs(listed.select("source_path", F.lit(0).cast("long").alias("offset"), F.col("size").alias("length")), 200_000)
    sums = packs.groupBy("pack").agg(F.sum(F.col("length") + workspace.OPEN_BYTES).alias("n")).collect()
    assert len(sums) > 10 and all(r.n <= 200_000 + 5000 + workspace.OPEN_BYTES for r in sums)


def test_files_that_change_after_the_listing(spark, tmp_path):
    write(tmp_path / "w", {"a": "a" * 3000, "b": "b" * 3000, "c": "c", "d": "d"})
    listed = written(list_workspace(spark, str(tmp_path / "w")), "listed")
    write(tmp_path / "w", {"a": "new" * 1500, "c": "longer"})
    os.remove(tmp_path / "w" / "b")
    os.remove(tmp_path / "w" / "d")
    rows = {r.path: r for r in read_contents(listed, range_bytes=1000).collect()}
    assert {k: (bytes(r.content), r.size) for k, r in rows.items()} == {"a": (b"new" * 1500, 4500), "c": (b"longer", 6)}


class Opens:
    """Counts openings of the files of some directories, by any process."""

    def __init__(self, *directories):
        self.libc = ctypes.CDLL(None, use_errno=True)
        self.fd = self.libc.inotify_init1(os.O_NONBLOCK)
        for directory in directories:
            assert self.libc.inotify_add_watch(self.fd, str(directory).encode(), 0x20) >= 0  # IN_OPEN

    def counted(self):
        found = Counter()
        try:
            while data := os.read(self.fd, 1 << 16):
                at = 0
                while at < len(data):
                    _, mask, _, size = struct.unpack_from("iIII", data, at)
                    name = data[at + 16:at + 16 + size].rstrip(b"\0").decode()
                    if not mask & 0x40000000 and name:  # IN_ISDIR
                        found[name] += 1
                    at += 16 + size
        except BlockingIOError:
            return dict(found)


def test_only_misses_are_opened_once(spark, tmp_path):
    root, folder = tmp_path / "w", str(tmp_path / "kept")
    write(root, {"src/a.txt": "clean", "src/b.txt": "a secret", "src/c.jks": "x", "lib/d.bin": b"\xff"})
    opens = Opens(root / "src", root / "lib")
    run_tree(spark, str(root), POLICY, folder).stats.collect()
    assert opens.counted() == {"a.txt": 1, "b.txt": 1, "c.jks": 1, "d.bin": 1}
    assert run_tree(spark, str(root), POLICY, folder).stats.first().cache_hits == 4
    assert opens.counted() == {}
    write(root, {"src/a.txt": "now a secret"})
    opens.counted()
    assert run_tree(spark, str(root), POLICY, folder).stats.first().cache_hits == 3
    assert opens.counted() == {"a.txt": 1}
    known = current_manifest(spark, f"{folder}/manifest", POLICY)
    run = evaluate_workspace(list_workspace(spark, str(root)), known, POLICY, read=contents)
    assert run.stats.first().cache_hits == 4 and opens.counted() == {}


def data_files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_a_run_writes_what_has_changed(spark, tmp_path):
    root, folder = tmp_path / "w", str(tmp_path / "kept")
    write(root, {f"d{i}/f{i}.txt": f"text {i}" for i in range(20)} | {"gone.txt": "x", "k/late.jks": "k", "bin": b"\xfe"})

    def state():
        shared = {r.path: r.text if r.text is not None else bytes(r.content) for r in read_staged(spark, f"{folder}/staged").collect()}
        return shared, {r.path for r in run.decisions.collect()}
    run = run_tree(spark, str(root), POLICY, folder)
    shared, _ = state()
    assert shared == {f"d{i}/f{i}.txt": f"text {i}" for i in range(20)} | {"gone.txt": "x", "bin": b"\xfe"}
    before = data_files(f"{folder}/staged") | data_files(f"{folder}/manifest")
    write(root, {"d3/f3.txt": "my secret"})
    run = run_tree(spark, str(root), POLICY, folder)
    after = data_files(f"{folder}/staged") | data_files(f"{folder}/manifest")
    assert all(after[f] == t for f, t in before.items())
    rows = [r for f in set(after) - set(before) for r in spark.read.parquet(f).collect()]
    assert sorted(r.asDict().get("path") or r.source_path for r in rows) == [str(root / "d3/f3.txt"), "d3/f3.txt"]
    os.remove(root / "gone.txt")
    os.rename(root / "d4" / "f4.txt", root / "d4" / "f4.jks")  # blocked under its new name
    for n in range(3):
        write(root, {"d5/f5.txt": f"round {'x' * n}"})
        run = run_tree(spark, str(root), POLICY, folder, fold_after=1)
    shared, _ = state()
    want = {f"d{i}/f{i}.txt": f"text {i}" for i in range(20) if i not in (3, 4, 5)} | {"d3/f3.txt": "my <redacted>", "d5/f5.txt": "round xx", "bin": b"\xfe"}
    assert shared == want and run.stats.first().cache_hits == 21
    entries = current_manifest(spark, f"{folder}/manifest", POLICY)
    assert {r.source_path for r in entries.collect()} == {str(root / p) for p in want} | {str(root / p) for p in ("k/late.jks", "d4/f4.jks")}
    assert len(manifest_log(spark, f"{folder}/manifest").versions()[0]) <= 2  # folded, older bases forgotten


def test_deltas(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path / "log"), "k string, v long")

    def rows(*values):
        return spark.createDataFrame(values, "k string, v long")

    def state():
        return sorted(tuple(r) for r in log.read().collect())
    assert state() == [] and log.name("a").startswith("delta-00000000-")
    first = log.name("a")
    assert log.append(rows(("x", 1)), first) and log.name("a") == first and log.name("b").startswith("delta-00000001-")
    reader = log.read()  # planned before the batch is repeated
    assert not log.append(rows(("x", 2)), first) and state() == [("x", 1)] == [tuple(r) for r in reader.collect()]
    (tmp_path / "log" / "delta-00000007-dead").mkdir()  # a writer that was lost
    assert log.append(rows(("x", 3), ("y", 1)), log.name("b"))

    def newest(df):
        return df.groupBy("k").agg(F.max("v").alias("v"))
    old = log.read()
    assert not log.fold(newest, after=2) and log.fold(newest)
    assert state() == [("x", 3), ("y", 1)] and old.count() == 3  # a reader of the time before still has its files
    assert log.state() == ("_base-00000001", []) and log.read(before="delta-00000001-z").count() == 2
    for n in range(4):
        log.append(rows(("x", 10 + n)), log.name(f"c{n}"))
        log.fold(newest)
    assert state() == [("x", 13), ("y", 1)] and len(log.versions()[0]) == 2


def run(spark, root, manifest=None):
    return evaluate_workspace(decoded(read_workspace(spark, str(root))), manifest, POLICY)


def test_second_run_reuses_decisions_until_a_file_changes(spark, tmp_path):
    root, folder = tmp_path / "w", str(tmp_path / "manifest")
    assert read_manifest(spark, folder, POLICY).count() == 0  # nothing written yet
    write(root, {"src/a.txt": "clean", "src/b.txt": "a secret", "src/c.jks": "x", "lib/d.txt": "clean"})
    first = run(spark, root)
    assert first.stats.first().asDict() == {"root": str(root), "mirrored": 3, "redacted": 1, "blocked": 1, "pass_through": 2, "cache_hits": 0}
    assert [r.directory for r in first.safe.collect()] == ["lib"]
    write_manifest(first.decisions, folder, POLICY)

    second = run(spark, root, read_manifest(spark, folder, POLICY))
    assert second.stats.first().cache_hits == 4
    columns = ["source_path", "disposition", "sanitized_text", "findings"]
    assert sorted(second.decisions.select(*columns).collect()) == sorted(first.decisions.select(*columns).collect())

    write(root, {"src/a.txt": "new secret"})
    third = run(spark, root, read_manifest(spark, folder, POLICY))
    changed = {r.path: (r.cache_hit, r.disposition, r.sanitized_text) for r in third.decisions.collect()}
    assert changed["src/a.txt"] == (False, "WRITE_SANITIZED_TEXT", "new <redacted>")
    assert third.stats.first().cache_hits == 3

    os.remove(root / "lib" / "d.txt")
    files = decoded(read_workspace(spark, str(root)))
    gone = removed_paths(read_manifest(spark, folder, POLICY), files).collect()
    assert [os.path.basename(r.source_path) for r in gone] == ["d.txt"]


def test_another_policy_drops_the_manifest(spark, tmp_path):
    write(tmp_path / "w", {"a.txt": "x"})
    folder = str(tmp_path / "manifest")
    write_manifest(run(spark, tmp_path / "w").decisions, folder, POLICY)
    other = load_policy({"version": 1, "rules": []})
    assert policy_fingerprint(other) != policy_fingerprint(POLICY)
    assert read_manifest(spark, folder, other).count() == 0 and read_manifest(spark, folder, POLICY).count() == 1


def test_probe_reads_no_text(spark, tmp_path):
    write(tmp_path / "w", {"a.txt": "x"})
    folder = str(tmp_path / "manifest")
    write_manifest(run(spark, tmp_path / "w").decisions, folder, POLICY)
    table = str(tmp_path / "files")
    decoded(read_workspace(spark, str(tmp_path / "w"))).write.parquet(table)
    probe = reuse.probe_manifest(spark.read.parquet(table), spark.read.parquet(folder), policy_fingerprint(POLICY))
    assert probe.first().cache_hit
    schemas = [line for line in probe._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1:]]
    assert all("content" not in s.split("\n")[0] and "text" not in s.split("\n")[0] for s in schemas)


def test_invalidate_prefix(spark):
    manifest = spark.createDataFrame([("/w", p) for p in ("/w/a", "/w/a/b", "/w/ab", "/w/c/d/e", "/w/c")], "root string, source_path string")
    removed = spark.createDataFrame([("/w", "/w/a"), ("/w", "/w/c/d"), ("/x", "/w")], "root string, source_path string")
    assert {r.source_path for r in invalidate_prefix(manifest, removed).collect()} == {"/w/ab", "/w/c"}


def test_staged_copy_leaves_blocked_items_out(spark, tmp_path):
    frame = spark.createDataFrame([("/w", "a/x.jks", "k"), ("/w", "b", "secret"), ("/v", "c", "ok")], "root string, path string, text string")
    write_staged(apply_policy(frame, POLICY), str(tmp_path / "out"))
    rows = {r.path: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: r.text for k, r in rows.items()} == {"b": "<redacted>", "c": "ok"}
    assert rows["b"].workspace != rows["c"].workspace


def test_many_misses_and_duplicate_manifest_roots(spark):
    files = spark.createDataFrame([(r, f"{r}/f{i}", f"f{i}", "secret" if i % 2 else "x", 1, i) for i in range(50) for r in ("/a", "/b")],
                                  "root string, source_path string, path string, text string, size long, mtime_ms long")
    known = files.filter("root = '/a'").select(
        F.lit(1).alias("version"), F.lit(policy_fingerprint(POLICY)).alias("policy_fingerprint"), "root", "source_path", "size",
        "mtime_ms", F.lit("COPY_ORIGINAL").alias("disposition"), F.lit(None).cast("string").alias("sanitized_text"),
        F.array().cast("array<struct<target:string,action:string,source:string,message:string,rule_id:string>>").alias("findings"))
    rows = reuse_decisions(files, known, POLICY).groupBy("root", "cache_hit", "disposition").count().collect()
    assert {tuple(r) for r in rows} == {("/a", True, "COPY_ORIGINAL", 50), ("/b", False, "COPY_ORIGINAL", 25), ("/b", False, "WRITE_SANITIZED_TEXT", 25)}


def test_working_folders_follow_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == named.rstrip("/")
    assert new_folder(spark, "x") != new_folder(spark, "x")
