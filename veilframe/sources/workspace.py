"""Directory trees as tables: a listing by rounds of Spark jobs, and contents for a table of paths.

Hidden files are listed, symbolic links are not followed, skipped directories are
pruned.  The listing reads no file.  Contents are read for the rows of any table of
listed files, say the misses of a manifest, in tasks of about equal bytes.
"""

from __future__ import annotations

import os
import stat as modes
import sys
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.paths import SKIPPED_DIRECTORIES
from .scratch import written

LISTING_SCHEMA = "root string, source_path string, path string, size long, mtime_ms long"
WORKSPACE_SCHEMA = "root string, source_path string, path string, content binary, size long, mtime_ms long"

#: Directories that a task opens below each one that it is given, before it hands the rest on.
DIRECTORIES_A_ROUND = 256
#: Bytes that one read task is given, and the size from which a file is read in ranges by several.
PACK_BYTES, RANGE_BYTES = 1 << 27, 1 << 26
#: What opening a file costs, in bytes.
OPEN_BYTES = 1 << 16
BATCH_BYTES, BATCH_ROWS = 1 << 25, 4096

_FOUND = pa.schema([("root", pa.string()), ("source_path", pa.string()), ("is_directory", pa.bool_()), ("size", pa.int64()), ("mtime_ms", pa.int64())])


def _millis(stat: os.stat_result) -> int:
    return stat.st_mtime_ns // 1_000_000


def _scan(directory: str, skip: Sequence[str], most: int) -> Iterator[tuple[str, bool, int, int]]:
    """Files at or below a directory; subdirectories beyond the first ``most`` are handed back unopened."""
    pending, opened = deque([directory]), 0
    while pending:
        here = pending.popleft()
        if opened == most:
            yield here, True, 0, 0
            continue
        opened += 1
        try:
            entries = os.scandir(here)
        except FileNotFoundError:  # removed since its parent was listed
            continue
        with entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in skip:
                        pending.append(entry.path)
                elif entry.is_file(follow_symlinks=False):
                    try:
                        stat = entry.stat(follow_symlinks=False)
                    except FileNotFoundError:
                        continue
                    yield entry.path, False, stat.st_size, _millis(stat)


def list_workspace(spark: SparkSession, root: str, skip_dirs: Sequence[str] = SKIPPED_DIRECTORIES, *,
                   directories_a_round: int = DIRECTORIES_A_ROUND) -> DataFrame:
    """root, source_path, path (relative), size and mtime_ms of the regular files below a root every executor can see.

    Runs one job per round over a table of directories that are not open yet, spread over
    all tasks; each opens a bounded number of directories below every one that it is given and
    hands the others on to the next round.  So no task holds a subtree, a deep chain takes few
    rounds, and what is found is written after every round.  One directory is listed by one
    task, as a stream.
    """
    root, skip = os.path.normpath(os.path.abspath(root)), tuple(skip_dirs)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for directory in batch.column(0).to_pylist():
                for found in _scan(directory, skip, directories_a_round):
                    held.append((root, *found))
                    if len(held) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _FOUND)], schema=_FOUND)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _FOUND)], schema=_FOUND)

    listed, unopened = None, spark.createDataFrame([(root,)], "source_path string")
    while True:
        found = written(unopened.mapInArrow(scan, "root string, source_path string, is_directory boolean, size long, mtime_ms long"), "listing")
        files = found.where("NOT is_directory")
        listed = files if listed is None else listed.unionByName(files)
        waiting = found.where("is_directory").select("source_path")
        count = waiting.count()
        if not count:
            break
        unopened = waiting.repartition(min(count, 4 * spark.sparkContext.defaultParallelism))
    cut = len(root.rstrip("/")) + 2
    return listed.select("root", "source_path", F.substring("source_path", cut, 1 << 30).alias("path"), "size", "mtime_ms")


def _packs(parts: DataFrame, pack_bytes: int) -> DataFrame:
    """Parts with the number of their read task: running sums of bytes, taken per range of rows."""
    cost = F.col("length") + OPEN_BYTES
    placed = written(parts.repartitionByRange("source_path", "offset").sortWithinPartitions("source_path", "offset")
                     .withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.shiftright("place", 33)), "parts")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = placed.groupBy("range").agg(F.sum(cost).alias("bytes")).select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    inside = F.sum(cost).over(Window.partitionBy("range").orderBy("place")) - cost
    return placed.join(offsets, "range").withColumn("pack", F.floor((F.col("start") + inside) / pack_bytes).cast("int")).drop("range", "place", "start")


def _read(path: str, offset: int, length: int | None) -> tuple[bytes, os.stat_result] | None:
    """Bytes, and the file's state, the same before and after; None if there is no such file any more.

    A file that changes all the time is read a few times; its last reading counts, with the state before it.
    """
    for _ in range(4):
        try:
            with open(path, "rb") as handle:
                before = os.fstat(handle.fileno())
                if not modes.S_ISREG(before.st_mode):
                    return None
                handle.seek(offset)
                data = handle.read() if length is None else handle.read(length)
                after = os.fstat(handle.fileno())
        except FileNotFoundError:
            return None
        if (before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns):
            break
    return data, before


_CONTENT = pa.schema([("root", pa.string()), ("path", pa.string()), ("source_path", pa.string()), ("offset", pa.int64()), ("content", pa.binary()), ("size", pa.int64()), ("mtime_ms", pa.int64())])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Arrow batches bounded by bytes, so large files do not add up in memory."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"")
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _CONTENT)], schema=_CONTENT)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _CONTENT)], schema=_CONTENT)


def read_contents(files: DataFrame, *, pack_bytes: int = PACK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """root, source_path, path and content of listed files, with ``size`` and ``mtime_ms`` as they were when they were read.

    ``files`` has the columns of a listing, one row per source_path; only its files are
    opened, each once per range.  They are packed into tasks of about ``pack_bytes``; files
    larger than ``range_bytes`` are read in ranges, maybe by several tasks, and put
    together.  A file that has changed since it was listed is read again as a whole, one
    that is gone has no row.  So decisions are on the state whose bytes are there.
    """
    ranges = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    parts = _packs(files.select("root", "path", "source_path", F.col("size").alias("listed_size"), F.col("mtime_ms").alias("listed_ms"),
                                F.explode(ranges).alias("offset"))
                   .withColumn("length", F.least(F.col("listed_size") - F.col("offset"), F.lit(range_bytes)).cast("long")), pack_bytes)
    packs = (parts.agg(F.max("pack")).first()[0] or 0) + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for root, name, path, size, mtime_ms, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    whole = size <= range_bytes
                    found = _read(path, offset, None if whole else length)
                    if found is not None:
                        # A range of a file that is not as listed has no content: the file is read anew below.
                        same = whole or (found[1].st_size, _millis(found[1])) == (size, mtime_ms)
                        yield root, name, path, offset, found[0] if same else None, found[1].st_size, _millis(found[1])
        yield from _batches(rows())

    shape = "root string, path string, source_path string, offset long, content binary, size long, mtime_ms long"
    out = (parts.repartitionById(packs, F.col("pack")).select("root", "path", "source_path", "listed_size", "listed_ms", "offset", "length")
           .mapInArrow(read, shape))
    large = files.where(F.col("size") > range_bytes).select("source_path", F.col("size").alias("listed"))
    if not large.isEmpty():
        got = written(out, "contents")

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    for root, name, path, listed, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        parts = [p["content"] for p in own]
                        if None not in parts and sum(map(len, parts)) == listed:
                            yield root, name, path, 0, b"".join(parts), own[0]["size"], own[0]["mtime_ms"]
                        elif (found := _read(path, 0, None)) is not None:
                            yield root, name, path, 0, found[0], found[1].st_size, _millis(found[1])
            yield from _batches(rows())

        several = got.join(large, "source_path").groupBy("root", "path", "source_path", "listed").agg(
            F.sort_array(F.collect_list(F.struct("offset", "content", "size", "mtime_ms"))).alias("own"))
        out = got.join(large, "source_path", "left_anti").unionByName(several.mapInArrow(joined, shape))
    return out.select("root", "source_path", "path", "content", "size", "mtime_ms")


def read_workspace(spark: SparkSession, root: str, skip_dirs: Sequence[str] = SKIPPED_DIRECTORIES, *, content: bool = True) -> DataFrame:
    """Regular files below a root every executor can see, with their bytes; without ``content``, the listing alone."""
    listed = list_workspace(spark, root, skip_dirs)
    columns = [c.split()[0] for c in WORKSPACE_SCHEMA.split(", ")]
    return (read_contents(listed) if content else listed.withColumn("content", F.lit(None).cast("binary"))).select(*columns)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
