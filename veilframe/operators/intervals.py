"""Which known directories lie above a path, without looking up its ancestors.

Put in order component by component, a directory is directly followed by all that is
below it: an interval.  Paths and directories are dealt out together by ranges of this
order, and one sweep over a range keeps a stack of the directories that are open.  A
directory that was opened in an earlier range lies above the first path of this one, so
only these first paths, one per range, are looked up by their ancestors.  No path is
repeated per ancestor, and a directory above everything is no key of a join.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.paths import absolute_chain
from ..sources.scratch import written


def _parts(path: str) -> list[str]:
    return [p for p in path.split("/") if p]


def _under(path: str, directory: str) -> bool:
    return path == directory or directory == "/" or path.startswith(directory + "/")


def with_directories_above(paths: DataFrame, directories: DataFrame, key: Sequence[str], path: str, value: Sequence[str] = ()) -> DataFrame:
    """The rows of ``paths`` with ``above``: the directories of their key that are equal to or above their path, highest first.

    ``directories`` has the key, ``directory`` and the ``value`` columns, one row per key and
    directory.  ``above`` is an array of structs of directory and the values.  Paths are
    absolute; a NULL path has nothing above it.  Rows may repeat.
    """
    keyed = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})

    # No path holds a NUL, so nothing comes between a directory and what is below it.
    order = F.replace(F.col("path"), F.lit("/"), F.lit("\0"))
    asked = paths.select(keyed.alias("key"), F.col(path).alias("path"), F.lit(1).alias("kind"), F.struct(*paths.columns).alias("row"))
    entry = F.struct("directory", *value)
    known = directories.select(keyed.alias("key"), F.col("directory").alias("path"), F.lit(0).alias("kind"), entry.alias("entry"))
    events = asked.unionByName(known, allowMissingColumns=True).withColumn("order", order)
    dealt = events.repartitionByRange("key", "order", "kind").sortWithinPartitions("key", "order", "kind").select("key", "path", "kind", "row", "entry")
    entries = ArrayType(dealt.schema["entry"].dataType)
    shape = StructType([dealt.schema["row"], StructField("above", entries), StructField("shared", IntegerType()), StructField("part", IntegerType()),
                        StructField("first_key", StringType()), StructField("first_path", StringType()), StructField("first_kind", IntegerType())])
    arrow = to_arrow_schema(shape)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, above, here, first = TaskContext.get().partitionId(), [], [], None, None
        for batch in batches:
            rows, at = [], []
            kinds, holders = batch.column(2).to_pylist(), batch.column(4)
            for i, (key_, path_, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), kinds, strict=True)):
                if first is None:
                    first = key_, _parts(path_ or "")
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow.field("row").type), pa.array([[]], arrow.field("above").type),
                                                      *(pa.array([v], arrow.field(n).type) for n, v in (
                                                          ("shared", None), ("part", part), ("first_key", key_), ("first_path", path_), ("first_kind", kind)))],
                                                     schema=arrow)
                if key_ != here:
                    here, stack, above = key_, [], []
                while stack and not (path_ is not None and _under(path_, stack[-1][0])):
                    stack.pop()
                    above = [e for _, e in stack]
                if kind == 0:
                    stack.append((path_, holders[i].as_py()))
                    above = [e for _, e in stack]
                    continue
                shared = -1
                if key_ == first[0] and path_ is not None:
                    shared = 0
                    for a, b in zip(_parts(path_), first[1]):
                        if a != b:
                            break
                        shared += 1
                at.append(i)
                rows.append((above, shared))
            if at:
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3).take(pa.array(at)), pa.array([a for a, _ in rows], arrow.field("above").type), pa.array([s for _, s in rows], pa.int32()),
                     pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], schema=arrow)

    swept = written(dealt.mapInArrow(sweep, shape), "swept-paths")
    # Directories opened before a range: above its first path, or equal to it if that is no directory row itself.
    firsts = (swept.where("row IS NULL").select("part", F.col("first_key").alias("key"), "first_path", "first_kind")
              .withColumn("path", F.explode(absolute_chain(F.col("first_path")))))
    earlier = firsts.where("first_kind = 1 OR path <> first_path").join(known.select("key", "path", "entry"), ["key", "path"])
    depth = F.size(F.filter(F.split("path", "/"), lambda p: p != ""))
    opened = earlier.groupBy("part").agg(F.sort_array(F.collect_list(F.struct(depth.alias("depth"), "path", F.col("entry").alias("entry")))).alias("opened"))
    found = swept.where("row IS NOT NULL").join(opened, "part", "left")
    # The path may share part of its way with the range's first one: so much of what was open is still.
    kept = F.transform(F.filter(F.coalesce("opened", F.array().cast(opened.schema["opened"].dataType)), lambda o: o["depth"] <= F.col("shared")),
                       lambda o: o["entry"])
    return found.select("row.*", F.concat(kept, F.col("above")).alias("above"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
