"""Lookups along path prefixes: includes, staged paths, nearest policy, numbering.

What lies above a path is found by intervals of the paths' order (see ``intervals``), so
the directories at the top, which are above everything, are no hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.paths import file_name, safe_name
from ..sources.scratch import written
from .intervals import with_directories_above
from .reuse import covered_by

# Kinds of mapping entries by precedence, policy file names.
PROJECT, DIRECTORY, FILE = "PROJECT", "DIR", "FILE"
POLICY_FILE_NAMES = ("llm-policy.yaml", "llm-policy.yml")

#: Name of a staged path whose original has none; a fixed value.
NAMELESS = "external-path"


def external_files(candidates: DataFrame, roots: DataFrame, directories: DataFrame) -> DataFrame:
    """Distinct candidate files (session, path) outside the root and the include directories.

    ``roots`` and ``directories`` are (session, directory).
    """
    known = roots.select("session", "directory").unionByName(directories.select("session", "directory"))
    distinct = candidates.select("session", "path").distinct()
    return distinct.join(covered_by(distinct, known, ["session"], "path"), ["session", "path"], "left_anti")


def map_paths(paths: DataFrame, mapping: DataFrame, workspace_root: str) -> DataFrame:
    """Staged path of every distinct (session, path).

    ``mapping`` has session, kind, ord, from_path, to_path.  The project root
    wins, then the first include directory by ``ord``, then an exact include
    file; anything else goes to ``_unmapped/NAME``, a path without a name to
    ``_unmapped/external-path``.
    """
    exact_only = F.col("kind") == FILE
    rank = F.when(F.col("kind") == PROJECT, 0).when(F.col("kind") == DIRECTORY, 1).otherwise(2)
    hit = F.struct(rank.alias("rank"), "ord", "from_path", "to_path")
    # Of the entries of one directory the first counts: for what is below it, and for the path itself.
    entries = mapping.groupBy("session", F.col("from_path").alias("directory")).agg(
        F.min(F.when(~exact_only, hit)).alias("below"), F.min(hit).alias("own"))
    above = with_directories_above(paths.select("session", "path").distinct(), entries, ["session"], "path", ["below", "own"])
    best = above.withColumn("hit", F.array_min(F.array_compact(F.transform(
        "above", lambda e: F.when(e["directory"] == F.col("path"), e["own"]).otherwise(e["below"])))))
    rest = F.substring(F.col("path"), F.when(F.col("hit.from_path") == "/", F.lit(1)).otherwise(
        F.length("hit.from_path") + 1), F.length("path"))
    name = file_name(F.col("path"))
    fallback = F.concat(F.lit(workspace_root + "/_unmapped/"), F.when(name != "", name).otherwise(NAMELESS))
    return best.select("session", "path", F.when(F.col("hit").isNull(), fallback).otherwise(
        F.concat(F.col("hit.to_path"), rest)).alias("staged_path"))


def map_includes(includes: DataFrame, mapping: DataFrame, workspace_root: str) -> DataFrame:
    """Staged path of every distinct include directory (session, path).

    ``mapping`` is that of ``map_paths``.  A path in the project keeps its place; an include
    directory that is mapped itself goes there; any other goes to ``_external/NAME``, and a
    path without a name stays as it is.
    """
    wanted = includes.select("session", "path").distinct()
    projects = mapping.filter(F.col("kind") == PROJECT).groupBy("session", F.col("from_path").alias("directory")).agg(
        F.min(F.struct("ord", "from_path", "to_path")).alias("project"))
    inside = with_directories_above(wanted, projects, ["session"], "path", ["project"]).select(
        "session", "path", F.array_min(F.transform("above", lambda e: e["project"])).alias("project"))
    exact = mapping.filter(F.col("kind") == DIRECTORY).groupBy("session", F.col("from_path").alias("path")).agg(
        F.min(F.struct("ord", "to_path")).alias("own"))
    found = inside.join(exact, ["session", "path"], "left")
    project = F.col("project.from_path")
    rest = F.substring(F.col("path"), F.when(project == "/", 1).otherwise(F.length(project) + 1), F.length("path"))
    name = file_name(F.col("path"))
    return found.select("session", "path", F.when(project.isNotNull(), F.concat("project.to_path", rest))
                        .when(F.col("own").isNotNull(), F.col("own.to_path"))
                        .when(name == "", F.col("path")).otherwise(F.concat(F.lit(workspace_root + "/_external/"), name)).alias("staged_path"))


def nearest_policy(directories: DataFrame, policies: DataFrame, *, names=POLICY_FILE_NAMES) -> DataFrame:
    """Policy of every distinct directory.

    ``directories`` has directory, explicit, environment (both may be NULL) and
    ``policies`` has path.  The explicit path wins, then the environment's, then
    the policy in the nearest directory upwards, names in the order given.
    """
    wanted = directories.select("directory", "explicit", "environment").distinct()
    name = file_name(F.col("path"))
    priority = F.when(name == names[0], 0)
    for i, other in enumerate(names[1:], 1):
        priority = priority.when(name == other, i)
    located = policies.select(
        F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1).alias("_dir"), priority.alias("_priority"), "path") \
        .filter(F.col("_priority").isNotNull()) \
        .groupBy(F.when(F.col("_dir") == "", "/").otherwise(F.col("_dir")).alias("ancestor")) \
        .agg(F.min(F.struct("_priority", "path")).alias("_best")) \
        .select("ancestor", F.col("_best.path").alias("policy_path"))
    nearest = with_directories_above(wanted.select("directory").distinct(), located.withColumnRenamed("ancestor", "directory"), [], "directory", ["policy_path"]) \
        .select("directory", F.try_element_at("above", F.lit(-1))["policy_path"].alias("found"))
    return wanted.join(nearest, "directory", "left").select(
        "directory", "explicit", "environment",
        F.coalesce("explicit", "environment", "found").alias("policy_path"))


def number_externals(includes: DataFrame, *, prefix: str = "_external", fallback: str = "include",
                     partitions: int | None = None) -> DataFrame:
    """Staged name ``PREFIX/N-NAME`` of every distinct include (root, path, position).

    N counts the distinct includes of a root by first position.  Includes are dealt out by
    ranges of (root, position, path), of about equal numbers of rows however positions lie,
    numbered within a range and shifted by the ranges before.  So a root with all includes
    is sorted by many tasks.  The dealt rows are written, as the ranges have to stay.
    """
    partitions = partitions or int(includes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = includes.groupBy("root", "path").agg(F.min("position").alias("position"))
    first = written(first.repartitionByRange(partitions, "root", "position", "path")
                    .withColumn("_bucket", F.spark_partition_id()), "includes")
    sizes = first.groupBy("root", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_bucket = Window.partitionBy("root").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("root", "_bucket", F.coalesce(F.sum("_n").over(by_bucket), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("root", "_bucket").orderBy("position", "path")
    numbered = first.withColumn("_n", F.row_number().over(within)).join(shifts, ["root", "_bucket"])
    number = F.col("_n") + F.col("_shift")
    return numbered.select("root", "path", "position", number.alias("number"), F.concat(
        F.lit(prefix + "/"), number.cast("string"), F.lit("-"), safe_name(F.col("path"), fallback)).alias("staged_path"))
