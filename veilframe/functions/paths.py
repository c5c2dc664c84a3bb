"""Path expressions: normalisation, relative paths, ancestors, safe names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Directories that are never part of a workspace.
SKIPPED_DIRECTORIES = (".git", ".gradle", ".idea", "build", "out", "node_modules")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalize(path: Column) -> Column:
    """Drop ``.`` and empty components and resolve ``..`` of an absolute path."""
    def step(kept: Column, part: Column) -> Column:
        return (F.when((part == "") | (part == "."), kept)
                .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
                .otherwise(F.concat(kept, F.array(part))))

    cleaned = F.concat(F.lit("/"), F.array_join(
        F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"//|/\.{1,2}(/|$)|./$"), cleaned).otherwise(path)


def is_under(path: Column, directory: Column) -> Column:
    """Component-wise prefix test: the directory itself or below it."""
    return (path == directory) | (directory == "/") | path.startswith(F.concat(directory, F.lit("/")))


def relative_path(root: Column, path: Column) -> Column:
    """Path relative to the root; ``_external/NAME`` if it is outside."""
    base = normalize(root)
    full = normalize(F.when(path.startswith("/"), path).otherwise(F.concat(root, F.lit("/"), path)))
    skip = F.when(base == "/", F.lit(2)).otherwise(F.length(base) + 2)
    return (F.when(is_under(full, base), F.substring(full, skip, F.length(full)))
            .otherwise(F.concat(F.lit("_external/"), file_name(full))))


def in_skipped_directory(path: Column, skip=SKIPPED_DIRECTORIES) -> Column:
    """True if a directory component (not the file name) is a skipped one."""
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(directories, F.array(*(F.lit(s) for s in skip)))


def parent_directory(path: Column) -> Column:
    """Relative path of the containing directory, ``''`` for the root."""
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def directory_chain(directory: Column) -> Column:
    """A relative directory and all directories above it, root ``''`` included."""
    parts = F.split(directory, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)),
                        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), below))


def absolute_chain(path: Column) -> Column:
    """An absolute path and all directories above it, ``/`` included."""
    return F.transform(directory_chain(F.substring(path, F.lit(2), F.length(path))),
                       lambda d: F.concat(F.lit("/"), d))


def path_depth(path: Column) -> Column:
    return F.when(path == "/", F.lit(0)).otherwise(F.size(F.split(path, "/")) - 1)


def safe_name(path: Column, fallback: str) -> Column:
    """Last component with unusual characters replaced by ``_``."""
    name = file_name(path)
    return F.regexp_replace(F.when(F.trim(name) == "", F.lit(fallback)).otherwise(name),
                            "[^A-Za-z0-9._-]", "_")


def workspace_key(root: Column) -> Column:
    """Stable short name of a workspace root."""
    return F.concat(safe_name(root, "include"), F.lit("-"), F.substring(F.sha2(root, 256), 1, 12))
