"""Tables of texts as files, policies as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..policy import Policy

RULES_SCHEMA = (
    "policy_id string, version int, rule_ord int, rule_id string, description string, paths array<string>, "
    "path_regex array<string>, content_regex array<string>, kotlin struct<packages:array<string>,"
    "classes:array<string>,functions:array<string>,annotations:array<string>>, action string, "
    "replacement string, default_replacement string")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def files_from_table(df: DataFrame, path: Column, text: Column | str, *, root: Column | str | None = None,
                     size: Column | None = None, mtime_ms: Column | None = None,
                     carry: Sequence[str] = ()) -> DataFrame:
    """Files view of any table of texts: root, source_path, path, text, size, mtime_ms.

    ``path`` is relative to the root.  Without a size, the text's byte length is
    taken; a missing time is NULL.
    """
    base = F.lit("/w") if root is None else _column(root)
    text = _column(text)
    size = F.octet_length(text).cast("long") if size is None else size.cast("long")
    mtime = F.lit(None).cast("long") if mtime_ms is None else mtime_ms.cast("long")
    return df.select(*carry, base.alias("root"), F.concat(base, F.lit("/"), path).alias("source_path"),
                     path.alias("path"), text.alias("text"), size.alias("size"), mtime.alias("mtime_ms"))


def spread(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Share out an input that is one file, or one row group, over ``partitions`` tasks.

    Pattern matching is bound by CPU.  This moves all rows: a table of many files is better
    left as it is and split by ``spark.sql.files.maxPartitionBytes``.
    """
    return df.repartition(partitions, *keys)


def rules_frame(spark: SparkSession, policy: Policy, policy_id: str = "policy") -> DataFrame:
    """One row per rule; ``rule_ord`` is the evaluation order."""
    rows = []
    for i, rule in enumerate(policy.rules):
        match, k = rule.match, rule.match.kotlin
        symbols = None if k is None else (list(k.packages), list(k.classes), list(k.functions), list(k.annotations))
        rows.append((policy_id, policy.version, i, rule.id, rule.description, list(match.paths),
                     list(match.path_regex), list(match.content_regex), symbols, rule.action,
                     rule.replacement, policy.redact_replacement))
    return spark.createDataFrame(rows, RULES_SCHEMA)
