"""Checks over a table of many policies' rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank
from ..policy import REDACT, SUPPORTED_VERSION

UNSUPPORTED_VERSION, DUPLICATE_ID = "unsupported_version", "duplicate_id"
BLANK_ID, NO_MATCHER, BLANK_REPLACEMENT = "blank_id", "no_matcher", "blank_replacement"


def validate_policies(rules: DataFrame) -> DataFrame:
    """Violations (policy_id, rule_id, violation) of a rules table.

    Columns: policy_id, version, rule_id, paths, path_regex, content_regex,
    kotlin (struct or NULL), action, replacement, default_replacement.  Rule
    counts are summed before the shuffle, so one huge policy is no hot spot.
    """
    def missing(array: Column) -> Column:
        return F.coalesce(F.size(array), F.lit(0)) <= 0

    own = F.coalesce(F.col("replacement"), F.col("default_replacement"), F.lit("<redacted>"))
    action = F.upper(F.trim(F.col("action")))
    no_match = reduce(lambda a, b: a & b, (missing(F.col(c)) for c in ("paths", "path_regex", "content_regex")))
    checks = F.array_compact(F.array(
        F.when(F.col("version") != SUPPORTED_VERSION, F.lit(UNSUPPORTED_VERSION)),
        F.when(F.coalesce(is_blank(F.col("rule_id")), F.lit(True)), F.lit(BLANK_ID)),
        F.when(no_match & F.col("kotlin").isNull(), F.lit(NO_MATCHER)),
        F.when((action == REDACT) & is_blank(own), F.lit(BLANK_REPLACEMENT))))
    # One aggregation gives both kinds: per rule, the violations seen and the count.
    grouped = rules.select("policy_id", "rule_id", checks.alias("found")).groupBy("policy_id", "rule_id").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.max(F.array_contains("found", v)).alias(v)
          for v in (UNSUPPORTED_VERSION, BLANK_ID, NO_MATCHER, BLANK_REPLACEMENT)))
    kinds = F.array_compact(F.array(
        F.when(F.col("n") > 1, F.lit(DUPLICATE_ID)),
        *(F.when(F.col(v), F.lit(v)) for v in (UNSUPPORTED_VERSION, BLANK_ID, NO_MATCHER, BLANK_REPLACEMENT))))
    return grouped.select("policy_id", "rule_id", F.explode(kinds).alias("violation"))
