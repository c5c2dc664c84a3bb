"""Equality joins whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Parts that the rows of one key are split into.
SALTS = 16


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, by: Sequence[str]) -> DataFrame:
    """Join a large left side with a narrow lookup side, hot keys split.

    The left rows of a key are shared out over ``SALTS`` parts by the columns
    ``by``, and the lookup rows are repeated for every part.  So a key with a
    third of all rows (a common ancestor directory, say) is worked on by many
    tasks, also where adaptive execution does not step in.  ``how`` is inner,
    left, left_semi or left_anti.  If the lookup side turns out small, adaptive
    execution broadcasts it by its measured size.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
