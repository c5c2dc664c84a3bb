"""Labelled texts to learn from, bounded, without moving texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import written


def crc_bucket(doc_id: str, n: int) -> Column:
    """The remainder of CRC-32 of the id as text; NULL for NULL."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def held_out(doc_id: str, n: int, remainder: int) -> Column:
    """Whether a row is kept back from learning; a row without an id has no label and is not."""
    return F.coalesce(crc_bucket(doc_id, n) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, learn: Column, max_rows: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns text and label of at most ``max_rows`` labelled rows for which ``learn`` (on the id) holds.

    Rows are chosen by the hash of their id, so reruns agree and every label is
    as likely.  Only the chosen ids are sent to the texts: at most ``max_rows``
    numbers, which is the bound of the broadcast.  Labels that are NULL are left
    out, of repeated labels the largest counts, of repeated texts all rows.  The
    result is a table in the shared folder, as learners read it several times.
    """
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & learn)
    total = usable.count()
    if total > max_rows:
        edge = int(-2**63 + 2**64 * (0.95 * max_rows / total))
        usable = usable.where(F.xxhash64(F.col(doc_id).cast("long"), F.lit(7)) < F.lit(edge))
    chosen = usable.groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_label")).limit(max_rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("text"))
    return written(texts.join(F.broadcast(chosen), "_id").select("text", F.col("_label").alias("label")), "labelled")
