"""Sanitising a stream of typed lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.context import sanitize_turns
from ..policy import Policy


def sanitize_stream(lines: DataFrame, policy: Policy, *, approve: bool = False, text: str = "text",
                    detectors: Sequence = ()) -> DataFrame:
    """Forwarded lines of a streaming frame; stateless, so no watermark is needed."""
    return sanitize_turns(lines, policy, approve=approve, text=text, detectors=detectors)


def run_lines(lines: DataFrame, policy: Policy, output: str, checkpoint: str, *, approve: bool = False,
              text: str = "text", detectors: Sequence = (), trigger: dict | None = None) -> StreamingQuery:
    """Append the forwarded lines to a parquet table.

    By default the lines that are there are processed; pass ``trigger`` (say
    ``{"processingTime": "1 second"}``) for a session that goes on.
    """
    return (sanitize_stream(lines, policy, approve=approve, text=text, detectors=detectors).writeStream
            .format("parquet").option("path", output).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())
