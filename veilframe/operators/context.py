"""Prompt context from allowed files, and sanitised conversation turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.match import is_sanitizable_line
from ..policy import BLOCK, CONFIRM, Policy
from .rules import BLOCKED, evaluate_prompts, has_action

CONTEXT_HEAD = "These cleaned files may be read for more context:"
CONTEXT_TAIL = "Paths are relative to the cleaned workspace, which is the current directory."

#: Positions of files in one part of an assembled prompt.
PART_LINES = 1024


def context_lines(prompts: DataFrame, files: DataFrame, *, request: str = "request_id",
                  path: str = "path", position: str = "position") -> DataFrame:
    """Blocks of the assembled prompts as rows (request, section, ord, content).

    In order of section and ord: 0 the base prompt, 1 a blank line and the
    heading, 2 one line per allowed file, 3 a blank line and the closing note.
    Without files only the base prompt remains.  ``files`` are the attachments
    of the given prompts' requests and ``position`` numbers them.

    Every file also brings the heading and the note of its request; duplicates
    of these fall to the partial aggregation.  So files are evaluated once, and
    a request with any number of them stays spread over the cluster.
    """
    def block(section: int, ord_: Column, content: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), ord_.cast("long").alias("ord"), content.alias("content"))

    base = prompts.select(request, block(0, F.lit(0), F.col("sanitized_text")).alias("b"))
    listed = files.filter(F.col("disposition") != BLOCKED).select(request, F.explode(F.array(
        block(1, F.lit(0), F.lit("\n" + CONTEXT_HEAD)),
        block(2, F.col(position), F.concat(F.lit("- "), path)),
        block(3, F.lit(0), F.lit("\n" + CONTEXT_TAIL)))).alias("b"))
    return base.select(request, "b.*").unionByName(listed.select(request, "b.*").distinct())


def assemble_context(prompts: DataFrame, files: DataFrame, *, request: str = "request_id", path: str = "path",
                     position: str = "position", part_lines: int = PART_LINES) -> DataFrame:
    """The prompt of every request in parts (request, section, part, text).

    A part holds the lines of ``part_lines`` positions, so its size is bounded however many
    files a request has; the texts in the order of section and part, one after the other,
    are the whole prompt.  Requests of any size are spread over the cluster by part.
    """
    blocks = context_lines(prompts, files, request=request, path=path, position=position)
    part = F.floor(F.col("ord") / part_lines).alias("part")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "content"))), lambda b: b["content"])
    before = F.when(F.col("section") == 0, "").otherwise("\n")
    return blocks.groupBy(request, "section", part).agg(F.array_join(lines, "\n").alias("_lines")).select(
        request, "section", "part", F.concat(before, "_lines").alias("text"))


def sanitize_turns(turns: DataFrame, policy: Policy, *, approve: bool = False, text: str = "text",
                   detectors: Sequence = ()) -> DataFrame:
    """Forwarded lines: blank lines and commands as they are, others sanitised.

    Blocked lines are dropped, and lines that need approval unless ``approve``.
    Stateless, so it runs on streams as well as on tables.
    """
    flagged = turns.withColumn("_checked", is_sanitizable_line(F.col(text))) \
        .withColumn("_line", F.when(F.col("_checked"), F.col(text))).withColumn("_label", F.lit("interactive"))
    done = evaluate_prompts(flagged, policy, text="_line", label="_label", detectors=detectors)
    stopped = has_action(F.col("findings"), BLOCK)
    if not approve:
        stopped = stopped | has_action(F.col("findings"), CONFIRM)
    return done.filter(~(F.col("_checked") & stopped)).select(
        *turns.columns, F.coalesce("sanitized_text", text).alias("sanitized_text"),
        F.coalesce("was_redacted", F.lit(False)).alias("was_redacted"))
