"""Kotlin declarations in a table of source files.

Files are searched inside of their own row: one pass over a file's lines keeps the
running offset and brace balance and a stack of declarations whose block is open.  A
block's end is the next line that falls back to the declaration's level, and levels in
the stack only grow, so every declaration is pushed and popped once: linear in the
file, without a shuffle, and a chain of symbol rules needs none either.  Only files
that pass the package gate and mention a wanted name go to a Python worker.

The parts are operators on tables of lines as well (offsets, balances, annotation
groups, block ends, merged ranges), as windows by file; there every change of level
becomes one event per level crossed, and the next event of the same level is found
with ``lead``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_
from unicodedata import category

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import BLANK_CLASS, replace_ranges, trimmed
from ..policy import SymbolCriteria

# The declaration syntax that is recognised.
PACKAGE_REGEX = r"(?m)^\s*package\s+([A-Za-z0-9_.]+)"
ANNOTATION_REGEX = r"^@([A-Za-z_][A-Za-z0-9_.]*)"
CLASS_MODIFIERS = ("public", "private", "internal", "protected", "data", "sealed", "enum", "annotation",
                   "open", "abstract", "final", "value", "expect", "actual", "inner", "companion")
FUNCTION_MODIFIERS = ("public", "private", "internal", "protected", "suspend", "inline", "tailrec",
                      "operator", "infix", "override", "open", "abstract", "final", "actual", "expect",
                      "external")
NAME = "[A-Za-z_][A-Za-z0-9_]*"
CLASS_REGEX = rf"^(?:(?:{'|'.join(CLASS_MODIFIERS)})\s+)*(class|object|interface)\s+({NAME})"
FUNCTION_REGEX = rf"^(?:(?:{'|'.join(FUNCTION_MODIFIERS)})\s+)*fun(?:\s*<[^>]+>)?\s+({NAME})\s*\("

BLANK, ANNOTATION, CLASS, FUNCTION, OTHER = "blank", "annotation", "class", "fun", "other"

RANGES_TYPE = "array<struct<start:int,end:int,description:string>>"


def package_name(text: Column) -> Column:
    """Name in the first package line, NULL without one."""
    return F.when(text.rlike(PACKAGE_REGEX), F.regexp_extract(text, PACKAGE_REGEX, 1))


def package_matches(text: Column, criteria: SymbolCriteria) -> Column:
    """The package gate: equal to a configured package or below it."""
    if not criteria.packages:
        return F.lit(True)
    name = package_name(text)
    checks = [(name == p) | name.startswith(p + ".") for p in criteria.packages]
    return F.coalesce(reduce(or_, checks), F.lit(False))


def may_match(text: Column, criteria: SymbolCriteria) -> Column:
    """The package gate, and some wanted name occurs in the text at all.

    A match needs a declared name or an annotation's short name in the text, so
    files without any of them need not be split into lines.
    """
    gate = package_matches(text, criteria)
    if criteria.whole_file:
        return gate
    names = {*criteria.classes, *criteria.functions, *(_short(a) for a in criteria.annotations)}
    mentioned = reduce(or_, (text.contains(name) for name in sorted(names)))
    return F.coalesce(mentioned, F.lit(False)) & gate


def _short(name: str) -> str:
    return name.rsplit(".", 1)[-1]


def source_lines(files: DataFrame, key: Sequence[str], text: Column | str = "text") -> DataFrame:
    """One row per line: key, ``line`` (from 0) and ``line_text``."""
    text = F.col(text) if isinstance(text, str) else text
    return files.select(*key, F.posexplode(F.split(text, "\n", -1)).alias("line", "line_text"))


def _by_line(key: Sequence[str]):
    return Window.partitionBy(*key).orderBy("line")


def _before(key: Sequence[str]):
    return _by_line(key).rowsBetween(Window.unboundedPreceding, -1)


def line_offsets(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds ``start`` and ``end`` of each line; the end includes the line break."""
    length = F.length("line_text")
    has_next = F.lead("line").over(_by_line(key)).isNotNull()
    return (lines
            .withColumn("start", F.coalesce(F.sum(length + 1).over(_before(key)), F.lit(0)).cast("int"))
            .withColumn("end", F.col("start") + length + F.when(has_next, 1).otherwise(0)))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def brace_balance(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds ``delta`` (opened minus closed braces) and its running sum ``balance``."""
    text = F.col("line_text")
    return lines.withColumn("delta", F.when(text.rlike("[{}]"), _count(text, "{") - _count(text, "}"))
                            .otherwise(0)) \
        .withColumn("balance", F.sum("delta").over(
            _by_line(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))


def line_kinds(lines: DataFrame) -> DataFrame:
    """Adds ``kind``, the declared ``name`` (or annotation short name) and ``indent``."""
    t = F.col("_trimmed")
    kind = (F.when(t == "", BLANK).when(t.rlike(ANNOTATION_REGEX), ANNOTATION)
            .when(t.rlike(CLASS_REGEX), CLASS).when(t.rlike(FUNCTION_REGEX), FUNCTION).otherwise(OTHER))
    kinded = lines.withColumn("_trimmed", trimmed(F.col("line_text"))).withColumn("kind", kind)
    name = (F.when(F.col("kind") == ANNOTATION,
                   F.substring_index(F.regexp_extract(t, ANNOTATION_REGEX, 1), ".", -1))
            .when(F.col("kind") == CLASS, F.regexp_extract(t, CLASS_REGEX, 2))
            .when(F.col("kind") == FUNCTION, F.regexp_extract(t, FUNCTION_REGEX, 1)))
    indent = F.when(F.col("kind") == BLANK, 0).otherwise(
        F.length(F.regexp_extract("line_text", rf"\A{BLANK_CLASS}*", 0)))
    return kinded.withColumns({"name": name, "indent": indent}).drop("_trimmed")


def annotation_groups(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds ``island``: a run of annotation lines shares it with the line that follows.

    ``group_start`` is the first line of the island, ``group_offset`` its
    offset (where ``end`` is known).  Needs ``kind``.
    """
    plain = F.col("kind") != ANNOTATION
    before = _before(key)
    out = lines.withColumns({
        "island": F.coalesce(F.count(F.when(plain, 1)).over(before), F.lit(0)),
        "group_start": F.coalesce(F.last(F.when(plain, F.col("line")), True).over(before) + 1, F.lit(0))})
    if "end" in lines.columns:
        out = out.withColumn("group_offset", F.coalesce(
            F.last(F.when(plain, F.col("end")), True).over(before), F.lit(0)))
    return out


def block_end(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """End line of every target declaration.

    Needs the columns of ``line_offsets``, ``brace_balance``, ``line_kinds`` and
    ``is_target``.  Gives one row per target with ``end_line``, ``end_offset``.

    Brace mode (the line opens more than it closes): the next line where the
    balance is back at its value before the declaration, else the last line.
    Indent mode: up to the line before the first non-blank line that is indented
    less, or as much while it looks like a declaration; trailing blanks are left
    out.  With ``rank = 2*indent + (0 if it may stop else 1)`` that line is the
    next one with a rank of at most ``2*indent`` of the declaration.
    """
    partition = "PARTITION BY " + ", ".join(f"`{k}`" for k in key)
    by_line = f"OVER ({partition} ORDER BY line)"
    before = f"OVER ({partition} ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    spot = "struct(line, `end`)"
    no_event = "CAST(array() AS array<struct<mode:string,level:int,direction:int>>)"

    def events(condition: str, mode: str, direction: int, low: str, high: str, step: int = 1) -> str:
        """SQL: one event per level from low to high; none unless the condition holds."""
        return f"""CASE WHEN {condition} AND {low} <= {high} THEN transform(
            sequence(CAST({low} AS INT), CAST({high} AS INT), {step}),
            l -> named_struct('mode', '{mode}', 'level', l, 'direction', {direction})) ELSE {no_event} END"""

    # Thresholds are even ranks: the next one from a rank upwards.
    even_rank = "(rank + pmod(rank, 2))"
    ranked = lines.withColumn("rank", F.expr(
        f"CASE WHEN kind <> '{BLANK}' THEN 2 * indent + CASE WHEN kind IN ('{ANNOTATION}', '{CLASS}', '{FUNCTION}') "
        "OR indent = 0 THEN 0 ELSE 1 END END"))
    surrounded = ranked.selectExpr(
        "*", f"last(rank, true) {before} AS prev_rank", f"lead(rank) IGNORE NULLS {by_line} AS next_rank",
        f"last(CASE WHEN rank IS NOT NULL THEN {spot} END, true) {before} AS prev_solid",
        f"max({spot}) OVER ({partition}) AS file_spot",
        f"max(CASE WHEN rank IS NOT NULL THEN {spot} END) OVER ({partition}) AS file_solid",
        f"max(is_target AND delta > 0) OVER ({partition}) AS any_brace",
        f"max(is_target AND delta <= 0) OVER ({partition}) AS any_indent")
    crossings = surrounded.selectExpr("*", f"""inline(concat(
        {events("is_target AND delta <= 0 AND coalesce(next_rank <= 2 * indent, true)", "self", 1, "0", "0")},
        {events("any_brace AND delta > 0", "brace", 1, "balance - delta", "balance - 1")},
        {events("any_brace AND delta < 0", "brace", 0, "balance", "balance - delta - 1")},
        {events("any_indent AND prev_rank > rank", "indent", 0, even_rank, "prev_rank - 1", 2)},
        {events("any_indent AND next_rank > rank", "indent", 1, even_rank, "next_rank - 1", 2)}))""")
    following = crossings.selectExpr("*", f"""lead(struct(line, `end`, prev_solid))
        OVER ({partition}, mode, level ORDER BY line, direction) AS next_event""")
    own = ("is_target AND direction = 1 AND (mode = 'self' OR (mode = 'brace' AND delta > 0 AND level = balance - delta) "
           "OR (mode = 'indent' AND delta <= 0 AND level = 2 * indent))")
    found = f"""CASE mode
        WHEN 'brace' THEN CASE WHEN next_event IS NULL THEN file_spot
                               ELSE struct(next_event.line AS line, next_event.`end` AS `end`) END
        WHEN 'indent' THEN CASE WHEN next_event IS NULL THEN file_solid ELSE next_event.prev_solid END
        WHEN 'self' THEN {spot} END"""
    rows = following.filter(own).withColumn("_found", F.expr(found))
    return rows.withColumns({"end_line": F.expr("_found.line"), "end_offset": F.expr("_found.`end`")})


#: What ``trimmed`` takes for blank.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 32), *(c for c in range(0x3001) if category(chr(c)).startswith("Z"))]))
_ANNOTATION, _CLASS, _FUNCTION = (re.compile(p, re.ASCII) for p in (ANNOTATION_REGEX, CLASS_REGEX, FUNCTION_REGEX))

DECLARATIONS_TYPE = "array<struct<kind:string,name:string,start_line:int,end_line:int,start:int,end:int>>"


def _kind(line: str) -> tuple[str, str | None]:
    """Kind of a trimmed line, and the declared name or the annotation's short name."""
    if not line:
        return BLANK, None
    if line[0] == "@":
        found = _ANNOTATION.match(line)
        return (ANNOTATION, _short(found[1])) if found else (OTHER, None)
    if found := _CLASS.match(line):
        return CLASS, found[2]
    if found := _FUNCTION.match(line):
        return FUNCTION, found[1]
    return OTHER, None


def declared(text: str, criteria: SymbolCriteria) -> list[dict]:
    """Matched declarations of a text in order of their lines: kind, name, lines and offsets (in code points)."""
    classes, functions = set(criteria.classes), set(criteria.functions)
    hidden = {_short(a) for a in criteria.annotations}
    lines = text.split("\n")
    out, braces, indents = [], [], []
    offset, balance, group, solid = 0, 0, None, None  # group: line, offset and hit of pending annotations; solid: last line with text

    def close(stack: list, level: int, at: tuple[int, int]) -> None:
        while stack and stack[-1][0] >= level:
            stack.pop()[1].update(end_line=at[0], end=at[1])

    for number, line in enumerate(lines):
        end = offset + len(line) + (number < len(lines) - 1)
        body = line.strip(_BLANKS)
        kind, name = _kind(body)
        delta = line.count("{") - line.count("}")
        balance += delta
        close(braces, balance, (number, end))
        if kind != BLANK:
            indent = len(line) - len(line.lstrip(_BLANKS))
            # Even ranks stop a block of their indentation, odd ones only deeper blocks.
            if indents:
                close(indents, 2 * indent + (0 if kind != OTHER or indent == 0 else 1), solid)
            solid = number, end
        if kind == ANNOTATION:
            group = (*(group[:2] if group else (number, offset)), name in hidden or bool(group and group[2]))
        else:
            if kind in (CLASS, FUNCTION) and (name in (classes if kind == CLASS else functions) or group and group[2]):
                found = {"kind": kind, "name": name, "start_line": group[0] if group else number, "start": group[1] if group else offset}
                out.append(found)
                if delta > 0:
                    braces.append((balance - delta, found))
                else:
                    indents.append((2 * indent, found))
            group = None
        offset = end
    close(braces, -len(text) - 1, (len(lines) - 1, offset))
    close(indents, -1, solid)
    return out


def merged(found: list[dict]) -> list[dict]:
    """Ranges of declarations, overlapping and adjacent ones as one, their descriptions joined in order of start."""
    out = []
    for d in sorted(found, key=lambda d: d["start"]):  # of one start, by line
        description = f"{d['kind']} {d['name']}"
        if out and d["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], d["end"])
            out[-1]["description"] += ", " + description
        else:
            out.append({"start": d["start"], "end": d["end"], "description": description})
    return out


def _per_text(text: Column, find, kind: str) -> Column:
    """A function of a text as an Arrow-batched column; NULL texts give NULL."""
    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else find(t))
    return found(text)


def _whole(text: Column) -> Column:
    return F.coalesce(package_name(text), F.lit("<unknown>"))


def kotlin_symbols(files: DataFrame, criteria: SymbolCriteria, *, key: Sequence[str] = ("root", "path"),
                   path: str = "path", text: str = "text") -> DataFrame:
    """Matched declarations: key, kind, name, first and last line, start and end offset."""
    sources = files.filter(F.col(path).endswith(".kt") & may_match(F.col(text), criteria))
    if criteria.whole_file:
        return sources.select(*key, F.lit("package").alias("kind"), _whole(F.col(text)).alias("name"), F.lit(0).alias("start_line"),
                              (F.size(F.split(F.col(text), "\n", -1)) - 1).alias("end_line"),
                              F.lit(0).alias("start"), F.length(text).alias("end"))
    found = sources.select(*key, _per_text(F.col(text), lambda t: declared(t, criteria), DECLARATIONS_TYPE).alias("_found"))
    return found.select(*key, F.inline("_found"))


def merge_ranges(ranges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Merge overlapping or adjacent (start, end, description) ranges per key.

    Descriptions are joined in order of start; ``line`` breaks ties.
    """
    w = Window.partitionBy(*key).orderBy("start", "line")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1)
    numbered = ranges.withColumn("_reach", reach).withColumn("_island", F.sum(opens).over(w))
    described = F.sort_array(F.collect_list(F.struct("start", "line", "description")))
    return numbered.groupBy(*key, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_join(F.transform(described, lambda d: d["description"]), ", ").alias("description")) \
        .drop("_island")


def symbol_ranges(path: Column, text: Column, criteria: SymbolCriteria) -> Column:
    """The merged ranges of the criteria in a Kotlin file, an empty array for any other."""
    gate = F.coalesce(path.endswith(".kt") & may_match(text, criteria), F.lit(False))
    if criteria.whole_file:
        found = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.concat(F.lit("package "), _whole(text)).alias("description")))
        return F.when(gate, found).otherwise(F.array()).cast(RANGES_TYPE)
    return F.coalesce(_per_text(F.when(gate, text), lambda t: merged(declared(t, criteria)), RANGES_TYPE), F.array().cast(RANGES_TYPE))


def redact_kotlin(files: DataFrame, criteria: SymbolCriteria, replacement: str, *, path: str = "path", text: str = "text") -> DataFrame:
    """Replace every merged range by ``REPLACEMENT // DESCRIPTION``; Kotlin files only."""
    sources = files.filter(F.col(path).endswith(".kt"))
    ranged = sources.withColumn("_ranges", symbol_ranges(F.col(path), F.col(text), criteria))
    replaced = replace_ranges(F.col(text), F.transform("_ranges", lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), F.concat(F.lit(replacement + " // "), r["description"]).alias("replacement"))))
    return ranged.withColumn("redacted_text", replaced).drop("_ranges")
