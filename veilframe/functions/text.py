"""Text transformations as Column expressions (no Python per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Whitespace as trimming and blank tests understand it: every Unicode
#: separator plus the ASCII control blanks.
BLANK_CLASS = r"[\p{Z}\t-\r\x1C-\x1F]"

RANGE_TYPE = "array<struct<start:int,end:int,replacement:string>>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decode_text(content: Column) -> Column:
    """Strict UTF-8 text of a binary column; NULL for anything else."""
    return F.try_validate_utf8(content.cast("string"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK_CLASS}+|{BLANK_CLASS}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{BLANK_CLASS[1:]}")


def quote_replacement(text: str) -> str:
    """Escape a literal for use as a regex replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def sql_string(value: str) -> str:
    """A string literal for SQL expressions."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def redact_content(text: Column, patterns, replacement: str) -> Column:
    """Replace every pattern in order; ``$1`` and ``\\`` work in the replacement."""
    return reduce(lambda t, p: F.regexp_replace(t, F.lit(p), F.lit(replacement)), patterns, text)


def summary_of_rule(rule_id: str) -> Column:
    return F.lit(f"<summarized by {rule_id}>")


def summary_of_detector(detector_id: str) -> Column:
    return F.lit(f"<summarized:{detector_id}>")


def replace_ranges(text: Column, ranges: Column) -> Column:
    """Replace (start, end, replacement) ranges, offsets in code points.

    Disjoint ranges (the normal case) are cut out of a fixed-width encoding, so
    the cost is linear in the text however many ranges there are.  Overlapping
    ranges are applied one by one, highest start first.
    """
    ordered = F.sort_array(ranges)

    def overlaps(rs: Column) -> Column:
        return F.exists(
            F.sequence(F.lit(1), F.size(rs)),
            lambda i: (i > 1) & (F.get(rs, i - 1)["start"] < F.get(rs, i - 2)["end"]))

    def cut(wide: Column, start: Column, end: Column) -> Column:
        return F.decode(F.substring(wide, 4 * start + 1, 4 * F.greatest(end - start, F.lit(0))), "UTF-32")

    def pieces(bound: Column) -> Column:
        rs, wide = bound["rs"], bound["wide"]
        total = (F.octet_length(wide) / 4).cast("int")
        heads = F.transform(rs, lambda r, i: F.concat(
            cut(wide, F.when(i == 0, F.lit(0)).otherwise(F.get(rs, i - 1)["end"]), r["start"]),
            r["replacement"]))
        return F.concat(F.array_join(heads, ""), cut(wide, F.element_at(rs, -1)["end"], total))

    def one_by_one(rs: Column) -> Column:
        return F.aggregate(F.reverse(rs), text, lambda t, r: F.concat(
            F.substring(t, F.lit(1), r["start"]), r["replacement"],
            F.substring(t, r["end"] + 1, F.length(t))))

    return (F.when(F.coalesce(F.size(ranges), F.lit(0)) <= 0, text)
            .when(let(ordered, overlaps), let(ordered, one_by_one))
            .otherwise(let(F.struct(ordered.alias("rs"), F.encode(text, "UTF-32").alias("wide")), pieces)))


def redact_values(text: Column, values: Column, replacement: str) -> Column:
    """Replace literal values: blanks dropped, distinct, longest first.

    Values of one length keep the order of their first occurrence.
    """
    kept = F.array_distinct(F.filter(values, lambda v: ~is_blank(v)))
    ranked = F.sort_array(F.transform(kept, lambda v, i: F.struct(
        (-F.length(v)).alias("rank"), i.alias("ord"), v.alias("value"))))
    redacted = F.aggregate(ranked, text, lambda t, r: F.replace(t, r["value"], F.lit(replacement)))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, redacted).otherwise(text)


def extract_spans(text: Column, spans: Column) -> Column:
    """Substring per (start, end) span; invalid spans are dropped.

    Offsets count UTF-16 units, as the detectors' output does.  A span that
    would split a surrogate pair names no text and is dropped as well.
    """
    def low_surrogate(wide: Column, at: Column) -> Column:
        lead = F.hex(F.substring(wide, 2 * at + 1, F.lit(1)))
        return lead.between("DC", "DF")

    def cut(wide: Column) -> Column:
        units = (F.octet_length(wide) / 2).cast("int")
        valid = F.filter(spans, lambda s: F.coalesce(
            (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= units)
            & ~low_surrogate(wide, s["start"]) & ~low_surrogate(wide, s["end"]), F.lit(False)))
        return F.transform(valid, lambda s: F.decode(
            F.substring(wide, 2 * s["start"] + 1, 2 * (s["end"] - s["start"])), "UTF-16BE"))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, let(F.encode(text, "UTF-16BE"), cut)) \
        .otherwise(F.array().cast("array<string>"))
