"""Predicates over paths and texts: globs, regexes, rule conditions."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from ..policy import Match
from .text import BLANK_CLASS


def glob_to_regex(glob: str) -> str:
    """Translate a path glob to an anchored Java regex.

    ``*`` and ``?`` stay within one path component, ``**`` crosses components,
    ``[...]`` never matches ``/`` and ``{a,b}`` are alternatives.  The whole
    path has to match, so ``**/x`` does not match ``x`` at the root.
    """
    out, i, in_group = [], 0, False
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "\\":
            if i == len(glob):
                raise ValueError(f"glob ends with an escape: {glob!r}")
            out.append(_literal(glob[i]))
            i += 1
        elif c == "*":
            if glob[i:i + 1] == "*":
                out.append(".*")
                i += 1
            else:
                out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 1)
            if end < 0:
                raise ValueError(f"unclosed [ in glob {glob!r}")
            body = glob[i:end]
            negated = body.startswith("!")
            body = body[1:] if negated else body
            if "/" in body:
                raise ValueError(f"/ inside [] in glob {glob!r}")
            for special in "\\[]^&":
                body = body.replace(special, "\\" + special)
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
            i = end + 1
        elif c == "{":
            if in_group:
                raise ValueError(f"nested group in glob {glob!r}")
            out.append("(?:(?:")
            in_group = True
        elif c == "}" and in_group:
            out.append("))")
            in_group = False
        elif c == "," and in_group:
            out.append(")|(?:")
        else:
            out.append(_literal(c))
    if in_group:
        raise ValueError(f"unclosed {{ in glob {glob!r}")
    return rf"\A(?:{''.join(out)})\z"


def _literal(char: str) -> str:
    return char if char.isalnum() or char in "/_" else "\\" + char


def required_literals(pattern: str) -> tuple[str, ...]:
    """Plain texts of which every match contains at least one, empty if unknown.

    One per alternative at the top: its longest run of plain characters.  Groups
    and classes are stepped over; anything unusual gives no literals.  Of escapes,
    only the common classes, ``\\b``, ``\\B`` and escaped punctuation are known.
    """
    best, runs, run, i = [], [""], "", 0

    def after_class(at: int) -> int:
        body = re.compile(r"\[\^?\]?(?:\\.|[^\]\[\\&])*\]").match(pattern, at)
        return body.end() if body else -1

    def after_group(at: int) -> int:
        depth = 0
        while at < len(pattern):
            c = pattern[at]
            if c == "\\":
                at += 1
            elif c == "[":
                at = after_class(at) - 1
                if at < 0:
                    return -1
            elif c in "()":
                depth += 1 if c == "(" else -1
                if depth == 0:
                    return at + 1
            at += 1
        return -1

    if re.search(r"\\[QE1-9kcN]|\(\?[^:]", pattern):
        return ()
    while i < len(pattern):
        c, char = pattern[i], ""
        if c == "|":
            best.append(max([*runs, run], key=len))
            runs, run, i = [""], "", i + 1
            continue
        if c in "{}*+?)]":
            return ()
        if c in "([":
            i = after_group(i) if c == "(" else after_class(i)
            if i < 0:
                return ()
        elif c == "\\":
            if i + 1 == len(pattern):
                return ()
            if pattern[i + 1].isalnum() and pattern[i + 1] not in "dwsbDWSB":
                return ()
            char = "" if pattern[i + 1].isalnum() else pattern[i + 1]
            i += 2
        else:
            char = "" if c in "^$." else c
            i += 1
        quantifier = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?").match(pattern, i)
        if quantifier:
            i = quantifier.end()
            run += char if quantifier.group().startswith("+") else ""
        else:
            run += char
        if quantifier or not char:
            runs.append(run)
            run = ""
    best.append(max([*runs, run], key=len))
    return tuple(best) if all(best) else ()


def found(text: Column, pattern: str) -> Column:
    """``rlike`` behind a byte search for the literals that matches contain.

    Most texts match no rule; the byte search rejects them at a fraction of the
    cost of a regex scan.
    """
    literals = required_literals(pattern)
    if not literals:
        return text.rlike(pattern)
    return reduce(or_, (text.contains(literal) for literal in literals)) & text.rlike(pattern)


def any_regex(col: Column, patterns) -> Column:
    """True if any pattern is found; NULL input gives false."""
    return F.coalesce(reduce(or_, (found(col, p) for p in patterns), F.lit(False)), F.lit(False))


def glob_match(path: Column, globs) -> Column:
    """Whole-path match of any glob."""
    return F.coalesce(reduce(or_, (path.rlike(glob_to_regex(g)) for g in globs), F.lit(False)), F.lit(False))


def path_regex_match(path: Column, patterns) -> Column:
    return any_regex(path, patterns)


def content_regex_match(text: Column, patterns) -> Column:
    return any_regex(text, patterns)


def path_condition(match: Match, path: Column | None) -> Column | None:
    """Conjunction of the path criteria, None if there are none."""
    if not match.has_path:
        return None
    if path is None:
        return F.lit(False)
    kinds = []
    if match.paths:
        kinds.append(glob_match(path, match.paths))
    if match.path_regex:
        kinds.append(path_regex_match(path, match.path_regex))
    return reduce(and_, kinds)


def rule_matches(match: Match, path: Column | None, text: Column,
                 symbols_found: Column | None = None) -> Column:
    """Patterns of one kind are alternatives, the kinds present must all hold.

    A rule without criteria never matches.  ``symbols_found`` is None where
    symbol rules do not apply.
    """
    kinds = []
    on_path = path_condition(match, path)
    if on_path is not None:
        kinds.append(on_path)
    if match.content_regex:
        kinds.append(content_regex_match(text, match.content_regex))
    if match.kotlin is not None:
        kinds.append(F.lit(False) if symbols_found is None else symbols_found)
    return reduce(and_, kinds) if kinds else F.lit(False)


def is_sanitizable_line(text: Column) -> Column:
    """False for blank lines and for commands (trimmed text starts with ``/``)."""
    return F.coalesce(text.rlike(rf"\A{BLANK_CLASS}*[^/{BLANK_CLASS[1:]}"), F.lit(False))
