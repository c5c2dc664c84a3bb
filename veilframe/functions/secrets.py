"""Secret-like values: one alternation, so matches never overlap."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from ..policy import REDACT, SUMMARIZE
from .match import found
from .text import quote_replacement

# Public credential formats.  Plain character classes only, so
# that every common regex engine agrees on them.
SECRET_PATTERNS = (
    # assignment of a long value to a credential-like key
    r"""(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?[ \t]*[:=][ \t]*["']?[A-Za-z0-9_-]{16,}["']?""",
    # AWS access key id
    r"AKIA[0-9A-Z]{16}",
    # GitHub tokens
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    # PEM private key header
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    # JSON web token
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
)

SECRET_REGEX = "|".join(SECRET_PATTERNS)


def has_secrets(text: Column) -> Column:
    """Whether any secret-like value occurs; cheap for texts without one."""
    assigned = (text.contains("=") | text.contains(":")) & text.rlike(SECRET_PATTERNS[0])
    return F.coalesce(reduce(or_, (found(text, p) for p in SECRET_PATTERNS[1:]), assigned), F.lit(False))


def find_secrets(text: Column) -> Column:
    """All secret-like values of a text, in order."""
    return F.when(has_secrets(text), F.regexp_extract_all(text, F.lit(SECRET_REGEX), F.lit(0))) \
        .otherwise(F.array().cast("array<string>"))


def count_secrets(text: Column) -> Column:
    return F.when(has_secrets(text), F.regexp_count(text, F.lit(SECRET_REGEX))).otherwise(0)


def redact_secrets(text: Column, count: Column, action: str, replacement: str) -> Column:
    """The text after the secret stage; ``count`` is the number in that text."""
    if action == REDACT:
        changed = F.regexp_replace(text, F.lit(SECRET_REGEX), F.lit(quote_replacement(replacement)))
    elif action == SUMMARIZE:
        changed = F.lit("<summarized:secret-content>")
    else:
        return text
    return F.when(count > 0, changed).otherwise(text)


def secret_message(count: str, action: str) -> str:
    """SQL of the finding's message; ``count`` is SQL as well."""
    if action == SUMMARIZE:
        return "'Summarized content after secret detection'"
    verb = "Redacted" if action == REDACT else "Detected"
    return f"concat('{verb} ', CAST({count} AS STRING), ' secret-like value(s)')"
