"""Text expressions: whitespace, excerpts, redaction, injection flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip / str.split treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
)
SPACE_CLASS = "[\\s\\x1c-\\x1f]"  # with (?U): the same set as a regular expression

# Phrases that try to override instructions.
INJECTION_PATTERNS = (
    r"(?iUd)ignore\s+(all\s+)?previous\s+instructions",
    r"(?Ud)忽略.{0,8}(之前|以上|系统).{0,8}(指令|规则)",
    r"(?iUd)system\s*prompt",
)
REDACTED_CHUNK = "[Potential prompt injection redacted]"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.trim(_column(value), F.lit(WHITESPACE))


def collapse_spaces(value: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(_column(value), f"(?U){SPACE_CLASS}+", " "))


def excerpt(value: Column | str, limit: int) -> Column:
    return F.left(collapse_spaces(value), F.lit(limit))


def redact_text(value: Column | str, limit: int = 280) -> Column:
    """Short texts stay; long ones become a prefix plus a short hash of the original."""
    compact = collapse_spaces(value)
    digest = F.left(F.sha2(_column(value), 256), F.lit(12))
    cut = F.concat(F.left(compact, F.lit(limit)), F.lit("… [sha256:"), digest, F.lit("]"))
    return F.when(F.length(compact) <= limit, compact).otherwise(cut)


def flag_injection(value: Column | str) -> Column:
    hit = F.lit(False)
    for pattern in INJECTION_PATTERNS:
        hit = hit | F.rlike(_column(value), F.lit(pattern))
    return hit
