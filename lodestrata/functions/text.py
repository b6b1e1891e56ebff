"""Text, path and identity expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: path classes and query intents.
TEST_DIR = r"(^|/)(tests?|__tests__|specs?)(/|$)"
TEST_FILE = r"(^|/)(test_[^/]*|[^/]*_(test|spec)|[^/]*\.(test|spec))\.[^/]+$"
DOCS_DIR = r"(^|/)(docs?|documentation)(/|$)"
DOCS_FILE = r"(^|/)(readme|changelog)(\.[^/]*)?$"
DOCS_EXTENSION = r"\.(md|mdx|rst|adoc)$"
TEST_INTENT = r"(?<!\w)(?:tests?|testing|pytest|unittest|specs?)(?!\w)"
DOCS_INTENT = r"(?<!\w)(?:docs?|documentation|readme|markdown|changelog)(?!\w)"


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(TEST_DIR) | low.rlike(TEST_FILE)


def is_docs_path(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(DOCS_DIR) | low.rlike(DOCS_FILE) | low.rlike(DOCS_EXTENSION)


def path_class(path: Column) -> Column:
    """test, docs or other; test wins."""
    return F.when(is_test_path(path), "test").when(is_docs_path(path), "docs").otherwise("other")


def intends(query: str, pattern: str) -> bool:
    return re.search(pattern, query, re.IGNORECASE) is not None


def contains_ignoring_case(column: Column, needle: str) -> Column:
    return F.contains(F.lower(column), F.lit(needle.lower()))


def like(column: Column, pattern: str) -> Column:
    """SQL LIKE without an escape character, as an anchored regular expression."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return column.rlike(f"(?s)^{body}\\z")


def any_like(column: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | like(column, pattern)
    return out


def strip(column: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def is_aligned(text: Column, start: Column, end: Column) -> Column:
    """Whether the text has exactly the lines that its range claims."""
    return line_count(text) == end - start + 1


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(path: Column, start: Column, end: Column, text: Column) -> Column:
    nul = F.char(F.lit(0))
    return F.substring(F.sha2(F.concat(path, nul, start.cast("string"), F.lit(":"), end.cast("string"), nul, text), 256), 1, 16)
