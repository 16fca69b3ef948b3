"""Text functions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import QueryError


def occurrences(text: Column | str, pattern: str) -> Column:
    """How often the pattern occurs, left to right without overlap; null text has none."""
    if not pattern:
        raise QueryError("the pattern is empty")
    text = F.col(text) if isinstance(text, str) else text
    gone = F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))
    # most texts lack the pattern: a search costs less than a copy
    return F.when(text.contains(F.lit(pattern)), (gone / F.lit(len(pattern))).cast("long")).otherwise(F.lit(0).cast("long"))


def token_after(text: Column | str, lead: str, longest: int = 63) -> Column:
    """The token after the first ``lead``: spaces are skipped, a blank or line end stops it."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(text, rf"{lead} *([^ \r\n]{{0,{longest}}})", 1)
