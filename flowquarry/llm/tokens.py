"""Sizes of texts in tokens: maximal runs of letters, digits and underscores, or of other non-space characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, beyond what \s covers.
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"


def token_count(text: Column) -> Column:
    """Number of tokens; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def plain_key(c: Column) -> Column:
    """Trimmed (any white space), lower case."""
    return F.lower(F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", ""))
