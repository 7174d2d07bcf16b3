"""Text column functions that follow Python's string rules with built-in Spark
expressions only (no UDF): Unicode-aware trim and Python-style title case."""

from __future__ import annotations

import sys

from pyspark.sql import Column, functions as F

# Python's str.strip() removes the characters for which str.isspace() is true.
# Spark's trim() removes only U+0020, so the full set is derived by that rule.
WHITESPACE: str = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())

# "Cased" characters as Python's title() sees them: Uppercase, Lowercase and
# Titlecase properties (Java regex names).
_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{IsTitlecase}"


def unicode_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def title_case(col: Column) -> Column:
    """Python ``str.title()``: the first letter of every run of cased letters is
    upper-cased, the rest lower-cased.

    ``initcap`` starts a word only after a space, so every run of non-cased
    characters is wrapped in two marker spaces, ``initcap`` runs once over the
    whole text, and the markers are removed again. Each run is maximal, so the
    removal pattern matches exactly the inserted pair."""
    wrapped = F.regexp_replace(col, F.lit(f"([^{_CASED}]+)"), F.lit(" $1 "))
    return F.regexp_replace(F.initcap(wrapped), F.lit(f" ([^{_CASED}]+) "), F.lit("$1"))
