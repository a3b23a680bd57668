"""Small text expressions that several operators use. White space is the ASCII class in all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def compact(text: Column) -> Column:
    """``text`` without white space."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def filled_lines(text: Column) -> Column:
    """The stripped lines that are not blank."""
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    return F.array_remove(stripped, "")


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def runs(text: Column, chars: str) -> Column:
    """The maximal runs of the characters ``chars`` (the inside of a class).

    Splitting at all others is many times as fast as extracting, which copies the text for each match.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[^{chars}]+"), "")


# The same in the SQL dialect of the twins.
def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


def filled_lines_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda s: {strip_sql('s')}), lambda s: s <> '')"


def tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
