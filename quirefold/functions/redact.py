"""Redaction of personal data: e-mail addresses, phone numbers, home folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (name, pattern, replacement), applied in this order. Patterns use no look-around, so that any engine reads them.
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    ("home", r"(/home/|/Users/)[A-Za-z0-9._-]+", "<home>"),
    ("phone", r"\+?[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}", "<phone>"),
]


def redacted(text: Column) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[1], rule[2]), RULES, text)


def found(text: Column) -> Column:
    """Places that ``redacted`` replaces with a mark that was not in the text before."""
    marks = lambda t: sum((F.size(F.split(t, m)) - 1 for _, _, m in RULES), F.lit(0))
    return (marks(redacted(text)) - marks(text)).cast("long")


def sql(text: str) -> str:
    return reduce(lambda t, rule: f"regexp_replace({t}, '{rule[1]}', '{rule[2]}', 'g')", RULES, text)


def found_sql(text: str) -> str:
    marks = lambda t: " + ".join(f"len(string_split({t}, '{m}')) - 1" for _, _, m in RULES)
    return f"CAST(({marks(sql(text))}) - ({marks(text)}) AS BIGINT)"
