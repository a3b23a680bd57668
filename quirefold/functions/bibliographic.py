"""Dates, publishers, links and titles in bibliographic text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import strip

# The patterns of dates and publishers, tried in this order.
YEAR = "(?:18|19|20)[0-9]{2}"
DATES = [
    rf"(?:발행일|출판일|간행일|발행)\s*[:：]?\s*({YEAR}[./년 -]?\s*[0-9]{{0,2}}[./월 -]?\s*[0-9]{{0,2}})",
    rf"(?i)(?:Published|Publication date|Date published)\s*[:：]?\s*({YEAR}(?:[-/.][0-9]{{1,2}})?(?:[-/.][0-9]{{1,2}})?)",
    rf"(?i)(?:Copyright|©|\(c\))\s*({YEAR})",
]
PUBLISHERS = [
    r"(?:출판사|발행처|발행자|펴낸곳|펴낸 곳|출판)\s*[:：]\s*([^\n\r]{2,80})",
    r"(?i)(?:Publisher|Published by)\s*[:：]\s*([^\n\r]{2,100})",
]
PUBLISHER_ENDS = r"(?i)(?:ISBN|ISSN|DOI|전화|팩스|주소|등록|인쇄|발행일|출판일|copyright|©|http|www\.)"
PUBLISHER_EDGE = r"[ \t|,.;·ㆍ-]+"
LINKS = [
    r"""(?i)<meta[^>]+name=["']citation_pdf_url["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']citation_pdf_url["']""",
    r"""(?i)href=["']([^"']+\.pdf(?:\?[^"']*)?)["']""",
]
HEAD, TAIL = 80_000, 40_000


def first_match(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that matches caught; '' without a match."""
    caught = [F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in patterns]
    return F.coalesce(*caught, F.lit(""))


def clean_date(raw: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD, as precise as the text is."""
    bare = F.regexp_replace(raw, r"\s+", "")
    pattern = rf"^({YEAR})(?:[./년 -]?([0-9]{{1,2}}))?(?:[./월 -]?([0-9]{{1,2}}))?"
    year, month, day = (F.regexp_extract(bare, pattern, i) for i in (1, 2, 3))
    two = lambda c: F.lpad(c, 2, "0")
    return (
        F.when(year == "", "")
        .when((month != "") & (day != ""), F.concat_ws("-", year, two(month), two(day)))
        .when(month != "", F.concat_ws("-", year, two(month)))
        .otherwise(year)
    )


def sample(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.concat(F.substring(whole, 1, HEAD), F.lit("\n"), F.substring(whole, F.greatest(F.length(whole) - TAIL + 1, F.lit(1)), F.lit(TAIL)))


def published(text: Column) -> Column:
    return clean_date(first_match(sample(text), DATES))


def published_from_name(name: Column) -> Column:
    """From an arXiv-like number, a compact year and month, or a leading year."""
    arxiv = r"(?:^|[^0-9A-Za-z_])([12][0-9])(0[1-9]|1[0-2])\.[0-9]{4,5}(?:[^0-9A-Za-z_]|$)"
    compact = r"(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(0[1-9]|1[0-2])(?:[^0-9A-Za-z_]|$)"
    leading = r"^[^0-9]*((?:19|20)[0-9]{2})(?:[^0-9]|$)"
    pick = lambda p, i: F.regexp_extract(name, p, i)
    return (
        F.when(name.rlike(arxiv), F.concat(F.lit("20"), pick(arxiv, 1), F.lit("-"), pick(arxiv, 2)))
        .when(name.rlike(compact), F.concat_ws("-", pick(compact, 1), pick(compact, 2)))
        .when(name.rlike(leading), pick(leading, 1))
        .otherwise("")
    )


def clean_publisher(raw: Column) -> Column:
    """A publisher's name up to the first stop word; '' for what can't be one."""
    edge = lambda t: F.regexp_replace(t, f"^{PUBLISHER_EDGE}|{PUBLISHER_EDGE}$", "")
    text = edge(F.split(F.regexp_replace(edge(raw), r"\s+", " "), PUBLISHER_ENDS)[0])
    return F.when(F.length(text).between(2, 80) & ~text.rlike("^[0-9]+$"), text).otherwise("")


def publisher(text: Column) -> Column:
    found = [F.nullif(clean_publisher(first_match(sample(text), [p])), F.lit("")) for p in PUBLISHERS]
    return F.coalesce(*found, F.lit(""))


def pdf_link(html: Column) -> Column:
    """The first PDF link of a page, as it is written but for &amp;; '' without one."""
    return F.replace(first_match(html, LINKS), F.lit("&amp;"), F.lit("&"))


def resolved(base: Column, link: Column) -> Column:
    """``link`` against ``base``: absolute, root-relative, and relative with leading ../ or ./"""
    root = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    folder = F.when(F.length(folder) <= F.length(root), F.concat(root, F.lit("/"))).otherwise(folder)
    up = F.regexp_replace(folder, r"[^/]+/$", "")
    return (
        F.when(link == "", F.lit(None).cast("string"))
        .when(link.rlike("^[a-z]+://"), link)
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("../"), F.concat(F.when(F.length(up) > F.length(root), up).otherwise(F.concat(root, F.lit("/"))), F.substring(link, F.lit(4), F.length(link))))
        .otherwise(F.concat(folder, F.regexp_replace(link, r"^\./", "")))
    )


# ---- titles -------------------------------------------------------------------------------------------------------

ILLEGAL = r'[\\/:*?<>|]+'
TITLE_BYTES = 180
NO_TITLE = "untitled"
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def paired_quotes(title: Column) -> Column:
    """Straight double quotes in turn as opening and closing ones."""
    parts = F.split(title, '"')
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, "“").otherwise("”"), p)), "")


def cut_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, ended at a space if one stands in the last two thirds."""
    # the longest prefix that fits: characters have 1 to 4 bytes, so it is searched among prefix lengths
    lengths = F.sequence(F.lit(0), F.least(F.length(text), F.lit(limit)))
    fit = F.array_max(F.filter(lengths, lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= limit))
    cut = F.substring(text, F.lit(1), fit)
    space = F.length(cut) - F.locate(" ", F.reverse(cut))
    at_word = (F.locate(" ", F.reverse(cut)) > 0) & (space > limit // 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.rtrim(F.when(at_word, F.substring(cut, F.lit(1), space)).otherwise(cut)))


def safe_title(title: Column) -> Column:
    """A title as a file name: quotes paired, illegal characters a dash, at most TITLE_BYTES bytes."""
    clean = strip(F.regexp_replace(F.regexp_replace(paired_quotes(title), ILLEGAL, " - "), r"\s+", " "))
    edge = r"[ .,:-]+"
    cut = F.regexp_replace(cut_bytes(clean, TITLE_BYTES), f"^{edge}|{edge}$", "")
    return F.when(cut == "", NO_TITLE).otherwise(cut)


def roman_to_int(numeral: Column) -> Column:
    """The value of a Roman numeral in either case; null for anything else."""
    values = F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))])
    letters = F.reverse(F.split(F.upper(numeral), ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(acc: Column, letter: Column) -> Column:
        v = F.element_at(values, letter)
        return F.struct(F.when(v < acc["most"], acc["total"] - v).otherwise(acc["total"] + v).alias("total"), F.greatest(acc["most"], v).alias("most"))

    return F.when(numeral.rlike("^(?i)[IVXLCDM]+$"), F.aggregate(letters, start, step, lambda a: a["total"]))


def with_plain_title(df: DataFrame, title: str, ordinal: str, out: str) -> DataFrame:
    """Append ``out``: the title without leading numbers that only repeat its ordinal, up to three of them."""
    dotted, spaced = r"^([0-9]{1,3})\s*[.):]\s*(.+)$", r"^([0-9]{1,3})\s+(\S.*)$"
    roman, chapter = r"^([IVXLCivxlc]{1,6})\s*[.):]\s*(.+)$", r"^제?\s*([0-9]{1,3})\s*장\s*[.:)]?\s+(.+)$"
    df = df.withColumn("_t0", strip(F.col(title)))
    for i in range(3):
        t, step = F.col(f"_t{i}"), None
        for pattern, is_roman in ((dotted, False), (spaced, False), (roman, True), (chapter, False)):
            number = F.regexp_extract(t, pattern, 1)
            got = roman_to_int(number) if is_roman else number.try_cast("int")
            hit = t.rlike(pattern) & F.coalesce(got == F.col(ordinal), F.lit(False))
            step = (F.when if step is None else step.when)(hit, strip(F.regexp_extract(t, pattern, 2)))
        df = df.withColumn(f"_t{i + 1}", step.otherwise(t))
    return df.withColumn(out, F.when(F.col("_t3") == "", F.col("_t0")).otherwise(F.col("_t3"))).drop("_t0", "_t1", "_t2", "_t3")
