"""Names, keys, numbers and small notations."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.text import compact, strip


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Canonical composition, which Spark has no function for."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


# ---- keys: each compares names of another kind, so they stay apart --------------------------------------------------


def title_key(title: Column) -> Column:
    """A title for comparison: lower case, letters and digits only."""
    return F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}]+", ""))


def letters_key(line: Column) -> Column:
    """A line for comparison: its letters alone."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def citation_key(quote: Column) -> Column:
    """A quotation for comparison: without parentheses, white space and outer quotes."""
    return F.regexp_replace(compact(F.regexp_replace(quote, r"\([^)]*\)", "")), "^[\"“”‘’]+|[\"“”‘’]+$", "")


def override_key(text: Column) -> Column:
    """The key of a user's override: 16 digits of the SHA-1 of the text with single spaces."""
    return F.substring(F.sha1(strip(F.regexp_replace(text, r"\s+", " "))), 1, 16)


# ---- file names ------------------------------------------------------------------------------------------------------


def file_name(title: Column, most: int = 80) -> Column:
    """A title as a file name: no separators or control characters, single spaces, at most ``most`` characters."""
    clean = strip(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|\x00-\x1f]+', " "), r"\s+", " "))
    cut = strip(F.substring(clean, 1, most))
    return F.when(cut == "", "untitled").otherwise(cut)


def stem_key(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def author_from_stem(stem: Column) -> Column:
    """The last part of a stem in the form title_author, if it looks like a name; '' otherwise."""
    last = strip(F.element_at(F.split(stem, "_"), -1))
    fits = (F.size(F.split(stem, "_")) >= 2) & F.length(last).between(2, 40) & ~last.rlike("[0-9]")
    return F.when(fits, last).otherwise("")


# ---- notations -------------------------------------------------------------------------------------------------------


def plain_superscripts(text: Column) -> Column:
    """Superscript digits as digits, but not where a digit stands before them: 10² is no note."""
    out = text
    for digit, sup in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹"):
        # a run is changed from its first digit on, which no other digit precedes
        out = F.regexp_replace(out, f"(?<![0-9⁰¹²³⁴-⁹]){sup}", f"\x01{digit}")
    for _ in range(3):
        for digit, sup in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹"):
            out = F.regexp_replace(out, f"(\x01[0-9]+){sup}", f"$1{digit}")
    return F.replace(out, F.lit("\x01"), F.lit(""))


def page_range(text: Column) -> Column:
    """``"200-203, 250"`` as a sorted array of page numbers; parts that are no range are left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), compact), lambda p: p.rlike("^[0-9]{1,6}(-[0-9]{1,6})?$"))

    def pages(p: Column) -> Column:
        a = F.regexp_extract(p, "^([0-9]+)", 1).cast("int")
        b = F.when(p.contains("-"), F.regexp_extract(p, "-([0-9]+)$", 1).cast("int")).otherwise(a)
        return F.sequence(F.least(a, b), F.greatest(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def source_candidates(source: Column) -> Column:
    """URLs to try for an arXiv number, a DOI or an address, in order and without repeats."""
    s = strip(F.coalesce(source, F.lit("")))
    arxiv = F.regexp_extract(s, r"(?i)(?:arxiv[:.\s]*|arxiv\.org/(?:abs|pdf)/)?([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)", 1)
    doi = F.regexp_extract(s, r"(?i)(?:doi[:\s]*|doi\.org/)?(10\.[0-9]{4,9}/[^\s]+)", 1)
    tried = F.array(
        F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)),
        F.when(s.rlike(r"(?i)^https?://\S+$"), s),
        F.when((doi != "") & (arxiv == ""), F.concat(F.lit("https://doi.org/"), doi)),
    )
    return F.array_distinct(F.array_compact(tried))


def sniffed(content: Column) -> Column:
    """pdf, office, zip, html or text by the first bytes of a file."""
    head = F.substring(content, 1, 512)
    low = F.lower(F.ltrim(F.try_validate_utf8(head.cast("string"))))
    return (
        F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf")
        .when(F.substring(content, 1, 4) == F.lit(b"\xd0\xcf\x11\xe0"), "office")
        .when(F.substring(content, 1, 4) == F.lit(b"PK\x03\x04"), "zip")
        .when(low.startswith("<!doctype html") | low.startswith("<html"), "html")
        .otherwise("text")
    )


def first_json(text: Column) -> Column:
    """The outermost {...} of a reply, code fences aside; null where it is no JSON."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull(), body)


def pdf_date(raw: Column) -> Column:
    """YYYY-MM-DD of ``D:YYYYMMDD...`` and of ctime forms, else the year in it; '' without one."""
    compact_form = F.regexp_extract(raw, r"^(?:D:)?([0-9]{4})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])", 0)
    digits = F.regexp_replace(compact_form, "^D:", "")
    spelled = F.regexp_extract(raw, r"^[A-Z][a-z]{2} +([A-Z][a-z]{2}) +([0-9]{1,2}) [0-9:]{8} (?:[A-Z]+ )?([0-9]{4})", 0)
    pick = lambda i: F.regexp_extract(raw, r"^[A-Z][a-z]{2} +([A-Z][a-z]{2}) +([0-9]{1,2}) [0-9:]{8} (?:[A-Z]+ )?([0-9]{4})", i)
    month = F.lpad((F.floor((F.position(pick(1), F.lit("JanFebMarAprMayJunJulAugSepOctNovDec")) - 1) / 3) + 1).cast("string"), 2, "0")
    return (
        F.when(digits != "", F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))
        .when(spelled != "", F.concat_ws("-", pick(3), month, F.lpad(pick(2), 2, "0")))
        .otherwise(F.regexp_extract(raw, "((?:19|20)[0-9]{2})", 1))
    )


def escaped(text: Column) -> Column:
    """Text for XHTML."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for mark, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


# ---- messages --------------------------------------------------------------------------------------------------------

LIMIT_WORDS = r"(?i)(^|[^0-9])429([^0-9]|$)|rate.?limit|usage.?limit|quota|too many requests|resource.?exhausted|overloaded"
CONFIG_WORDS = r"(?i)api.?key|unauthori[sz]ed|forbidden|invalid.?model|model.?not.?found|not.?configured|permission denied"


def error_class(status: Column, message: Column) -> Column:
    """limit, configuration or other: only a limit is a reason to wait or to go to the next provider."""
    m = F.coalesce(message, F.lit(""))
    return F.when((status == 429) | m.rlike(LIMIT_WORDS), "limit").when(status.isin(401, 403, 404) | m.rlike(CONFIG_WORDS), "configuration").otherwise("other")


def cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """Price of a call from the tokens and the rates for a million of them."""
    return (tokens_in * F.lit(rate_in) + tokens_out * F.lit(rate_out)) / F.lit(1_000_000.0)
