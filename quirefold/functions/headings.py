"""Headings: their names in all languages, page headers that are told by their shape, and small edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.text import SPACE, strip, tokens

# Section headings and summary marks of notes by language.
SECTIONS = {
    "summary": {"ko": "핵심 요약", "en": "Key Summary", "ja": "要約", "zh": "核心摘要", "de": "Kurzfassung", "fr": "Résumé", "es": "Resumen", "it": "Sintesi", "pt": "Resumo", "nl": "Samenvatting", "ru": "Краткое резюме"},
    "overview": {"ko": "개요", "en": "Overview", "ja": "概要", "zh": "概述", "de": "Überblick", "fr": "Aperçu", "es": "Panorama", "it": "Panoramica", "pt": "Visão geral", "nl": "Overzicht", "ru": "Обзор"},
    "main": {"ko": "주요 내용", "en": "Main Content", "ja": "主要内容", "zh": "主要内容", "de": "Hauptinhalt", "fr": "Contenu principal", "es": "Contenido principal", "it": "Contenuto principale", "pt": "Conteúdo principal", "nl": "Hoofdinhoud", "ru": "Основное содержание"},
    "quotes": {"ko": "핵심 인용", "en": "Key Quotes", "ja": "主要引用", "zh": "核心引用", "de": "Schlüsselzitate", "fr": "Citations clés", "es": "Citas clave", "it": "Citazioni chiave", "pt": "Citações principais", "nl": "Kernciteten", "ru": "Ключевые цитаты"},
    "keywords": {"ko": "핵심 키워드", "en": "Key Terms", "ja": "キーワード", "zh": "关键词", "de": "Schlüsselbegriffe", "fr": "Mots-clés", "es": "Palabras clave", "it": "Parole chiave", "pt": "Palavras-chave", "nl": "Kernbegrippen", "ru": "Ключевые термины"},
}
SUMMARY_MARK = {"ko": "요약:", "en": "Summary:", "ja": "要約:", "zh": "摘要：", "de": "Zusammenfassung:", "fr": "Résumé :", "es": "Resumen:", "it": "Sintesi:", "pt": "Resumo:", "nl": "Samenvatting:", "ru": "Резюме:"}
FALLBACK = "ko"
HEADER_SECTIONS = ["notes", "references", "index", "bibliography", "contents"]


def heading(key: str, code: str) -> str:
    """The heading of a section in a language, in the fallback language where that has none."""
    names = SECTIONS.get(key, {})
    return names.get(code) or names.get(FALLBACK, key)


def section_of(line: Column) -> Column:
    """The key of the section that a Markdown heading begins, in whatever language; null for other lines."""
    body = strip(F.regexp_replace(strip(line), "^#+", ""))
    names = sorted(((name, key) for key, by in SECTIONS.items() for name in set(by.values())), key=lambda x: (-len(x[0]), x))
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(key).alias("key")) for name, key in names])
    found = F.get(F.filter(known, lambda n: F.startswith(body, n["name"])), F.lit(0))["key"]
    return F.when(strip(line).startswith("#"), found)


def demoted(markdown: Column) -> Column:
    """Markdown with every heading from ## to ##### one level deeper."""
    return F.regexp_replace(markdown, r"(?m)^(#{2,5})(\s)", "#$1$2")


def without_number(title: Column) -> Column:
    """A title without the chapter number before it."""
    return F.regexp_replace(F.regexp_replace(title, rf"^{SPACE}*[0-9]+[.)]{SPACE}*", ""), "^[ :：]+|[ :：]+$", "")


def citation(publisher: Column, year: Column) -> Column:
    """Publisher and year as one line; the one that is there if the other is not."""
    p, y = F.coalesce(publisher, F.lit("")), F.coalesce(year, F.lit(""))
    return F.when((p != "") & (y != ""), F.concat(p, F.lit(", "), y, F.lit("."))).otherwise(F.trim(F.concat(p, y)))


def _key(words: Column) -> Column:
    return F.regexp_replace(F.lower(F.array_join(words, "")), "[^0-9a-z가-힣]+", "")


def without_header(paragraph: Column, title: Column) -> Column:
    """A paragraph without the page header at its start; null where it was nothing else.

    A header is a page number with "Chapter" and its number (also glued before text), with the title of this very
    chapter, or with the name of a back matter section; lists of contents name other chapters and stay.
    """
    words = tokens(paragraph)
    n = F.size(words)
    number = lambda i: F.coalesce(F.get(words, i).rlike("^[0-9]{1,4}$"), F.lit(False))
    word = lambda i: F.coalesce(_key(F.slice(words, i + 1, 1)), F.lit(""))
    chapter = (n >= 3) & number(F.lit(0)) & (word(1) == "chapter") & number(F.lit(2))
    own = _key(F.array(F.regexp_replace(F.coalesce(title, F.lit("")), r"^[0-9]+[_.\s-]*", "")))
    rest_first, rest_last = F.slice(words, 2, F.greatest(n - 1, F.lit(0))), F.slice(words, 1, F.greatest(n - 1, F.lit(0)))
    titled = (own != "") & n.between(2, 7) & ((number(F.lit(0)) & (_key(rest_first) == own)) | (number(n - 1) & (_key(rest_last) == own)))
    section = (n == 2) & ((number(F.lit(0)) & word(1).isin(HEADER_SECTIONS)) | (number(F.lit(1)) & word(0).isin(HEADER_SECTIONS)))
    glued = F.array_join(F.slice(words, 4, F.greatest(n - 3, F.lit(1))), " ")
    return F.when((n == 0) | (chapter & (n == 3)) | titled | section, None).when(chapter, glued).otherwise(strip(paragraph))


def stripped_pages(text: Column, title: Column) -> Column:
    """A text without page headers, page by page, so that form feeds stay."""
    page = lambda p: F.array_join(F.filter(F.transform(F.split(p, r"\n[ \t]*\n"), lambda x: without_header(x, title)), lambda x: x.isNotNull()), "\n\n")
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\f"), page), "\f")
