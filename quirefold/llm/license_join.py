"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line of a document or a window of consecutive words that crosses line ends, a template a short notice;
all are sets of words. A block matches a template when it holds at least four fifths of the template's words. A
window is a quarter longer than its template, so a notice wrapped over any number of lines is compared as a whole,
with comment marks or a few other words in between.

The join reads every line once and keeps of it the words that any template has. Those words get a global order,
rarest in the corpus first. With ``need`` words required of a template of ``size`` words,

* prefix filter: a match has one of the first ``size - need + 1`` words of the template in that order;
* length filter: the block has ``need`` template words at all;
* positional filter: the words after the first shared one, on the side that has fewer, suffice to reach ``need``.

What passes is counted exactly, and must hold the words that name the license. Windows are looked at only in documents that hold ``need`` words of the template at
all. The filters only leave out pairs that cannot match, so every match is found.

Templates that differ in a word or two match each other's notices. Such rivals make a family, and in each block only
the member with the largest containment counts, of equal ones that with more words; what is still equal counts
together ("CC BY-NC-SA" is cc-by-nc and cc-by-sa). A window that touches a line which matches a contested family by
itself is left to that line. Blocks are sets, so a word "sa" elsewhere in the line of a CC BY notice counts as its own.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .phrase_index import words

# Public license notices and the label each one gives.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The software is provided as is, without warranty of any kind, released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Notices that one of TEMPLATES would match too: rivals of it, which keep their own labels.
VARIANTS = [
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
]
#: Words that tell a license from others with the same wording: a block must hold those of them that its template has.
NAMES = {
    "mit": {"mit"},
    "apache": {"apache"},
    "gpl": {"gnu"},
    "cc-by": {"cc", "by"},
    "cc-by-nc": {"cc", "by", "nc"},
    "cc-by-sa": {"cc", "by", "sa"},
    "cc-by-nd": {"cc", "by", "nd"},
    "mpl": {"mozilla"},
}
#: Base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", text.lower())))


def names_of(label: str, text: str) -> list[str]:
    """The words of a template that a block can't do without."""
    return sorted(NAMES.get(label, set()) & set(template_words(text)))


def needed(size: int) -> int:
    """Words of a template of ``size`` words that make a match: four fifths, rounded up."""
    return (4 * size + 4) // 5


def span(text: str) -> int:
    """Words of a window for a template: its own words with repeats, and a quarter more for words in between."""
    return 5 * len(re.findall("[a-z0-9]+", text.lower())) // 4


def families(templates: list[tuple[str, str]]) -> list[int]:
    """For each template the number of its family: the first template that it is linked with by rivals of other labels."""
    sets = [(label, set(template_words(text))) for label, text in templates]
    family = list(range(len(sets)))
    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a != b and len(x & y) >= min(needed(len(x)), needed(len(y))):
                old, new = max(family[i], family[j]), min(family[i], family[j])
                family = [new if f == old else f for f in family]
    return family


def base_places(w: Column) -> Column:
    """All places where a base phrase stands: array of (start, label)."""

    def at(i: Column) -> Column:
        hit = F.lit(None).cast("string")
        for phrase, label in PHRASES:
            parts = phrase.split()
            same = reduce(lambda a, b: a & b, [F.get(w, i + k) == p for k, p in enumerate(parts)])
            hit = F.when(same, F.lit(label)).otherwise(hit)
        return F.struct(i.alias("start"), hit.alias("label"))

    last = {p.split()[-1] for p, _ in PHRASES}
    looked = reduce(lambda a, b: a | b, [F.array_contains(w, x) for x in last]) & (F.size(w) >= 2)
    none = F.array().cast("array<struct<start:int,label:string>>")
    return F.when(looked, F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1), at), lambda p: p["label"].isNotNull())).otherwise(none)


def similarity_join(blocks: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(the columns of ``blocks`` but for line, family, label, containment, size) for every matching pair of line and template."""
    sets = [(label, template_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    literal = lambda ws: F.array(*[F.lit(w) for w in ws])
    keys = [c for c in blocks.columns if c != "line"]
    records = common.stored(
        blocks.select(*keys, F.array_intersect(literal(vocabulary), words(F.col("line"))).alias("toks")).where(F.size("toks") > 0), "blocks"
    )
    # one row for each template word comes to the driver
    counts = {r["t"]: r["n"] for r in records.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes, whole, family = [], [], families(templates)
    for number, (label, ws) in enumerate(sets):
        ranked = sorted(ws, key=rank.__getitem__)
        need = needed(len(ws))
        whole.append((number, family[number], label, ranked, names_of(*templates[number])))
        prefixes += [(w, number, at, len(ws), need) for at, w in enumerate(ranked[: len(ws) - need + 1])]
    spark = blocks.sparkSession
    index = spark.createDataFrame(prefixes, "t string, template int, at int, size int, need int")
    least = min(p[4] for p in prefixes)
    ordered = records.where(F.size("toks") >= least).select(*keys, F.array_intersect(literal(order), "toks").alias("toks"))
    rare = sorted({p[0] for p in prefixes})
    shared = (
        ordered.where(F.arrays_overlap("toks", literal(rare)))
        .select(*keys, "toks", F.posexplode("toks").alias("place", "t"))
        .where(F.col("t").isin(rare))
        .join(common.maybe_broadcast(index, len(prefixes)), "t")
        .where(F.size("toks") >= F.col("need"))
        .where(1 + F.least(F.col("size") - F.col("at") - 1, F.size("toks") - F.col("place") - 1) >= F.col("need"))
        .select(*keys, "toks", "template", "need", "size")
        .distinct()
    )
    full = spark.createDataFrame(whole, "template int, family int, label string, ws array<string>, names array<string>")
    overlap = F.size(F.array_intersect("ws", "toks"))
    return (
        shared.join(common.maybe_broadcast_arrays(full, F.size("ws")), "template")
        .where((overlap >= F.col("need")) & (F.size(F.array_except("names", "toks")) == 0))
        .select(*keys, "family", "label", (overlap / F.col("size")).alias("containment"), "size")
    )


def winners(pairs: DataFrame, block: list[str]) -> DataFrame:
    """Of the pairs of each block and family those with the largest containment, then size: (block, family, label, containment)."""
    best = pairs.groupBy(*block, "family").agg(
        F.max(F.struct("containment", "size")).alias("_top"), F.collect_set(F.struct("label", "containment", "size")).alias("_all")
    )
    top = F.col("_top")
    won = F.filter("_all", lambda p: (p["containment"] == top["containment"]) & (p["size"] == top["size"]))
    return best.select(*block, "family", F.explode(won).alias("_won")).select(*block, "family", "_won.label", "_won.containment")


def wrapped_notices(texts: DataFrame, templates: list[tuple[str, str]], text: str = "_text") -> DataFrame:
    """(the columns of ``texts`` but for ``text``, first, last, family, label, containment) for every window from line ``first`` to a
    later line ``last`` that matches a template, with the winners of each family.

    Every window with the most shared words can be moved to begin at a word of the family, so only those are counted.
    """
    literal = lambda ws: F.array(*[F.lit(w) for w in ws])
    sets = [template_words(notice) for _, notice in templates]
    vocabulary = literal(sorted({w for ws in sets for w in ws}))
    keys = [c for c in texts.columns if c != text]
    groups: dict[int, list[int]] = {}
    for number, family in enumerate(families(templates)):
        groups.setdefault(family, []).append(number)
    possible = []
    for family, numbers in groups.items():
        fits = reduce(lambda a, b: a | b, [F.size(F.array_intersect(literal(sets[n]), "_toks")) >= needed(len(sets[n])) for n in numbers])
        members = [
            F.struct(
                F.lit(templates[n][0]).alias("label"),
                literal(sets[n]).alias("ws"),
                literal(names_of(*templates[n])).cast("array<string>").alias("names"),
                F.lit(needed(len(sets[n]))).alias("need"),
            )
            for n in numbers
        ]
        width = F.lit(max(span(templates[n][1]) for n in numbers)).alias("span")
        every = literal(sorted({w for n in numbers for w in sets[n]})).alias("ws")
        possible.append(F.when(fits, F.struct(F.lit(family).alias("family"), F.array(*members).alias("members"), every, width)))
    least = min(needed(len(ws)) for ws in sets)
    held = F.when(F.contains(text, F.lit("\n")), F.array_intersect(vocabulary, words(F.col(text))))
    lines = F.transform(F.split(text, "\n"), lambda x, n: F.transform(words(x), lambda w: F.struct(n.alias("line"), w.alias("w"))))
    placed = F.transform(F.flatten(lines), lambda x, i: F.struct(i.alias("at"), x["line"].alias("line"), x["w"].alias("w")))
    t, hits = F.col("_t"), F.col("_hits")
    # at most as many hits as words lie in a window, so a slice of that length holds it
    windows = F.transform(hits, lambda h, k: F.filter(F.slice(hits, k + 1, t["span"]), lambda g: g["at"] < h["at"] + t["span"]))
    crossing = F.transform(
        F.filter(windows, lambda x: F.get(x, F.lit(0))["line"] < F.element_at(x, -1)["line"]),
        lambda x: F.struct(
            F.get(x, F.lit(0))["at"].alias("at"),
            F.get(x, F.lit(0))["line"].alias("first"),
            F.element_at(x, -1)["line"].alias("last"),
            F.array_distinct(F.transform(x, lambda g: g["w"])).alias("ws"),
        ),
    )
    shared = F.size(F.array_intersect(F.col("_m")["ws"], F.col("_x")["ws"]))
    # outer generators: no condition on what they make is moved below them, where the splits would be computed again
    pairs = (
        texts.withColumn("_toks", held)
        .select(*keys, text, F.explode_outer(F.when(F.size("_toks") >= least, F.array_compact(F.array(*possible)))).alias("_t"))
        .where(t.isNotNull())
        .withColumn("_hits", F.filter(placed, lambda x: F.array_contains(t["ws"], x["w"])))
        .select(*keys, "_t", F.explode_outer(crossing).alias("_x"))
        .select(*keys, t["family"].alias("family"), "_x", F.explode_outer(t["members"]).alias("_m"))
        .where((shared >= F.col("_m")["need"]) & (F.size(F.array_except(F.col("_m")["names"], F.col("_x")["ws"])) == 0))
        .select(*keys, "_x.at", "_x.first", "_x.last", "family", "_m.label", (shared / F.size("_m.ws")).alias("containment"), F.size("_m.ws").alias("size"))
    )
    return winners(pairs, [*keys, "at", "first", "last"]).drop("at")


def scanned(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, variants: list[tuple[str, str]] = VARIANTS
) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    score is the largest containment of a matching template, and 1 where a base phrase stands. Null texts count as
    empty: no words, no labels, score 0. Repeated rows give equal results, rows that share a key are scanned each
    on its own text, and a null key is kept. Templates that tie in a block both give their labels. Long texts are
    scanned whole; an empty table gives an empty one. Other columns of ``docs`` are left out, whatever their names.
    """
    marked = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    marked = marked.withColumn("_text_hash", F.xxhash64("_text"))
    lines = marked.select("_key", "_text_hash", F.posexplode(F.split("_text", "\n")).alias("block", "line"))
    every = [*templates, *variants]
    family = families(every)
    contested = sorted({f for f in family if family.count(f) > 1})
    by_line = common.stored(winners(similarity_join(lines, every), ["_key", "_text_hash", "block"]), "notices")
    whole = by_line.where(F.col("family").isin(contested)).select(
        F.col("_key").alias("_k"), F.col("_text_hash").alias("_h"), F.col("family").alias("_f"), F.col("block").alias("_b")
    ).distinct()
    touches = (
        F.col("_key").eqNullSafe(F.col("_k"))
        & (F.col("_text_hash") == F.col("_h"))
        & (F.col("family") == F.col("_f"))
        & F.col("_b").between(F.col("first"), F.col("last"))
    )
    wrapped = wrapped_notices(marked, every).join(common.maybe_broadcast(whole, whole.count()), touches, "left_anti")
    pairs = by_line.drop("block", "family").unionByName(wrapped.drop("first", "last", "family"))
    found = common.stored(
        pairs.groupBy(F.col("_key").alias("_k"), F.col("_text_hash").alias("_h")).agg(
            F.collect_set("label").alias("found"), F.max("containment").alias("containment")
        ),
        "licensed",
    )
    rows = marked.select("_key", "_text_hash", words(F.col("_text")).alias("w"))
    rows = rows.select("_key", "_text_hash", F.size("w").cast("long").alias("n_words"), base_places(F.col("w")).alias("places"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_text_hash") == F.col("_h"))
    rows = rows.join(common.maybe_broadcast(found, found.count()), same, "left")
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    return rows.select(
        F.col("_key").alias(key),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates: list[tuple[str, str]] = [*TEMPLATES, *VARIANTS]) -> str:
    """The result for lines by comparing every line with every template. Windows over line ends are not in it."""
    listed = lambda ws: f"CAST([{', '.join(map(repr, ws))}] AS VARCHAR[])"
    values = ", ".join(
        f"({family}, '{label}', {listed(template_words(text))}, {listed(names_of(label, text))})" for family, (label, text) in zip(families(templates), templates)
    )
    places = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM spots WHERE " + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
        for phrase, label in PHRASES
    )
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH t(family, label, ws, names) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({lower.format("coalesce(text, '')")}, {word}) AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d WHERE list_contains(w, 'license')),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, n, list_distinct(regexp_extract_all({lower.format("line")}, {word})) AS w
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM d)),
pairs AS (SELECT doc_id, label, len(list_intersect(ws, w)) / len(ws) AS c FROM lines, t
          WHERE len(list_intersect(ws, w)) >= (4 * len(ws) + 4) // 5 AND len(list_intersect(names, w)) = len(names)
          QUALIFY rank() OVER (PARTITION BY doc_id, n, family ORDER BY c DESC, len(ws) DESC) = 1),
found AS (SELECT doc_id, list(DISTINCT label) AS ls, max(c) AS c FROM pairs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ','), '') AS labels,
       CAST(CASE WHEN coalesce(n_base, 0) > 0 THEN 1 ELSE coalesce(c, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""
