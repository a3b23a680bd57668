"""Footnotes: number sequences, and linking references with definitions."""

from __future__ import annotations

import re
from itertools import accumulate, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP_MOST = 15
SMALL_MISSING, SMALL_SPAN = 3, 2
RUN_LEAST = 3
PAIR_WINDOW = 1
LEAST_NOTE, NOTE_MOST, PROSE_LEAST = 12, 2_500, 400
ENDS_LIKE_NOTE = r"[.!?。…][\"”’')\]]*$"
_ENDS = re.compile(ENDS_LIKE_NOTE)
_OPEN = re.compile(r"""[^.!?。…”’"')\]』」\s]\s*$""")
_NOTE_LINE = re.compile(r"([0-9]{1,3})[ \t]+(\S.*)")


def gap_audit(notes: DataFrame, doc: str) -> DataFrame:
    """(doc, page, from_page, after, missing, small): numbers left out between neighbouring notes.

    notes: (doc, page, num) in reading order of page and number of appearance. Steps back, and jumps over GAP_MOST,
    are a new chapter and no gap.
    """
    w = Window.partitionBy(doc).orderBy("page", "num")
    nxt = notes.select(doc, F.col("page").alias("from_page"), F.col("num").alias("after"), F.lead("page").over(w).alias("page"), F.lead("num").over(w).alias("upto"))
    step = F.col("upto") - F.col("after")
    gaps = nxt.where((step > 1) & (step <= GAP_MOST)).withColumn("missing", F.sequence(F.col("after") + 1, F.col("upto") - 1))
    small = (F.size("missing") <= SMALL_MISSING) & (F.col("page") - F.col("from_page") <= SMALL_SPAN)
    return gaps.select(doc, "page", "from_page", "after", "missing", small.alias("small"))


def consecutive_runs(numbers: DataFrame, group: str, order: str, num: str, least: int = RUN_LEAST) -> DataFrame:
    """(group, first_num, last_num, n) of maximal runs of numbers that go up by one from row to row."""
    w = Window.partitionBy(group).orderBy(order)
    broken = F.when(F.col(num) == F.lag(num).over(w) + 1, 0).otherwise(1)
    runs = numbers.withColumn("_b", broken).withColumn("_run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(group, "_run").agg(F.min(num).alias("first_num"), F.max(num).alias("last_num"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("_run")


def _chain_from(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The numbers that rise from the first of ``starts`` on, each larger than the one before it."""
    tops = accumulate((n for _, n in starts), max, initial=-1)
    return [s for s, top in zip(starts, tops) if s[1] > top]


def _like_notes(blocks: list[list[str]]) -> bool:
    """Whether blocks may be notes: none is too long, none holds a long paragraph of its own behind an empty line."""
    apart = (p for lines in blocks for p in "\n".join(x.strip() for x in lines).split("\n\n")[1:])
    return all(sum(len(x.strip()) for x in lines) <= NOTE_MOST for lines in blocks) and all(len(p.replace("\n", "")) < PROSE_LEAST for p in apart)


def split_notes(page: str) -> tuple[str, list[tuple[int, str]]]:
    """(body, [(number, note)]): the longest rising chain of numbered lines that runs to the page end is its notes.

    A note goes on to the next number. What is too short for a note, and no sentence beside others, stays body.
    """
    lines = page.split("\n")
    starts = [(i, int(m[1])) for i, line in enumerate(lines) if (m := _NOTE_LINE.match(line.strip()))]
    cut = lambda chain: [lines[a:b] for a, b in pairwise([*(i for i, _ in chain), len(lines)])]
    chains = (_chain_from(starts[k:]) for k in range(len(starts)))
    best = max((c for c in chains if _like_notes(cut(c))), key=lambda c: (len(c), c[0]), default=[])
    body, notes = lines[: best[0][0]] if best else lines, []
    for (_, number), block in zip(best, cut(best)):
        text = " ".join(x.strip() for x in [_NOTE_LINE.match(block[0].strip())[2], *block[1:]] if x.strip())
        if len(text) >= LEAST_NOTE or (len(best) > 1 and _ENDS.search(text)):
            notes.append((number, text))
        else:
            body = body + block
    return ("\n".join(body).rstrip(), notes) if notes else (page, [])


_SPLIT = T.StructType(
    [
        T.StructField("body", T.StringType()),
        T.StructField("notes", T.ArrayType(T.StructType([T.StructField("num", T.IntegerType()), T.StructField("body", T.StringType())]))),
    ]
)


@F.arrow_udf(_SPLIT)
def notes_of_page(pages: pa.Array) -> pa.Array:
    kind = pa.struct([("body", pa.string()), ("notes", pa.list_(pa.struct([("num", pa.int32()), ("body", pa.string())])))])
    split = (split_notes(t or "") for t in pages.to_pylist())
    return pa.array([{"body": body, "notes": [{"num": n, "body": x} for n, x in notes]} for body, notes in split], kind)


def _index_like(body: Column) -> Column:
    """Ten or more numbers, three in a hundred characters: an index entry with its pages. Addresses don't count."""
    plain = F.regexp_replace(body, r"https?://\S+|doi\.org/\S+", " ")
    groups = F.size(F.regexp_extract_all(plain, F.lit("[0-9]+(?:[-–][0-9]+)?"), F.lit(0)))
    return (groups >= 10) & (groups >= 0.03 * F.length(body))


def linked_notes(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, page, num, body, ref_page, linked, is_note): the notes of pages with the reference that each one takes.

    pages: (doc, page, text) and, if measured, has_notes; pages without are not searched. A reference is a number glued
    to a word or its closing mark. Notes of one number take references of that number in turn, by page and place:
    each the first one left on a page at most PAIR_WINDOW away. A note without a reference stays one only if it ends
    like a sentence and its number is next to another note's, on its page or in the order of the book; index entries
    never do. What is no note is body text.
    """
    look = F.coalesce("has_notes", F.lit(True)) if "has_notes" in pages.columns else F.lit(True)
    split = pages.select(doc, "page", "text", F.when(look, notes_of_page("text")).alias("s"))
    split = split.select(doc, "page", F.coalesce("s.body", "text").alias("text"), F.coalesce("s.notes", F.array()).alias("notes"))
    notes = split.select(doc, "page", F.posexplode("notes").alias("at", "x")).select(doc, "page", "at", "x.num", "x.body").where(~_index_like(F.col("body")))
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}.,;:!?”’\"')\]]([0-9]{1,3})(?![0-9\p{L}])"), F.lit(1))
    refs = split.select(doc, "page", F.posexplode(found).alias("at", "n")).select(doc, F.expr("try_cast(n as int)").alias("num"), "page", "at")
    queue = refs.groupBy(doc, "num").agg(F.array_sort(F.collect_list(F.struct("page", "at"))).alias("free"))  # one number of one book
    asked = notes.groupBy(doc, "num").agg(F.array_sort(F.collect_list(F.struct("page", "at", "body"))).alias("asked"))

    def take(state: Column, note: Column) -> Column:
        near = F.filter(state["free"], lambda r: F.abs(r["page"] - note["page"]) <= PAIR_WINDOW)
        got = F.get(near, F.lit(0))
        left = F.when(got.isNull(), state["free"]).otherwise(F.array_except(state["free"], F.array(got)))
        row = F.struct(note["page"].alias("page"), note["at"].alias("at"), note["body"].alias("body"), got["page"].alias("ref_page"))
        return F.struct(left.alias("free"), F.array_append(state["done"], row).alias("done"))

    row = "array<struct<page:int,at:int,body:string,ref_page:int>>"
    places = F.coalesce("free", F.array()).cast("array<struct<page:int,at:int>>")
    start = F.struct(places.alias("free"), F.array().cast(row).alias("done"))
    paired = asked.join(queue, [doc, "num"], "left").withColumn("asked", F.col("asked").cast("array<struct<page:int,at:int,body:string>>"))
    done = paired.select(doc, "num", F.explode(F.aggregate("asked", start, take, lambda s: s["done"])).alias("d")).select(doc, "num", "d.*")
    on_page, in_book = Window.partitionBy(doc, "page").orderBy("num", "at"), Window.partitionBy(doc).orderBy("page", "num", "at")
    step = lambda w, least: [(F.col("num") - F.lag("num").over(w)).between(least, 2), (F.lead("num").over(w) - F.col("num")).between(least, 2)]
    mate = F.greatest(*[F.coalesce(c, F.lit(False)) for c in [*step(on_page, 0), *step(in_book, 1)]])
    linked = F.col("ref_page").isNotNull()
    kept = linked | (mate & F.col("body").rlike(ENDS_LIKE_NOTE))
    return done.select(doc, "page", "num", "body", "ref_page", linked.alias("linked"), kept.alias("is_note"))


def moved_definitions(markers: DataFrame, definitions: DataFrame) -> DataFrame:
    """(book, id, chapter, body, moved): each definition goes to the chapter that references it.

    markers: (book, chapter, id); definitions: (book, chapter, id, body). The first definition of an id wins, an
    unclaimed one stays at home, and the first chapter that has a marker claims it.
    """
    first = definitions.groupBy("book", "id").agg(F.min_by("body", "chapter").alias("body"), F.min("chapter").alias("home"))
    claim = markers.groupBy("book", "id").agg(F.min("chapter").alias("claimed"))
    out = first.join(claim, ["book", "id"], "left")
    return out.select("book", "id", F.coalesce("claimed", "home").alias("chapter"), "body", F.coalesce(F.col("claimed") != F.col("home"), F.lit(False)).alias("moved"))


def joined(left: str, right: str, lexicon: str = "") -> str:
    """Two halves of a sentence: without a space where a word is cut, which is a word of the lexicon or has a hyphen."""
    left, right = left.rstrip(), right.lstrip()
    cut = re.search("[가-힣]{1,4}$", left), re.match("[가-힣]{1,4}", right)
    if not left or not right or (all(cut) and cut[0][0] + cut[1][0] in lexicon):
        return left + right
    if left.endswith("-"):
        return (left[:-1] if right[0].islower() else left) + right
    return f"{left} {right}"


def reflowed(pages: list[str], lexicon: str = "") -> list[str]:
    """Pages with the sentences that their notes cut made whole on the page where they begin.

    Such a page takes the first paragraph of the next one's body, and goes on with the page after if that was all of
    it; notes of pages that are passed follow its own, in page order. The number of pages stays; a page may be empty.
    """
    heads, notes = [], []
    for page in pages:
        body, found = split_notes(page)
        heads.append(re.split(r"\n[ \t]*\n", body.strip()) if body.strip() else [])
        notes.append([f"{n} {x}" for n, x in found])
    for i, head in enumerate(heads):
        j = i + 1
        while notes[i] and head and _OPEN.search(head[-1]) and j < len(pages) and heads[j] and not _NOTE_LINE.match(heads[j][0].strip()):
            head[-1] = joined(head[-1], heads[j].pop(0), lexicon)
            if heads[j]:
                break
            notes[i] += notes[j]
            notes[j] = []
            j += 1
    return ["\n\n".join([*head, *(["\n".join(below)] if below else [])]).strip() for head, below in zip(heads, notes)]


def pages_reflowed(pages: DataFrame, lexicon: str = "") -> DataFrame:
    """(doc_id, page, text): sentences cut by a page end are whole on the earlier page, with notes in page order.

    One group is one book. Non-space characters are kept but for line-end hyphens.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("page")
        return pd.DataFrame({"doc_id": key[0], "page": group["page"].to_list(), "text": reflowed([t or "" for t in group["text"]], lexicon)})

    return pages.select("doc_id", "page", "text").groupBy("doc_id").applyInPandas(run, "doc_id int, page int, text string")


def recovery_hint(pages: list[str], page: int, missing: list[int], lexicon: str = "") -> str:
    """What to tell a reader that looks again for missing notes: their numbers, and the cut sentence if its joined word is known."""
    told = f"notes {', '.join(map(str, missing))}"
    if page + 1 >= len(pages):
        return told
    here, after = split_notes(pages[page])[0].strip(), split_notes(pages[page + 1])[0].strip()
    cut = re.search("[가-힣]{1,4}$", here), re.match("[가-힣]{1,4}", after)
    known = all(cut) and cut[0][0] + cut[1][0] in lexicon
    return f"{told}; the page ends in '{cut[0][0]}' of '{cut[0][0] + cut[1][0]}'" if known and _OPEN.search(here) else told
