"""Completions: batches, retries, failover between providers, and the checks on what comes back."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: A provider takes a system text and a prompt and returns a reply.
Provider = Callable[[str, str], str]

LIMIT = re.compile(r"429|rate.?limit|usage.?limit|quota|too many requests|overloaded", re.I)
COOL_DOWN = 3600.0
ATTEMPTS = 5


def echo(system: str, prompt: str) -> str:
    """The stand-in: the prompt in quotation marks, so that results are fixed and unlike their source."""
    return f"«{prompt}»"


@dataclass
class Failover:
    """Providers in order; one that reports a usage limit rests for COOL_DOWN seconds, any other error is raised."""

    providers: dict[str, Provider]
    clock: Callable[[], float] = time.monotonic
    resting: dict[str, float] = field(default_factory=dict)

    def candidates(self) -> list[str]:
        now = self.clock()
        return [n for n in self.providers if now - self.resting.get(n, -COOL_DOWN) >= COOL_DOWN]

    def __call__(self, system: str, prompt: str) -> tuple[str, str]:
        last: Exception | None = None
        for name in self.candidates():
            try:
                return name, self.providers[name](system, prompt)
            except Exception as problem:
                if not LIMIT.search(str(problem)):
                    raise
                self.resting[name] = self.clock()
                last = problem
        raise RuntimeError("no provider is available") from last


def completed(units: DataFrame, provider: Provider = echo, system: str = "", valid: Callable[[str, str], bool] = lambda s, r: bool(r.strip()), attempts: int = 3) -> DataFrame:
    """(key, src, tgt, status): each unit (key, src) through ``provider`` until ``valid``; 'failed' keeps the source.

    Filter the work list first (see operators.queue.reuse): every row here is a call.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, src in zip(batch["key"], batch["src"]):
                tgt, status = src, "failed"
                for _ in range(attempts):
                    reply = provider(system, src or "")
                    if valid(src or "", reply):
                        tgt, status = reply, "translated"
                        break
                rows.append((key, src, tgt, status))
            yield pd.DataFrame(rows, columns=["key", "src", "tgt", "status"])

    kind = units.schema["key"].dataType.simpleString()
    return units.select("key", "src").mapInPandas(run, f"key {kind}, src string, tgt string, status string")


def read_pages(images: DataFrame, reader: Callable[[list[bytes]], str], per_call: int = 8) -> DataFrame:
    """(pages, reply): page images in batches through a page reader; parse with operators.markup.reply_pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at in range(0, len(batch), per_call):
                part = batch.iloc[at : at + per_call]
                rows.append((part["page"].tolist(), reader([bytes(c) for c in part["content"]])))
            yield pd.DataFrame(rows, columns=["pages", "reply"])

    return images.select("page", "content").mapInPandas(run, "pages array<long>, reply string")


def decoded(files: DataFrame, decoder: Callable[[bytes], Iterable[Callable[[], list[tuple]]]]) -> DataFrame:
    """Glyph rows (path, page, idx, ch, x0, y, x1, skipped) of files (path, content) through a PDF decoder.

    decoder gives a function for each page. A page that fails, or a file that can't be opened (page -1), is one row
    without glyphs under ``skipped`` with its error, and ends nothing else.
    """
    columns = ["path", "page", "idx", "ch", "x0", "y", "x1", "skipped"]

    def glyphs_of(path: str, content: bytes) -> Iterator[tuple]:
        empty = (None,) * 5
        try:
            pages = list(decoder(content))
        except Exception as problem:  # one damaged file must not end the job
            yield (path, -1, *empty, str(problem)[:200])
            return
        for page, read in enumerate(pages):
            try:
                yield from [(path, page, i, *glyph, None) for i, glyph in enumerate(read() or [])]
            except Exception as problem:
                yield (path, page, *empty, str(problem)[:200])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for path, content in zip(batch["path"], batch["content"]) for row in glyphs_of(path, bytes(content))]
            yield pd.DataFrame(rows, columns=columns).astype({"page": "Int32", "idx": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, idx int, ch string, x0 double, y double, x1 double, skipped string")
