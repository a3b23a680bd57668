"""Reading order of the glyphs of a page: rows, spaces, columns, paragraphs. A group is one page."""

from __future__ import annotations

import statistics

import pandas as pd
from pyspark.sql import DataFrame

_COLUMNS = ["ch", "x0", "y", "x1"]


def _rows(glyphs: list[tuple], tolerance: float) -> list[list[tuple]]:
    """Glyphs grouped by their height on the page; a row's height is the mean of what it has so far."""
    out: list[list[tuple]] = []
    for g in sorted(glyphs, key=lambda g: (g[2], g[1])):
        if out and abs(g[2] - sum(x[2] for x in out[-1]) / len(out[-1])) <= tolerance:
            out[-1].append(g)
        else:
            out.append([g])
    return out


def _joined(row: list[tuple], space: float) -> str:
    out, end = "", None
    for ch, x0, _, x1 in sorted(row, key=lambda g: g[1]):
        if end is not None and (ch == " " or x0 - end > space) and not out.endswith(" "):
            out += " "
        out += ch if ch != " " else ""
        end = x1 if end is None else max(end, x1)
    return out.strip()


def _gutters(rows: list[list[tuple]], least_gap: float, width: float) -> list[float]:
    """Middles of wide gaps that several rows share, away from the page's edges."""
    found = []
    for row in rows:
        row = sorted(row, key=lambda g: g[1])
        for a, b in zip(row, row[1:]):
            middle = (a[3] + b[1]) / 2
            if b[1] - a[3] >= least_gap and width * 0.15 < middle < width * 0.85:
                found.append(middle)
    groups: list[list[float]] = []
    for x in sorted(found):
        if groups and x - groups[-1][-1] <= least_gap / 2:
            groups[-1].append(x)
        else:
            groups.append([x])
    need = max(3, len(rows) // 8)
    return [statistics.median(g) for g in groups if len(g) >= need]


def reading_order(glyphs: list[tuple]) -> str:
    """Text of one page; glyphs are (character, left, height on page, right)."""
    if not glyphs:
        return ""
    widths = sorted(max(g[3] - g[1], 0.1) for g in glyphs)
    glyph = widths[len(widths) // 2]
    rows = _rows(glyphs, glyph)
    gaps = sorted(b[1] - a[3] for r in rows for s in [sorted(r, key=lambda g: g[1])] for a, b in zip(s, s[1:]) if glyph * 0.05 < b[1] - a[3] < glyph * 1.5)
    space = min(glyph * 0.45, max(glyph * 0.1, gaps[len(gaps) // 2] * 0.5)) if gaps else glyph * 0.25
    space = max(space, gaps[len(gaps) // 2] * 1.5 if gaps and gaps[0] > 0 and gaps[-1] < 2 * gaps[0] else space)
    edges = _gutters(rows, max(glyph * 3.25, 12.0), max(g[3] for g in glyphs))
    steps = sorted(b[0][2] - a[0][2] for a, b in zip(rows, rows[1:]))
    apart = 1.8 * steps[len(steps) // 2] if steps else 0
    out: list[str] = []
    columns: list[list[str]] = [[] for _ in range(len(edges) + 1)]
    last: float | None = None

    def flush() -> None:
        for column in columns:
            out.extend(column)
            column.clear()

    for row in rows:
        top = min(g[2] for g in row)
        gap = last is not None and apart and top - last > apart
        sides: list[list[tuple]] = [[] for _ in columns]
        for g in row:
            sides[sum((g[1] + g[3]) / 2 >= e for e in edges)].append(g)
        # a row that fills the gutter goes over all columns
        across = any(l and r and min(g[1] for g in r) - max(g[3] for g in l) < glyph * 3.25 for l, r in zip(sides, sides[1:]))
        if across or len(columns) == 1:
            flush()
            if gap:
                out.append("")
            out.append(_joined(row, space))
        else:
            for column, side in zip(columns, sides):
                if side:
                    column.append(_joined(side, space))
        last = top
    flush()
    return "\n".join(out)


def pages_in_reading_order(glyphs: DataFrame) -> DataFrame:
    """(page, text) from glyph rows (page, idx, ch, x0, y, x1)."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.sort_values("idx")[_COLUMNS].itertuples(index=False, name=None))
        return pd.DataFrame({"page": [key[0]], "text": [reading_order(rows)]})

    return glyphs.groupBy("page").applyInPandas(run, "page int, text string")
