"""From positioned glyphs to Markdown: lines, columns, tables with stacked headers, headings, paragraphs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple


class Glyph(NamedTuple):
    """A drawn word, or the blanks between words."""

    x0: float
    x1: float
    y: float
    size: float
    text: str
    bold: bool
    italic: bool
    upright: bool


@dataclass
class Segment:
    """Text of one line up to a gap of at least the font size."""

    x0: float
    x1: float
    text: str
    bold: bool
    italic: bool


@dataclass
class Line:
    y: float
    size: float
    segments: list[Segment] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(s.text for s in self.segments)

    @property
    def bold(self) -> bool:
        return all(s.bold for s in self.segments)


_HEADING = 1.15  # times the body size
_STACKED = 0.8  # baselines closer than this many sizes belong to one row
_FAR = 2.6  # baselines further apart than this many sizes end a table


def lines_of(glyphs: list[Glyph]) -> list[Line]:
    """Lines from top to bottom, cut into segments."""
    rows: list[tuple[float, float, list[Glyph]]] = []
    for g in sorted((g for g in glyphs if not g.upright), key=lambda g: -g.y):
        for k in range(len(rows) - 1, max(-1, len(rows) - 4), -1):
            y, size, row = rows[k]
            if abs(y - g.y) <= 0.25 * min(size, g.size):
                row.append(g)
                break
        else:
            rows.append((g.y, g.size, [g]))
    spaced = any(not g.text.strip() for g in glyphs)
    out = []
    for y, _, row in rows:
        row.sort(key=lambda g: g.x0)
        size = Counter(round(g.size, 2) for g in row if g.text.strip()).most_common(1)
        if not size:
            continue
        line = Line(y, size[0][0])
        part: list[Glyph] = []
        edge = None
        for g in row:
            if g.text.strip():
                if edge is not None and g.x0 - edge > line.size:
                    line.segments.append(_segment(part, spaced))
                    part = []
                edge = g.x1
            part.append(g)
        line.segments.append(_segment(part, spaced))
        line.segments = [s for s in line.segments if s.text]
        if line.segments:
            out.append(line)
    return out


def _segment(part: list[Glyph], spaced: bool) -> Segment:
    """Where a page draws its blanks, smaller gaps between glyphs mean nothing."""
    text, last = "", None
    for g in part:
        if last and not spaced and g.x0 - last.x1 > 0.2 * g.size:
            text += " "
        text += g.text
        last = g
    shown = [g for g in part if g.text.strip()] or part
    n = len(shown)
    return Segment(shown[0].x0, shown[-1].x1, re.sub(r"\s+", " ", text).strip(), 2 * sum(g.bold for g in shown) > n, 2 * sum(g.italic for g in shown) > n)


def columns_of(lines: list[Line]) -> list[tuple[float, float]]:
    """Intervals that overlapping segments of the lines fill together."""
    return _merged((s.x0, s.x1) for line in lines for s in line.segments)


def _merged(intervals: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def _grown(columns: list[tuple[float, float]], line: Line) -> list[tuple[float, float]]:
    return _merged([*columns, *((s.x0, s.x1) for s in line.segments)])


def _spans(line: Line, columns: list[tuple[float, float]]) -> int:
    """The most columns that one segment of the line touches."""
    return max(sum(s.x0 <= hi and s.x1 >= lo for lo, hi in columns) for s in line.segments)


def tables_of(lines: list[Line], body: float) -> list[tuple[int, int]]:
    """Ranges of lines that form tables: several columns kept over lines near each other."""
    out, at = [], 0
    while at < len(lines):
        if len(lines[at].segments) < 2 or lines[at].size > _HEADING * body:
            at += 1
            continue
        end, columns, multi = at + 1, columns_of([lines[at]]), 1
        for k in range(at + 1, len(lines)):
            line = lines[k]
            if line.size > _HEADING * body or lines[k - 1].y - line.y > _FAR * line.size:
                break
            if len(line.segments) > 1:
                wider = _grown(columns, line)
                if len(wider) < 2:
                    break
                columns, end, multi = wider, k + 1, multi + 1
            elif len(_grown(columns, line)) < 2:
                break
        # Single lines right above may be the top of a stacked header.
        first = at
        while first > 0 and lines[first - 1].size <= _HEADING * body and lines[first - 1].y - lines[first].y < _STACKED * body and _spans(lines[first - 1], columns) <= 1:
            first -= 1
        if multi >= 2 and len(columns) >= 2:
            out.append((first, end))
            at = end
        else:
            at += 1
    return out


def _joined(parts: list[str]) -> str:
    """Wrapped lines of one cell; after a hyphen they go on without a blank."""
    out = ""
    for p in parts:
        out += p if not out or out.endswith("-") else " " + p
    return out


def table_markdown(lines: list[Line]) -> str:
    """Rows of a table, one per group of stacked lines, in the compact dialect; every row ends its line."""
    columns = columns_of([x for x in lines if len(x.segments) > 1])
    for line in lines:
        if len(line.segments) == 1 and _spans(line, columns) == 0:
            columns = columns_of(lines)
            break
    groups: list[list[Line]] = []
    for line in lines:
        if groups and groups[-1][-1].y - line.y < _STACKED * line.size:
            groups[-1].append(line)
        else:
            groups.append([line])
    rows = []
    for group in groups:
        cells: list[list[str]] = [[] for _ in columns]
        for line in group:
            for s in line.segments:
                fit = [k for k, (lo, hi) in enumerate(columns) if s.x0 <= hi and s.x1 >= lo]
                k = fit[0] if fit else min(range(len(columns)), key=lambda k: abs(columns[k][0] - s.x0))
                cells[k].append(s.text)
        rows.append([_joined(c).replace("|", "\\|") for c in cells])
    line_of = lambda row: "|" + "|".join(row) + "|\n"
    return line_of(rows[0]) + "|" + "---|" * len(columns) + "\n" + "".join(map(line_of, rows[1:]))


def _styled(s: Segment) -> str:
    mark = ("**" if s.bold else "") + ("*" if s.italic else "")
    return f"{mark}{s.text}{mark[::-1]}"


def page_markdown(glyphs: list[Glyph]) -> str:
    """The page's Markdown; the empty string for a page without text."""
    lines = lines_of(glyphs)
    if not lines:
        return ""
    weights: Counter = Counter()
    for line in lines:
        weights[line.size] += len(line.text)
    body = weights.most_common(1)[0][0]
    big = sorted({x.size for x in lines if x.size > _HEADING * body}, reverse=True)
    tables = dict(tables_of(lines, body))
    out, at = [], 0
    while at < len(lines):
        if at in tables:
            out.append(table_markdown(lines[at : tables[at]]))
            at = tables[at]
            continue
        line = lines[at]
        if line.size > _HEADING * body and len(line.text) <= 200:
            out.append("#" * min(6, big.index(line.size) + 1) + " " + line.text)
            at += 1
            continue
        alone = at + 1 >= len(lines) or not lines[at + 1].bold or at + 1 in tables
        if line.bold and alone and len(line.text) <= 120 and re.search(r"\w", line.text) and not line.text.endswith((".", ",", ";")) and any(not x.bold for x in lines):
            out.append("#" * min(6, max(2, len(big) + 1)) + " " + line.text)
            at += 1
            continue
        text = " ".join(map(_styled, line.segments))
        at += 1
        while at < len(lines) and at not in tables and lines[at].size == line.size and lines[at].bold == line.bold and lines[at - 1].y - lines[at].y <= 1.45 * line.size and not _BULLET.match(lines[at].text):
            more = " ".join(map(_styled, lines[at].segments))
            text = text[:-1] + more if re.search(r"[a-z]-$", text) and more[:1].islower() else f"{text} {more}".replace("** **", " ")
            at += 1
        out.append(_BULLET.sub("- ", text, count=1))
    return "\n".join(x if x.endswith("\n") or k == len(out) - 1 else x + "\n" for k, x in enumerate(out))


_BULLET = re.compile(r"^[•▪●‣◦]\s*")
