"""Markdown text read once, line by line, with a stack of containers: fences, lines of paragraphs, code spans.

Block quotes and list items hold each other to any depth; what they hold is read without their marks. A fence opens with three or more back quotes or tildes and ends with as many of the same, with its container, or with the
text. A paragraph goes on over lines that leave out the marks of its containers. Indented code, thematic breaks and underlines of headings are no prose. A code span ends with as many back quotes as it began with, over any lines of
its paragraph; a back quote behind a backslash opens none. Each line costs as much as it is long: open items are met by the columns that they take, and a blank line leaves all of them open at once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

_FENCE = re.compile(r"(`{3,}|~{3,})([^\r]*)")
_ITEM = re.compile(r"(?:[-+*]|([0-9]{1,9})[.)])(?=[ \t\r]|\Z)")
_HEADING = re.compile(r"#{1,6}(?=[ \t\r]|\Z)")
_UNDERLINE = re.compile(r"(?:=+|-+)[ \t\r]*\Z")
_TICKS = re.compile(r"`+")
_BLANK = " \t\r"


def _skip(line: str, i: int, col: int, most: int | None = None) -> tuple[int, int, int]:
    """Over white space from i at column col, of `most` columns at most: (i, col, columns of a tab that stay)."""
    end = None if most is None else col + most
    while i < len(line) and line[i] in " \t" and (end is None or col < end):
        step = 1 if line[i] == " " else 4 - col % 4
        if end is not None and col + step > end:
            return i + 1, end, col + step - end
        i, col = i + 1, col + step
    return i, col, 0


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each code span of a paragraph."""
    runs = [(m.start(), m.end()) for m in _TICKS.finditer(text)]
    by_size: dict[int, list[int]] = {}
    for n, (a, b) in enumerate(runs):
        by_size.setdefault(b - a, []).append(n)
    out, n = [], 0
    while n < len(runs):
        a, b = runs[n]
        k = a
        while k and text[k - 1] == "\\":
            k -= 1
        a += (a - k) % 2
        same = by_size.get(b - a, [])
        at = bisect_right(same, n)
        if b > a and at < len(same):
            n = same[at]
            out.append((a, runs[n][1]))
        n += 1
    return out


def _paragraph(lines: list[tuple[int, str]]) -> Iterator[tuple]:
    first, text = lines[0][0], "\n".join(t for _, t in lines)
    parts, last, no = [], 0, first
    for a, b in spans(text):
        no += text.count("\n", last, a)
        yield "span", no, no, first, text[a:b].strip("`"), None
        inner = text.count("\n", a, b)
        parts += [text[last:a], " ", "\n" * inner]
        last, no = b, no + inner
    masked = "".join([*parts, text[last:]]).split("\n")
    for (no, _), t in zip(lines, masked):
        yield "line", no, no, first, t, None


def read(text: str) -> Iterator[tuple]:
    """(kind, line, line_end, first line of the paragraph, text, info): `fence` with its content and info; `line` of a paragraph, code spans in it being one space; `span` with what is between its back quotes. Each kind in the order of
    the text."""
    stack: list[int] = []  # of each open container the columns that its lines are indented by, 0 for a quote
    quotes: list[int] = []  # which of them are quotes
    held: list[tuple[int, str]] = []  # the open paragraph
    fence: tuple | None = None  # mark, columns before it, containers around it, first line, info, content
    lines = text.split("\n")
    if lines[-1] == "" and len(lines) > 1:
        lines.pop()

    def close(keep: int) -> None:
        del stack[keep:]
        while quotes and quotes[-1] >= keep:
            quotes.pop()

    def push(width: int) -> None:
        if not width:
            quotes.append(len(stack))
        stack.append(width)

    def fenced(last: int) -> tuple:
        return "fence", fence[3], last, fence[3], "\n".join(fence[5]), fence[4]

    for no, line in enumerate(lines, 1):
        end, i, col, extra, met = len(line.rstrip(_BLANK)), 0, 0, 0, 0
        while met < len(stack):
            j, c, _ = _skip(line, i, col)
            if j >= end:  # blank: list items go on, quotes end
                k = bisect_right(quotes, met - 1)
                met = quotes[k] if k < len(quotes) else len(stack)
                break
            if stack[met]:
                if c - col + extra < stack[met]:
                    break
                i, col, extra = _skip(line, i, col, stack[met] - extra) if stack[met] > extra else (i, col, extra - stack[met])
            elif c - col + extra < 4 and line[j] == ">":
                i, col, extra = _skip(line, j + 1, c + 1, 1)
            else:
                break
            met += 1
        if fence is not None:
            if met >= fence[2]:
                j, c, _ = _skip(line, i, col)
                m = _FENCE.match(line, j) if c - col + extra < 4 else None
                if m and m[1].startswith(fence[0]) and not m[2].strip():
                    yield fenced(no)
                    fence = None
                else:
                    a, _, more = _skip(line, i, col, max(fence[1] - extra, 0))
                    fence[5].append(" " * (more if fence[1] >= extra else extra - fence[1]) + line[a:])
                continue
            yield fenced(no - 1)
            fence = None
        j, c, _ = _skip(line, i, col)
        if j >= end:
            if held:
                yield from _paragraph(held)
                held = []
            close(met)
            continue
        tail = line[:end].rstrip(line[end - 1] + " \t") if line[end - 1] in "-*_" else line[:end]
        opened = met
        while True:  # new containers
            j, c, _ = _skip(line, i, col)
            wide = c - col + extra
            if j >= end or wide > 3 or (j >= len(tail) and line.count(line[end - 1], j, end) > 2):
                break
            m = _ITEM.match(line, j)
            within = held and opened == met == len(stack)  # of what may begin within a paragraph, items of any number or without text are none
            if line[j] == ">":
                width = 0
            elif m and not (within and (m.end() >= end or m[1] not in (None, "1"))):
                k, d, _ = _skip(line, m.end(), c + m.end() - j)
                space = d - c - (m.end() - j)
                width = wide + m.end() - j + (space if k < end and space < 5 else 1)
            else:
                break
            if held:
                yield from _paragraph(held)
                held = []
            close(opened)
            push(width)
            opened += 1
            i, col, extra = _skip(line, j + 1, c + 1, 1) if not width else _skip(line, m.end(), c + m.end() - j, width - wide - (m.end() - j))
        j, c, _ = _skip(line, i, col)
        wide = c - col + extra
        if j >= end:
            close(opened)
            continue
        m = _FENCE.match(line, j) if wide < 4 else None
        if m and (m[1][0] == "~" or "`" not in m[2]):
            if held:
                yield from _paragraph(held)
                held = []
            close(opened)
            fence = (m[1], wide, len(stack), no, m[2], [])
            continue
        broken = wide < 4 and j >= len(tail) and line.count(line[end - 1], j, end) > 2
        heading = wide < 4 and _HEADING.match(line, j)
        under = wide < 4 and held and opened == len(stack) and _UNDERLINE.match(line, j)
        if under or broken or heading:
            if held:
                yield from _paragraph(held)
                held = []
            close(opened)
            if heading:
                yield from _paragraph([(no, line[j:])])
        elif held:  # goes on, even where the marks of its containers are left out
            held.append((no, line[j:]))
        else:
            close(opened)
            if wide < 4:
                held = [(no, line[j:])]
    if fence is not None:
        yield fenced(len(lines))
    if held:
        yield from _paragraph(held)
