"""Tables without bars: rows and columns from the places of words in lines. Plain functions over one text; operators/tables.py runs them in tasks."""

from __future__ import annotations

import re
from collections import Counter
from statistics import median

Table = tuple[str | None, list[str], list[list[str]]]
Token = tuple[str, int, int]

CAPTION = re.compile(r"(?i)^(?:Tabel|Table)\s+\d+")
NUMBER = re.compile(r"^[<>≈~±(]*[+\-−]?\d[\d.,]*(?:[eE][+\-−]?\d+)?[%‰)]*$|^[-–—]$|^(?i:n/?a|nil)$")
#: What it costs to leave a column empty, and to put numbers together, or with words, into one cell: in characters of distance.
EMPTY, MIXED = 6.0, 40.0


def tokens(line: str) -> list[Token]:
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", line)]


def is_number(t: Token) -> bool:
    return NUMBER.match(t[0]) is not None


def runs(ts: list[Token]) -> list[list[Token]]:
    """Tokens as cells: a number is one, and so are the words between numbers."""
    out: list[list[Token]] = []
    for t in ts:
        if out and not is_number(t) and not is_number(out[-1][-1]):
            out[-1].append(t)
        else:
            out.append([t])
    return out


def join(ts: list[Token]) -> str:
    return " ".join(t[0] for t in ts)


def placed(ts: list[Token], columns: list[tuple[float, float]], typed: bool = True) -> list[str]:
    """The tokens dealt to the columns in order, so that cells begin and end as near as can be to where their columns do: dynamic programming over columns and tokens."""
    n = len(ts)

    def cost(a: int, b: int, column: tuple[float, float]) -> float:
        if a == b:
            return EMPTY
        numbers = sum(map(is_number, ts[a:b]))
        odd = MIXED * (max(0, numbers - 1) + (0 < numbers < b - a)) if typed else 0.0
        return abs(ts[a][1] - column[0]) + abs(ts[b - 1][2] - column[1]) + odd

    best: list[tuple[float, list[int]]] = [(0.0, [0])] + [(float("inf"), [])] * n
    for column in columns:
        new = []
        for b in range(n + 1):
            new.append(min(((best[a][0] + cost(a, b, column), [*best[a][1], b]) for a in range(b + 1) if best[a][1]), default=(float("inf"), [])))
        best = new
    cuts = best[n][1]
    return [join(ts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def by_gaps(lines: list[str]) -> tuple[list[str], list[list[str]]] | None:
    """Columns set apart by tabs or two spaces: longer rows have their end joined, shorter ones are filled."""
    body = [r for r in (re.split(r"\t+|\s{2,}", x.strip()) for x in lines) if len(r) >= 2]
    if len(body) < 2:
        return None
    n = len(body[0])
    return body[0], [[*r[: n - 1], " ".join(r[n - 1 :])] if len(r) > n else r + [""] * (n - len(r)) for r in body[1:]]


def by_places(lines: list[str]) -> tuple[list[str], list[list[str]]] | None:
    """Columns a single space apart: how many there are is what most lines with numbers say, where they are is the median of those lines, and other lines and the header are dealt to them."""
    rows = [tokens(x.rstrip()) for x in lines if x.strip()]
    counts = Counter(len(runs(r)) for r in rows[1:] if any(map(is_number, r)))
    if not counts:
        return None
    n = max(counts, key=lambda c: (counts[c], c))
    plain = [runs(r) for r in rows[1:] if len(runs(r)) == n]
    if n < 2 or len(rows[0]) < n or any(map(is_number, rows[0])) or not plain:
        return None
    columns = [(median(r[k][0][1] for r in plain), median(r[k][-1][2] for r in plain)) for k in range(n)]
    head: list[list[Token]] = []
    for t in rows[0]:  # a word in lower case goes on with the name before it
        if head and t[0][0].islower():
            head[-1].append(t)
        else:
            head.append([t])
    names = [join(c) for c in head] if len(head) == n else placed(rows[0], columns, typed=False)
    return names, [[join(c) for c in runs(r)] if len(runs(r)) == n else placed(r, columns) for r in rows[1:]]


def in_one_line(text: str) -> Table | None:
    """A caption, a header and rows run together. Rows are words and as many numbers as most of them have; the words before the first row are caption, header and its own, told by how many the other rows have."""
    m = re.match(r"(?i)^((?:Tabel|Table)\s+\d+[.:\-—]?)\s+(.*)$", text, re.S)
    if not m:
        return None
    cells = runs(tokens(m.group(2)))
    rows: list[tuple[list[Token], list[Token]]] = []
    for c in cells:
        if not is_number(c[0]):
            rows.append((c, []))
        elif rows:
            rows[-1][1].append(c[0])
    rows = [r for r in rows if r[1]]
    if len(rows) < 2:
        return None
    width = Counter(len(v) for _, v in rows).most_common(1)[0][0]
    rows = [r for r in rows if len(r[1]) == width]
    own = Counter(len(w) for w, _ in rows[1:]).most_common(1)[0][0] if len(rows) > 1 else 0
    lead = rows[0][0]
    if len(rows) < 2 or len(lead) < own:
        return None
    head, first = lead[: len(lead) - own], lead[len(lead) - own :]
    capital = [t for t in head[-(width + 1) :] if t[0][0].isupper()]
    headers = [t[0] for t in head[-(width + 1) :]] if len(capital) == width + 1 and len(head) > width else ["Item", *[f"Column {k + 1}" for k in range(width)]]
    title = head[: -(width + 1)] if len(capital) == width + 1 and len(head) > width else head
    caption = " ".join([m.group(1), *[t[0] for t in title]])
    return caption, headers, [[join(first), *[t[0] for t in rows[0][1]]], *[[join(w), *[t[0] for t in v]] for w, v in rows[1:]]]


def parse(text: str) -> Table | None:
    """(caption or None, headers, rows) of a table without bars, None for what is none."""
    lines = [x for x in text.split("\n") if x.strip()]
    at = next((i for i, x in enumerate(lines[:3]) if CAPTION.match(x.strip())), None)
    if len(lines) <= 2:
        return in_one_line(" ".join(x.strip() for x in lines))
    caption = None if at is None else lines[at].strip()
    body = lines if at is None else lines[at + 1 :]
    got = by_gaps(body) or by_places(body)
    return got and (caption, *got)
