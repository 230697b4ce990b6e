"""Oversized texts cut at natural borders, by structure-tree packing.

A text is parsed into a tree: sections under headings of each of the six levels, in them the elements of markup as they
nest, fenced code, list items and paragraphs, in these lines, sentences, words and at last characters.  From the bottom up, neighbouring siblings are
merged as long as they fit; only nodes that are too large themselves are descended into.  A piece is the
stretch of its own text preceded by ``overlap`` characters of the text before it, and all that is at most
``limit`` characters (code points) long.  ``own_start`` tells where a piece's own text begins:
``rebuild`` joins the own texts, in order, to exactly the original.

Defined results: null and empty texts give no pieces; a text within the limit is one piece; a word longer
than the limit is cut between characters; equal texts are cut alike; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

HEADING = re.compile(r"(?m)^(#{1,6})[ \t]+\S")
FENCE = re.compile(r"(?ms)^([ \t]*)(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\2[ \t]*(?:\n|\Z)|\Z)")
BLOCK = re.compile(r"\n[ \t]*\n\s*|(?=^[ \t]*(?:[-*+•]|\d+[.)])[ \t]+\S)|(?=^[ \t]*<(?:/?[a-z][^>\n]*)>)", re.MULTILINE)
TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)(?:\s[^<>]*?)?(/?)>")
# Elements of markup that make blocks.
ELEMENTS = frozenset("article aside blockquote body dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+|[。！？]")
CLAUSE = re.compile(r"[,;:]\s+")
SPACE = re.compile(r"\s+")


def _after(pattern: re.Pattern, text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """[start, stop) cut behind each match of ``pattern``."""
    cuts = [m.end() for m in pattern.finditer(text, start, stop) if start < m.end() < stop]
    ends = sorted({start, *cuts, stop})
    return list(zip(ends, ends[1:]))


def _sections(text: str, start: int, stop: int, level: int) -> list[tuple[int, int]]:
    """[start, stop) cut before each heading of at most ``level``, outside fences."""
    fences = [m.span() for m in FENCE.finditer(text, start, stop)]
    opens = [a for a, _ in fences]

    def fenced(i: int) -> bool:
        k = bisect_right(opens, i) - 1
        return k >= 0 and i < fences[k][1]

    cuts = [m.start() for m in HEADING.finditer(text, start, stop) if len(m.group(1)) <= level and not fenced(m.start())]
    ends = sorted({start, *cuts, stop})
    return list(zip(ends, ends[1:]))


def _blocks(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """[start, stop) cut around fenced code, at blank lines and before list items and markup lines."""
    out: list[tuple[int, int]] = []
    at = start
    for m in FENCE.finditer(text, start, stop):
        if m.start() > at:
            out += _after(BLOCK, text, at, m.start())
        out.append(m.span())
        at = m.end()
    if at < stop:
        out += _after(BLOCK, text, at, stop)
    return out


def _elements(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """[start, stop) cut around the outermost elements of markup in it; the inside of one that fills it all, likewise."""
    if text.find("<", start, stop) < 0:
        return [(start, stop)]
    fences = [m.span() for m in FENCE.finditer(text, start, stop)]
    opens = [a for a, _ in fences]
    stack: list[str] = []
    places: dict[int, set[int]] = {}
    for m in TAG.finditer(text, start, stop):
        k = bisect_right(opens, m.start()) - 1
        if k >= 0 and m.start() < fences[k][1]:
            continue
        name = m.group(2).lower()
        if name not in ELEMENTS and text[m.start() - 1 : m.start()] not in ("", "\n"):
            continue  # within a line only elements that make blocks count
        if not m.group(1):
            places.setdefault(len(stack), set()).add(m.start())
            if not m.group(3):
                stack.append(name)
        elif name in stack:
            del stack[len(stack) - 1 - stack[::-1].index(name) :]
            places.setdefault(len(stack), set()).add(m.end())
    for depth in sorted(places):
        cuts = {c for c in places[depth] if start < c < stop and text[start:c].strip() and text[c:stop].strip()}
        if cuts:
            ends = sorted({start, *cuts, stop})
            return list(zip(ends, ends[1:]))
    return [(start, stop)]


#: From the coarsest border to the finest.
LEVELS = [
    *(lambda t, a, b, n=n: _sections(t, a, b, n) for n in (1, 2, 3, 4, 5, 6)),
    _elements,
    _blocks,
    *(lambda t, a, b, p=p: _after(p, t, a, b) for p in (LINE, SENTENCE, CLAUSE, SPACE)),
]


def pack(text: str, start: int, stop: int, room: int, level: int = 0) -> list[tuple[int, int]]:
    """Stretches of at most ``room`` characters that cover [start, stop), cut at the coarsest borders."""
    if stop - start <= room:
        return [(start, stop)]
    if level == len(LEVELS):
        return [(i, min(i + room, stop)) for i in range(start, stop, room)]
    kids = LEVELS[level](text, start, stop)
    if len(kids) == 1:
        return pack(text, start, stop, room, level + 1)
    out: list[tuple[int, int]] = []
    for a, b in kids:
        inner = pack(text, a, b, room, level if LEVELS[level] is _elements else level + 1)  # elements nest in their kind
        # a subtree that fits joins its elder sibling; of one that was descended into, the first part does
        if out and inner[0][1] - out[-1][0] <= room:
            out[-1] = (out[-1][0], inner[0][1])
            inner = inner[1:]
        out += inner
    return out


def pieces(text: str | None, limit: int = 2000, overlap: int = 100) -> list[tuple[int, int, int]]:
    """(start, own_start, stop) of each piece of ``text``."""
    if limit <= overlap:
        raise ValueError("the limit must exceed the overlap")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    return [(max(0, a - overlap), a, b) for a, b in pack(text, 0, len(text), limit - overlap)]


def rebuild(parts: Iterable[tuple[int, int, str]]) -> str:
    """The text from its pieces' (start, own_start, piece), in any order."""
    return "".join(p[own - start :] for start, own, p in sorted(parts))
