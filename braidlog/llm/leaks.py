"""Evaluation texts in a corpus, found with one Aho-Corasick automaton.

A run of ``words`` consecutive words of an item always holds one of the item's blocks of ``(words + 1) // 2`` words
that begin at a multiple of that length.  These blocks, each word in one of them only, are the patterns; the
automaton reads each document once, and a block's place is extended in both directions, word by word, to the whole
passage.  So nothing is missed, and the automaton has at most two nodes a word of the items, instead of one per
character of every window.  Words are written as two letters of two alphabets, which keeps nodes narrow and
matches in step with the words.

Texts are normalised to their words (maximal runs of letters and digits, lower case); hits are mapped back to
offsets in the original.  The automaton is built once a worker process and serves all its tasks.

The items are broadcast.  Their words are counted first: up to ``most_words`` (about 16 million characters, 240 MB a
worker) one automaton reads the corpus once; beyond that the items are split into groups by id, each with an
automaton and a pass of its own, so that a worker's memory stays bounded.

Defined results: null and empty texts, and items of fewer than ``words`` words, match nothing; a document
that repeats a passage gives one row per item; repeated documents each give their rows; other columns are
ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.functions.arrow import map_rows

WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id bigint, item_id bigint, passages bigint, start bigint, stop bigint"
UNKNOWN = "\0\0"


class Automaton:
    """All passages of ``words`` or more words that a text shares with the items."""

    def __init__(self, items: list[tuple[int, str | None]], words: int) -> None:
        import ahocorasick

        self.words, self.ids, self.nodes = words, [], 0
        split = []
        number: dict[str, int] = {}
        for item, text in items:
            w = [x.lower() for x in WORD.findall(text or "")]
            if len(w) >= words:
                self.ids.append(item)
                split.append(w)
                for x in w:
                    number.setdefault(x, len(number))
        base = int(len(number) ** 0.5) + 1
        if base > 20_000:
            raise ValueError("too many different words for one automaton")
        # the first letters and the second ones differ, so a pattern never begins inside a word
        self.code = {x: chr(2 + k // base) + chr(2 + base + k % base) for x, k in number.items()}
        self.texts = ["".join([self.code[x] for x in w]) for w in split]
        size = 2 * ((words + 1) // 2)
        places: dict[str, list[tuple[int, int]]] = {}
        for i, text in enumerate(self.texts):
            for at in range(0, len(text) - size + 1, size):
                places.setdefault(text[at : at + size], []).append((i, at))
        self.automaton = None
        if places:
            self.automaton = ahocorasick.Automaton()
            for pattern, where in places.items():
                self.automaton.add_word(pattern, where)
            self.automaton.make_automaton()
            self.nodes = self.automaton.get_stats()["nodes_count"]
        self.size = size

    def hits(self, text: str) -> dict[int, list[int]]:
        """Item -> [windows of the text found, start, stop], offsets in the original text."""
        if self.automaton is None:
            return {}
        code = self.code
        plain = "".join([code.get(x, UNKNOWN) for x in " ".join(WORD.findall(text)).lower().split(" ")])
        done: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the run seen there
        runs: dict[int, list[tuple[int, int]]] = {}
        for end, where in self.automaton.iter(plain):
            begin = end + 1 - self.size
            for i, at in where:
                line = (i, begin - at)
                if done.get(line, -1) > begin:
                    continue
                item = self.texts[i]
                a, p = begin, at
                while a >= 2 and p >= 2 and plain[a - 2 : a] == item[p - 2 : p]:
                    a, p = a - 2, p - 2
                b, q = end + 1, at + self.size
                while b < len(plain) and q < len(item) and plain[b : b + 2] == item[q : q + 2]:
                    b, q = b + 2, q + 2
                done[line] = b
                if b - a >= 2 * self.words:
                    runs.setdefault(i, []).append((a // 2, b // 2))
        if not runs:
            return {}
        spans = [m.span() for m in WORD.finditer(text)]
        found: dict[int, list[int]] = {}
        for i, parts in runs.items():
            n, reached = 0, 0
            for a, b in sorted(parts):  # windows begin at a .. b - words
                n += max(0, b - self.words + 1 - max(a, reached))
                reached = max(reached, b - self.words + 1)
            start, stop = spans[min(a for a, _ in parts)][0], spans[max(b for _, b in parts) - 1][1]
            old = found.get(self.ids[i])
            found[self.ids[i]] = [n, start, stop] if old is None else [old[0] + n, min(old[1], start), max(old[2], stop)]
        return found


_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, items: list[tuple[int, str]], words: int) -> Automaton:
    """The automaton of this worker process; it holds the last one only."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(items, words)
    return _BUILT[name]


def leaked(documents: DataFrame, items: DataFrame, words: int = 10, most_words: int = 3_000_000) -> DataFrame:
    """doc_id, item_id, number of windows found, and the stretch of the document they span."""
    spark = documents.sparkSession
    n = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+")))).first()[0] or 0
    groups = max(1, -(-n // most_words))
    out = None
    for g in range(groups):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).select(F.col("item_id").cast("long"), "text")
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r[0], r[1]) for r in mine.collect()]))  # at most about ``most_words``

        def make(sent=sent) -> Callable[..., Iterable[tuple]]:
            automaton = _automaton(*sent.value, words)

            def each(doc: int, text: str | None) -> Iterable[tuple]:
                return [(doc, i, n, s, e) for i, (n, s, e) in automaton.hits(text).items()] if text else ()

            return each

        part = map_rows(documents.select(F.col("doc_id").cast("long"), "text"), make, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out
