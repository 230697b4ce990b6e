"""Text that was decoded with the wrong character encoding: found, and restored where possible.

A *step* undoes one wrong decoding: the characters of a stretch are encoded again with the wrong encoding
and decoded with the right one.  A *chain* is any number of steps that each change the word; steps from UTF-8 make it
shorter, so chains end.  What explains a text best is a question of minimum description length: the words with
signs outside ASCII, as they are and as each chain restores them, are compressed by Zstandard with a dictionary per
language.  Chains are taken into a text's description one after another, the one that saves most first, as long as
the words it restores save more bytes than the chain itself costs; each word goes by the one among them that
describes it shortest.  Where no chain pays, the text is left unchanged.

Encodings of several bytes (Shift-JIS, GB18030, Big5, EUC-KR) are undone where all pairs of signs of the result occur
in the dictionaries: chance alone often gives rare ideographs.

The dictionaries hold the words of all documents that reach a share (``SHARE``) of those in their language, at least
``LEAST`` documents; the counts are added up in the tasks first.  A language of less than ``RARE`` of all documents has no
dictionary of its own.  So the size of all dictionaries is bounded by the words of a mean document, whatever the corpus.

Words are judged first, each distinct word once a task (a bounded cache), so that a document costs a lookup
per word; only documents with suspect words have their chains compared as a whole.

Replacement characters and stray C1 controls are signs of a wrong decoding that can't be undone: they are
reported and left as they are.

Defined results: null, empty and ASCII-only texts are never reported; repeated documents each give a row;
an empty table gives none; other columns are ignored; a text garbled in several ways is restored in all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.functions.arrow import map_rows, safe

#: Least share, and least number, of a language's documents that a word of its dictionary is in; least share of a language.
SHARE, LEAST, RARE = 5e-4, 3, 1e-3
#: Wrong decodings of UTF-8, and pairs (wrong, right) of one-byte encodings (fixed values).
WRONG = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250"]
PAIRS = [("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"),
         ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp1250"), ("cp1250", "cp1252")]
#: A word with signs outside ASCII, with what stands next to them.
WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]*+(?:[^\x00-\x7f]++[A-Za-z]*+)+")
#: Lines of boxes, which some wrong decodings of letters look like.
BOX = re.compile("[\u2500-\u257f]+")
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
UNITS, STEP_COST, WORDS_KEPT = "utf-16-le", 1, 200_000
#: Encodings of several bytes a sign, as wrong decodings of UTF-8 and as right ones of text read as a one-byte encoding.
WIDE = ["gb18030", "shift_jis", "big5", "euc_kr"]
WIDE_READ_AS = ["cp1252", "latin_1"]


def words_of(text: str) -> list[str]:
    """All words with signs outside ASCII; ASCII ones are passed over before any expression sees them."""
    return [w for part in text.replace("\n", " ").split(" ") if not part.isascii() for w in WORD.findall(part)]


def _bytes_of(codec: str) -> dict[str, int]:
    """Character -> byte for the upper half; bytes the codec leaves undefined stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    if codec == "cp1252":  # text that went through Latin-1 keeps the controls
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


class Undo:
    """One step: restores the stretches of a word that it can explain, and leaves the rest."""

    def __init__(self, wrong: str, right: str) -> None:
        self.name = f"{wrong}>{right}"
        self.table = _bytes_of(wrong)
        self.right = right
        if right != "utf-8":
            self.table.pop("\xa0", None)  # a blank stays one

        def some(low: int, high: int) -> str:
            return "[" + re.escape("".join(c for c, b in self.table.items() if low <= b <= high)) + "]"

        if right == "utf-8":
            t = some(0x80, 0xBF)
            self.stretch = re.compile(f"{some(0xC2, 0xDF)}{t}|{some(0xE0, 0xEF)}{t}{t}|{some(0xF0, 0xF4)}{t}{t}{t}" + (f"|â€(?!{t})|Ã(?!{t})$" if wrong == "cp1252" else ""))
        else:
            self.stretch = re.compile(f"{some(0x80, 0xFF)}+")

    def _one(self, m: re.Match) -> str:
        s = m.group()
        if BOX.fullmatch(s) and not (m.string[max(0, m.start() - 1) : m.start()].isalpha() or m.string[m.end() : m.end() + 1].isalpha()):
            return s  # a drawing, unless letters touch it
        if s == "â€":  # the third byte, 9D, was dropped
            return "”"
        if s == "Ã" and self.right == "utf-8":  # the second, A0, was taken for a blank
            return "à"
        try:
            return bytes(self.table[c] for c in s).decode(self.right)
        except UnicodeDecodeError:
            return s

    def __call__(self, word: str) -> str:
        return self.stretch.sub(self._one, word)


class Wide:
    """One step with an encoding of several bytes on one of its sides; a stretch is undone as a whole or not at all, to a lone sign only beside letters."""

    def __init__(self, wrong: str, right: str) -> None:
        self.name, self.wrong, self.right = f"{wrong}>{right}", wrong, right
        # the trail bytes of some encodings are ASCII
        self.stretch = re.compile(r"[^\x00-\x7f]+" if right == "utf-8" else r"[^\x00-\x7f][\x40-\x7e\x80-\U0010ffff]*")

    def _one(self, m: re.Match) -> str:
        try:
            new = m.group().encode(self.wrong).decode(self.right)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m.group()
        beside = m.string[max(0, m.start() - 1) : m.start()].isalpha() or m.string[m.end() : m.end() + 1].isalpha()
        return new if (len(new) > 1 or beside) and not new.isascii() else m.group()

    def __call__(self, word: str) -> str:
        return self.stretch.sub(self._one, word)


FROM_UTF8 = [Undo(w, "utf-8") for w in WRONG]
STEPS = [*FROM_UTF8, *(Undo(w, r) for w, r in PAIRS), *(Wide(w, "utf-8") for w in WIDE), *(Wide(w, r) for w in WIDE_READ_AS for r in WIDE)]
#: Steps from here on need pairs of signs that the corpus knows.
FIRST_WIDE = len(FROM_UTF8) + len(PAIRS)
#: Wide steps make sense for words with such signs only: ideographs, kana, Hangul, or the upper half of Latin-1.
MAYBE_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7a3\uf900-\uffef]|[\x80-\xff\u2010-\u2122\u0152-\u0192]{2}")


BESIDE = re.compile("[^\x00-\x7f]{2}|Ã$")


def chains(word: str, known: frozenset[str] | None = None) -> dict[tuple[int, ...], str]:
    """Chain of steps -> what it makes of ``word``, for chains that change it at every step.

    A step from UTF-8 shortens the word, and a chain has one other step at most, at any place, so the search ends by
    itself.  ``known``: signs outside ASCII, and pairs of them, that the corpus has; what a chain with another step
    gives must consist of them, and of known pairs if that step was a wide one.
    """
    out: dict[tuple[int, ...], str] = {}
    seen = {word}
    level: list[tuple[tuple[int, ...], str, int]] = [((), word, 0)]
    while level:
        nxt = []
        for chain, text, other in level:
            wide = not other and known is not None and MAYBE_WIDE.search(text) is not None
            # what came from UTF-8 has at least two signs outside ASCII side by side
            first = 0 if BESIDE.search(text) else len(FROM_UTF8)
            for i in range(first, len(FROM_UTF8) if other else len(STEPS) if wide else FIRST_WIDE):
                new = STEPS[i](text)
                if new in seen:
                    continue
                seen.add(new)
                kind = other or (2 if i >= FIRST_WIDE else 1 if i >= len(FROM_UTF8) else 0)
                if not kind or known is None or all(c in known for c in (_pairs(new) if kind == 2 else OUTSIDE.findall(new))):
                    out[(*chain, i)] = new
                if not new.isascii():
                    nxt.append(((*chain, i), new, kind))
        level = nxt
    return out


OUTSIDE = re.compile("[^\x00-\x7f]")


def _pairs(text: str) -> list[str]:
    """Neighbouring signs both outside ASCII; a lone sign counts with itself."""
    got = [text[i : i + 2] for i in range(len(text) - 1) if text[i] > "\x7f" < text[i + 1]]
    return got or [c for c in text if c > "\x7f"]


class Judge:
    """Description lengths with one dictionary per language, and verdicts on words and texts."""

    def __init__(self, dictionaries: dict[str, str]) -> None:
        import zstandard as z

        self.pressers = []
        self.known = {w for words in dictionaries.values() for w in words.split(" ")}
        for words in dictionaries.values():
            d = z.ZstdCompressionDict(words.encode(UNITS), dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=12)
            self.pressers.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.signs = frozenset(p for w in self.known for p in (*_pairs(w), *OUTSIDE.findall(w)))
        self.seen: dict[str, dict[tuple[int, ...], str]] = {}
        self.made: dict[str, dict[tuple[int, ...], str]] = {}

    def length(self, text: str) -> int:
        """Bytes of the shortest description; every character weighs the same before compression."""
        data = text.encode(UNITS, "surrogatepass")
        return min(len(p.compress(data)) for p in self.pressers)

    def chains(self, word: str) -> dict[tuple[int, ...], str]:
        got = self.made.get(word)
        if got is None:
            if len(self.made) >= WORDS_KEPT:
                self.made.clear()
            got = self.made[word] = chains(word, self.signs)
        return got

    def suspects(self, word: str) -> dict[tuple[int, ...], str]:
        """Chains that describe the word itself in fewer bytes, with what they make of it."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= WORDS_KEPT:
                self.seen.clear()
            got = chains(word, self.signs)
            if got:
                own = self.length(f" {word} ")
                got = {c: t for c, t in got.items() if self.length(f" {t} ") < own}
            self.seen[word] = got
        return got

    def best(self, text: str) -> tuple[list[tuple[int, ...]], dict[str, str]]:
        """The chains of the shortest description of the text's words, and what they make of them."""
        words = list(dict.fromkeys(words_of(text)))
        candidates = {c for w in words for c in self.suspects(w)}
        if not candidates:
            return [], {}
        by: dict[tuple[int, ...], dict[str, str]] = {c: {} for c in candidates}
        for w in words:
            if w not in self.known:
                sure = self.suspects(w)
                for c, t in self.chains(w).items():
                    if c in by and (t in self.known or c in sure):
                        by[c][w] = t
        # words no chain would touch describe themselves alike under all
        touched = [w for w in words if any(w in made for made in by.values())]
        alone: dict[str, int] = {}

        def size(t: str) -> int:
            if t not in alone:
                alone[t] = self.length(f" {t} ")
            return alone[t]

        now: dict[str, str] = {}
        used: list[tuple[int, ...]] = []
        least = self.length(" ".join(touched))
        while True:
            found = None
            for c, made in sorted(by.items(), key=lambda x: (len(x[0]), x[0])):
                if c in used:
                    continue
                new = now | {w: t for w, t in made.items() if w not in now or size(t) < size(now[w])}
                if new == now:
                    continue
                n = self.length(" ".join(new.get(w, w) for w in touched)) + STEP_COST * sum(map(len, [*used, c]))
                if n < least:
                    least, found = n, (c, new)
            if found is None:
                return used, now
            used.append(found[0])
            now = found[1]

    def restore(self, text: str) -> tuple[str, list[str]]:
        """The restored text and the names of the chains used; what is restored is looked at again until nothing pays."""
        used: list[str] = []
        seen = {text}
        while True:
            chosen, made = self.best(text)
            text = WORD.sub(lambda m: made.get(m.group(), m.group()), text)  # noqa: B023
            if not chosen or text in seen:
                return text, used
            seen.add(text)
            used += [" ".join(STEPS[i].name for i in c) for c in chosen]


def clean_words(counts: Counter) -> Counter:
    """``counts`` without words that lost signs, or that some chain turns into a commoner word."""
    out: Counter = Counter()
    for word, k in counts.items():
        if not LOST.search(word) and not any(counts.get(t, 0) > k or t.isascii() for t in chains(word).values()):
            out[word] = k
    return out


def dictionaries(documents: DataFrame) -> dict[str, str]:
    """Language -> the words outside ASCII that enough of its documents have, the commonest last.

    Words that may be garbled themselves are left out.
    """
    most = 200_000
    docs = documents.groupBy("lang").count().where("lang is not null")
    every_doc = documents.count()
    sizes = {r[0]: r[1] for r in docs.where(F.col("count") >= max(1, RARE * every_doc)).collect()}  # at most 1 / RARE rows
    known = sorted(sizes)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array([g for g, _ in counts], pa.string()), pa.array([safe(w) for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])
            counts.clear()
            return batch

        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text and not text.isascii():
                    for w in set(words_of(text)):
                        counts["", w] += 1  # texts of any language, or in several
                        if lang in sizes:
                            counts[lang, w] += 1
            if len(counts) >= most:
                yield flush()
        if counts:
            yield flush()

    found = documents.select("lang", "text").mapInArrow(words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    least = F.lit(float(max(LEAST, SHARE * every_doc)))
    for lang in known:
        least = F.when(F.col("lang") == lang, float(max(LEAST, SHARE * sizes[lang]))).otherwise(least)
    by: dict[str, Counter] = {}
    for lang, word, k in found.where(F.col("n") >= least).collect():  # see the module's text
        by.setdefault(lang, Counter())[word] = k
    every: Counter = Counter()
    for c in by.values():
        for w, k in c.items():
            every[w] = max(every[w], k)
    clean = clean_words(every)
    return {lang: " " + " ".join(w for w, _ in sorted(c.items(), key=lambda x: (x[1], x[0])) if w in clean) + " " for lang, c in by.items()}


SCHEMA = "doc_id bigint, restored string, chain string, lost boolean"


def garbled(documents: DataFrame) -> DataFrame:
    """doc_id, restored text, chains used, and whether signs remain that can't be restored."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(dictionaries(documents))

    def make() -> Callable[..., Iterable[tuple]]:
        judge = Judge(sent.value)

        def each(doc: int, text: str) -> Iterable[tuple]:
            if text.isascii():
                return ()
            suspect = lost = False
            for w in set(words_of(text)):
                suspect = suspect or bool(judge.suspects(w))
                lost = lost or bool(LOST.search(w))
            new, used = judge.restore(text) if suspect else (text, [])
            if not used and not lost:
                return ()
            return [(doc, safe(new), ", ".join(used), bool(LOST.search(new)))]

        return each

    return map_rows(documents.where("text is not null").select(F.col("doc_id").cast("long"), "text"), make, SCHEMA, 500)
