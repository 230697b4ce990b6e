"""Text functions as columns; Python only where Spark has no expression for it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HANGUL = r"[가-힣]"
CUT_MARK = "…[truncated]"


def hangul_terms(text: Column) -> Column:
    """Runs of two or more Hangul syllables as overlapping pairs with blanks around; all else unchanged."""
    parts = F.regexp_extract_all(text, F.lit(f"({HANGUL}{{2,}}|{HANGUL}|[^가-힣]+)"), F.lit(1))

    def expand(p: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(p) - 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(2)))
        return F.when(p.rlike(f"^{HANGUL}{{2,}}$"), F.concat(F.lit(" "), F.array_join(pairs, " "), F.lit(" "))).otherwise(p)

    return F.array_join(F.transform(parts, expand), "")


def tokens(text: Column, hangul: bool = True) -> Column:
    """Lower-case tokens: maximal runs of letters and digits, Hangul runs as pairs."""
    t = F.when(text.rlike(f"{HANGUL}{{2}}"), hangul_terms(text)).otherwise(text) if hangul else text
    return F.filter(F.split(F.lower(t), r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: x != "")


#: Letters with marks and their plain letters (fixed values of Latin-1 and Latin Extended-A).
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
assert len(MARKED) == len(PLAIN)


def fold_marks(text: Column) -> Column:
    """Lower case without diacritics of Latin letters, be they part of the letter or marks of their own behind it."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "(?<=[a-z])[\u0300-\u036f]+", "")


def one_line(text: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def cut_bytes(text: Column, most: int, mark: str = CUT_MARK) -> Column:
    """At most ``most`` bytes of UTF-8, cut between characters, with a mark where cut.

    Native: an encoded prefix that ends inside a character loses up to three bytes until it decodes.
    """
    raw = F.encode(text, "UTF-8")
    tries = [F.try_validate_utf8(F.substring(raw, 1, n)) for n in range(most, max(most - 4, -1), -1)]
    return F.when(text.isNull() | (F.octet_length(text) <= most), text).otherwise(F.concat(F.coalesce(*tries, F.lit("")), F.lit(mark)))


def left_trimmed(text: Column) -> Column:
    """Without white space of any kind at the start."""
    return F.regexp_replace(text, r"^(?U)\s+", "")


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def base_path(path: Column) -> Column:
    """An archive path without its generation."""
    return F.regexp_replace(path, r"\.gen-[0-9]+\.jsonl$", ".jsonl")


def generation(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"\.gen-([0-9]+)\.jsonl$", 1).try_cast("long"), F.lit(0))


def archive_name(kind: Column, relative: Column, gen: Column) -> Column:
    """Path of a generation of an archive."""
    stem = F.regexp_replace(relative, r"\.jsonl$", "")
    return F.concat(F.lit("conversation-archive/"), kind, F.lit("/"), stem, F.when(gen > 0, F.concat(F.lit(".gen-"), gen.cast("string"))).otherwise(""), F.lit(".jsonl"))


def project_of(cwd: Column) -> Column:
    """Last part of a working directory; ``unknown`` where there is none."""
    parts = F.filter(F.split(cwd, "/"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("unknown"))


# ---- stemming --------------------------------------------------------------------------------------

def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    form = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", form))


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") for i, c in enumerate(stem))


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False

    def con(i: int) -> bool:
        ch = w[i]
        return ch not in "aeiou" and not (ch == "y" and i and con(i - 1))

    n = len(w)
    return con(n - 3) and not con(n - 2) and con(n - 1) and w[-1] not in "wxy"


# The suffixes of the published algorithm, by step.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(word: str) -> str:
    """Stem by Porter's published algorithm; words of under 3 or over 64 bytes and other scripts stay."""
    w = word
    if not (3 <= len(w.encode()) <= 64) or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for suffix, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


_FOLD = str.maketrans(MARKED, PLAIN)
_RUN = re.compile(r"[가-힣]{2,}")
_TOKEN = re.compile(r"[^\W_]+")
_MARKS = re.compile("(?<=[a-z])[\u0300-\u036f]+")


def analyzer(stem: bool) -> Callable[[str], list[str]]:
    """Function that gives a text's terms: Hangul pairs and lower-case tokens; with ``stem`` folded marks and Porter stems.

    Each distinct token is stemmed once per function (a bounded cache).
    """
    seen: dict[str, str] = {}

    def stemmed(w: str) -> str:
        s = seen.get(w)
        if s is None:
            if len(seen) > 500_000:
                seen.clear()
            s = seen[w] = porter(w)
        return s

    def pairs(m: re.Match) -> str:
        run = m.group()
        return " " + " ".join(run[i : i + 2] for i in range(len(run) - 1)) + " "

    def plain(text: str) -> list[str]:
        text = text.lower()
        return _TOKEN.findall(text if text.isascii() else _RUN.sub(pairs, text))

    if not stem:
        return plain
    return lambda text: [stemmed(w) for w in plain(text if text.isascii() else _MARKS.sub("", text.lower().translate(_FOLD)))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _analyze(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    terms = analyzer(True)
    for t in texts:
        yield t.map(lambda x: None if x is None else terms(x))


#: A plan must not fold the UDF into the lambdas that read its result.
_analyze = _analyze.asNondeterministic()


def analyzed(text: Column) -> Column:
    """Tokens as a stemming index has them: folded marks, Hangul pairs, Porter stems."""
    return _analyze(text)
