"""Documents packed into containers of fixed capacity: best-fit decreasing, exact over the whole corpus.

Best fit looks only at the remaining capacity of the open containers, and sizes are whole tokens, so all
documents of one size, and all containers with the same room, are interchangeable.  The plan therefore is
made on the histogram of sizes (at most ``capacity`` numbers, whatever the corpus): for each size, the largest first,
a segment tree over the remaining capacities gives the tightest open container in logarithmic time; equal
containers are filled in one step.  Containers are kept as runs of consecutive numbers.  The plan is a
list of stretches "documents number a..b of size s go to containers x.., q in each", which every task
looks up for its own documents after their numbers within their size are known from counts per
partition.  The result is the one that best-fit decreasing gives on one machine.

A document larger than the capacity is cut into full containers and one rest, and only such a document is.

Defined results: null and empty texts have no tokens and lie in container 0; equal sizes are numbered by
partition and row; repeated documents are packed each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from re import Pattern

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.arrow import map_rows
from braidlog.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer splits a text before its merges (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters that the tokenizer gets at once; longer texts go in parts that give the same tokens.
AT_ONCE = 100_000


def counter(vocabulary: str) -> Callable[[str], int]:
    """Function that counts a text's tokens; special tokens' strings are ordinary text."""
    import regex
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    split = regex.compile(SPLIT)

    def count(text: str) -> int:
        if len(text) <= AT_ONCE:
            return len(encoding.encode_ordinary(text))
        n = 0
        for part, single in parts(text, split):
            n += len(encoding._encode_single_piece(part)) if single else len(encoding.encode_ordinary(part))
        return n

    return count


def parts(text: str, split: Pattern, most: int = AT_ONCE) -> Iterator[tuple[str, bool]]:
    """``text`` in parts of about ``most`` characters, cut only where the tokenizer splits it anyway.

    A run that it doesn't split stays whole, however long, and comes alone, marked true: such runs would
    overflow the tokenizer's own matching.
    """
    start = at = 0
    for m in split.finditer(text):
        a, b = m.span()
        if b - a > most:
            if a > start:
                yield text[start:a], False
            yield text[a:b], True
            start = b
        elif b - start > most:
            yield text[start:a], False
            start = a
        at = b
    if at > start:
        yield text[start:at], False


class Rooms:
    """Segment tree over remaining capacities 0..capacity, each with runs of container numbers."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, room: int, first: int, n: int) -> None:
        self.runs[room].append((first, n))
        self._add(room, n)

    def tightest(self, size: int) -> int | None:
        """Least room >= ``size`` that some container has."""
        i = self.leaves + size
        if self.count[i]:
            return size
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """At most ``most`` containers of one run with this room: (first number, how many)."""
        first, n = self.runs[room].pop()
        k = min(n, most)
        if k < n:
            self.runs[room].append((first + k, n - k))
        self._add(room, -k)
        return first, k


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """size -> [(first document, first container, documents in each)], sorted; and the number of containers.

    ``histogram``: number of documents of each size 1..capacity.
    """
    rooms, opened = Rooms(capacity), 0
    out: dict[int, list[tuple[int, int, int]]] = {}
    for size in sorted(histogram, reverse=True):
        left, at = histogram[size], 0
        steps = out.setdefault(size, [])
        while at < left:
            room = rooms.tightest(size)
            if room is None:
                # new containers, each filled with this size as often as it goes: once begun, none is tighter
                each = capacity // size
                n, rest = divmod(left - at, each)
                if n:
                    steps.append((at, opened, each))
                    rooms.put(capacity - each * size, opened, n)
                    opened, at = opened + n, at + n * each
                if rest:
                    steps.append((at, opened, rest))
                    rooms.put(capacity - rest * size, opened, 1)
                    opened, at = opened + 1, left
                break
            each = room // size
            full = (left - at) // each
            if full:
                first, k = rooms.take(room, full)
                steps.append((at, first, each))
                rooms.put(room - each * size, first, k)
                at += k * each
            else:
                first, _ = rooms.take(room, 1)
                steps.append((at, first, left - at))
                rooms.put(room - (left - at) * size, first, 1)
                at = left
    return out, opened


PIECES = "doc_id bigint, piece bigint, token_start bigint, n_tokens bigint, part int, nth bigint"


def _number(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document, numbered within this partition by size."""
    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for batch in batches:
        rows: list[tuple] = []
        for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for k in range(max(1, -(-n // capacity))):
                size = min(capacity, n - k * capacity)
                nth = seen.get(size, 0)
                seen[size] = nth + 1
                rows.append((doc, k, k * capacity, size, part, nth))
        if rows:
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and its number of tokens."""

    def make() -> Callable[..., Iterable[tuple]]:
        count = counter(vocabulary)
        return lambda doc, text: [(doc, count(text) if text else 0)]

    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), make, "doc_id bigint, n_tokens bigint")


def packed(documents: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, token_start, n_tokens, container of every piece of every document."""
    spark = documents.sparkSession
    sizes = cut(token_counts(documents, vocabulary))
    numbered = cut(sizes.mapInArrow(lambda b: _number(b, capacity), PIECES))
    counts = numbered.groupBy("n_tokens", "part").agg(F.count("*").alias("n"))
    total = {r[0]: r[1] for r in counts.groupBy("n_tokens").agg(F.sum("n")).collect()}  # at most capacity + 1 rows
    total.pop(0, None)
    steps, _ = plan(total, capacity)
    sent = spark.sparkContext.broadcast({s: ([x[0] for x in v], v) for s, v in steps.items()})
    w = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    ranked = numbered.join(offsets, ["n_tokens", "part"]).select("doc_id", "piece", "token_start", "n_tokens", F.col("nth") + F.col("offset"))

    def make() -> Callable[..., Iterable[tuple]]:
        lookup = sent.value

        def each(doc: int, piece: int, start: int, size: int, nth: int) -> Iterable[tuple]:
            if not size:
                return [(doc, piece, start, size, 0)]
            firsts, steps = lookup[size]
            first, container, q = steps[bisect_right(firsts, nth) - 1]
            return [(doc, piece, start, size, container + (nth - first) // q)]

        return each

    return map_rows(ranked, make, "doc_id bigint, piece bigint, token_start bigint, n_tokens bigint, container bigint")
