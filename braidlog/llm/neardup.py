"""Near-duplicate texts: a MinHash LSH forest with exact verification.

1. Texts with the same sequence of words are one *class* (a hash of the words); only classes go on, so a
   group of copies weighs as much as one text.  Copies are folded inside each task before any shuffle, and what several tasks
   send of a class lies side by side in the sorted tries and is dropped there.
2. Each class gets a sketch of its sequences and, in each of ``TREES`` prefix tries, a key of MinHash levels over
   all of them, common ones too: the similarity that the tries search by is the one that defines a pair.  The
   matched prefix is shortened until the recall at the threshold reaches ``TARGET`` (``longest`` gives that
   length, ``DEEPEST``); where a place of the trie is sparse it is shortened by one level more (``SHALLOW``), which
   costs little there and only adds to the recall.
3. Pairs whose sketches disagree too much are dropped: by the first two planes in the tries, then by all ``PLANES``.
   ``least`` sets both floors so that each loses a pair at the threshold with a chance of at most ``LOSS``.
   The rest is verified on the whole texts.

The sorted tries are cut into ranges of equal size, whatever the nodes, so a node of any size is spread over as many
tasks as it needs.  What a range holds of a node that may go on in the next, and nodes larger than ``BLOCK``, are written as
blocks; each pair of blocks of a node is a row of its own and these rows are spread by block.  ``links`` gives the verified
pairs of classes, ``members`` the class of each row, ``pairs`` the pairs of rows: within classes of at most ``expand`` rows and
between two such classes all of them; a row of a larger class is paired with the class's first row, which stands for it
elsewhere (``groups`` gives class, group and number of links of every row, whatever the sizes).

Defined results: null texts are empty; texts with fewer than ``SHINGLE`` words have no sequences, hence no
pairs; empty tables give no rows; repeated rows are members of one class; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.arrow import map_rows
from braidlog.session import cut, shuffle_width

WORD = re.compile(r"[^\W_]+")
SHINGLE, THRESHOLD = 3, 0.5
#: Recall at the threshold that the tries must reach, and how many there are.
TARGET, TREES, BITS, SMALL, BLOCK = 0.995, 40, 16, 8, 2048


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that two texts of this similarity share a prefix of ``depth`` levels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def longest(target: float = TARGET, similarity: float = THRESHOLD, trees: int = TREES) -> int:
    """Levels of the longest prefix at which pairs of this similarity meet with a chance of at least ``target``."""
    depth = 1
    while recall(similarity, depth + 1, trees) >= target:
        depth += 1
    if recall(similarity, depth, trees) < target:
        raise ValueError("too few trees for this recall")
    return depth


DEEPEST = longest()
#: Levels that a sorted key has: three, whose first two make a number of 32 bits.
SHALLOW = DEEPEST - 1
assert DEEPEST == 3
#: A sketch has ``FUNCTIONS`` hash values of ``PLANES`` bits; a plane is one bit of each, in words of 64.
FUNCTIONS, PLANES, WALK_PLANES, LOSS = 128, 4, 2, 1e-6
WORDS = FUNCTIONS // 64
_RNG = np.random.default_rng(20240229)
# hash functions x -> (x ^ a) * b on 32 bits
_TREE_FUNCTIONS = np.stack([_RNG.integers(0, 1 << 32, TREES * DEEPEST, dtype=np.uint32), _RNG.integers(0, 1 << 31, TREES * DEEPEST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)], axis=1)
_SKETCH_FUNCTIONS = np.stack([_RNG.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32), _RNG.integers(0, 1 << 31, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)], axis=1)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def least(planes: int, functions: int = FUNCTIONS, similarity: float = THRESHOLD, loss: float = LOSS) -> int:
    """Most hash values of ``planes`` bits that may be asked to be equal if at most ``loss`` of the pairs of this similarity are lost."""
    p = similarity + (1 - similarity) / 2**planes
    below = 0.0
    for k in range(functions + 1):
        below += comb(functions, k) * p**k * (1 - p) ** (functions - k)
        if below > loss:
            return k
    return functions


#: ASCII letters in lower case and digits as they are, all else a blank.
_ASCII = {i: (chr(i).lower() if chr(i).isalnum() else " ") for i in range(128)}


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return text.translate(_ASCII).split() if text.isascii() else WORD.findall(text.lower())


def sequences(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def similarity(a: str, b: str) -> float:
    """Shared part of the distinct sequences of ``SHINGLE`` words of both texts."""
    x, y = sequences(words_of(a)), sequences(words_of(b))
    either = len(x | y)
    return len(x & y) / either if either else 0.0


class Hasher:
    """Hashes of word sequences, repeats included; words are hashed once a task (a bounded cache)."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All hashes of some texts of at least ``SHINGLE`` words one after another, and how many each has."""
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        try:
            flat = [seen[w] for ws in texts for w in ws]
        except KeyError:
            for ws in texts:
                for w in ws:
                    if w not in seen:
                        seen[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            flat = [seen[w] for ws in texts for w in ws]
        a = np.frombuffer(array("Q", flat), np.uint64)
        n = len(a) - SHINGLE + 1
        s = a[:n] * _STEPS[0]
        for i in range(1, SHINGLE):
            s = (s ^ (s >> np.uint64(29))) * _MIX + a[i : n + i] * _STEPS[i % 3]
        s ^= s >> np.uint64(32)
        s *= _MIX
        s ^= s >> np.uint64(29)
        words = np.array([len(ws) for ws in texts])
        counts = words - SHINGLE + 1
        # leave out the sequences that reach into the next text
        first = np.cumsum(words) - words
        return s[np.arange(counts.sum()) + np.repeat(first - _before(counts), counts)], counts


def _before(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _smallest(h: np.ndarray, counts: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """Least value of each text's hashes under each function: one row per function."""
    x, at = (h >> np.uint64(32)).astype(np.uint32), _before(counts)
    out = np.empty((len(functions), len(counts)), np.uint32)
    for i, (a, b) in enumerate(functions):
        out[i] = np.minimum.reduceat((x ^ a) * b, at)
    return out.astype(np.uint64) * _MIX


def keys_of(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of ``BITS`` bits, one row per text and one column per tree: the first two in 32 bits, the last in 16."""
    level = (_smallest(h, counts, _TREE_FUNCTIONS) >> np.uint64(64 - BITS)).astype(np.uint32).reshape(TREES, DEEPEST, -1)
    upper = (level[:, 0] << np.uint32(BITS)) | level[:, 1]
    return np.ascontiguousarray(upper.T).view(np.int32), np.ascontiguousarray(level[:, 2].T.astype(np.uint16)).view(np.int16)


def sketches_of(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``PLANES`` times ``WORDS`` words of 64 one-bit hashes for each text, plane after plane."""
    values = _smallest(h, counts, _SKETCH_FUNCTIONS)
    bits = np.stack([(values >> np.uint64(63 - i)) & np.uint64(1) for i in range(PLANES)]).reshape(PLANES * WORDS, 64, -1)
    return (bits * _POWERS[None, :, None]).sum(axis=1, dtype=np.uint64).astype(np.int64)


def _classed(words: list[str]) -> int:
    return int.from_bytes(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _in_parts(batches: Iterator[pa.RecordBatch], most: int = 60_000) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Ids and words of the texts with sequences, about ``most`` words at a time."""
    ids: list[int] = []
    texts: list[list[str]] = []
    size = 0
    for b in batches:
        for rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words_of(t)
            if len(w) >= SHINGLE:
                ids.append(rid)
                texts.append(w)
                size += len(w)
                if size >= most:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def signatures(texts: DataFrame) -> DataFrame:
    """id and class of every text that has sequences; sketch and tree keys where the task meets the class first.

    So a group of copies costs one sketch a task at most; the walk drops what is left of them.
    """
    most = 500_000
    names = ["id", "class", "sketch", "upper", "lower"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int16())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        met: set[int] = set()
        for ids, words in _in_parts(batches):
            classes = [_classed(w) for w in words]
            new, old = [], []
            for i, c in enumerate(classes):
                (old if c in met else new).append(i)
                met.add(c)
            if len(met) > most:
                met.clear()
            if old:
                yield pa.record_batch([pa.array([ids[i] for i in old], pa.int64()), pa.array([classes[i] for i in old], pa.int64()), *(pa.nulls(len(old), k) for k in kinds)], names=names)
            if new:
                h, counts = hasher([words[i] for i in new])
                values = (np.ascontiguousarray(sketches_of(h, counts).T), *keys_of(h, counts))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1))) for x in values]
                yield pa.record_batch([pa.array([ids[i] for i in new], pa.int64()), pa.array([classes[i] for i in new], pa.int64()), *lists], names=names)

    return texts.select("id", "text").mapInArrow(run, "id bigint, class bigint, sketch array<bigint>, upper array<int>, lower array<smallint>")


def _layout(words: int) -> tuple[int, int]:
    """Words a plane and least agreement of sketches of so many words (one word: 64 values of one bit)."""
    return (1, least(1, 64)) if words == 1 else (WORDS, least(words // WORDS))


def _close(a: list[tuple[int, ...]], b: list[tuple[int, ...]] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (smaller class first) within ``a``, or between ``a`` and ``b``, of (class, words of the sketch), whose sketches agree."""
    if not a or (b is None and len(a) < 2):
        return
    step, floor = _LAYOUTS[len(a[0]) - 1]
    most = 64 * step - floor
    if b is None and len(a) <= 5:
        for i, x in enumerate(a):
            for y in a[:i]:
                if x[0] != y[0]:
                    apart = 0
                    for w in range(1, step + 1):
                        z = 0
                        for k in range(w, len(x), step):
                            z |= x[k] ^ y[k]
                        apart += (z & 0xFFFFFFFFFFFFFFFF).bit_count()
                    if apart <= most:
                        yield (x[0], y[0]) if x[0] < y[0] else (y[0], x[0])
        return
    x = np.array(a, np.int64)
    y = x if b is None else np.array(b, np.int64)
    rows = max(1, 50_000 // len(y))
    for at in range(0, len(x), rows):
        start = at if b is None else 0
        apart = np.zeros((min(rows, len(x) - at), len(y) - start), np.int64)
        for w in range(1, step + 1):
            z = np.zeros(apart.shape, np.int64)
            for k in range(w, x.shape[1], step):
                z |= x[at : at + rows, None, k] ^ y[None, start:, k]
            apart += np.bitwise_count(z.view(np.uint64))
        i, j = np.nonzero(apart <= most)
        if b is None:
            i, j = i[j > i], j[j > i]
        for c, d in zip(x[i + at, 0].tolist(), y[j + start, 0].tolist(), strict=True):
            if c != d:
                yield (c, d) if c < d else (d, c)


_LAYOUTS = {n: _layout(n) for n in (1, WALK_PLANES * WORDS)}
FOUND = "a bigint, b bigint, node bigint, block bigint, packed binary"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of sorted keys with class and sketch in; candidate pairs out, and blocks of nodes.

    Blocks are written of deep nodes larger than ``BLOCK``, and of the nodes at both ends of the range, deep and (while
    small) shallow, since they may go on in the neighbouring ranges.  A shallow node's number is negative.
    """
    shift = BITS * (DEEPEST - SHALLOW)
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    sent: set[tuple[int, int]] = set()
    out: list[tuple] = []
    head: list[tuple[int, ...]] = []  # members of the shallow node, while it is small
    deep: list[tuple[int, ...]] = []  # members of the node at the deepest level
    shallow_key = deep_key = None
    small, cut_up, first_deep, first_shallow = True, False, True, True
    keys: list[int] = []

    def emit(pairs: Iterable[tuple[int, int]]) -> None:
        for p in pairs:
            if p not in sent:
                if len(sent) > 300_000:
                    sent.clear()
                sent.add(p)
                out.append((*p, None, None, None))

    def block(node: int, rows: list[tuple[int, ...]]) -> None:
        nonlocal number
        if rows:
            out.append((None, None, node, number, np.array(rows, np.int64).tobytes()))
            number += 1

    def end_deep(last: bool = False) -> None:
        nonlocal cut_up, first_deep
        if deep_key is not None:
            if cut_up or first_deep or last:
                block(deep_key, deep)
            elif not small:
                emit(_close(deep))
            first_deep = False
        cut_up = False
        deep.clear()

    def end_shallow(last: bool = False) -> None:
        nonlocal first_shallow
        if shallow_key is not None:
            if small and (first_shallow or last):
                block(-shallow_key - 1, head)
            elif small:
                emit(_close(head))
            first_shallow = False
        head.clear()
        keys.clear()

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["a", "b", "node", "block", "packed"])
        out.clear()
        return batch

    for batch in batches:
        if batch.num_rows > 2:  # members of a node stand side by side: whoever stands alone has no pairs
            node = batch.column(0).to_numpy() >> shift
            near = node[1:] == node[:-1]
            batch = batch.filter(pa.array(np.concatenate(([True], near[:-1] | near[1:], [True]))))
        for key, *rest in zip(*(c.to_numpy().tolist() for c in batch.columns), strict=True):
            member = tuple(rest)
            if key == deep_key and deep and deep[-1][0] == member[0]:
                continue  # a copy from another task
            if key >> shift != shallow_key:
                end_deep()
                end_shallow()
                shallow_key, deep_key, small = key >> shift, key, True
            elif key != deep_key:
                end_deep()
                deep_key = key
            deep.append(member)
            if small:
                head.append(member)
                keys.append(key)
                if len(head) > SMALL:  # too dense here: the prefix has to be longer
                    small = False
                    start = 0
                    # the parts that ended while the node looked small
                    for i in range(1, len(head) + 1):
                        if i == len(head) or keys[i] != keys[start]:
                            if keys[start] != deep_key:
                                emit(_close(head[start:i]))
                            start = i
                    head.clear()
                    keys.clear()
                else:
                    continue
            if len(deep) >= BLOCK:
                block(deep_key, deep)
                cut_up = True
                deep.clear()
        if len(out) >= 10_000:
            yield flush()
    end_deep(True)
    end_shallow(True)
    if out:
        yield flush()


def _unpacked(packed: bytes) -> list[tuple[int, ...]]:
    return [tuple(r) for r in np.frombuffer(packed, np.int64).reshape(-1, 1 + WALK_PLANES * WORDS).tolist()]


def between_blocks(found: DataFrame) -> DataFrame:
    """Pairs within and between the blocks of each node, one row per pair of blocks, spread by node and block."""
    big = found.where("node is not null")
    w = Window.partitionBy("node")
    # numbers of few bytes per block; the blocks themselves are joined to them
    named = cut(big.select("node", "block").withColumns({"nth": F.row_number().over(w.orderBy("block")), "of": F.count("*").over(w)}))
    blocks = big.select("node", "block", "packed").join(named, ["node", "block"]).select("node", "nth", "packed")
    both = named.select("node", F.col("nth").alias("i"), F.explode(F.sequence("nth", F.col("of").cast("int"))).alias("j"))
    left = blocks.withColumnsRenamed({"nth": "i", "packed": "x"})
    right = blocks.withColumnsRenamed({"nth": "j", "packed": "y"})
    tasks = both.join(left, ["node", "i"]).join(right, ["node", "j"]).select("x", "y", F.expr("i = j").alias("same"))

    def make() -> Callable[..., Iterable[tuple]]:
        return lambda x, y, same: _close(_unpacked(x), None if same else _unpacked(y))

    return map_rows(tasks, make, "a bigint, b bigint")


def candidates(sig: DataFrame) -> DataFrame:
    """Distinct pairs of classes that share a node and whose sketches agree: a < b."""
    words = [F.col("sketch")[i].alias(f"w{i}") for i in range(WALK_PLANES * WORDS)]
    # the tree's number, then DEEPEST levels
    key = F.expr(f"shiftleft(cast(tree as bigint), {BITS * DEEPEST}) | shiftleft(cast(top as bigint) & 4294967295, {BITS}) | (cast(lower[tree] as bigint) & 65535)")
    keyed = sig.where("upper is not null").select(F.posexplode("upper").alias("tree", "top"), "lower", "class", "sketch").select(key.alias("key"), "class", *words)
    found = keyed.repartitionByRange(shuffle_width(sig.sparkSession), "key", "class").sortWithinPartitions("key", "class").mapInArrow(_walk, FOUND)
    found = cut(found)
    return found.where("node is null").select("a", "b").unionByName(between_blocks(found)).distinct()


def members(sig: DataFrame) -> DataFrame:
    """id, class, first (the smallest id of the class) and size of every row with sequences."""
    heads = sig.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    return sig.select("id", "class").join(heads, "class")


def links(texts: DataFrame, sig: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified pairs of classes, by the ids of their first rows: a < b, with their similarity."""
    heads = sig.groupBy("class").agg(F.min("id").alias("first"), F.first("sketch", ignorenulls=True).alias("sketch"))
    found = candidates(sig)
    named = found.join(heads.withColumnsRenamed({"class": "a", "first": "first_a", "sketch": "x"}), "a").join(heads.withColumnsRenamed({"class": "b", "first": "first_b", "sketch": "y"}), "b")
    apart = reduce(lambda p, q: p + q, [F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), [F.col("x")[i].bitwiseXOR(F.col("y")[i]) for i in range(w, PLANES * WORDS, WORDS)])) for w in range(WORDS)])
    named = named.where(apart <= FUNCTIONS - least(PLANES)).select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    one = named.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    both = one.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")

    def make() -> Callable[..., Iterable[tuple]]:
        kept: dict[int, set] = {}  # rows come sorted by b, so its sequences serve again

        def of(rid: int, text: str) -> set:
            got = kept.get(rid)
            if got is None:
                if len(kept) >= 64:
                    kept.clear()
                got = kept[rid] = sequences(words_of(text))
            return got

        def each(a: int, b: int, x: str, y: str) -> Iterable[tuple]:
            p, q = of(a, x), of(b, y)
            shared = len(p & q)
            s = shared / (len(p) + len(q) - shared)
            return [(a, b, s)] if s >= threshold else ()

        return each

    return map_rows(both, make, "a bigint, b bigint, similarity double")


def pairs(linked: DataFrame, member: DataFrame, expand: int = 32) -> DataFrame:
    """id_a < id_b of all similar rows; see the module's text on classes of more than ``expand`` rows."""
    small = member.where(F.col("size") <= expand)
    stand = member.where((F.col("size") <= expand) | (F.col("id") == F.col("first"))).select("first", "id")
    x, y = small.where("size > 1").alias("x"), small.where("size > 1").alias("y")
    copies = x.join(y, F.expr("x.first = y.first and x.id < y.id")).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    star = member.where((F.col("size") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    across = (
        linked.select("a", "b")
        .join(stand.withColumnsRenamed({"first": "a", "id": "p"}), "a")
        .join(stand.withColumnsRenamed({"first": "b", "id": "q"}), "b")
        .select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    )
    return copies.unionByName(star).unionByName(across)


def shared_with(linked: DataFrame, member: DataFrame, kin: DataFrame, of: DataFrame) -> DataFrame:
    """session_id, forked_from_id, exchanges, linked of each fork: how many of its rows are similar to one of its parent's.

    ``kin`` (session_id, forked_from_id), ``of`` (id, session_id).  Rows meet over their classes, so copies cost nothing.
    """
    mine = member.select("id", "first").join(of.where("session_id is not null").select("id", "session_id"), "id")
    near = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(member.select(F.col("first").alias("a"), F.col("first").alias("b")).distinct())
    fork = mine.join(kin, "session_id").select("session_id", "forked_from_id", "id", F.col("first").alias("a"))
    theirs = mine.select(F.col("session_id").alias("forked_from_id"), F.col("first").alias("b")).distinct()
    hit = fork.join(near, "a").join(theirs, ["forked_from_id", "b"], "left_semi").select("session_id", "forked_from_id", "id").distinct()
    counted = fork.groupBy("session_id", "forked_from_id").agg(F.count("*").alias("exchanges"))
    found = hit.groupBy("session_id", "forked_from_id").agg(F.count("*").alias("linked"))
    return counted.join(found, ["session_id", "forked_from_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(0)).cast("long"))


def groups(linked: DataFrame, member: DataFrame) -> DataFrame:
    """id, class_id, group_id (the smallest id it is linked to over any number of links) and its class's links.

    Components by hooking to the smallest neighbour and pointer jumping; each round is written, and the
    number of rounds follows the logarithm of a component's diameter.
    """
    edges = cut(linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = edges.groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "first")
    label = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "v"))
    while True:
        near = edges.join(label.withColumnsRenamed({"v": "b", "root": "r"}), "b").groupBy(F.col("a").alias("v")).agg(F.min("r").alias("near"))
        hooked = label.join(near, "v", "left").select("v", F.least("root", F.coalesce("near", "root")).alias("mid"), F.col("root").alias("old"))
        jump = hooked.join(label.withColumnsRenamed({"v": "mid", "root": "far"}), "mid", "left").select("v", F.least("mid", F.coalesce("far", "mid")).alias("root"), "old")
        jump = cut(jump)
        label = jump.select("v", "root")
        if jump.where("root <> old").isEmpty():
            break
    named = label.withColumnsRenamed({"v": "first", "root": "group_id"})
    out = member.join(named, "first", "left").join(degree, "first", "left")
    return out.select("id", F.col("first").alias("class_id"), F.coalesce("group_id", "first").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.col("size").alias("copies"))


def joined(*columns: str) -> Column:
    """The text of several columns, null as empty, with a blank between."""
    return reduce(lambda x, y: F.concat(x, F.lit(" "), y), [F.coalesce(c, F.lit("")) for c in columns])
