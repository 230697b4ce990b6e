"""Deeply nested records as related flat tables, with Merkle identities.

Every object (and array) of a JSON text is canonicalised and hashed bottom-up: its identity is the hash
of its sorted members, nested ones standing for themselves by their identity.  Equal subtrees thus share one
identity, wherever they occur.  Three flat tables come out:

``occurrences``  one row per object of every physical row: row key, path, its identity, the path of its parent
                 object, the member that holds it and its ordinal in the array (null outside arrays);
``nodes``        each distinct object once: identity and canonical scalars as JSON;
``bridge``       each distinct parent-child link once: parent identity, member, ordinals, child identity.

Occurrences come from one pass without a shuffle; nodes and bridge rows are deduplicated inside each task
before they are shuffled by identity.

Defined results: null or invalid JSON gives no rows; strings are leaves, even when they hold JSON; of equal
names in one object the last counts; nesting of any depth is walked without recursion; other columns of the
input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.functions.jsontext import loads

OCCURRENCES = "tbl string, row_id bigint, path string, parent_path string, member string, ordinal bigint, in_array boolean, node_id binary"
_ARROW = [("tbl", pa.string()), ("row_id", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()), ("member", pa.string()), ("ordinal", pa.int64()), ("in_array", pa.bool_()), ("node_id", pa.binary())]
PARTS = "what string, id binary, other binary, member string, ordinals string, body string"


def _hash(kind: bytes, text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, person=kind).digest()


def walk(root: object, base: str) -> tuple[list[tuple], dict[bytes, tuple[str, list[tuple]]]]:
    """Occurrences (path, parent path, member, ordinal, in array, identity) and distinct nodes of one value.

    A node is (canonical scalars, [(member, ordinals, child identity)]).  Arrays keep the place of their
    objects in ``ordinals``, the indexes joined by a comma; the canonical text keeps the empty places.
    """
    found: list[list] = []
    if type(root) is dict:
        found.append([base, None, None, None, False, root, None])
    # top-down: list all objects; bottom-up: hash them in reverse, so that children come first
    nodes: dict[bytes, tuple[str, list[tuple]]] = {}
    at = 0
    lists: list[tuple] = [(root, base, None, "", "")] if type(root) is list else []
    kids: list[list[tuple]] = [[]] if found else []
    while at < len(found) or lists:
        if lists:
            values, path, parent, member, ordinals = lists.pop()
            for i, v in enumerate(values):
                if type(v) is dict:
                    found.append([f"{path}[{i}]", None if parent is None else found[parent][0], member or None, i, True, v, None])
                    kids.append([])
                    if parent is not None:
                        kids[parent].append((member, f"{ordinals}{i}", len(found) - 1))
                elif type(v) is list:
                    lists.append((v, f"{path}[{i}]", parent, member, f"{ordinals}{i},"))
            continue
        path, value = found[at][0], found[at][5]
        for k, v in value.items():
            if type(v) is dict:
                found.append([f"{path}.{k}", path, k, None, False, v, None])
                kids.append([])
                kids[at].append((k, "", len(found) - 1))
            elif type(v) is list:
                lists.append((v, f"{path}.{k}", at, k, ""))
        at += 1
    for i in range(len(found) - 1, -1, -1):
        links = [(m, o, found[c][6]) for m, o, c in kids[i]]
        body = json.dumps({k: _bare(v) for k, v in found[i][5].items()}, sort_keys=True, separators=(",", ":"))
        links.sort()
        found[i][6] = ident = _hash(b"object", body + "".join(f"\0{m}\0{o}\0{c.hex()}" for m, o, c in links))
        nodes[ident] = (body, links)
    return [(p, q, m, o, a, h) for p, q, m, o, a, _, h in found], nodes


def _bare(v: object) -> object:
    """``v`` with an empty object in each object's place."""
    if type(v) is dict:
        return {}
    if type(v) is not list:
        return v
    out: list = []
    todo = [(v, out)]
    while todo:
        source, target = todo.pop()
        for x in source:
            if type(x) is list:
                target.append(inner := [])
                todo.append((x, inner))
            else:
                target.append({} if type(x) is dict else x)
    return out


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def occurrences(records: DataFrame, tbl: str, key: str, column: str, beside: str = "") -> DataFrame:
    """One row per object in ``column`` (JSON text) of every row of ``records``; see the module's text.

    ``beside``: further columns of the row to give with each object, as "name type, name type" of bigint and string columns.
    """
    more = [x.split() for x in beside.split(", ")] if beside else []
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    arrow = pa.schema([*_ARROW, *[(n, kinds[k]) for n, k in more]])
    picked = [F.col(n).cast(k) for n, k in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in arrow]
            size = 0
            for rid, text, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None or "{" not in text:
                    continue
                try:
                    value = loads(text)
                except ValueError:
                    continue
                for row in walk(value, column)[0]:
                    for c, x in zip(out, (tbl, rid, *row, *rest), strict=True):
                        c.append(x)
                    size += 1
                if size >= 20_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
                    out, size = [[] for _ in arrow], 0
            if size:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return records.select(F.col(key).cast("long"), F.col(column), *picked).mapInArrow(run, ", ".join([OCCURRENCES, *([beside] if beside else [])]))


def _parts(records: DataFrame, column: str) -> DataFrame:
    """Distinct nodes and links of each task; a bounded set of those already sent keeps repeats home."""
    arrow = pa.schema([("what", pa.string()), ("id", pa.binary()), ("other", pa.binary()), ("member", pa.string()), ("ordinals", pa.string()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(0).to_pylist():
                if text is None or "{" not in text:
                    continue
                try:
                    value = loads(text)
                except ValueError:
                    continue
                for ident, (body, links) in walk(value, column)[1].items():
                    if ident in sent:
                        continue
                    if len(sent) >= 200_000:
                        sent.clear()  # the shuffle below deduplicates whatever is sent twice
                    sent.add(ident)
                    out.append(("node", ident, None, None, None, body))
                    out += [("link", ident, c, m, o, None) for m, o, c in links]
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return records.select(column).mapInArrow(run, PARTS)


def nodes(records: DataFrame, column: str) -> DataFrame:
    """Each distinct object once: node_id, body (canonical JSON; nested objects stand as {})."""
    return _parts(records, column).where("what = 'node'").groupBy(F.col("id").alias("node_id")).agg(F.first("body").alias("body"))


def bridge(records: DataFrame, column: str) -> DataFrame:
    """Each distinct parent-child link once: parent_id, member, ordinals (indexes in nested arrays), child_id."""
    return _parts(records, column).where("what = 'link'").select(F.col("id").alias("parent_id"), "member", "ordinals", F.col("other").alias("child_id")).distinct()
