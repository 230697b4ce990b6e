"""Searching, reading and health over one set of tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.text import base_path, first_chars, one_line
from braidlog.functions.timefn import local_day, midnight_millis, strict_day
from braidlog.operators import fusion, reading
from braidlog.operators import vectors as vec
from braidlog.operators.index import TextIndex

MOST, DEEP, CONCEPTS = 50, 300, 5


@dataclass
class Answer:
    """Hits, best first, and how they came about."""

    hits: DataFrame
    vector_used: bool
    notes: list[str] = field(default_factory=list)


def checked_queries(query: str | Sequence[str]) -> list[str]:
    """One query, or two to five concepts; blanks are refused."""
    if isinstance(query, str):
        if not query.strip():
            raise ValueError("the query is blank")
        return [query]
    if not 2 <= len(query) <= CONCEPTS or any(not isinstance(q, str) or not q.strip() for q in query):
        raise ValueError("an array query has two to five concepts, none blank")
    return list(query)


def checked_limit(limit: object) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise ValueError("the limit is a whole number")
    return min(max(limit, 1), MOST)


def chosen(project: str | None = None, after: str | date | None = None, before: str | date | None = None, zone: str = "UTC") -> Column:
    """Filter on project and days (both included, in a zone); it reaches the scan of whatever has ``project`` and ``ts``."""
    day = lambda x: strict_day(x) if isinstance(x, str) else x
    keep = F.lit(True)
    if project is not None:
        if not project:
            raise ValueError("the project is empty")
        keep = keep & (F.col("project") == project)
    if after is not None:
        keep = keep & (F.col("ts") >= midnight_millis(day(after), zone))
    if before is not None:
        keep = keep & (F.col("ts") < midnight_millis(day(before) + timedelta(days=1), zone))
    return keep


@dataclass
class Engine:
    """``exchanges`` as in the index; ``vectors`` (id, embedding, project, ts, is_sidechain), if any.

    ``index`` is the kept text index of user and assistant messages (``TextIndex.write(engine.texts(), path)``); without one the
    texts are read for each search.  ``embed_query`` turns a text into a vector, once per query; if it fails, the search
    goes on with keywords alone.
    """

    exchanges: DataFrame
    vectors: DataFrame | None = None
    embed_query: Callable[[str], Sequence[float]] | None = None
    floor: float = vec.FLOOR
    zone: str = "UTC"
    index: TextIndex | None = None

    def texts(self) -> DataFrame:
        """What the text index is built from: both messages, not the tools."""
        return self.exchanges.select("id", "project", "ts", F.concat_ws("\n", "user_message", "assistant_message").alias("text"))

    def _index(self) -> TextIndex:
        if self.index is None:
            self.index = TextIndex.of(self.texts())
        return self.index

    def _ranked(self, query: str, n: int, keep: Column, exclude: str | None, vector: Sequence[float] | None) -> tuple[DataFrame, bool]:
        """id, raw, kw of one concept, before the cut."""
        # the index has figures of the whole corpus; filters only choose candidates
        keyword = self._index().best(query, n, keep)
        near = None
        if vector is not None:
            near = vec.nearest(self.vectors.where(keep).select("id", "embedding"), vector, n)
            near = fusion.floored(near, keyword, self.floor)
        facts = self.exchanges.select("id", "session_id", "archive_path", "is_sidechain")
        if exclude is not None:
            keyword = fusion.ranked_again(fusion.without_session(keyword, self.exchanges, exclude), "score")
            near = None if near is None else fusion.ranked_again(fusion.without_session(near, self.exchanges, exclude), "cos")
        merged = fusion.fused(keyword, near).join(facts, "id")
        return fusion.penalised(merged), near is not None

    def search(
        self, query: str | Sequence[str], limit: int = 10, after: str | date | None = None, before: str | date | None = None, project: str | None = None, exclude_session: str | None = None
    ) -> Answer:
        """The best exchanges; of several concepts, those of conversations that all of them hit."""
        queries, limit, keep = checked_queries(query), checked_limit(limit), chosen(project, after, before, self.zone)
        if any(not any(c.isalnum() for c in q) for q in queries):
            return Answer(self._cards(self.exchanges.where(F.lit(False)).select("id", F.lit(0.0).alias("raw"), F.lit(False).alias("kw"))), False)
        notes: list[str] = []
        embedded: list[Sequence[float] | None] = [None] * len(queries)
        if self.vectors is not None and self.embed_query is not None:
            try:
                embedded = [self.embed_query(q) for q in queries]
            except Exception as e:  # a broken model must not break the search
                notes.append(f"keywords only: {e}")
        else:
            notes.append("keywords only")
        if len(queries) == 1:
            ranked, used = self._ranked(queries[0], max(50, 3 * limit), keep, exclude_session, embedded[0])
            best = ranked.select("id", "raw", "kw")
        else:
            parts = []
            for i, q in enumerate(queries):
                ranked, used = self._ranked(q, DEEP, keep, exclude_session, embedded[i])
                cut = ranked.orderBy(F.desc("raw"), F.desc("id")).limit(2 * DEEP)
                parts.append(cut.select(F.lit(i).alias("concept"), "archive_path", "id", "raw", "kw"))
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            best = fusion.all_concepts(every, len(queries)).select("id", "raw", "kw")
        return Answer(self._cards(best.orderBy(F.desc("raw"), F.desc("id")).limit(limit)), used, notes)

    def _cards(self, best: DataFrame) -> DataFrame:
        """Texts are read only for the winners."""
        hit = best.join(self.exchanges, "id")
        return hit.select(
            F.col("id").alias("exchange_id"), "project", "ts", fusion.scaled(F.col("raw")).alias("score"), first_chars(F.col("user_message"), 200).alias("user_snippet"),
            first_chars(F.col("assistant_message"), 200).alias("assistant_snippet"), "archive_path", "line_start", "line_end", F.col("kw").alias("keyword_match"),
        ).orderBy(F.desc("score"), F.desc("exchange_id"))

    def cards(self, answer: Answer) -> DataFrame:
        """Hits as short texts."""
        n = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("exchange_id")))  # at most MOST rows
        place = F.concat(F.col("archive_path"), F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
        return answer.hits.select(
            F.format_string("%d. [%s, %s, score %.2f]\n   User: %s\n   Assistant: %s\n   %s", n, "project", local_day(F.col("ts"), self.zone), "score", one_line(F.col("user_snippet")), one_line(F.coalesce("assistant_snippet", F.lit(""))), place).alias("card")
        )

    def search_many(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """Keyword search for many queries (query_id, query) in one job: query_id, id, score, rank."""
        return self._index().best_of_many(queries, checked_limit(limit))

    @staticmethod
    def read(items: DataFrame, path: str, start: int | None = None, end: int | None = None, skipped: DataFrame | None = None, kinds: Sequence[str] | None = None, registry: bool = True) -> DataFrame:
        """One page of a file as text; files that opted out, in any generation, are refused.

        ``skipped`` (archive_path) lists the files that opted out; where there is a registry of files and it can't be given, nothing
        is read.  ``registry=False`` says that there is none.  ``kinds``: the folders below the archive's root that may be read.
        """
        parts = path.split("/")
        if path.startswith("/") or any(p in ("", ".", "..") for p in parts) or "\\" in path:
            raise ValueError("path outside archive")
        if kinds is not None and parts[1 if parts[0] == "conversation-archive" else 0] not in kinds:
            raise ValueError("path of an unknown kind")
        if skipped is None and registry:
            raise PermissionError("without the list of files that opted out nothing is read")
        if skipped is not None and not skipped.where(base_path(F.col("archive_path")) == base_path(F.lit(path))).isEmpty():
            raise PermissionError("the conversation opted out")
        return reading.page_text(reading.pages(items.where(F.col("archive_path") == path), start or 1, end))
