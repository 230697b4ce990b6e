"""One query per operator of the retrieval engine, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.functions import text as tx
from braidlog.functions.timefn import local_day
from braidlog.operators import catalog, fulltext, fusion, reading, vectors
from braidlog.operators import exchanges as ex
from braidlog.operators import providers as pv
from braidlog.plans import views as v
from braidlog.search import chosen
from braidlog.session import shared_path
from braidlog.sources.tables import table

Spark = SparkSession
#: Parameters of the queries over the test tables.
QUERY, CONCEPTS, FLOOR, VEC, DEPTH, LIMIT = "cursor checkpoint restart vector", ["cursor position", "posting list"], 0.3, 0, 50, 10
AFTER, BEFORE, ZONE = "2025-02-01", "2025-06-30", "America/Sao_Paulo"
MARK, ROOT = "similarity floor", "conversation-archive/"


# ---- folding --------------------------------------------------------------------------------------


def _facts_a(s: Spark, d: str) -> DataFrame:
    return pv.facts_a(pv.parsed(v.raw_a(s, d)))


def _folded_a(s: Spark, d: str) -> DataFrame:
    return ex.folded(_facts_a(s, d))


def _tools(df: DataFrame) -> DataFrame:
    return df.withColumn("tools", F.array_join("tool_names", ","))


def exchange_fold(s: Spark, d: str) -> DataFrame:
    return _tools(ex.answered(_folded_a(s, d))).select("archive_path", "line_start", "line_end", "user_message", "assistant_message", "tools")


def exchange_drop_unanswered(s: Spark, d: str) -> DataFrame:
    df = _folded_a(s, d)
    return df.where((F.col("assistant_message") == "") & (F.size("tool_names") == 0)).select("archive_path", "line_start", "line_end", "user_message")


def exchange_tools_ordered_distinct(s: Spark, d: str) -> DataFrame:
    return _tools(_folded_a(s, d)).where("tools <> ''").select("archive_path", "line_start", "tools")


def exchange_fold_b(s: Spark, d: str) -> DataFrame:
    lines = pv.parsed(v.raw_b(s, d))
    return _tools(ex.answered(ex.folded(pv.facts_b(lines, pv.meta_b(lines))))).select("archive_path", "line_start", "line_end", "user_message", "assistant_message", "tools")


def index_build(s: Spark, d: str) -> DataFrame:
    """The index of both providers: ids, file facts, opt-outs and oversize applied."""
    facts = _facts_a(s, d)
    lines = pv.parsed(v.raw_b(s, d))
    meta = pv.meta_b(lines)
    a = ex.indexed(ex.folded(facts), pv.meta_a(facts), "claude", MARK)
    b = ex.indexed(ex.folded(pv.facts_b(lines, meta)), meta, "codex", MARK)
    return ex.numbered(a.unionByName(b)).select("id", "archive_path", "line_start", "session_id", "project", "harness", "is_sidechain")


def resume_point(s: Spark, d: str) -> DataFrame:
    return ex.resume_points(_folded_a(s, d))


def line_byte_offsets(s: Spark, d: str) -> DataFrame:
    rows = v.once(table(s, d, "claude").select("archive_path", "line", "row_id", "content"))
    return ex.byte_starts(rows, "content").select("archive_path", "line", "byte_start")


def file_meta_first_nonnull(s: Spark, d: str) -> DataFrame:
    return pv.meta_a(_facts_a(s, d)).select("archive_path", "session_id", "cwd", "is_sidechain")


def signal_max_rank(s: Spark, d: str) -> DataFrame:
    return pv.meta_b(pv.parsed(v.raw_b(s, d))).select("archive_path", F.col("signal").cast("long").alias("signal"), "session_id")


def bad_lines_per_file(s: Spark, d: str) -> DataFrame:
    return _facts_a(s, d).groupBy("archive_path").agg(F.count_if("is_bad").alias("bad_lines")).where("bad_lines > 0")


def sync_stats(s: Spark, d: str) -> DataFrame:
    return catalog.observed(ex.answered(_folded_a(s, d)))


def streaming_exchanges(s: Spark, d: str) -> DataFrame:
    """Lines replayed through a stream into a table; folding that table must give ``exchange_fold``."""
    work = shared_path(s, "stream")
    v.raw_a(s, d).write.mode("overwrite").parquet(f"{work}/in")
    src = s.readStream.schema("archive_path string, line bigint, raw string").option("maxFilesPerTrigger", 4).parquet(f"{work}/in")
    src.writeStream.format("parquet").option("path", f"{work}/lines").option("checkpointLocation", f"{work}/cp").trigger(availableNow=True).start().awaitTermination()
    lines = s.read.schema("archive_path string, line bigint, raw string").parquet(f"{work}/lines")
    return _tools(ex.answered(ex.folded(pv.facts_a(pv.parsed(lines))))).select("archive_path", "line_start", "line_end", "user_message", "assistant_message", "tools")


# ---- filters --------------------------------------------------------------------------------------


def filter_project_date(s: Spark, d: str) -> DataFrame:
    return table(s, d, "exchanges").where(chosen("birch-cache", AFTER, BEFORE, ZONE)).select("id", "project", "ts")


def exclude_session(s: Spark, d: str) -> DataFrame:
    """The newest exchanges without those of the session of the newest one."""
    t = table(s, d, "exchanges").select("id", "session_id", "ts")
    mine = t.where(F.col("session_id").isNotNull()).orderBy(F.desc("ts"), "id").first()
    return fusion.without_session(t.orderBy(F.desc("ts"), "id").limit(DEPTH), t, mine["session_id"] if mine else None).select("id", "session_id")


def opt_out_purge(s: Spark, d: str) -> DataFrame:
    return ex.purged(table(s, d, "exchanges").select("id", "archive_path", "user_message"), MARK).select("id", "archive_path")


def oversize_drop(s: Spark, d: str) -> DataFrame:
    return table(s, d, "exchanges").where(~ex.fits(8192)).select("id", F.octet_length("user_message").cast("long").alias("n_bytes"))


# ---- tokens and full text -------------------------------------------------------------------------


def _words(s: Spark, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), tx.tokens(F.col("text")).alias("ws"))


def tokenize(s: Spark, d: str) -> DataFrame:
    ws = F.col("ws")
    return _words(s, d).select("id", F.size(ws).cast("long").alias("n_tokens"), F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"), F.try_element_at(ws, F.lit(1)).alias("first_token"), F.md5(F.array_join(ws, " ")).alias("digest"))


def hangul_bigrams(s: Spark, d: str) -> DataFrame:
    df = table(s, d, "documents").where(F.col("text").rlike("[가-힣]"))
    return df.select(F.col("doc_id").alias("id"), F.md5(tx.hangul_terms(F.col("text"))).alias("digest"))


def strip_diacritics_tokens(s: Spark, d: str) -> DataFrame:
    """Folded tokens of whole texts in all languages; without SQL, as DuckDB folds other letters too."""
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.array_join(tx.tokens(tx.fold_marks(F.col("text")), hangul=False), " ")).alias("digest"))


def token_df(s: Spark, d: str) -> DataFrame:
    return fulltext.frequencies(table(s, d, "documents"), key="doc_id")


def prune_common_tokens(s: Spark, d: str) -> DataFrame:
    return fulltext.common(table(s, d, "documents"), key="doc_id")


def prefix_match(s: Spark, d: str) -> DataFrame:
    return fulltext.beginning_with(table(s, d, "documents"), "che", key="doc_id")


def text_index_build(s: Spark, d: str) -> DataFrame:
    """The kept index of all documents (built once per application): each term with its number of texts."""
    return v.text_index(s, d).terms


def _keyword(s: Spark, d: str, n: int = DEPTH, keep: Column | None = None, query: str = QUERY) -> DataFrame:
    return v.text_index(s, d).best(query, n, keep)


def bm25_topk(s: Spark, d: str) -> DataFrame:
    return _keyword(s, d).withColumn("rank", F.col("rank").cast("long"))


def bm25_filtered(s: Spark, d: str) -> DataFrame:
    return _keyword(s, d, keep=F.col("project") == "birch-cache").withColumn("rank", F.col("rank").cast("long"))


def porter_bm25(s: Spark, d: str) -> DataFrame:
    """As bm25_topk, by the index with folded marks and stems; without SQL, as DuckDB has no stemmer here."""
    return v.text_index(s, d, True).best(QUERY, DEPTH).withColumn("rank", F.col("rank").cast("long"))


def keyword_only_search(s: Spark, d: str) -> DataFrame:
    hit = fusion.penalised(fusion.fused(_keyword(s, d), None).join(v.docs(s, d).select("id", "is_sidechain"), "id"))
    return hit.select("id", F.round(fusion.scaled(F.col("raw")), 9).alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(LIMIT)


def search_many(s: Spark, d: str) -> DataFrame:
    """The test items whose id is divisible by 20 as queries against all documents, in one job."""
    items = table(s, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return v.text_index(s, d).best_of_many(items, 5).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


# ---- vectors and fusion ---------------------------------------------------------------------------


def _near(s: Spark, d: str, n: int = DEPTH, keep=None) -> DataFrame:
    t = v.vecs(s, d)
    return vectors.nearest((t if keep is None else t.where(keep)).select("id", "embedding"), v.vector_of(s, d, VEC), n)


def knn_topk(s: Spark, d: str) -> DataFrame:
    return _near(s, d).select("id", "cos", F.col("rank").cast("long").alias("rank"))


def knn_filtered(s: Spark, d: str) -> DataFrame:
    return _near(s, d, keep=F.col("project") == "label_3").select("id", "cos", F.col("rank").cast("long").alias("rank"))


def knn_many(s: Spark, d: str) -> DataFrame:
    """The ten nearest of all vectors to each vector whose id is divisible by 20."""
    t = v.vecs(s, d)
    return vectors.nearest_of_many(t, t.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), LIMIT).withColumn("rank", F.col("rank").cast("long"))


def knn_floor_or_keyword(s: Spark, d: str) -> DataFrame:
    return fusion.floored(_near(s, d, 300), _keyword(s, d), FLOOR).select("id", "cos", F.col("rank").cast("long").alias("rank"))


def vector_only_search(s: Spark, d: str) -> DataFrame:
    near = _near(s, d).where(F.col("cos") >= FLOOR)
    return fusion.fused(None, near).select("id", F.round(fusion.scaled(F.col("raw")), 9).alias("score"))


def rrf_fusion(s: Spark, d: str) -> DataFrame:
    return fusion.fused(_keyword(s, d), _near(s, d)).select("id", F.round("raw", 9).alias("raw"), "kw")


def rrf_sidechain_penalty(s: Spark, d: str) -> DataFrame:
    hit = fusion.penalised(fusion.fused(_keyword(s, d), _near(s, d)).join(v.docs(s, d).select("id", "is_sidechain"), "id"))
    return hit.select("id", F.round("raw", 9).alias("raw"), "is_sidechain")


def hybrid_search(s: Spark, d: str) -> DataFrame:
    """Keywords and vectors, floor, fusion, penalty, scale, snippets of the winners."""
    keyword = _keyword(s, d)
    near = fusion.floored(_near(s, d), keyword, FLOOR)
    t = v.docs(s, d)
    best = fusion.penalised(fusion.fused(keyword, near).join(t.select("id", "is_sidechain"), "id")).orderBy(F.desc("raw"), F.desc("id")).limit(LIMIT)
    hit = best.select("id", "raw", "kw").join(t.select("id", "project", "ts", "archive_path", "text"), "id")
    return hit.select("id", "project", "ts", "archive_path", F.round(fusion.scaled(F.col("raw")), 9).alias("score"), tx.first_chars(F.col("text"), 200).alias("snippet"), "kw")


def multi_concept_and(s: Spark, d: str) -> DataFrame:
    """Conversations that both concepts hit, by keywords or by vectors."""
    parts = None
    t = v.docs(s, d).select("id", "archive_path", "is_sidechain")
    for i, c in enumerate(CONCEPTS):
        keyword = _keyword(s, d, 300, query=c)
        near = fusion.floored(vectors.nearest(v.vecs(s, d).select("id", "embedding"), v.vector_of(s, d, i), 300), keyword, FLOOR)
        one = fusion.penalised(fusion.fused(keyword, near).join(t, "id")).select(F.lit(i).alias("concept"), "archive_path", "id", "raw", "kw")
        parts = one if parts is None else parts.unionByName(one)
    best = fusion.all_concepts(parts, len(CONCEPTS))
    return best.select("archive_path", "id", F.round(fusion.scaled(F.col("raw")), 9).alias("score"), "kw")


def pending_embeddings(s: Spark, d: str) -> DataFrame:
    return vectors.pending(v.docs(s, d).select("id"), v.vecs(s, d))


def hashed_embedding(s: Spark, d: str) -> DataFrame:
    """Vectors of 384 numbers of all documents; their digest, size and length."""
    e = vectors.embed(384)(F.col("text"))
    df = table(s, d, "documents").select(F.col("doc_id").alias("id"), e.alias("e"))
    return df.select("id", F.size("e").alias("dim"), F.md5(F.array_join(F.transform("e", lambda x: F.round(x.cast("double"), 4).cast("string")), " ")).alias("digest"), F.round(F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("norm"))


def embedding_text(s: Spark, d: str) -> DataFrame:
    text = ex.embedding_text(F.col("user_message"), F.coalesce("assistant_message", F.lit("")), F.col("tool_names"))
    return table(s, d, "exchanges").select("id", F.md5(text).alias("digest"), F.char_length(text).cast("long").alias("n"))


# ---- cards and pages ------------------------------------------------------------------------------


def snippet_cards(s: Spark, d: str) -> DataFrame:
    """Cards of all rows with all their letters."""
    cut = lambda c: tx.one_line(tx.first_chars(F.coalesce(F.col(c), F.lit("")), 200))
    return table(s, d, "exchanges").select("id", "project", local_day(F.col("ts")).alias("day"), cut("user_message").alias("user_line"), cut("assistant_message").alias("assistant_line"))


def _items(s: Spark, d: str) -> DataFrame:
    t = v.once(table(s, d, "exchanges").select("archive_path", F.col("line_start").alias("line"), F.col("id").alias("row_id"), "user_message", "assistant_message"))
    said = F.filter(F.array(pv.item_text("User", F.col("user_message")), pv.item_text("Assistant", F.when(F.col("assistant_message") != "", F.col("assistant_message")))), lambda x: x.isNotNull())
    return t.select("archive_path", "line", said.alias("items"))


def read_range(s: Spark, d: str) -> DataFrame:
    return reading.line_blocks(_items(s, d).where("line between 5 and 40")).select("archive_path", "line", F.md5("block").alias("digest"))


def read_page_budget(s: Spark, d: str) -> DataFrame:
    return reading.pages(_items(s, d), 1, None, 3000).select("archive_path", "line", F.md5("block").alias("digest"), "next_line")


def rendered_lines(s: Spark, d: str) -> DataFrame:
    """Items of both producers' lines, one row per line that has some."""
    b = pv.parsed(v.raw_b(s, d))
    both = _facts_a(s, d).select("archive_path", "line", "items").unionByName(pv.facts_b(b, pv.meta_b(b)).select("archive_path", "line", "items"))
    return reading.line_blocks(both)


def truncate_chars(s: Spark, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.md5(tx.first_chars(F.col("text"), 200)).alias("digest"))


def truncate_bytes(s: Spark, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.md5(tx.cut_bytes(F.col("text"), 1000)).alias("digest"))


# ---- JSON -----------------------------------------------------------------------------------------


def json_line_facts(s: Spark, d: str) -> DataFrame:
    p = F.try_parse_json("props")
    return table(s, d, "events").select("event_id", F.try_variant_get(p, "$.k", "long").alias("k"))


def content_dispatch(s: Spark, d: str) -> DataFrame:
    c = F.try_parse_json("content")
    k = F.schema_of_variant(c)
    kind = F.when(c.isNull(), "bad").when(k == "STRING", "string").when(k.startswith("ARRAY"), "array").otherwise("other")
    return table(s, d, "claude").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# ---- catalog --------------------------------------------------------------------------------------


def latest_upsert(s: Spark, d: str) -> DataFrame:
    return catalog.latest(table(s, d, "files"), "source_path", "mtime", "generation", "end_offset").select("source_path", "archive_path", "generation", "end_offset", "skipped")


def delete_suffix(s: Spark, d: str) -> DataFrame:
    t = table(s, d, "exchanges").select("id", "archive_path", "line_start")
    cuts = t.where("line_start > 20").groupBy("archive_path").agg(F.min("line_start").alias("from_line"))
    return ex.without_suffix(t, cuts).select("id")


def generation_current(s: Spark, d: str) -> DataFrame:
    rows = table(s, d, "files").select("archive_path").distinct()
    return catalog.current_generations(rows).select("archive_path", tx.generation(F.col("archive_path")).alias("gen"))


def discovered_left_join_files(s: Spark, d: str) -> DataFrame:
    files = catalog.latest(table(s, d, "files"), "source_path", "mtime", "generation", "end_offset")
    found = files.select("source_path", (F.col("end_offset") + F.when(F.col("n_lines") % 3 == 0, 7).otherwise(0)).alias("size"))
    return catalog.changed(found, files).select("source_path", "size", "end_offset")


def already_known(s: Spark, d: str) -> DataFrame:
    """Archives with exchanges that the registry doesn't know by either path."""
    seen = table(s, d, "exchanges").select("archive_path", F.concat(F.lit("/x/"), F.col("archive_path")).alias("source_path")).distinct()
    return catalog.unknown(seen, table(s, d, "files").where("skipped = false")).select("archive_path")


def not_exists_relative_paths(s: Spark, d: str) -> DataFrame:
    return catalog.relative_paths(table(s, d, "files").select("source_path", "archive_path").distinct(), ROOT)


def project_from_cwd(s: Spark, d: str) -> DataFrame:
    return table(s, d, "claude").select("cwd").distinct().select("cwd", tx.project_of(F.col("cwd")).alias("project"))


def health_counts(s: Spark, d: str) -> DataFrame:
    return catalog.counts(table(s, d, "files"), table(s, d, "exchanges"), v.vecs(s, d))


def health_checks(s: Spark, d: str) -> DataFrame:
    return catalog.health(health_counts(s, d), {"revision": "2", "last_sync": "2025-06-01T00:00:00Z"}, {"a": True, "b": False})


def skipped_archives(s: Spark, d: str) -> DataFrame:
    """Exchanges whose archive, in any generation, opted out."""
    return catalog.opted_out(table(s, d, "exchanges").select("id", "archive_path"), table(s, d, "files"))


def reindex_candidates(s: Spark, d: str) -> DataFrame:
    files = catalog.latest(table(s, d, "files"), "source_path", "mtime", "generation", "end_offset")
    return catalog.reindexed(files).select("source_path", "archive_path", "end_offset")


# ---- extensions: not part of the reference ---------------------------------------------------------


def ext_session_window_events(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    w = e.groupBy("user_id", F.session_window("at", "30 minutes")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "n", "total")


def ext_tumbling_window_events(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    w = e.groupBy("event_type", F.window("at", "1 hour")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.unix_millis("window.start").alias("start_ms"), "n")


def ext_rollup_corpus(s: Spark, d: str) -> DataFrame:
    t = table(s, d, "exchanges")
    return t.rollup("harness", "project").agg(F.count("*").alias("n"), F.sum(F.size("tool_names")).alias("tools"))


QUERIES = {
    f.__name__: f
    for f in (
        exchange_fold, exchange_drop_unanswered, exchange_tools_ordered_distinct, exchange_fold_b, index_build, resume_point, line_byte_offsets, file_meta_first_nonnull, signal_max_rank, bad_lines_per_file, sync_stats, streaming_exchanges,
        filter_project_date, exclude_session, opt_out_purge, oversize_drop, tokenize, hangul_bigrams, strip_diacritics_tokens, token_df, prune_common_tokens, prefix_match, text_index_build, bm25_topk, bm25_filtered, porter_bm25, keyword_only_search, search_many,
        knn_topk, knn_filtered, knn_many, knn_floor_or_keyword, vector_only_search, rrf_fusion, rrf_sidechain_penalty, hybrid_search, multi_concept_and, pending_embeddings, hashed_embedding, embedding_text, snippet_cards, read_range, read_page_budget, rendered_lines,
        truncate_chars, truncate_bytes, json_line_facts, content_dispatch, latest_upsert, delete_suffix, generation_current, discovered_left_join_files, already_known, not_exists_relative_paths, project_from_cwd, health_counts, health_checks, skipped_archives, reindex_candidates,
        ext_session_window_events, ext_tumbling_window_events, ext_rollup_corpus,
    )
}

_Q = QUERY.split()
_BM = f"WITH {v.DOCS}, {v.sql_bm25(_Q)}"
_HY = f"WITH {v.DOCS}, {v.VECS}, {v.sql_bm25(_Q)}, {v.sql_knn()}"
_BONUS = "CASE rank WHEN 1 THEN 0.01 WHEN 2 THEN 0.005 WHEN 3 THEN 0.0025 ELSE 0 END"
_PARTS = f"SELECT id, 0.4::DOUBLE / (rank + 60) + {_BONUS} part, true kw FROM bm UNION ALL SELECT id, 0.6::DOUBLE / (rank + 60), false FROM {{near}}"
_BEST = "(0.4::DOUBLE / 61 + 0.01 + 0.6::DOUBLE / 61)"
_PEN = "round(CASE WHEN is_sidechain THEN raw * 0.9 ELSE raw END, 12)"
_FLOOR = f"""
fl AS (SELECT kn.id, cos, row_number() OVER (ORDER BY cos DESC, kn.id) rank FROM kn LEFT JOIN bm ON bm.id = kn.id WHERE cos >= {FLOOR} OR bm.id IS NOT NULL)"""
_ITEMS = """
it AS (SELECT * FROM (SELECT archive_path, line_start line, id, user_message u, assistant_message a FROM exchanges) QUALIFY row_number() OVER (PARTITION BY archive_path, line ORDER BY id) = 1),
cutu AS (SELECT archive_path, line, """ + ", ".join(
    f"CASE WHEN strlen({c}) <= 16384 THEN {c} ELSE substr({c}, 1, list_max(list_filter(range(4096, 16385), lambda k: strlen(substr({c}, 1, k::INT)) <= 16384))::INT) || '…[truncated]' END {c}" for c in ("u", "a")
) + " FROM it)"
_BLOCK = "CASE WHEN u IS NULL THEN '' ELSE 'L' || line || ' **User:** ' || u || chr(10) || chr(10) END || CASE WHEN coalesce(a, '') = '' THEN '' ELSE 'L' || line || ' **Assistant:** ' || a || chr(10) || chr(10) END"


def _one_line(column: str) -> str:
    """SQL for the first 200 letters of a column in one line; white space as Unicode has it."""
    space = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+".replace(r"\x{1c}-\x{1f}", "")
    return f"trim(regexp_replace(substr(coalesce({column}, ''), 1, 200), '{space}', ' ', 'g'))"


def _concept(i: int, q: str) -> str:
    """SQL for one concept's list: keywords and vectors, floor, fusion, penalty."""
    fused = _PARTS.format(near="fl")
    return f"""SELECT {i} concept, d.archive_path, d.id, {_PEN} raw, kw FROM (SELECT id, sum(part) raw, bool_or(kw) kw FROM (WITH {v.DOCS}, {v.VECS}, {v.sql_bm25(q.split(), n=300)}, {v.sql_knn(n=300, vec_id=i)}, {_FLOOR} {fused}) GROUP BY id) x
JOIN (SELECT doc_id id, source archive_path, coalesce(doc_id % 5 = 0, false) is_sidechain FROM documents) d USING (id)"""


# provider B: lines, signals, facts and fold in SQL
_PREFIX_B = " OR ".join(f"starts_with(regexp_replace(typed, '^\\s+', ''), '{p}')" for p in pv.NOT_TYPED_B)


def _texts(place: str, kind: str, glue: str) -> str:
    """SQL for the joined texts of the blocks of a kind."""
    blocks = f"CASE WHEN json_type(p, '{place}') = 'ARRAY' THEN (p -> '{place}')::JSON[] ELSE [] END"
    kept = f"list_filter({blocks}, lambda b: json_extract_string(b, '$.type') = '{kind}' AND json_type(b, '$.text') = 'VARCHAR')"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string(list_transform({kept}, lambda b: json_extract_string(b, '$.text')), {glue}) END"


_NL, _NL2 = "chr(10)", "chr(10) || chr(10)"
_FOLD_B = f"""
lb AS (SELECT archive_path, line, type, CASE WHEN json_valid(payload) THEN payload::JSON END p FROM (
  SELECT * FROM (SELECT archive_path, line, row_id, type, payload FROM modern) QUALIFY row_number() OVER (PARTITION BY archive_path, line ORDER BY row_id) = 1
  UNION ALL SELECT * FROM (SELECT archive_path, line, row_id, type, payload FROM legacy) QUALIFY row_number() OVER (PARTITION BY archive_path, line ORDER BY row_id) = 1)),
kb AS (SELECT *, json_extract_string(p, '$.type') k, CASE WHEN type = 'event_msg' AND json_extract_string(p, '$.type') = 'item_completed' AND json_extract_string(p, '$.item.type') = 'UserMessage' THEN 2
  WHEN type = 'event_msg' AND json_extract_string(p, '$.type') = 'user_message' THEN 1 ELSE 0 END sig FROM lb),
mb AS (SELECT archive_path, max(sig)::BIGINT signal, arg_min(CASE WHEN json_type(p, '$.id') = 'VARCHAR' THEN json_extract_string(p, '$.id') ELSE '' END, line) FILTER (type = 'session_meta' AND p IS NOT NULL) session_id FROM kb GROUP BY 1),
xb AS (SELECT kb.*, signal, {_texts('$.content', 'input_text', _NL)} typed, {_texts('$.content', 'output_text', _NL2)} said, {_texts('$.item.content', 'text', _NL)} done FROM kb JOIN mb USING (archive_path)),
fb AS (SELECT archive_path, line, CASE signal WHEN 2 THEN CASE WHEN sig = 2 THEN done END WHEN 1 THEN CASE WHEN sig = 1 AND json_type(p, '$.message') = 'VARCHAR' THEN json_extract_string(p, '$.message') END
    ELSE CASE WHEN type = 'response_item' AND k = 'message' AND json_extract_string(p, '$.role') = 'user' AND NOT coalesce({_PREFIX_B}, false) THEN typed END END start_text,
  CASE WHEN type = 'response_item' AND k = 'message' AND json_extract_string(p, '$.role') = 'assistant' THEN said END answer,
  CASE WHEN type = 'event_msg' AND k = 'agent_message' AND json_type(p, '$.message') = 'VARCHAR' AND json_extract_string(p, '$.message') <> '' THEN json_extract_string(p, '$.message') END spare,
  CASE WHEN type = 'response_item' AND k IN ('function_call', 'custom_tool_call') AND json_type(p, '$.name') = 'VARCHAR' THEN json_extract_string(p, '$.name') WHEN type = 'response_item' AND k = 'local_shell_call' THEN 'local_shell' END tool FROM xb),
sb AS (SELECT *, sum(CASE WHEN start_text IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY archive_path ORDER BY line ROWS UNBOUNDED PRECEDING) segment FROM fb),
gb AS (SELECT archive_path, segment, min(line) line_start, max(line) line_end, max(start_text) user_message, {v.sql_joined('list(answer ORDER BY line) FILTER (answer IS NOT NULL)')} a, {v.sql_joined('list(spare ORDER BY line) FILTER (spare IS NOT NULL)')} f, list(tool ORDER BY line) FILTER (tool IS NOT NULL) t FROM sb WHERE segment > 0 GROUP BY 1, 2),
eb AS (SELECT archive_path, line_start, line_end, user_message, CASE WHEN a <> '' THEN a ELSE f END assistant_message, coalesce(array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ','), '') tools FROM gb)"""

_WIN = "PARTITION BY archive_path ORDER BY line"

ORACLE = {
    "index_build": f"""WITH {v.FOLD_A}, {_FOLD_B},
ma AS (SELECT archive_path, arg_min(sessionId, line) FILTER (j IS NOT NULL AND sessionId IS NOT NULL) session_id, arg_min(cwd, line) FILTER (j IS NOT NULL AND cwd IS NOT NULL) cwd,
  list_contains(string_split(archive_path, '/'), 'subagents') OR coalesce(arg_min(isSidechain, line) FILTER (j IS NOT NULL AND isSidechain IS NOT NULL), false) is_sidechain FROM ja GROUP BY archive_path),
hb AS (SELECT archive_path, CASE WHEN json_type(p, '$.id') = 'VARCHAR' THEN json_extract_string(p, '$.id') END session_id, CASE WHEN json_type(p, '$.cwd') = 'VARCHAR' THEN json_extract_string(p, '$.cwd') END cwd, coalesce(json_type(p, '$.source.subagent') <> 'NULL', false) is_sidechain
  FROM lb WHERE type = 'session_meta' AND p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY archive_path ORDER BY line) = 1),
al AS (SELECT archive_path, line_start, user_message, assistant_message, tools, session_id, cwd, 'claude' harness, coalesce(is_sidechain, false) is_sidechain FROM ea LEFT JOIN ma USING (archive_path)
  UNION ALL SELECT archive_path, line_start, user_message, assistant_message, tools, session_id, cwd, 'codex', coalesce(is_sidechain, false) FROM eb LEFT JOIN hb USING (archive_path))
SELECT row_number() OVER (ORDER BY archive_path, line_start) id, archive_path, line_start, session_id, coalesce(list_filter(string_split(cwd, '/'), lambda x: x <> '')[-1], 'unknown') project, harness, is_sidechain FROM al
WHERE (assistant_message <> '' OR tools <> '') AND strlen(user_message) <= 262144 AND strlen(assistant_message) <= 262144 AND archive_path NOT IN (SELECT archive_path FROM al WHERE contains(user_message, '{MARK}'))""",
    "exchange_fold_b": f"WITH {_FOLD_B} SELECT * FROM eb WHERE assistant_message <> '' OR tools <> ''",
    "signal_max_rank": f"WITH {_FOLD_B} SELECT archive_path, signal, nullif(session_id, '') session_id FROM mb",
    "hangul_bigrams": f"SELECT doc_id id, md5({v.sql_hangul('text')}) digest FROM documents WHERE regexp_matches(text, '[가-힣]')",
    "read_page_budget": f"""WITH {_ITEMS}, b AS (SELECT archive_path, line, {_BLOCK} x FROM cutu WHERE {_BLOCK} <> ''),
r AS (SELECT *, sum(strlen(x)) OVER ({_WIN} ROWS UNBOUNDED PRECEDING) total, row_number() OVER ({_WIN}) nth, lead(line) OVER ({_WIN}) nxt FROM b),
s AS (SELECT *, CASE WHEN total <= 3000 THEN x ELSE substr(x, 1, list_max(list_filter(range(700, 2985), lambda k: strlen(substr(x, 1, k::INT)) <= 2984))::INT) || '…[truncated]' END y FROM r WHERE total <= 3000 OR nth = 1)
SELECT archive_path, line, md5(y) digest, nullif(arg_max(CASE WHEN nxt IS NULL THEN -1 ELSE nxt END, line) OVER (PARTITION BY archive_path), -1) next_line FROM s""",
    "exchange_fold": f"WITH {v.FOLD_A} SELECT archive_path, line_start, line_end, user_message, assistant_message, tools FROM ea WHERE assistant_message <> '' OR tools <> ''",
    "streaming_exchanges": f"WITH {v.FOLD_A} SELECT archive_path, line_start, line_end, user_message, assistant_message, tools FROM ea WHERE assistant_message <> '' OR tools <> ''",
    "exchange_drop_unanswered": f"WITH {v.FOLD_A} SELECT archive_path, line_start, line_end, user_message FROM ea WHERE assistant_message = '' AND tools = ''",
    "exchange_tools_ordered_distinct": f"WITH {v.FOLD_A} SELECT archive_path, line_start, tools FROM ea WHERE tools <> ''",
    "resume_point": f"WITH {v.FOLD_A} SELECT archive_path, max(line_start) reparse_line FROM ea GROUP BY 1",
    "bad_lines_per_file": f"WITH {v.FOLD_A} SELECT archive_path, count(*) FILTER (is_bad) bad_lines FROM fa GROUP BY 1 HAVING count(*) FILTER (is_bad) > 0",
    "sync_stats": f"WITH {v.FOLD_A} SELECT count(DISTINCT archive_path) files_synced, count(*) new_exchanges, sum(bad_lines)::BIGINT bad_lines, count(*) FILTER (strlen(user_message) > 262144 OR strlen(assistant_message) > 262144) oversize FROM ea WHERE assistant_message <> '' OR tools <> ''",
    "line_byte_offsets": "SELECT archive_path, line, coalesce(sum(strlen(content) + 1) OVER (PARTITION BY archive_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT byte_start FROM (SELECT * FROM claude QUALIFY row_number() OVER (PARTITION BY archive_path, line ORDER BY row_id) = 1)",
    "file_meta_first_nonnull": f"""WITH {v.FOLD_A} SELECT archive_path, arg_min(sessionId, line) FILTER (j IS NOT NULL AND sessionId IS NOT NULL) session_id, arg_min(cwd, line) FILTER (j IS NOT NULL AND cwd IS NOT NULL) cwd,
list_contains(string_split(archive_path, '/'), 'subagents') OR coalesce(arg_min(isSidechain, line) FILTER (j IS NOT NULL AND isSidechain IS NOT NULL), false) is_sidechain FROM ja GROUP BY archive_path""",
    "filter_project_date": "SELECT id, project, ts FROM exchanges WHERE project = 'birch-cache' AND ts >= epoch_ms(TIMESTAMP '2025-02-01 03:00:00') AND ts < epoch_ms(TIMESTAMP '2025-07-01 03:00:00')",
    "exclude_session": f"""WITH b AS (SELECT id, session_id FROM exchanges ORDER BY ts DESC, id LIMIT {DEPTH}), m AS (SELECT session_id FROM exchanges WHERE session_id IS NOT NULL ORDER BY ts DESC, id LIMIT 1)
SELECT id, session_id FROM b WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM m)""",
    "opt_out_purge": f"SELECT id, archive_path FROM exchanges WHERE archive_path NOT IN (SELECT archive_path FROM exchanges WHERE contains(user_message, '{MARK}'))",
    "oversize_drop": "SELECT id, strlen(user_message)::BIGINT n_bytes FROM exchanges WHERE strlen(user_message) > 8192 OR coalesce(strlen(assistant_message), 0) > 8192",
    "text_index_build": f"SELECT term, count(DISTINCT id) df FROM (SELECT doc_id id, unnest({v.sql_terms('text')}) term FROM documents) GROUP BY 1",
    "knn_many": """WITH v AS (SELECT vec_id id, embedding::DOUBLE[] e FROM embeddings), x AS (SELECT q.id query_id, v.id, round(power(list_distance(v.e, q.e), 2), 7) d FROM v, v q WHERE q.id % 20 = 0)
SELECT query_id, id, round(1 - d / 2, 8) cos, row_number() OVER (PARTITION BY query_id ORDER BY d, id) rank FROM x QUALIFY rank <= 10""",
    "reindex_candidates": """SELECT source_path, archive_path, end_offset FROM (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY mtime DESC, generation DESC, end_offset DESC) = 1) WHERE end_offset > 0 AND NOT skipped""",
    "truncate_bytes": "SELECT doc_id id, md5(CASE WHEN strlen(text) <= 1000 THEN text ELSE substr(text, 1, list_max(list_filter(range(240, 1001), lambda k: strlen(substr(text, 1, k::INT)) <= 1000))::INT) || '…[truncated]' END) digest FROM documents",
    "tokenize": f"SELECT id, len(ws)::BIGINT n_tokens, len(list_distinct(ws))::BIGINT n_distinct, ws[1] first_token, md5(array_to_string(ws, ' ')) digest FROM (SELECT doc_id id, {v.sql_terms('text')} ws FROM documents)",
    "token_df": f"SELECT term, count(DISTINCT id) df FROM (SELECT doc_id id, unnest({v.sql_terms('text')}) term FROM documents) GROUP BY 1",
    "prune_common_tokens": f"SELECT term, count(DISTINCT id) df FROM (SELECT doc_id id, unnest({v.sql_terms('text')}) term FROM documents) GROUP BY 1 HAVING count(DISTINCT id) > 0.2 * (SELECT count(*) FROM documents)",
    "prefix_match": f"SELECT id, count(*) tf, count(DISTINCT term) terms FROM (SELECT doc_id id, unnest({v.sql_terms('text')}) term FROM documents) WHERE starts_with(term, 'che') GROUP BY 1",
    "bm25_topk": f"{_BM} SELECT id, score, rank FROM bm",
    "bm25_filtered": f"WITH {v.DOCS}, {v.sql_bm25(_Q, where=chr(39).join(['project = ', 'birch-cache', '']))} SELECT id, score, rank FROM bm",
    "keyword_only_search": f"{_BM} SELECT id, round(least(greatest({_PEN} / {_BEST}, 0), 1), 9) score FROM (SELECT id, 0.4::DOUBLE / (rank + 60) + {_BONUS} raw FROM bm) JOIN docs USING (id) ORDER BY score DESC, id DESC LIMIT {LIMIT}",
    "search_many": f"""WITH w AS (SELECT doc_id id, {v.sql_terms('text')} ws FROM documents), c AS (SELECT count(*)::DOUBLE total, avg(coalesce(len(ws), 0)) avgdl FROM w),
p AS (SELECT id, term, count(*) tf FROM (SELECT id, unnest(ws) term FROM w) GROUP BY 1, 2), df AS (SELECT term, count(*) n FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id query_id, unnest({v.sql_terms('text')}) term FROM eval_items WHERE item_id % 20 = 0),
sc AS (SELECT query_id, p.id, round(sum(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avgdl))), 9) score FROM q JOIN df USING (term) JOIN p USING (term) JOIN w ON w.id = p.id, c WHERE n <= 0.2 * total GROUP BY 1, 2)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank FROM sc QUALIFY rank <= 5""",
    "knn_topk": f"WITH {v.VECS}, {v.sql_knn()} SELECT id, cos, rank FROM kn",
    "knn_filtered": f"WITH {v.VECS}, {v.sql_knn(where=chr(39).join(['v.project = ', 'label_3', '']))} SELECT id, cos, rank FROM kn",
    "knn_floor_or_keyword": f"WITH {v.DOCS}, {v.VECS}, {v.sql_bm25(_Q)}, {v.sql_knn(n=300)}, {_FLOOR} SELECT id, cos, rank FROM fl",
    "vector_only_search": f"WITH {v.VECS}, {v.sql_knn()} SELECT id, round(0.6::DOUBLE / (rank + 60) / {_BEST}, 9) score FROM kn WHERE cos >= {FLOOR}",
    "rrf_fusion": f"{_HY} SELECT id, round(sum(part), 9) raw, bool_or(kw) kw FROM ({_PARTS.format(near='kn')}) GROUP BY id",
    "rrf_sidechain_penalty": f"{_HY} SELECT id, round({_PEN}, 9) raw, is_sidechain FROM (SELECT id, sum(part) raw FROM ({_PARTS.format(near='kn')}) GROUP BY id) JOIN docs USING (id)",
    "hybrid_search": f"""{_HY}, {_FLOOR}, h AS (SELECT id, {_PEN} raw, kw FROM (SELECT id, sum(part) raw, bool_or(kw) kw FROM ({_PARTS.format(near='fl')}) GROUP BY id) JOIN docs USING (id) ORDER BY raw DESC, id DESC LIMIT {LIMIT})
SELECT id, project, ts, archive_path, round(least(greatest(raw / {_BEST}, 0), 1), 9) score, substr(text, 1, 200) snippet, kw FROM h JOIN docs USING (id)""",
    "multi_concept_and": f"""WITH r AS ({' UNION ALL '.join(_concept(i, q) for i, q in enumerate(CONCEPTS))}), b AS (SELECT archive_path, concept, max(raw) raw, arg_max(id, (raw, id)) id, arg_max(kw, (raw, id)) kw FROM r GROUP BY 1, 2)
SELECT archive_path, arg_max(id, (raw, id)) id, round(least(round(avg(raw), 12) / {_BEST}, 1), 9) score, bool_or(kw) kw FROM b GROUP BY 1 HAVING count(*) = {len(CONCEPTS)}""",
    "pending_embeddings": "SELECT doc_id id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "embedding_text": "SELECT id, md5('passage: ' || substr(x, 1, 2000)) digest, length('passage: ' || substr(x, 1, 2000)) n FROM (SELECT id, 'User: ' || user_message || chr(10) || chr(10) || 'Assistant: ' || coalesce(assistant_message, '') || chr(10) || chr(10) || 'Tools: ' || array_to_string(tool_names, ',') x FROM exchanges)",
    "snippet_cards": rf"""SELECT id, project, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') "day", {_one_line('user_message')} user_line, {_one_line('assistant_message')} assistant_line FROM exchanges""",
    "read_range": f"WITH {_ITEMS} SELECT archive_path, line, md5({_BLOCK}) digest FROM cutu WHERE line BETWEEN 5 AND 40 AND {_BLOCK} <> ''",
    "truncate_chars": "SELECT doc_id id, md5(substr(text, 1, 200)) digest FROM documents",
    "json_line_facts": "SELECT event_id, try_cast(json_extract(props, '$.k') AS BIGINT) k FROM events",
    "content_dispatch": "SELECT CASE WHEN NOT json_valid(content) THEN 'bad' WHEN json_type(content) = 'VARCHAR' THEN 'string' WHEN json_type(content) = 'ARRAY' THEN 'array' ELSE 'other' END kind, count(*) n FROM claude GROUP BY 1",
    "latest_upsert": "SELECT source_path, archive_path, generation, end_offset, skipped FROM files QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY mtime DESC, generation DESC, end_offset DESC) = 1",
    "delete_suffix": "SELECT id FROM exchanges e LEFT JOIN (SELECT archive_path, min(line_start) f FROM exchanges WHERE line_start > 20 GROUP BY 1) c USING (archive_path) WHERE f IS NULL OR line_start < f",
    "generation_current": r"""SELECT archive_path, coalesce(try_cast(regexp_extract(archive_path, '\.gen-([0-9]+)\.jsonl$', 1) AS BIGINT), 0) gen FROM (SELECT DISTINCT archive_path FROM files)
QUALIFY row_number() OVER (PARTITION BY regexp_replace(archive_path, '\.gen-[0-9]+\.jsonl$', '.jsonl') ORDER BY gen DESC) = 1""",
    "discovered_left_join_files": """WITH f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY mtime DESC, generation DESC, end_offset DESC) = 1)
SELECT source_path, end_offset + 7 size, end_offset FROM f WHERE n_lines % 3 = 0""",
    "already_known": "SELECT DISTINCT archive_path FROM exchanges WHERE archive_path NOT IN (SELECT archive_path FROM files WHERE NOT skipped)",
    "not_exists_relative_paths": f"WITH f AS (SELECT DISTINCT source_path, archive_path FROM files) SELECT source_path, substr(archive_path, {len(ROOT) + 1}) archive_path FROM f WHERE starts_with(archive_path, '{ROOT}') AND substr(archive_path, {len(ROOT) + 1}) NOT IN (SELECT archive_path FROM f)",
    "project_from_cwd": "SELECT DISTINCT cwd, coalesce(list_filter(string_split(cwd, '/'), lambda x: x <> '')[-1], 'unknown') project FROM claude",
    "health_counts": "SELECT (SELECT count(*) FROM files) files, (SELECT count(*) FROM files WHERE skipped) skipped, (SELECT count(*) FROM exchanges) exchanges, (SELECT count(*) FROM exchanges WHERE id NOT IN (SELECT vec_id FROM embeddings)) pending",
    "health_checks": """WITH p AS (SELECT count(*) n FROM exchanges WHERE id NOT IN (SELECT vec_id FROM embeddings))
SELECT 'db' name, 'warn' level, 'revision 2 of 3: the next sync migrates' detail UNION ALL SELECT 'last-sync', 'ok', '2025-06-01T00:00:00Z' UNION ALL SELECT 'source-roots', 'ok', 'a (found); b (missing)'
UNION ALL SELECT 'embeddings', CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END, CASE WHEN n > 0 THEN n || ' exchange(s) waiting for embedding' ELSE 'none pending' END FROM p""",
    "skipped_archives": r"SELECT id, archive_path FROM exchanges WHERE regexp_replace(archive_path, '\.gen-[0-9]+\.jsonl$', '.jsonl') IN (SELECT regexp_replace(archive_path, '\.gen-[0-9]+\.jsonl$', '.jsonl') FROM files WHERE skipped)",
    "ext_tumbling_window_events": "SELECT event_type, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) start_ms, count(*) n FROM events GROUP BY 1, 2",
    "ext_session_window_events": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) run FROM m)
SELECT user_id, epoch_us(min(ts)) // 1000 start_ms, count(*) n, round(sum(value), 4) total FROM r GROUP BY user_id, run""",
    "ext_rollup_corpus": "SELECT harness, project, count(*) n, sum(len(tool_names))::BIGINT tools FROM exchanges GROUP BY ROLLUP (harness, project)",
}
