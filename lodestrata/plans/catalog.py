"""Registered queries of the retrieval engine and their SQL.

Most run over a chunk view of ``documents`` that both engines build alike: every
document is one chunk, a third of the paths is shared by many chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import chunk_id, content_hash, is_aligned, path_class
from lodestrata.operators import changes, lines, scoring
from lodestrata.plans import reader
from lodestrata.schema import SearchOptions

LIMIT, TOP_K, DIGITS = 50, 10, 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_view(spark: SparkSession, sf_dir: str, slack: bool = False) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('tests/test_', doc_id, '.py') WHEN 1 THEN concat('docs/', doc_id, '.md') ELSE concat('src/', source, '/', lang, '.py') END")
    start = (1 + (F.col("doc_id") * 7) % 200).cast("int")
    lines_in = F.size(F.split("text", "\n", -1))
    end = start + lines_in - 1 + ((F.col("doc_id") % 3).cast("int") if slack else F.lit(0))
    return docs.select(
        F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), path.alias("path"), start.alias("start_line"), end.cast("int").alias("end_line"),
        "text", F.col("lang").alias("symbol"), F.lit("section").alias("chunk_kind"),
    )


_VIEW = """WITH chunk AS (SELECT 'c' || doc_id AS chunk_id,
 CASE doc_id % 5 WHEN 0 THEN 'tests/test_' || doc_id || '.py' WHEN 1 THEN 'docs/' || doc_id || '.md' ELSE 'src/' || source || '/' || lang || '.py' END AS path,
 CAST(1 + (doc_id * 7) % 200 AS INT) AS start_line,
 CAST(1 + (doc_id * 7) % 200 + len(string_split(text, chr(10))) - 1{slack} AS INT) AS end_line,
 text, lang AS symbol, 'section' AS chunk_kind, doc_id FROM documents)"""
VIEW, SLACK = _VIEW.format(slack=""), _VIEW.format(slack=" + doc_id % 3")


def index_info(spark, sf_dir):
    chunks = chunk_view(spark, sf_dir)
    vectors = _table(spark, sf_dir, "embeddings")
    return reader.index_info(chunks.select("path").distinct(), chunks, vectors)


def find_paths(spark, sf_dir):
    return reader.find_paths(chunk_view(spark, sf_dir), "SRC/src1", LIMIT)


def text_search(spark, sf_dir):
    return reader.text_search(chunk_view(spark, sf_dir), "Licensed UNDER", limit=LIMIT).select("chunk_id", "path", "start_line", "end_line")


def find_text_lines(spark, sf_dir):
    return reader.find_text_lines(chunk_view(spark, sf_dir, slack=True), "license", limit=LIMIT)


def get_chunks_range(spark, sf_dir):
    return reader.get_chunks(chunk_view(spark, sf_dir), "src/src3/en.py", 50, 120).select("chunk_id", "path", "start_line", "end_line")


def get_chunks_by_ids(spark, sf_dir):
    wanted = spark.createDataFrame([(f"c{i}",) for i in (1, 5, 77, 123456789)], "chunk_id string")
    return chunk_view(spark, sf_dir).join(wanted, "chunk_id", "left_semi").select("chunk_id", "path", "start_line", "end_line")


def outline(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("start_line"), F.col("turn").cast("int").alias("end_line"),
        F.when(F.col("turn") % 3 != 2, F.lit("open")).alias("symbol"), F.lit("turn").alias("chunk_kind"), F.concat_ws("-", "conv_id", "turn", F.md5("text")).alias("chunk_id"),
    )
    return lines.outline(turns)


def source_lines(spark, sf_dir):
    return lines.source_lines(chunk_view(spark, sf_dir, slack=True), 20, 160)


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id")).alias("chunk_id"), F.col("embedding").alias("vector"))


def _query_vectors(spark, sf_dir, ids):
    rows = _table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(ids)).select("vec_id", "embedding").collect()
    found = {r[0]: [float(x) for x in r[1]] for r in rows}
    return [found[i] for i in ids]


def vector_topk(spark, sf_dir):
    return reader.vector_topk(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir, [3])[0], TOP_K, DIGITS)


def vector_search_meta(spark, sf_dir):
    hits = reader.vector_topk(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir, [3])[0], TOP_K, DIGITS)
    return hits.join(chunk_view(spark, sf_dir), "chunk_id").select("chunk_id", "path", "start_line", "end_line", "score")


def semantic_multi_query(spark, sf_dir):
    queries = reader.query_table(spark, ["account rules", "account tests"], _query_vectors(spark, sf_dir, [3, 11]))
    return reader.semantic_hits(chunk_view(spark, sf_dir), _vectors(spark, sf_dir), queries, SearchOptions(top_k=TOP_K), DIGITS)


def vector_scores_blocks(spark, sf_dir):
    """Every query against every vector through one matrix product per Arrow batch."""
    scored = scoring.score_blocks(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir, [3, 11]))
    return scored.select("query_id", "chunk_id", F.round("raw", DIGITS).alias("raw"))


def path_filters(spark, sf_dir):
    options = SearchOptions(include_paths=("src/%", "docs/_.md"), exclude_paths=("%/fr.py",))
    return reader.filter_paths(chunk_view(spark, sf_dir), options).select("chunk_id", "path")


def path_classes(spark, sf_dir):
    urls = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("chunk_id"), F.col("url").alias("path"))
    both = chunk_view(spark, sf_dir).select("chunk_id", "path").unionByName(urls)
    return both.select("chunk_id", path_class(F.col("path")).alias("path_class"))


def overlap_drop(spark, sf_dir):
    hits = chunk_view(spark, sf_dir).select("chunk_id", "path", "start_line", "end_line", (F.length("text") % 97).cast("double").alias("score"))
    return scoring.drop_overlaps(hits)


def chunk_ids(spark, sf_dir):
    c = chunk_view(spark, sf_dir)
    return c.select("path", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")).alias("chunk_id"), content_hash(F.col("text")).alias("content_hash"))


def aligned_chunks(spark, sf_dir):
    c = chunk_view(spark, sf_dir, slack=True)
    return c.select("chunk_id", is_aligned(F.col("text"), F.col("start_line"), F.col("end_line")).alias("aligned"))


def change_diff(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    stored = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("fingerprint"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("fingerprint"))
    return changes.change_report(stored, current)


def stale_vectors(spark, sf_dir):
    chunks = chunk_view(spark, sf_dir).select("chunk_id", "path")
    vectors = _vectors(spark, sf_dir).select("chunk_id", F.lit("m").alias("model_id"))
    return changes.missing_vectors(chunks, vectors, "m")


def upsert_overlay(spark, sf_dir):
    base = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("size"), F.col("doc_id").alias("ordinal"))
    new = base.where("id % 3 = 0").select("id", (F.col("size") + 1).alias("size"), "ordinal").unionByName(base.where("id % 6 = 0").select("id", (F.col("size") + 2).alias("size"), (F.col("ordinal") + 1).alias("ordinal")))
    return changes.overlay(base, changes.last_per_key(new, ("id",), "ordinal"), ("id",)).select("id", "size")


def json_depth_keys(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("k").agg(F.count("*").alias("events"))


def kind_counts(spark, sf_dir):
    kinds = chunk_view(spark, sf_dir).select(F.lit("chunk").alias("kind")).unionByName(chunk_view(spark, sf_dir).select("path").distinct().select(F.lit("file").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def _late(module: str, name: str):
    """A query whose module is imported when it runs."""
    def run(spark, sf_dir):
        import importlib

        return getattr(importlib.import_module(module), name)(spark, sf_dir)
    run.__name__ = name
    return run


_PLAIN = (
    index_info, find_paths, text_search, find_text_lines, get_chunks_range, get_chunks_by_ids, outline, source_lines, vector_topk, vector_search_meta,
    semantic_multi_query, vector_scores_blocks, path_filters, path_classes, overlap_drop, chunk_ids, aligned_chunks, change_diff, stale_vectors,
    upsert_overlay, json_depth_keys, kind_counts,
)
_INDEXING = ("split_oversized", "route_files", "chunk_languages", "embed_chunks", "build_index_twice", "watch_index")


def queries() -> dict:
    return {f.__name__: f for f in _PLAIN} | {n: _late("lodestrata.plans.indexing_queries", n) for n in _INDEXING}


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_LOW = "lower(path)"
_TESTS = rf"(regexp_matches({_LOW}, '(^|/)(tests?|__tests__|specs?)(/|$)') OR regexp_matches({_LOW}, '(^|/)(test_[^/]*|[^/]*_(test|spec)|[^/]*\.(test|spec))\.[^/]+$'))"
_DOCS = rf"(regexp_matches({_LOW}, '(^|/)(docs?|documentation)(/|$)') OR regexp_matches({_LOW}, '(^|/)(readme|changelog)(\.[^/]*)?$') OR regexp_matches({_LOW}, '\.(md|mdx|rst|adoc)$'))"
#: Greedy fold over each path's hits in score order, one hit per step.
_FOLD = """, ordered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_id) AS rn FROM hits),
 fold(path, rn, kept) AS (SELECT path, 1::BIGINT, [{'s': start_line, 'e': end_line, 'id': chunk_id, 'v': score}] FROM ordered WHERE rn = 1
  UNION ALL SELECT f.path, o.rn, CASE WHEN len(list_filter(f.kept, lambda k: greatest(0, least(k.e, o.end_line) - greatest(k.s, o.start_line) + 1) / (o.end_line - o.start_line + 1)::DOUBLE >= 0.5)) > 0
   THEN f.kept ELSE list_append(f.kept, {'s': o.start_line, 'e': o.end_line, 'id': o.chunk_id, 'v': o.score}) END
  FROM fold f JOIN ordered o ON o.path = f.path AND o.rn = f.rn + 1),
 last AS (SELECT path, arg_max(kept, rn) AS kept FROM fold GROUP BY path), flat AS (SELECT path, unnest(kept) AS k FROM last)"""


def oracle_sql() -> dict:
    from lodestrata.plans import indexing_queries

    view = VIEW
    recursive = VIEW.replace("WITH chunk", "WITH RECURSIVE chunk", 1)
    return {
        "index_info": f"{view} SELECT (SELECT count(DISTINCT path) FROM chunk) AS files, (SELECT count(*) FROM chunk) AS chunks, (SELECT count(*) FROM embeddings) AS vectors",
        "find_paths": f"{view} SELECT DISTINCT path FROM chunk WHERE contains(lower(path), lower('SRC/src1')) ORDER BY path LIMIT {LIMIT}",
        "text_search": f"{view} SELECT chunk_id, path, start_line, end_line FROM chunk WHERE contains(lower(text), lower('Licensed UNDER')) ORDER BY path, start_line, chunk_id LIMIT {LIMIT}",
        "find_text_lines": f"""{SLACK}, hit AS (SELECT * FROM chunk WHERE contains(lower(text), 'license') ORDER BY path, start_line, chunk_id LIMIT {LIMIT}),
 line AS (SELECT path, start_line, chunk_id, len(string_split(text, chr(10))) = end_line - start_line + 1 AS ok, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS off FROM hit),
 m AS (SELECT path, CAST(CASE WHEN ok THEN start_line + off ELSE start_line END AS INT) AS line_number, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text, ok AS exact_line,
  row_number() OVER (PARTITION BY path, CASE WHEN ok THEN start_line + off ELSE start_line END, regexp_replace(line, '^\\s+|\\s+$', '', 'g') ORDER BY start_line, chunk_id, off) AS rn FROM line WHERE contains(lower(line), 'license'))
 SELECT path, line_number, text, exact_line FROM m WHERE rn = 1 ORDER BY path, line_number, text LIMIT {LIMIT}""",
        "get_chunks_range": f"{view} SELECT chunk_id, path, start_line, end_line FROM chunk WHERE path = 'src/src3/en.py' AND end_line >= 50 AND start_line <= 120",
        "get_chunks_by_ids": f"{view} SELECT chunk_id, path, start_line, end_line FROM chunk WHERE chunk_id IN ('c1', 'c5', 'c77', 'c123456789')",
        "outline": """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS INT) AS line, CASE WHEN turn % 3 <> 2 THEN 'open' END AS symbol, concat_ws('-', conv_id, turn, md5(text)) AS id FROM conversations),
 n AS (SELECT *, CASE WHEN symbol IS NOT NULL AND lag(symbol) OVER w = symbol THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY path ORDER BY line, id)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY line, id ROWS UNBOUNDED PRECEDING) AS island FROM n)
 SELECT path, any_value(symbol) AS symbol, 'turn' AS chunk_kind, min(line) AS start_line, max(line) AS end_line FROM g GROUP BY path, island""",
        "source_lines": f"""{SLACK}, l AS (SELECT path, start_line, chunk_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS off FROM chunk WHERE len(string_split(text, chr(10))) = end_line - start_line + 1)
 SELECT path, CAST(start_line + off AS INT) AS line_number, arg_max(text, {{'a': start_line, 'b': chunk_id}}) AS text FROM l WHERE start_line + off BETWEEN 20 AND 160 GROUP BY 1, 2""",
        "vector_topk": f"SELECT 'c' || e.vec_id AS chunk_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY score DESC, chunk_id LIMIT {TOP_K}",
        "vector_search_meta": f"{view}, hit AS (SELECT 'c' || e.vec_id AS chunk_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY score DESC, chunk_id LIMIT {TOP_K}) SELECT chunk_id, path, start_line, end_line, score FROM hit JOIN chunk USING (chunk_id)",
        "semantic_multi_query": f"""{recursive}, q AS (SELECT 0 AS qid, embedding, 0.8 AS tf, 0.8 AS df FROM embeddings WHERE vec_id = 3 UNION ALL SELECT 1, embedding, 1.0, 0.8 FROM embeddings WHERE vec_id = 11),
 raw AS (SELECT qid, chunk_id, path, start_line, end_line, round({_COS}, 6) AS raw, CAST(CASE WHEN {_TESTS} THEN tf WHEN {_DOCS} THEN df ELSE 1.0 END AS DOUBLE) AS f FROM embeddings e JOIN chunk ON chunk_id = 'c' || e.vec_id, q),
 top AS (SELECT *, round(raw - (1 - f) * abs(raw), 6) AS score FROM raw QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(raw - (1 - f) * abs(raw), 6) DESC, chunk_id) <= {TOP_K * 3}),
 hits AS (SELECT chunk_id, path, start_line, end_line, max(score) AS score FROM top GROUP BY ALL){_FOLD}
 SELECT k.id AS chunk_id, path, k.s AS start_line, k.e AS end_line, k.v AS score FROM flat ORDER BY score DESC, chunk_id LIMIT {TOP_K}""",
        "vector_scores_blocks": f"SELECT CAST(CASE q.vec_id WHEN 3 THEN 0 ELSE 1 END AS INT) AS query_id, 'c' || e.vec_id AS chunk_id, round({_COS}, 6) AS raw FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (3, 11)) q",
        "path_filters": f"{view} SELECT chunk_id, path FROM chunk WHERE (path LIKE 'src/%' OR path LIKE 'docs/_.md') AND path NOT LIKE '%/fr.py'",
        "path_classes": f"{view}, p AS (SELECT chunk_id, path FROM chunk UNION ALL SELECT 'p' || page_id, url FROM pages) SELECT chunk_id, CASE WHEN {_TESTS} THEN 'test' WHEN {_DOCS} THEN 'docs' ELSE 'other' END AS path_class FROM p",
        "overlap_drop": f"{recursive}, hits AS (SELECT chunk_id, path, start_line, end_line, CAST(length(text) % 97 AS DOUBLE) AS score FROM chunk){_FOLD} SELECT k.id AS chunk_id, path, k.s AS start_line, k.e AS end_line, k.v AS score FROM flat",
        "chunk_ids": f"{view} SELECT path, substr(sha256(path || chr(0) || start_line || ':' || end_line || chr(0) || text), 1, 16) AS chunk_id, sha256(text) AS content_hash FROM chunk",
        "aligned_chunks": f"{SLACK} SELECT chunk_id, len(string_split(text, chr(10))) = end_line - start_line + 1 AS aligned FROM chunk",
        "change_diff": """WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
 b AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
 SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path)""",
        "stale_vectors": f"{view} SELECT chunk_id, path FROM chunk WHERE chunk_id NOT IN (SELECT 'c' || vec_id FROM embeddings)",
        "upsert_overlay": "SELECT doc_id AS id, CAST(length(text) + CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS size FROM documents",
        "json_depth_keys": "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS events FROM events GROUP BY 1",
        "kind_counts": f"{view} SELECT 'chunk' AS kind, count(*) AS n FROM chunk UNION ALL SELECT 'file', count(DISTINCT path) FROM chunk",
        "route_files": ROUTE_SQL,
    } | indexing_queries.oracle_sql()


ROUTE_SQL = """WITH f AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'fixtures/' ELSE 'src/' END || 'f' || doc_id ||
 (['.py', '.TSX', '.json', '.md', '.txt', '-lock.json', '.kt'])[CAST(doc_id % 7 + 1 AS INT)] AS path FROM documents),
 r(ext, language, chunking_mode) AS (VALUES ('py', 'python', 'ast'), ('tsx', 'typescript', 'ast'), ('json', 'json', 'section'), ('md', 'markdown', 'section'), ('kt', 'kotlin', 'ast'))
 SELECT path, language, chunking_mode FROM f JOIN r ON lower(regexp_extract(path, '[.]([^.]*)$', 1)) = ext
 WHERE NOT (ext = 'json' AND (path LIKE 'fixtures/%' OR path LIKE '%-lock.json'))"""
