"""The read side: every public query over chunk and vector tables.

An index can hold several repositories.  Where chunk rows carry a ``repo``, files are told
apart by (repo, path) in every join, overlap and line; a reader that names no repository
returns a chunk that several of them hold alike once, and a path that several hold from
the first of them by name.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import DOCS_INTENT, TEST_INTENT, any_like, contains_ignoring_case, intends
from lodestrata.operators import lines, scoring
from lodestrata.schema import PATH_PENALTY, IndexedChunk, IndexInfo, OutlineEntry, SearchOptions, SearchResult, SourceLine, TextMatch


def check_limit(limit: int, name: str = "limit") -> None:
    if limit <= 0:
        raise ValueError(f"{name} must be positive")


def check_range(start_line: int | None, end_line: int | None) -> None:
    for value, name in ((start_line, "start_line"), (end_line, "end_line")):
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be positive")
    if start_line is not None and end_line is not None and start_line > end_line:
        raise ValueError("start_line must not come after end_line")


@dataclass(frozen=True)
class Queries:
    """The query strings of a search: their vectors, and a table of their path factors."""

    vectors: list[list[float]]
    factors: DataFrame


def query_table(spark: SparkSession, texts: list[str], vectors: list[list[float]]) -> Queries:
    """One row of factors for each query string; what a search call is given literally."""
    rows = [(i, 1.0 if intends(t, TEST_INTENT) else PATH_PENALTY, 1.0 if intends(t, DOCS_INTENT) else PATH_PENALTY) for i, t in enumerate(texts)]
    return Queries([[float(x) for x in v] for v in vectors], spark.createDataFrame(rows, "query_id int, test_factor double, docs_factor double"))


def filter_paths(chunks: DataFrame, options: SearchOptions) -> DataFrame:
    if options.include_paths:
        chunks = chunks.where(any_like(F.col("path"), options.include_paths))
    if options.exclude_paths:
        chunks = chunks.where(~any_like(F.col("path"), options.exclude_paths))
    return chunks


def _file(chunks: DataFrame) -> tuple[str, ...]:
    """The columns that tell files apart."""
    return ("repo", "path") if "repo" in chunks.columns else ("path",)


def semantic_hits(chunks: DataFrame, vectors: DataFrame, queries: Queries, options: SearchOptions, digits: int | None = None) -> DataFrame:
    """([repo,] chunk_id, path, start_line, end_line, score) of the best hits.

    Vectors are scored where they lie; ids and scores are joined to the places, and
    texts stay out of it: callers join them to the few hits.
    """
    file = _file(chunks)
    places = filter_paths(chunks, options).select("chunk_id", *file, "start_line", "end_line")
    scored = scoring.score_blocks(vectors, queries.vectors)
    if digits is not None:
        scored = scored.withColumn("raw", F.round("raw", digits))
    scored = scored.join(places, "chunk_id").join(F.broadcast(queries.factors), "query_id")  # a row per query string
    score = scoring.penalised(F.col("raw"), F.col("path"), F.col("test_factor"), F.col("docs_factor"))
    scored = scored.withColumn("score", score if digits is None else F.round(score, digits))
    top = scoring.top_per_query(scored, options.top_k)
    merged = scoring.best_per_chunk(top, *file, "start_line", "end_line")
    return scoring.ranked(scoring.drop_overlaps(merged, file), options.top_k)


def vector_topk(vectors: DataFrame, query: list[float], top_k: int, digits: int | None = None) -> DataFrame:
    """Plain cosine search: no penalty, filter or overlap removal."""
    check_limit(top_k, "top_k")
    score = F.col("raw") if digits is None else F.round("raw", digits)
    return scoring.ranked(scoring.score_blocks(vectors, [query]).select("chunk_id", score.alias("score")), top_k)


def find_paths(chunks: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    check_limit(limit)
    return chunks.where(F.col("path").isNotNull() & contains_ignoring_case(F.col("path"), pattern)).select("path").distinct().orderBy("path").limit(limit)


def text_search(chunks: DataFrame, text: str, path: str | None = None, limit: int = 20) -> DataFrame:
    check_limit(limit)
    found = chunks.where(contains_ignoring_case(F.col("text"), text))
    if path is not None:
        found = found.where(F.col("path") == path)
    return found.orderBy("path", "start_line", "chunk_id").limit(limit)


def find_text_lines(chunks: DataFrame, text: str, path: str | None = None, limit: int = 20) -> DataFrame:
    """The limit bounds the chunks looked at as well as the lines returned."""
    return lines.matching_lines(text_search(chunks, text, path, limit), text).orderBy("path", "line_number", "text").limit(limit)


def get_chunks(chunks: DataFrame, path: str, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
    check_range(start_line, end_line)
    found = chunks.where(F.col("path") == path)
    if start_line is not None:
        found = found.where(F.col("end_line") >= start_line)
    if end_line is not None:
        found = found.where(F.col("start_line") <= end_line)
    return found.orderBy("start_line", "chunk_id")


def index_info(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts, 0 where a table is empty."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))
    return count(files, "files").crossJoin(count(chunks, "chunks")).crossJoin(count(vectors, "vectors"))


_FIELDS = tuple(f.name for f in fields(IndexedChunk))
_RESULT = tuple(f.name for f in fields(SearchResult))


class SourceReader:
    """Typed results over an index; the DataFrame functions above do the work."""

    def __init__(self, spark: SparkSession, index_dir: str, repo: str | None = None) -> None:
        from lodestrata.sources.store import SnapshotStore

        self.spark, self.store = spark, SnapshotStore(spark, index_dir)
        if not self.store.exists():
            raise FileNotFoundError(index_dir)
        self.repo = repo
        #: Whether rows of more than one repository are read.
        self.several = repo is None and len(self.store.manifest().get("repos", [])) > 1

    def __enter__(self) -> "SourceReader":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open; readers see the snapshot that was current."""

    def _table(self, name: str) -> DataFrame:
        """The rows of the reader's repository, or of all."""
        rows = self.store.read(name)
        return rows.where(F.col("repo") == self.repo) if self.repo is not None and "repo" in rows.columns else rows

    def _chunks_once(self) -> DataFrame:
        """Chunks for a search: one that several repositories hold alike counts for the first."""
        rows = self._table("chunks")
        if not self.several:
            return rows
        first = rows.groupBy("chunk_id").agg(F.min("repo").alias("repo"))
        return rows.join(first, ["chunk_id", "repo"], "left_semi")

    def _of_path(self, path: str) -> DataFrame:
        """Chunks of one file."""
        rows = self._table("chunks").where(F.col("path") == path)
        if self.several:
            first = rows.agg(F.min("repo")).first()[0]
            rows = rows.where(F.col("repo").eqNullSafe(F.lit(first)))
        return rows

    def _vectors(self, embedder) -> DataFrame:
        return self._table("vectors").where(F.col("model_id") == embedder.model_id)

    def index_info(self) -> IndexInfo:
        chunks, vectors = self._table("chunks"), self._table("vectors")
        if self.repo is not None:
            vectors = vectors.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
        row = index_info(self._table("files"), chunks, vectors).first()
        return IndexInfo(row["files"], row["chunks"], row["vectors"], self.store.dims())

    def semantic_search(self, queries: Iterable[str], *, embedder, options: SearchOptions | None = None) -> list[SearchResult]:
        options = options or SearchOptions()
        check_limit(options.top_k, "top_k")
        texts = [q.strip() for q in queries if q.strip()]
        if not texts:
            raise ValueError("at least one query must not be blank")
        self._check_dims(embedder)
        chunks = self._chunks_once()
        hits = semantic_hits(chunks, self._vectors(embedder), query_table(self.spark, texts, embedder.encode_queries(texts)), options)
        return self._results(hits, chunks, ["repo", "chunk_id"])

    @staticmethod
    def _results(hits: DataFrame, chunks: DataFrame, keys: list[str]) -> list[SearchResult]:
        """Hits, at most top_k of them, with their texts, best first."""
        about = chunks.select("repo", "chunk_id", *(c for c in _RESULT if c not in hits.columns and c != "snippet"), F.col("text").alias("snippet"))
        rows = F.broadcast(hits).join(about, keys).orderBy(F.col("score").desc(), "chunk_id").collect()
        return [SearchResult(**{name: r[name] for name in _RESULT}) for r in rows]

    def _check_dims(self, embedder) -> None:
        dims = self.store.dims()
        if dims is None:
            raise RuntimeError("the index holds no vectors")
        if dims != embedder.dims:
            raise RuntimeError(f"the index holds {dims} dimensions, the embedder makes {embedder.dims}")

    def search(self, query: str, top_k: int = 10, *, embedder) -> list[SearchResult]:
        """The plain vector search joined to its chunks; hits without one are left out."""
        self._check_dims(embedder)
        chunks = self._chunks_once()
        vectors = self._vectors(embedder)
        if self.repo is not None:
            vectors = vectors.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
        return self._results(vector_topk(vectors, embedder.encode_queries([query])[0], top_k), chunks, ["chunk_id"])

    @staticmethod
    def _chunks(df: DataFrame) -> list[IndexedChunk]:
        return [IndexedChunk(*(r[f] for f in _FIELDS)) for r in df.select(*_FIELDS).collect()]

    def find_paths(self, pattern: str, *, limit: int = 50) -> list[str]:
        return [r[0] for r in find_paths(self._table("files").select("path").unionByName(self._table("chunks").select("path")), pattern, limit).collect()]

    def _searched(self, path: str | None) -> DataFrame:
        return self._chunks_once() if path is None else self._of_path(path)

    def text_search(self, text: str, *, path: str | None = None, limit: int = 20) -> list[IndexedChunk]:
        return self._chunks(text_search(self._searched(path), text, path, limit))

    def find_text_lines(self, text: str, *, path: str | None = None, limit: int = 20) -> list[TextMatch]:
        rows = find_text_lines(self._searched(path), text, path, limit).collect()
        return [TextMatch(r["path"], r["line_number"], r["text"], r["exact_line"]) for r in rows]

    def get_chunks(self, path: str, *, start_line: int | None = None, end_line: int | None = None) -> list[IndexedChunk]:
        return self._chunks(get_chunks(self._of_path(path), path, start_line, end_line))

    def get_chunks_by_ids(self, chunk_ids: Iterable[str]) -> dict[str, IndexedChunk]:
        ids = sorted(set(chunk_ids))
        if not ids:
            return {}
        wanted = self.spark.createDataFrame([(i,) for i in ids], "chunk_id string")
        return {c.chunk_id: c for c in self._chunks(self._chunks_once().join(wanted, "chunk_id", "left_semi"))}

    def get_outline(self, path: str) -> list[OutlineEntry]:
        rows = lines.outline(get_chunks(self._of_path(path), path)).orderBy("start_line", "end_line").collect()
        return [OutlineEntry(r["symbol"], r["chunk_kind"], r["start_line"], r["end_line"]) for r in rows]

    def get_source_lines(self, path: str, *, start_line: int, end_line: int) -> list[SourceLine]:
        rows = lines.source_lines(get_chunks(self._of_path(path), path, start_line, end_line), start_line, end_line).orderBy("line_number").collect()
        return [SourceLine(r["line_number"], r["text"]) for r in rows]
