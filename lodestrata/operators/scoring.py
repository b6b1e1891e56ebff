"""Vector scoring, penalties, per-query top, merging and overlap removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import is_docs_path, is_test_path
from lodestrata.schema import OVERFETCH, OVERLAP_LIMIT


def penalised(score: Column, path: Column, test_factor: Column, docs_factor: Column) -> Column:
    """Lower the score of test and documentation paths; test wins over docs."""
    factor = F.when(is_test_path(path), test_factor).when(is_docs_path(path), docs_factor).otherwise(F.lit(1.0))
    return score - (F.lit(1.0) - factor) * F.abs(score)


def score_blocks(vectors: DataFrame, queries: list[list[float]]) -> DataFrame:
    """(query_id, chunk_id, raw): the cosine of every vector and query, in double precision; NaN where a vector is zero.

    One pass over the vectors and one matrix product per Arrow batch; only ids and scores leave it.
    """
    matrix = np.asarray(queries, np.float64).reshape(len(queries), -1)
    norms = np.linalg.norm(matrix, axis=1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            with np.errstate(divide="ignore", invalid="ignore"):
                found = block @ matrix.T / np.outer(np.linalg.norm(block, axis=1), norms)
            ids = batch.column("chunk_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(len(matrix), dtype=np.int32), batch.num_rows)), ids.take(pa.array(np.repeat(np.arange(batch.num_rows), len(matrix)))), pa.array(found.ravel())],
                ["query_id", "chunk_id", "raw"],
            )
    return vectors.select("chunk_id", "vector").mapInArrow(score, "query_id int, chunk_id string, raw double")


def top_per_query(scored: DataFrame, top_k: int) -> DataFrame:
    """The best OVERFETCH * top_k of each query; planned as a partial and a final group limit."""
    ties = [c for c in ("chunk_id", "repo") if c in scored.columns]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ties)
    return scored.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= top_k * OVERFETCH).drop("__rank")


def best_per_chunk(hits: DataFrame, *carried: str) -> DataFrame:
    return hits.groupBy("chunk_id", *carried).agg(F.max("score").alias("score"))


def drop_overlaps(hits: DataFrame, within: tuple[str, ...] = ("path",)) -> DataFrame:
    """Greedy in score order: a hit goes if a kept hit of its file covers half of its lines.

    Hits of different files (columns ``within``) never meet, so the fold runs inside one
    row per file.  A row's list is as long as its file has hits, which a search bounds.
    """
    member = F.struct((-F.col("score")).alias("low"), "chunk_id", "start_line", "end_line")
    kept = F.aggregate(
        F.sort_array(F.collect_list(member)),
        F.expr("cast(array() as array<struct<low:double,chunk_id:string,start_line:int,end_line:int>>)"),
        lambda kept, c: F.when(F.exists(kept, lambda k: _covers(k, c)), kept).otherwise(F.concat(kept, F.array(c))),
    )
    return hits.groupBy(*within).agg(kept.alias("kept")).select(*within, F.inline("kept")).select(
        *[c for c in within if c != "path"], "chunk_id", "path", "start_line", "end_line", (-F.col("low")).alias("score")
    )


def _covers(kept: Column, candidate: Column) -> Column:
    shared = F.least(kept["end_line"], candidate["end_line"]) - F.greatest(kept["start_line"], candidate["start_line"]) + 1
    return F.greatest(F.lit(0), shared) / (candidate["end_line"] - candidate["start_line"] + 1) >= F.lit(OVERLAP_LIMIT)


def ranked(hits: DataFrame, top_k: int) -> DataFrame:
    ties = [c for c in ("chunk_id", "repo") if c in hits.columns]
    return hits.orderBy(F.col("score").desc(), *ties).limit(top_k)
