"""Exact cosine top-k.

``grid_topk`` is the way for any size: blocks of queries meet blocks of vectors of the same
key in one task each, as a matrix product, and pass on k rows a query, which are merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_QUERIES = 10_000
BLOCK = 8192  # rows of a block of the grid: with 768 dimensions some 50 MB
TILE_SCORES = 2_000_000  # of a task at a time: 16 MB


def grid_topk(queries: DataFrame, vectors: DataFrame, k: int, on: list[str], block: int = BLOCK, digits: int = 9, exclude_self: bool = False, partial: bool = False) -> DataFrame:
    """The k best ``vectors`` (``on``, chunk_id, vector, ...) of each of the ``queries`` (``on``,
    query_id, vector) among those equal in ``on``: query_id, the vectors' columns, score, rank.

    Both sides are cut into blocks of about ``block`` rows a key by a hash of their ids; a row
    is sent to every block of the other side, so a task holds two blocks, whatever the size of
    a key. Scores are rounded to ``digits``, ties go to the smaller chunk_id; a vector without
    length scores 0. Null keys meet nothing; rows without a vector are left out. ``partial``
    leaves out the merge: k rows a query and block, unranked."""
    rest = [c for c in vectors.columns if c not in (*on, "chunk_id", "vector")]
    q, v = queries.select(*on, "query_id", "vector").filter("vector is not null"), vectors.filter("vector is not null")
    count = lambda rows, to: rows.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias(to))
    sizes = count(q, "_nq").join(count(v, "_nv"), on)
    dealt = lambda rows, key, own, mine, n, other, m: rows.join(sizes, on).withColumn(mine, F.pmod(F.xxhash64(key), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).select(*[F.col(c).alias(c) for c in (*on, mine, other, *own)])
    # aliases: both sides may come from one table
    left = dealt(q, "query_id", ["query_id", "vector"], "_q", "_nq", "_v", "_nv")
    right = dealt(v, "chunk_id", ["chunk_id", "vector", *rest], "_v", "_nv", "_q", "_nq")
    names = [*on, "query_id", "chunk_id", *rest, "score"]

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names})
        b = b.sort_values("chunk_id", kind="stable", ignore_index=True)
        ids, chunk = a["query_id"].to_numpy(), b["chunk_id"].to_numpy()
        mine, theirs = _unit(np.stack(a["vector"].to_numpy()).astype(np.float64)), _unit(np.stack(b["vector"].to_numpy()).astype(np.float64)).T
        tile, found = max(1, TILE_SCORES // len(chunk)), []
        for at in range(0, len(ids), tile):
            loss = -np.round(mine[at : at + tile] @ theirs, digits)
            if exclude_self:
                loss[ids[at : at + tile, None] == chunk[None, :]] = np.inf
            rows, columns, loss = _least(loss, k)
            found.append((at + rows, columns, -loss))
        rows, columns, score = (np.concatenate(x) for x in zip(*found, strict=True))
        out = b.iloc[columns][[*on, "chunk_id", *rest]].reset_index(drop=True)
        out["query_id"], out["score"] = ids[rows], score
        return out[np.isfinite(score)][names]

    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *vectors.schema)}
    by = [*on, "_q", "_v"]
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(product, ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in names))
    return best if partial else _first_k(best, k, on)


def topk_views(queries: DataFrame, corpus: DataFrame, k: int, views: dict[str, Callable[[Column], Column]], exclude_self: bool = False, digits: int = 9) -> DataFrame:
    """Top k of the query's own video under several configurations: ``views`` names each and
    says what it makes of an embedding.

    queries: query_id, video_id, embedding; corpus: chunk_id, video_id, embedding, .... Each
    view of a vector is made once, and a video's blocks are scored as matrix products."""

    def viewed(rows: DataFrame, *keep: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(name).alias("config"), view(F.col("embedding")).cast("array<double>").alias("vector")) for name, view in views.items()])
        return rows.select(*keep, F.inline(each))

    kept = [c for c in corpus.columns if c != "embedding"]
    return grid_topk(viewed(queries, "video_id", "query_id"), viewed(corpus, *kept), k, ["video_id", "config"], digits=digits, exclude_self=exclude_self)


def topk_within(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, digits: int = 9) -> DataFrame:
    """``topk_views`` of the embeddings as they are."""
    return topk_views(queries, corpus, k, {"as is": lambda x: x}, exclude_self, digits).drop("config")


def _least(loss: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and loss of the k smallest of each row, ties by column: all that are as good
    as the k-th, and of these the first k."""
    last = min(k, loss.shape[1]) - 1
    row, column = np.nonzero(~(loss > np.partition(loss, last, axis=1)[:, last : last + 1]))
    best = np.lexsort((column, loss[row, column], row))
    row, column = row[best], column[best]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, column = row[top], column[top]
    return row, column, loss[row, column]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _scan(rows: list[Row], queries: DataFrame, corpus: DataFrame, k: int, digits: int) -> DataFrame:
    """(query_id, chunk_id, score): of each batch of the corpus the k best of every query in ``rows``."""
    ids = np.array([r.query_id for r in rows])
    matrix = _unit(np.array([r.embedding for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not len(ids):
                continue
            chunk = b["chunk_id"].to_numpy()
            order = np.argsort(chunk, kind="stable")
            chunk, vectors = chunk[order], _unit(np.stack(b["embedding"].to_numpy()).astype(np.float64))[order].T
            tile = max(1, TILE_SCORES // len(chunk))
            for at in range(0, len(ids), tile):
                q, c, loss = _least(-np.round(matrix[at : at + tile] @ vectors, digits), k)
                yield pd.DataFrame({"query_id": ids[at + q], "chunk_id": chunk[c], "score": -loss})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return corpus.select("chunk_id", "embedding").mapInPandas(run, f"query_id {kind(queries, 'query_id')}, chunk_id {kind(corpus, 'chunk_id')}, score double")


def _first_k(best: DataFrame, k: int, on: list[str] | None = None) -> DataFrame:
    order = W.partitionBy("query_id", *(on or [])).orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topk_scan(queries: DataFrame, corpus: DataFrame, k: int, max_queries: int = MAX_QUERIES, digits: int = 9) -> DataFrame:
    """Top k over the whole corpus for a stated, bounded query set.

    The query matrix (at most ``max_queries`` rows, or an error) goes to every task; each
    block of the corpus is one matrix product, and a task passes on k rows a query.
    ``topk_blocks`` takes any number of queries."""
    rows = queries.select("query_id", "embedding").limit(max_queries + 1).collect()
    if len(rows) > max_queries:
        raise ValueError(f"more than {max_queries} queries: split the query set")
    return _first_k(_scan(rows, queries, corpus, k, digits), k)


def topk_blocks(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK, digits: int = 9) -> DataFrame:
    """Top k over the whole corpus for any number of queries: one grid of blocks. Nothing goes
    through the driver, and the plan is the same for any number of rows."""
    rows = lambda df, key: df.select(F.lit(0).alias("_all"), key, F.col("embedding").alias("vector"))
    return grid_topk(rows(queries, "query_id"), rows(corpus, "chunk_id"), k, ["_all"], block, digits).drop("_all")


def prefixes(hits: DataFrame, ks: tuple[int, ...], key: str = "query_id") -> DataFrame:
    """One retrieval, every k: rows (key, k) with the first k hits in rank order."""
    ranked = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("_h"))
    return ranked.select(key, F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "_h").select(key, "k", F.transform(F.slice("_h", F.lit(1), F.col("k")), lambda x: x["chunk_id"]).alias("chunk_ids"))
