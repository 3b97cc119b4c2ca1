"""An inverted-file index of vectors, with exact answers.

Vectors are dealt to the nearest of some centres and written by cell. A cell knows how near
and how far from its centre its vectors lie, so by the triangle inequality none of them can
be nearer to a query than the query's distance to the centre allows. A search scores the
cells nearest to a query, takes its k-th score as a bound, and then scores those cells, and no
others, that may hold something as good: the result is that of a full scan.

Centres are fitted on at most ``SAMPLE`` vectors, those with the smallest hash of their id;
every vector is indexed. There are at most ``MAX_CELLS`` centres, so their table is small
whatever the corpus (4,096 of 768 dimensions: 25 MB); a cell of any size is searched in blocks.

Distances are between vectors of length 1, where cosine = 1 - distance^2 / 2; a vector without
length stays as it is, scores 0 with everything, and the bound holds for it too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch_folder
from .retrieval import BLOCK, TILE_SCORES, _first_k, _least, _unit

SAMPLE = 20_000
MAX_CELLS = 4_096
ROUNDS = 12
TILE = 1_000_000  # distances of a task at a time: 8 MB
SLACK = 1e-7  # scores are rounded, and distances computed: a bound this much below still counts


def fit_centres(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds over the sample; two per square root of it unless asked."""
    rows = vectors.filter("embedding is not null").select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h", "embedding").limit(sample).collect()
    if not rows:
        return np.zeros((0, 1))
    x = _unit(np.array([r.embedding for r in rows], np.float64))
    cells = min(MAX_CELLS, len(x), cells or max(1, int(2 * len(x) ** 0.5)))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centres)[0]
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        count = np.bincount(nearest, minlength=cells)
        centres[count > 0] = _unit(total[count > 0])
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, least = np.zeros(len(x), np.int64), np.zeros(len(x))
    tile = max(1, TILE // len(centres))
    for lo in range(0, len(x), tile):
        d = _distances(x[lo : lo + tile], centres)
        at[lo : lo + tile] = d.argmin(1)
        least[lo : lo + tile] = d.min(1)
    return at, least


def bundles_of(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundles of neighbouring cells that hold about ``block`` vectors: the bundle of each cell,
    and into how many parts each bundle is cut; a cell of more than that is one by itself."""
    bundle, parts, held = [], [], 0
    for n in sizes.tolist():
        if not parts or held + n > block:
            parts.append(-(-n // block))
            held = 0
        held += n
        bundle.append(len(parts) - 1)
    return np.array(bundle, np.int64), np.array(parts, np.int64)


def _score_cells(asked: pd.DataFrame, held: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """Of each query the k best among ``held`` (cell, chunk_id, vector) in the cells it asks for."""
    held = held.sort_values(["cell", "chunk_id"], kind="stable", ignore_index=True)
    mine, theirs = (_unit(np.stack(x["vector"].to_numpy()).astype(np.float64)) for x in (asked, held))
    size = np.array([len(x) for x in asked["cells"]])
    row, cell = np.repeat(np.arange(len(asked)), size), np.concatenate(asked["cells"].to_numpy())
    by = np.argsort(cell, kind="stable")
    row, cell = row[by], cell[by]
    names, first = np.unique(held["cell"].to_numpy(), return_index=True)
    found = []
    for name, lo, hi in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(held)], strict=True):
        rows = row[np.searchsorted(cell, name, "left") : np.searchsorted(cell, name, "right")]
        tile = max(1, TILE_SCORES // (hi - lo))
        for at in range(0, len(rows), tile):
            some = rows[at : at + tile]
            r, c, loss = _least(-np.round(mine[some] @ theirs[lo:hi].T, digits), k)
            found.append((some[r], lo + c, loss))
    if not found:
        return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
    row, column, loss = (np.concatenate(x) for x in zip(*found, strict=True))
    chunk = held["chunk_id"].to_numpy()
    by = np.lexsort((chunk[column], loss, row))
    row, column, loss = row[by], column[by], loss[by]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row[top]], "chunk_id": chunk[column[top]], "score": -loss[top]})


class VectorIndex:
    """The index below one folder: ``vectors`` by cell, and ``cells`` with their centres."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Index all ``vectors`` (chunk_id, embedding, ...); rows without an embedding stay out."""
        centres = fit_centres(vectors, cells, sample)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    b["cell"], b["distance"] = _nearest(_unit(np.stack(b["embedding"].to_numpy()).astype(np.float64)), centres)
                    yield b

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        placed = vectors.filter("embedding is not null").mapInPandas(assign, f"{fields}, cell int, distance double")
        # ranges, not hashes, of the cell: a large one is written by many tasks
        placed.repartitionByRange("cell", "distance").write.partitionBy("cell").parquet(f"{self.path}/vectors")
        written = self.spark.read.schema(placed.schema).parquet(f"{self.path}/vectors")
        ring = written.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far"))
        where = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        ring.join(where, "cell").coalesce(1).write.parquet(f"{self.path}/cells")
        return self

    def _read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def _cells(self) -> pd.DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").toPandas()  # MAX_CELLS rows

    def _asked(self, queries: DataFrame, k: int, cells: pd.DataFrame, bound: bool) -> DataFrame:
        """(query_id, vector, cells): the nearest cells that hold k vectors, or, with ``bound``
        (the queries' k-th score), the others that may hold one as good. One row a query, written
        down, without those that ask for none."""
        centres, number = np.stack(cells["centre"].to_numpy()), cells["cell"].to_numpy()
        near, far, size = (cells[c].to_numpy() for c in ("near", "far", "n"))
        tile = max(1, min(1024, TILE // len(number)))

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), tile):
                    b = whole.iloc[at : at + tile]
                    x = _unit(np.stack(b["vector"].to_numpy()).astype(np.float64))
                    d = _distances(x, centres)
                    least = np.maximum(0, np.maximum(d - far, near - d))
                    best = 1 - least**2 / 2
                    order = np.argsort(d, axis=1, kind="stable")
                    before = np.cumsum(size[order], axis=1) - size[order]
                    first = np.zeros(d.shape, bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    take = ~first & (best >= b["bound"].to_numpy()[:, None] - SLACK) if bound else first
                    some = np.flatnonzero(take.any(1))
                    if not len(some):
                        continue
                    b, take = b.iloc[some], take[some]
                    yield pd.DataFrame({"query_id": b["query_id"].to_numpy(), "vector": b["vector"].to_numpy(), "cells": [number[x] for x in take]})

        kind = queries.schema["query_id"].dataType.simpleString()
        path = scratch_folder(self.spark, "asked")
        rows = queries.mapInPandas(choose, f"query_id {kind}, vector array<double>, cells array<int>")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _scored(self, asked: DataFrame, k: int, cells: pd.DataFrame, block: int, digits: int) -> DataFrame:
        """(query_id, chunk_id, score): k rows of each query and bundle of cells.

        A query's vector is sent once to a bundle, however many of its cells are asked for, so it
        is copied once for each ``block`` vectors at most, and not for each cell. A task holds one
        block of queries and one of vectors."""
        number = cells["cell"].to_numpy()
        bundle, parts = bundles_of(cells["n"].to_numpy(), block)
        place = pd.DataFrame({"cell": number.astype(np.int32), "bundle": bundle.astype(np.int32), "parts": parts[bundle].astype(np.int32)})
        placed = F.broadcast(self.spark.createDataFrame(place, "cell int, bundle int, parts int"))  # MAX_CELLS rows
        wide = asked.select("query_id", F.explode("cells").alias("cell")).join(placed, "cell")
        some, askers = [], np.zeros(len(parts), np.int64)
        for r in wide.groupBy("cell", "bundle").agg(F.count("*").alias("n")).collect():  # MAX_CELLS rows
            some.append(r.cell)
            askers[r.bundle] = max(askers[r.bundle], r.n)
        blocks = np.maximum(1, -(-askers // block))  # of queries, for each bundle

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), 64):
                    out: list[tuple] = []
                    b = whole.iloc[at : at + 64]
                    for query, vector, mine, h in zip(b["query_id"], b["vector"], b["cells"], b["h"].tolist(), strict=True):
                        mine = np.sort(mine)
                        of = bundle[np.searchsorted(number, mine)]
                        edge = np.flatnonzero(np.diff(of)) + 1
                        for piece, name in zip(np.split(mine, edge), of[np.concatenate([[0], edge])].tolist(), strict=True):
                            out += [(name, part, h % int(blocks[name]), query, vector, piece) for part in range(int(parts[name]))]
                    for lo in range(0, len(out), 4096):
                        yield pd.DataFrame(out[lo : lo + 4096], columns=["bundle", "_v", "_q", "query_id", "vector", "cells"])

        kind, id_kind = asked.schema["query_id"].dataType.simpleString(), self._read().schema["chunk_id"].dataType.simpleString()
        left = asked.withColumn("h", F.pmod(F.xxhash64("query_id"), F.lit(1 << 30))).mapInPandas(deal, f"bundle int, _v int, _q int, query_id {kind}, vector array<double>, cells array<int>")
        held = self._read().filter(F.col("cell").isin(some)).select("cell", "chunk_id", F.col("embedding").cast("array<double>").alias("vector"))
        times = self.spark.createDataFrame(place.assign(times=blocks[bundle]), "cell int, bundle int, parts int, times int")
        right = held.join(F.broadcast(times), "cell").withColumn("_v", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
        right = right.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).select("bundle", "_v", "_q", "cell", "chunk_id", "vector")

        def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
            return _score_cells(a, b, k, digits)

        by = ["bundle", "_v", "_q"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(product, f"query_id {kind}, chunk_id {id_kind}, score double")

    def search(self, queries: DataFrame, k: int, digits: int = 9, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
        """The k best of each query (query_id, embedding), as a full scan would find them, and
        the work: query_id, how many cells and vectors were scored, and how many there are.

        ``query_id`` is unique. Only the folders of asked cells are read."""
        cells = self._cells()
        q = queries.filter("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("vector"))
        if not len(cells):
            kind = queries.schema["query_id"].dataType.simpleString()
            none = lambda schema: self.spark.createDataFrame([], schema)
            return none(f"query_id {kind}, chunk_id long, score double, rank int"), none(f"query_id {kind}, cells long, scored long, vectors long")

        first = self._asked(q, k, cells, bound=False)
        found = self._scored(first, k, cells, block, digits)
        kth = _first_k(found, k).groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("m"))
        # fewer than k vectors in all: everything has been scored
        then = self._asked(q.join(kth.filter(F.col("m") == k).drop("m"), "query_id"), k, cells, bound=True)
        best = _first_k(found.unionByName(self._scored(then, k, cells, block, digits)), k)
        size = self.spark.read.parquet(f"{self.path}/cells").select("cell", "n")
        every = first.unionByName(then).select("query_id", F.explode("cells").alias("cell"))
        work = every.join(F.broadcast(size), "cell").groupBy("query_id").agg(F.count("*").alias("cells"), F.sum("n").alias("scored"))
        return best, work.withColumn("vectors", F.lit(int(cells["n"].sum())))
