"""Connected components of an edge table, without collecting edges anywhere.

Each round contracts the edges of every partition by union-find, then does one large-star
and one small-star step (Kiveris et al. 2014), and is written to the shared folder; the
rounds end when the edges no longer change, and are then stars around their smallest node.
Partitions are cut by the number of edges (``EDGES_A_TASK``), not by the engine's number of
shuffle partitions: few edges are contracted in few tasks, and in one the answer is there.

Defined edge cases: an edge with a null, or from a node to itself, connects nothing;
repeated edges count once; without edges the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

_SCHEMA = "u long, v long, part int"
#: Bounds the union-find of a task: some 80 MB of a Python worker.
EDGES_A_TASK = 250_000


def spanning_stars(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for the nodes of ``pairs``, roots left out."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def pairs() -> Iterator[tuple[int, int]]:
        for b in batches:
            yield from zip(b["u"].tolist(), b["v"].tolist(), strict=True)

    context = TaskContext.get()
    found = pd.DataFrame(spanning_stars(pairs()), columns=["u", "v"], dtype="int64")
    yield found.assign(part=context.partitionId() if context else 0)


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    """Edges, a sum of their hashes, and how many partitions they were contracted in."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.count_distinct("part").alias("p")).first()
    return r.n, int(r.s or 0), r.p


def connected_components(edges: DataFrame, tag: str = "components", max_rounds: int = 60, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """From edges (u, v) of longs: (u, v) with v the smallest node of u's component, for
    every node but the smallest ones themselves."""
    now = materialize(edges.select("u", "v").filter("u <> v").distinct().mapInPandas(_contract, _SCHEMA), tag)
    mark = _mark(now)
    for _ in range(max_rounds):
        tasks = -(-mark[0] // edges_a_task)
        if 1 < mark[2] and tasks <= mark[2] // 2:  # what many tasks left fits fewer ones
            now = materialize(now.select("u", "v").coalesce(tasks).mapInPandas(_contract, _SCHEMA), tag)
            mark = _mark(now)
        if mark[2] <= 1:  # all edges were in one partition: its stars are the answer
            return now.select("u", "v")
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        step = small.filter("u <> v").distinct().mapInPandas(_contract, _SCHEMA)
        after = materialize(step, tag)
        new = _mark(after)
        if new[:2] == mark[:2]:
            return after.select("u", "v")
        now, mark = after, new
    raise RuntimeError("components did not settle")
