"""Operator 11: a Merkle manifest of a dataset, with a proof for every row.

A row is a leaf: the digest of its fields. The leaves of a group (a source) are numbered in
the order of doc_id, and every ``FAN`` consecutive nodes have one parent, until one node is
left, the subroot; the subroots, in the order of their sources, have a root alike.

A task never sees more than one aligned block of ``FAN ** HEIGHT`` nodes of a group. It
walks the block in postorder, recursively: children first, then the digest of the node, and
while unwinding the siblings are appended to the leaves below. The roots of blocks are the
nodes of the next distributed traversal; 3 * 10^10 leaves take three. On the way down each
block is given its root's path (the siblings from there to the top, a few KB) and walked
again, so paths of leaves are never stored.

Defined edge cases: null fields are written as ``-``; a null source is a group, the first; a
null doc_id comes last in its group and is not tampered with; rows with one doc_id are
ordered by their digests, so repeated rows change the root; an empty table gives an empty
result; other columns are ignored, so two tables that differ only there have one root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialize, ranged, table

FAN = 16
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "grp string, pos long, n long, digest string"
_PATH = "grp string, pos long, path string, subroot string, root string"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of the fields, each with its length before it, so no two rows are written alike."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def postorder(digests: list[str], n: int, height: int, seen: Callable[[int, int, str, str], None] | None = None) -> str:
    """Digest of the node over all ``digests``. ``n`` is how many nodes of this level the group
    has: a group in one block ends at one node, the others climb ``height`` levels.
    ``seen`` is told (first, last + 1, left, right): the siblings of a child over those leaves."""

    def walk(lo: int, hi: int, level: int) -> str:
        if not level:
            return digests[lo]
        step = FAN ** (level - 1)
        starts = range(lo, hi, step)
        below = [walk(at, min(at + step, hi), level - 1) for at in starts]
        if seen:
            for j, at in enumerate(starts):
                seen(at, min(at + step, hi), "".join(below[:j]), "".join(below[j + 1 :]))
        return digest_of("".join(below))

    if n <= FAN**height:
        height = next(h for h in range(height + 1) if FAN**h >= n)
    return walk(0, len(digests), height)


def paths_in_block(digests: list[str], n: int, height: int) -> list[str]:
    """For each leaf its siblings, level by level: ``left:right;`` for each level."""
    paths: list[list[str]] = [[] for _ in digests]

    def seen(lo: int, hi: int, left: str, right: str) -> None:
        part = f"{left}:{right};"
        for i in range(lo, hi):
            paths[i].append(part)

    postorder(digests, n, height, seen)
    return ["".join(p) for p in paths]


def proof(path: str) -> str:
    return digest_of(path.replace(":", "").replace(";", ""))


def fold(leaf: str, path: str) -> str:
    """The root that follows from a leaf and its path."""
    for level in path.split(";")[:-1]:
        left, right = level.split(":")
        leaf = digest_of(left + leaf + right)
    return leaf


def numbered(rows: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """``rows`` with ``pos``, their place in ``grp`` by ``order``, and ``n``, its size: numbers
    inside ranges of the order, and an offset for each range and group."""
    cut, _ = ranged(rows, [F.col("grp"), *order], tag)
    sizes = cut.groupBy("grp", "part").agg(F.count("*").alias("m"))
    whole = W.partitionBy("grp")
    sizes = sizes.select("grp", "part", (F.sum("m").over(whole.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(whole).alias("n"))
    place = F.row_number().over(W.partitionBy("grp", "part").orderBy(*order)) - 1
    return cut.withColumn("place", place).join(sizes, ["grp", "part"]).withColumn("pos", F.col("place") + F.col("before")).drop("place", "before", "part")


def block(height: int) -> Column:
    return F.call_function("div", F.col("pos"), F.lit(FAN**height)).alias("block")


def climb(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Levels of block roots (grp, pos, n, digest) above ``nodes``, which are the first of
    them; the last has one node a group."""

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("pos"), int(rows["n"].iloc[0])
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "n": [-(-n // FAN**height)], "digest": [postorder(rows["digest"].tolist(), n, height)]})

    levels = [nodes.select("grp", "pos", "n", "digest")]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        levels.append(materialize(levels[-1].groupBy("grp", block(height)).applyInPandas(up, _NODE), "merkle-roots"))
        most = -(-most // FAN**height)
    return levels


def descend(levels: list[DataFrame], paths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """From the paths of the last level's nodes to those of the first one's."""

    def down(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, top = rows.sort_values("pos"), above.iloc[0]
        found = paths_in_block(rows["digest"].tolist(), int(rows["n"].iloc[0]), height)
        return pd.DataFrame({"grp": rows["grp"], "pos": rows["pos"], "path": [p + top["path"] for p in found], "subroot": top["subroot"], "root": top["root"]})

    for nodes in reversed(levels):
        paths = nodes.groupBy("grp", block(height)).cogroup(paths.groupBy("grp", F.col("pos").alias("block"))).applyInPandas(down, _PATH)
    return paths


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``leaves`` (doc_id, grp, digest, test) with the digests above them.

    Returned: doc_id, leaf, subroot, root, path (the siblings, as ``paths_in_block`` writes
    them), proof_sha256, folded_root and verified; folded_root follows from ``test``, the
    digest that a reader found, and the path."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("digest"), F.col("test")]
    rows = materialize(numbered(leaves, order, "merkle-leaves"), "merkle-numbered")
    levels = climb(rows, height)
    tops = levels[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    tops = materialize(numbered(tops, [F.col("of")], "merkle-tops"), "merkle-subroots")
    over = climb(tops, height)
    root = over[-1].select("grp", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    # the last level's own nodes have the empty path: descend from the level below
    found = descend(over[:-1], root, height).join(tops.select("pos", "of", "digest"), "pos")
    start = materialize(found.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"), "merkle-paths")
    # block roots above the leaves get their paths; the leaves' own are made where they are used
    above = descend(levels[1:-1], start, height) if len(levels) > 1 else start

    def leaf_rows(key: tuple, some: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        some, top = some.sort_values("pos"), top.iloc[0]
        inner = paths_in_block(some["digest"].tolist(), int(some["n"].iloc[0]), height)
        paths = [p + top["path"] for p in inner]
        folded = [fold(t, p) for t, p in zip(some["test"], paths, strict=True)]
        out = pd.DataFrame({"doc_id": some["doc_id"], "leaf": some["digest"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": [proof(p) for p in paths], "folded_root": folded})
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out.assign(verified=out["folded_root"] == top["root"])

    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.groupBy("grp", block(height)).cogroup(above.groupBy("grp", F.col("pos").alias("block"))).applyInPandas(leaf_rows, out)


def document_leaves(docs: DataFrame) -> DataFrame:
    """A leaf a document, grouped by source (null first, then in the order of its bytes). The
    document is tampered with where 5 divides the crc32 of its id: its text loses its capitals."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("grp"),
        leaf_digest([F.col(c) for c in FIELDS]).alias("digest"),
        F.when(hit, leaf_digest(other)).alias("test"),
    ).withColumn("test", F.coalesce("test", "digest"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(materialize(document_leaves(table(spark, sf_dir, "documents")), "merkle-digests"))


def oracle(levels: int = 5, tops: int = 3) -> str:
    """DuckDB SQL of op11, for groups of up to 16 ** levels leaves."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"
    parts = [f"""c AS (SELECT *, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END) AS crc FROM documents),
s AS (SELECT doc_id, coalesce('s' || source, '') AS k, {leaf("text")} AS leaf, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {leaf("text")} END AS cur FROM c),
g0 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, '' AS proof FROM s),
a0 AS (SELECT k, pos, leaf AS d, count(*) OVER (PARTITION BY k) AS n FROM g0)"""]

    def tree(a: str, count: int) -> None:
        for i in range(count):
            run = "OVER (PARTITION BY k, pos // 16 ORDER BY pos ROWS BETWEEN"
            parts.append(f"""{a}{i + 1} AS (SELECT k, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d, (any_value(n) + 15) // 16 AS n FROM {a}{i} GROUP BY k, pos // 16),
{a}s{i} AS (SELECT k, pos, n, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a}{i})""")

    def folded(g: str, a: str, count: int, key: str) -> None:
        for i in range(count):
            parts.append(f"""{g}{i + 1} AS (SELECT g.* REPLACE (CASE WHEN x.n = 1 THEN g.cur ELSE sha256(x.l || g.cur || x.r) END AS cur, g.proof || x.l || x.r AS proof) FROM {g}{i} g JOIN {a}s{i} x ON x.k = {key} AND x.pos = g.pos // {16**i})""")

    tree("a", levels)
    folded("g", "a", levels, "g.k")
    parts.append(f"t0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS pos, d, count(*) OVER () AS n, k AS src FROM a{levels})")
    tree("t", tops)
    parts.append(f"h0 AS (SELECT g.* REPLACE (t0.pos AS pos), t0.d AS subroot FROM g{levels} g JOIN t0 ON t0.src = g.k)")
    folded("h", "t", tops, "''")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = d AS verified FROM h{tops}, (SELECT d FROM t{tops})"""
