"""Operator 8 [native]: sharding along a Hilbert curve.

Several metadata dimensions are quantised at equal depth, the cell's index on the Hilbert
curve orders the rows, and runs of that order become shards: each shard covers a compact
region in every dimension, so file statistics prune on all of them. Shards obey the law
``rows``: counts differ by at most one.

The global rank needs no sort in one task. Rows fall into buckets (curve index, slice,
part): a cell with many rows is cut into slices by a hash of id and text, and a slice that
is still large, because its rows repeat one id, into parts by the row's number in a written
copy. There are some ``CELLS`` + 2 * ``TARGET_BUCKETS`` buckets, whose counts are summed up,
and ranks inside a bucket are local to it.

Defined edge cases: null in a dimension sorts before all values; null text has 8 bytes and
the crc32 of the empty text; ties and repeated rows get different slots; an empty table
gives an empty result; with fewer rows than shards the last shards are empty; other columns
pass through whatever they are called, and the operator's own (``shard``, ``slot``) replace
any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ._common import materialize, ranged, table

SHARDS = 24
BITS = 4
DIMS = 3
CELLS = 1 << (BITS * DIMS)
TARGET_BUCKETS = 4096


def value_cuts(docs: DataFrame, dim: str, cells: int) -> list:
    """The values of a column at the quantiles 1/cells, 2/cells, ... of its rows, exactly: rows
    are counted by value, values are ranged and counts summed up in each range."""
    values = docs.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("times"))
    cut, parts = ranged(values, [F.col("value")], "hilbert-values")
    weights = cut.groupBy("part").agg(F.sum("times").alias("n"))
    before = weights.withColumns({"before": F.sum("n").over(W.orderBy("part")) - F.col("n"), "total": F.sum("n").over(W.partitionBy())}).drop("n")  # a row a range
    upto = cut.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("times").over(W.partitionBy("part").orderBy("value")))
    step = lambda c: F.call_function("div", c * cells, F.col("total"))
    found = upto.filter((step(F.col("upto")) > step(F.col("upto") - F.col("times"))) & (F.col("upto") < F.col("total"))).select("value").collect()  # fewer than ``cells``
    return sorted(r.value for r in found)


def hilbert_index(x: list[Column], bits: int = BITS) -> Column:
    """Distance along the Hilbert curve of a cell (Skilling's transform as one fold)."""
    n = len(x)
    names = [f"x{i}" for i in range(n)]
    as_state = lambda cols: F.struct(*[c.cast("int").alias(k) for c, k in zip(cols, names, strict=True)])
    steps = F.array(*[F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def undo(s: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        v = s[names[0]]
        for k in range(1, n):
            v = F.when(i == k, s[names[k]]).otherwise(v)
        up = v.bitwiseAND(q) != 0
        swap = F.when(up, q - 1).otherwise(s[names[0]].bitwiseXOR(v).bitwiseAND(q - 1))
        out = [s[names[0]].bitwiseXOR(swap)]
        out += [F.when((i == k) & ~up, s[names[k]].bitwiseXOR(swap)).otherwise(s[names[k]]) for k in range(1, n)]
        return as_state(out)

    def gray(s: Column) -> Column:
        out = [s[names[0]]]
        for k in range(1, n):
            out.append(s[names[k]].bitwiseXOR(out[-1]))
        return as_state(out)

    def interleave(s: Column) -> Column:
        t = F.lit(0)
        for q in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(s[names[-1]].bitwiseAND(F.lit(1 << q)) != 0, F.lit((1 << q) - 1)).otherwise(F.lit(0)))
        total = F.lit(0)
        for b in range(bits):
            for k in range(n):
                bit = F.shiftright(s[names[k]].bitwiseXOR(t), b).bitwiseAND(F.lit(1))
                total = total + F.shiftleft(bit, b * n + (n - 1 - k))
        return total

    folded = F.aggregate(steps, as_state(x), undo, gray)
    return F.transform(F.array(folded), interleave)[0].cast("long")


def quantised(docs: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """Each dimension's equal-depth cell 0 .. 2^bits - 1 as a column of ``docs``.

    The cut points, at most 2^bits - 1 for each dimension, are the only thing collected.
    Those of numbers come from a quantile sketch, all others from their value counts."""
    cells = 1 << bits
    is_number = {c: isinstance(docs.schema[c].dataType, T.NumericType) for c in dims}
    at = F.array(*[F.lit(k / cells) for k in range(1, cells)])
    numbers = [c for c in dims if is_number[c]]
    cuts = dict(zip(numbers, docs.agg(*[F.percentile_approx(c, at, 1000) for c in numbers]).first(), strict=True)) if numbers else {}
    cuts |= {c: value_cuts(docs, c, cells) for c in dims if not is_number[c]}
    return [sum([F.coalesce((F.col(c) > F.lit(e)).cast("int"), F.lit(0)) for e in sorted(set(cuts[c] or []))], F.lit(0)) for c in dims]


def hilbert_shards(docs: DataFrame, dims: list[str], n_shards: int = SHARDS, bits: int = BITS, target_buckets: int = TARGET_BUCKETS) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard)."""
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    crc = F.crc32(F.coalesce("text", F.lit(""))) if "text" in keep else F.col("text_crc32") if "text_crc32" in keep else F.lit(0)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        hilbert_index(quantised(docs, dims, bits), bits).alias("h"),
        F.pmod(F.xxhash64("doc_id", crc), F.lit(1 << 40)).alias("u"),
        F.monotonically_increasing_id().alias("number"),
    )
    rows = materialize(whole, "hilbert-rows")
    cells = materialize(rows.groupBy("h").agg(F.count("*").alias("n")), "hilbert-cells")  # at most 2^(bits * dims) rows
    total = cells.agg(F.sum("n")).first()[0] or 0
    target = max(1, -(-total // target_buckets))
    in_slices = F.floor(F.col("u") * F.ceil(F.col("n") / F.lit(target)) / F.lit(1 << 40)).cast("int")
    sliced = rows.join(F.broadcast(cells), "h").withColumn("slice", in_slices).drop("n")
    # slices that a hash of id and text leaves large, which are few, are parted by row
    slices = materialize(sliced.groupBy("h", "slice").agg(F.count("*").alias("n")), "hilbert-slices")
    parted = sliced.join(F.broadcast(slices), ["h", "slice"])
    parted = parted.withColumn("part", F.when(F.col("n") > 8 * target, F.pmod(F.xxhash64("number"), F.ceil(F.col("n") / F.lit(target)))).otherwise(0)).drop("n")
    counts = parted.groupBy("h", "slice", "part").agg(F.count("*").alias("n"))
    offsets = materialize(counts.withColumn("before", F.sum("n").over(W.orderBy("h", "slice", "part")) - F.col("n")).drop("n"), "hilbert-offsets")
    local = F.row_number().over(W.partitionBy("h", "slice", "part").orderBy("u", "number")) - 1
    ranked = parted.join(F.broadcast(offsets), ["h", "slice", "part"]).withColumn("rank", F.col("before") + local)
    q, r = divmod(total, n_shards)
    # the first r shards have q + 1 rows, the others q
    big = F.lit(r * (q + 1))
    in_big = F.col("rank") < big
    shard = F.when(in_big, F.call_function("div", F.col("rank"), F.lit(q + 1))).otherwise(F.lit(r) + F.call_function("div", F.col("rank") - big, F.lit(max(q, 1))))
    slot = F.when(in_big, F.col("rank") % F.lit(q + 1)).otherwise((F.col("rank") - big) % F.lit(max(q, 1)))
    return ranked.select(*[F.col("row")[c].alias(c) for c in keep], shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = hilbert_shards(docs, ["lang", "source", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
