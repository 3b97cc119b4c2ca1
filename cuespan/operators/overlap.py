"""Interval joins on a dyadic grid.

A span lies in one cell: its level is the power of two below its length, its cell the place
of its start in units of that level's width. A partner's length and start are bounded by the
predicate, so a span meets a few cells of a few levels by equality, whatever the number of
spans of a video; the exact predicate is the residual of that join. Each pair of rows meets
in one cell at most, so nothing is found twice.

Spans without a length, with a missing end or with an end before the start meet nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import temporal_iou
from ..sources import tables

BLOCK = 1024  # rows of a key on one side of a block of pairs
PAIRS = 1_000_000  # of a task, about
MAX_PARTS = 100_000
LEAST = 2.0**-20  # shorter chunks lie on the level of this length
SLACK = 1e-9  # for the rounding of logarithms and of starts


def level_of(length: Column) -> Column:
    return F.floor(F.log2(F.greatest(length, F.lit(LEAST)))).cast("int")


def _cells(low: Column, high: Column, width: Column) -> Column:
    return F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))


def iou_candidates(left: DataFrame, right: DataFrame, threshold: float, key: str = "video_id") -> DataFrame:
    """The pairs that an IoU of ``threshold`` or more allows by length and start.

    left: key, left_id, start, end; right: key, right_id, start, end. A partner's length is
    between t and 1/t of a span's, and the two starts differ by (1 - t)/t of the shorter
    length at most, as what only one of the two covers is that much of what both cover."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    ratio = (1 - threshold) / threshold
    # cells of a level are as wide as the starts of partners may differ there, so three are met
    width = lambda level: F.pow(F.lit(2.0), level + 1) * max(ratio, 0.25)
    a = left.select(F.col(key), "left_id", F.col("start").alias("ls"), F.col("end").alias("le")).filter("le > ls")
    b = right.select(F.col(key), "right_id", F.col("start").alias("rs"), F.col("end").alias("re")).filter("re > rs").withColumn("level", level_of(F.col("re") - F.col("rs")))
    b = b.withColumn("cell", F.floor(F.col("rs") / width(F.col("level"))).cast("long"))
    length = F.col("le") - F.col("ls")
    lowest = F.floor(F.log2(F.greatest(length * threshold, F.lit(LEAST))) - SLACK).cast("int")
    highest = F.floor(F.log2(F.greatest(length / threshold, F.lit(LEAST))) + SLACK).cast("int")
    a = a.withColumn("level", F.explode(F.sequence(lowest, highest)))
    reach = F.least(length, F.pow(F.lit(2.0), F.col("level") + 1)) * ratio * (1 + SLACK) + SLACK
    a = a.withColumn("cell", F.explode(_cells(F.col("ls") - reach, F.col("ls") + reach, width(F.col("level")))))
    return a.join(b, [key, "level", "cell"])


def iou_join(left: DataFrame, right: DataFrame, threshold: float, key: str = "video_id") -> DataFrame:
    """(key, left_id, right_id, iou) of all pairs of one key whose IoU reaches the threshold."""
    iou = temporal_iou(F.col("ls"), F.col("le"), F.col("rs"), F.col("re"))
    return iou_candidates(left, right, threshold, key).select(key, "left_id", "right_id", iou.alias("iou")).filter(F.col("iou") >= threshold)


def holding_candidates(spans: DataFrame, chunks: DataFrame, key: str = "video_id") -> DataFrame:
    """Spans with the chunks (key, start_time, end_time, ...) whose cell may hold their start:
    of each level that chunks have two cells. Chunks' columns come with a ``c_`` before them."""
    held = chunks.select(F.col(key), *[F.col(c).alias(f"c_{c}") for c in chunks.columns if c != key])
    held = held.filter("c_end_time >= c_start_time").withColumn("level", level_of(F.col("c_end_time") - F.col("c_start_time")))
    levels = sorted(r.level for r in held.select("level").distinct().collect())  # of a double's exponents: 1,044 at most
    width = lambda level: F.pow(F.lit(2.0), level + 1)
    held = held.withColumn("cell", F.floor(F.col("c_start_time") / width(F.col("level"))).cast("long"))
    # a chunk holds no longer span than itself
    shortest = F.floor(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(LEAST))) - SLACK)
    asked = spans.filter("end >= start").withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).filter(F.col("level") >= shortest)
    at = F.floor(F.col("start") / width(F.col("level"))).cast("long")
    return asked.withColumn("cell", F.explode(F.array(at, at - 1))).join(held, [key, "level", "cell"]).drop("level", "cell")


def holding_join(spans: DataFrame, chunks: DataFrame, key: str = "video_id") -> DataFrame:
    """Every pair of a span and a chunk that holds it whole, ends included."""
    return holding_candidates(spans, chunks, key).filter("c_start_time <= start and c_end_time >= end")


def near_candidates(spans: DataFrame, chunks: DataFrame, within: float, key: str = "video_id") -> DataFrame:
    """Spans with the chunks that start nearer than ``within`` to their start: three cells."""
    held = chunks.select(F.col(key), *[F.col(c).alias(f"c_{c}") for c in chunks.columns if c != key])
    held = held.withColumn("cell", F.floor(F.col("c_start_time") / within).cast("long"))
    at = F.floor(F.col("start") / within).cast("long")
    asked = spans.withColumn("cell", F.explode(F.array(at - 1, at, at + 1)))
    return asked.join(held, [key, "cell"]).drop("cell").filter(F.abs(F.col("c_start_time") - F.col("start")) < within)


def all_pairs(left: DataFrame, right: DataFrame, scores: Callable[[tuple[Column, ...]], dict[str, Column]], key: str = "video_id", block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """Every pair of one key: key, left_id, right_id, and ``scores`` of (rs, re, ls, le).

    left: key, left_id, start, end; right: key, right_id, start, end. That is as many rows as
    it says, so it is dealt out: both sides of a key are cut into blocks by a hash of their
    ids, and pairs of blocks are spread over as many tasks as the pairs ask for, whatever the
    size of a key. Inside a block rows of one span lie together: a score is computed once for
    two different spans, and the ids are paired after it."""
    names = lambda rows, side: rows.select(key, F.col(f"{side}_id"), F.col("start").alias(f"{side[0]}s"), F.col("end").alias(f"{side[0]}e"))
    count = lambda rows, to: rows.groupBy(key).agg(F.count("*").alias(to))
    folder = tables.scratch_folder(left.sparkSession, "pairs")
    count(left, "nl").join(count(right, "nr"), key).write.parquet(folder)
    sizes = left.sparkSession.read.parquet(folder)
    total = sizes.agg(F.sum(F.col("nl").cast("double") * F.col("nr"))).first()[0] or 0
    parts = max(1, min(MAX_PARTS, int(-(-total // pairs))))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")

    def dealt(side: str, rows: DataFrame, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        rows = names(rows, side).join(sizes, key).withColumn(own, F.pmod(F.xxhash64(f"{side}_id"), blocks(mine)).cast("int"))
        span = [f"{side[0]}s", f"{side[0]}e"]
        held = rows.groupBy(key, own, *span, blocks(theirs).alias("_n")).agg(F.collect_list(f"{side}_id").alias(f"{side}_ids"))
        return held.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n").repartition(parts, key, "_l", "_r")

    met = dealt("left", left, "_l", "nl", "_r", "nr").join(dealt("right", right, "_r", "nr", "_l", "nl"), [key, "_l", "_r"])
    found = scores((F.col("rs"), F.col("re"), F.col("ls"), F.col("le")))
    each = met.select(key, "left_ids", "right_ids", *[c.alias(k) for k, c in found.items()])
    one = each.select(key, F.explode("left_ids").alias("left_id"), "right_ids", *found)
    return one.select(key, "left_id", F.explode("right_ids").alias("right_id"), *found)
