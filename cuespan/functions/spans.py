"""Interval algebra as Column expressions, and the relational coalesce.

A span is a struct with ``start`` and ``end`` in seconds; lists of spans are arrays. All
of it stays in the engine: higher-order functions within a row, windows across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def overlap(ps: Column, pe: Column, gs: Column, ge: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(pe, ge) - F.greatest(ps, gs))


def temporal_iou(ps: Column, pe: Column, gs: Column, ge: Column) -> Column:
    """Intersection over union of two intervals; 0 where the union has no length."""
    inter = overlap(ps, pe, gs, ge)
    union = (pe - ps) + (ge - gs) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def iou_at(ps: Column, pe: Column, gs: Column, ge: Column, threshold: float) -> Column:
    return temporal_iou(ps, pe, gs, ge) >= F.lit(float(threshold))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end")))


def merge_spans(spans: Column) -> Column:
    """Coalesce spans that overlap or touch; sorted; null counts as empty."""
    kind = "array<struct<start:double,end:double>>"
    empty = F.array().cast(kind)

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(F.array_sort(F.coalesce(_plain(spans), empty)), empty, add)


def total_length(merged: Column) -> Column:
    return F.aggregate(merged, F.lit(0.0), lambda acc, s: acc + (s["end"] - s["start"]))


def intersection_length(a: Column, b: Column) -> Column:
    """Shared length of two coalesced lists."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.aggregate(b, F.lit(0.0), lambda t, y: t + overlap(x["start"], x["end"], y["start"], y["end"])))


def bounding_span(spans: Column) -> Column:
    """Smallest start and largest end; (0, 0) for no spans."""
    at = lambda f, name: F.coalesce(f(F.transform(spans, lambda s: s[name].cast("double"))), F.lit(0.0)).alias(name)
    return F.struct(at(F.array_min, "start"), at(F.array_max, "end"))


def union_iou(predicted: Column, truth: Column) -> Column:
    """IoU of the two lists' unions; 0 if either is empty."""
    pair = F.array(F.struct(merge_spans(predicted).alias("p"), merge_spans(truth).alias("g")))
    sizes = F.transform(pair, lambda x: F.struct(intersection_length(x["p"], x["g"]).alias("i"), total_length(x["p"]).alias("p"), total_length(x["g"]).alias("g")))
    return F.transform(sizes, lambda x: F.when(x["p"] + x["g"] - x["i"] > 0, x["i"] / (x["p"] + x["g"] - x["i"])).otherwise(F.lit(0.0)))[0]


def per_hop_iou(predicted: Column, hops: Column) -> Column:
    """Mean over hops of the best IoU with any predicted span; 0 if either is empty."""
    best = F.transform(hops, lambda g: F.array_max(F.transform(predicted, lambda p: temporal_iou(p["start"], p["end"], g["start"], g["end"]))))
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(hops)
    return F.when((F.size(hops) > 0) & (F.size(predicted) > 0), mean).otherwise(F.lit(0.0))


def covers(chunks: Column, hop: Column, threshold: float) -> Column:
    """Does any chunk reach the IoU threshold with the hop? Stops at the first that does."""
    return F.exists(chunks, lambda c: iou_at(c["start"], c["end"], hop["start"], hop["end"], threshold))


def hit(chunks: Column, hops: Column, threshold: float) -> Column:
    return F.coalesce(F.exists(hops, lambda g: covers(chunks, g, threshold)), F.lit(False))


def hop_recall(chunks: Column, hops: Column, threshold: float) -> Column:
    """Share of hops that some chunk covers; 0 without hops."""
    return F.when(F.size(hops) > 0, F.size(F.filter(hops, lambda g: covers(chunks, g, threshold))) / F.size(hops)).otherwise(F.lit(0.0))


def complete(chunks: Column, hops: Column, threshold: float) -> Column:
    return (F.size(hops) > 0) & F.forall(hops, lambda g: covers(chunks, g, threshold))


def merge_islands(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Relational coalesce of long span lists: one row for each island of a key."""
    order = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    # of equal spans the one that opens an island comes first, whatever their order above
    again = W.partitionBy(key).orderBy(start, end, F.desc("_new"))
    numbered = opened.withColumn("_island", F.sum("_new").over(again.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("_island")
