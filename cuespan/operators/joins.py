"""Range and nearest-neighbour joins. All have an equality on the video: the engine hashes
on it and keeps the range as a residual condition, whatever strategy it picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import tables
from . import overlap


def assign_captions(chunks: DataFrame, captions: DataFrame, bucket_seconds: float = 45.0) -> DataFrame:
    """Chunks with the captions inside [start, end), in order; a chunk without any gets the
    one nearest to its middle (the first of equals), and without captions in the video none.

    ``captions``: video_id, seq, time, caption. Those inside meet their chunks in buckets of
    time, so a pair is made for a bucket that both touch and no other; the nearest are the
    last before and the first after a middle, found by windows over the union of both."""
    held = captions.select(F.col("video_id").alias("of"), F.struct("seq", "time", "caption").alias("one"), F.col("time").alias("at"))
    number = lambda t: F.floor(t / bucket_seconds).cast("long")
    reach = chunks.select("chunk_id", F.col("video_id").alias("of"), "start_time", "end_time", F.explode(F.sequence(number(F.col("start_time")), number(F.col("end_time")))).alias("bucket"))
    pairs = reach.join(held.withColumn("bucket", number(F.col("at"))), ["of", "bucket"]).filter("at >= start_time and at < end_time")
    inside = pairs.groupBy("chunk_id").agg(F.array_sort(F.collect_list("one")).alias("inside"))
    middle = ((F.col("start_time") + F.col("end_time")) / 2).alias("at")
    alone = chunks.join(inside, "chunk_id", "left_anti").select("chunk_id", F.col("video_id").alias("of"), middle, F.lit(None).cast(held.schema["one"].dataType).alias("one"))
    first = held.groupBy("of", "at").agg(F.min("one").alias("one")).select(F.lit(None).cast("string").alias("chunk_id"), "of", "at", "one")
    by, back = W.partitionBy("of").orderBy("at", F.col("chunk_id").isNotNull()), W.partitionBy("of").orderBy(F.desc("at"), F.col("chunk_id").isNotNull())
    upto = lambda w: F.last("one", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    line = first.unionByName(alone).select("*", upto(by).alias("before"), upto(back).alias("after")).filter("chunk_id is not null")
    gap = lambda c: F.struct(F.abs(F.col(c)["time"] - F.col("at")).alias("gap"), F.col(c)["seq"].alias("seq"))
    nearer = F.when(F.col("before").isNull() | (F.col("after").isNotNull() & (gap("after") < gap("before"))), F.col("after")).otherwise(F.col("before"))
    near = line.select("chunk_id", nearer.alias("near"))
    both = chunks.join(inside, "chunk_id", "left").join(near, "chunk_id", "left")
    used = F.when(F.col("inside").isNotNull(), F.col("inside")).when(F.col("near").isNotNull(), F.array("near")).otherwise(F.slice(F.array("near"), 1, 0))
    marks = lambda u: F.array_join(F.transform(u, lambda x: F.concat(F.lit("[frame caption: "), x["caption"], F.lit("]"))), " ")
    text = F.when(F.size(used) > 0, F.concat_ws(" ", F.col("text"), marks(used))).otherwise(F.col("text"))
    shown = F.transform(used, lambda x: F.struct(x["time"].alias("time"), x["caption"].alias("caption")))
    return both.select(*[text.alias("text") if k == "text" else F.col(k) for k in chunks.columns], shown.alias("frame_captions"))


def oracle_window(hops: DataFrame, chunks: DataFrame, margin: float = 120.0) -> DataFrame:
    """Chunks that start within [max(0, hop - margin), hop + margin], ends included."""
    c = chunks.select(F.col("video_id").alias("_v"), F.col("chunk_id"), F.col("start_time").alias("chunk_start"), "text")
    near = F.col("chunk_start").between(F.greatest(F.lit(0.0), F.col("start") - margin), F.col("start") + margin)
    return hops.join(c, (F.col("video_id") == F.col("_v")) & near).drop("_v")


def chosen_chunks(spans: DataFrame, chunks: DataFrame, within: float = 50.0) -> DataFrame:
    """(video_id, start, end, chunk_seq, chunk_id) of each different span (video_id, start, end)
    for which there is one: the first chunk, in chunk order, that contains it; else the one
    that starts nearest, if nearer than ``within``.

    A span is looked up once, whatever number of rows has it, and of the chunks with one start
    and end only the first can be chosen, so pairs are made of different spans and different
    times, not of rows. Both kinds of candidates come from equi joins on cells of time, and one
    aggregate picks: the first of those that hold the span, or the nearest of the others."""
    key = ["video_id", "start", "end"]
    asked = spans.select(*key).distinct()
    first = chunks.groupBy("video_id", "start_time", "end_time").agg(F.min(F.struct("seq", "chunk_id")).alias("one"))
    gap = F.abs(F.col("c_start_time") - F.col("start"))
    pick = lambda tier, a: F.struct(F.lit(tier).alias("tier"), a.cast("double").alias("a"), F.col("c_one").alias("one")).alias("pick")
    holding = overlap.holding_join(asked, first).select(*key, pick(0, F.col("c_one.seq")))
    near = overlap.near_candidates(asked, first, within).select(*key, pick(1, gap))
    best = holding.unionByName(near).groupBy(*key).agg(F.min("pick").alias("pick"))
    return best.select(*key, F.col("pick.one.seq").alias("chunk_seq"), F.col("pick.one.chunk_id").alias("chunk_id"))


def with_chosen_texts(spans: DataFrame, chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """Different rows of ``spans`` with chunk_seq and chunk_text of their chunk in ``chosen``, null
    without one. ``texts`` (chunk_id, text) stay where they are read unless many are chosen."""
    spark, path = spans.sparkSession, tables.scratch_folder(spans.sparkSession, "chosen")
    chosen.write.parquet(path)  # so that the engine knows its size: it broadcasts few, and shuffles many
    chosen = spark.read.schema(chosen.schema).parquet(path)
    found = texts.select("chunk_id", "text").join(chosen.select("chunk_id").distinct(), "chunk_id")
    one = found.groupBy("chunk_id").agg(F.min(F.struct("text")).alias("one"))
    named = chosen.join(one, "chunk_id", "left").select(F.col("video_id").alias("_v"), F.col("start").alias("_s"), F.col("end").alias("_e"), "chunk_seq", F.col("one.text").alias("chunk_text"))
    same = (F.col("video_id") == F.col("_v")) & (F.col("start") == F.col("_s")) & F.col("end").eqNullSafe(F.col("_e"))
    return spans.distinct().join(named, same, "left").select(*spans.columns, "chunk_seq", "chunk_text")


def containing_or_near(spans: DataFrame, chunks: DataFrame, within: float = 50.0) -> DataFrame:
    """For each span (video_id, span_id, start, end) the first chunk, in chunk order, that
    contains it; else the one that starts nearest, if nearer than ``within``; else none."""
    c = chunks.withColumn("chunk_id", F.struct("video_id", "seq", "start_time", "end_time"))
    return with_chosen_texts(spans, chosen_chunks(spans, c.drop("text"), within), c)


def lookup_texts(rows: DataFrame, chunks: DataFrame, key: str, ids: str = "source_chunk_ids", default: str = "[chunk text not found]") -> DataFrame:
    """Texts of a row's chunk ids in their order, duplicates kept, missing ones by default."""
    wide = rows.select(F.col(key), F.posexplode(ids).alias("_pos", "chunk_id"))
    found = wide.join(chunks.select("chunk_id", F.col("text").alias("_text")), "chunk_id", "left")
    texts = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_text", F.lit(default)).alias("_text")))).alias("_t"))
    return rows.join(texts.select(key, F.transform("_t", lambda x: x["_text"]).alias("texts")), key, "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def with_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left lookup by video; the engine broadcasts the metadata while it is small."""
    return rows.join(metadata, "video_id", "left")


def with_every_config(pairs: DataFrame, configs: tuple[str, ...]) -> DataFrame:
    """Each pair under each configuration: an explode of a literal, no join."""
    return pairs.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs])))


def counts_with_zero(keys: DataFrame, rows: DataFrame, key: str = "video_id") -> DataFrame:
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return keys.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_rn = 1").drop("_rn")
