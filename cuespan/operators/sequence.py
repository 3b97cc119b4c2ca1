"""Caption cues to segments, segments to chunks, frame grids and sample times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import chunk_id, frame_id

LAST_SECONDS = 3.0


def display_phrases(cues: DataFrame, is_display: Column | None = None) -> DataFrame:
    """Display cues (shorter than 0.1 s) with their first line; a video without any falls
    back to all its cues and their last line."""
    short = is_display if is_display is not None else F.col("end") - F.col("start") < 0.1
    marked = cues.withColumn("_short", F.coalesce(short, F.lit(False)))
    any_short = F.max("_short").over(W.partitionBy("video_id"))
    chosen = marked.withColumn("_any", any_short).filter(F.col("_short") | ~F.col("_any"))
    line = F.when(F.col("_any"), F.col("text_lines")[0]).otherwise(F.element_at("text_lines", -1))
    return chosen.select("video_id", "seq", "start", line.alias("text"))


def segments_of(phrases: DataFrame) -> DataFrame:
    """Each phrase ends where the next one, dropped or not, begins; repeats of the phrase
    before are dropped afterwards, so gaps stay."""
    order = W.partitionBy("video_id").orderBy("seq")
    ended = phrases.select("*", F.coalesce(F.lead("start").over(order), F.col("start") + LAST_SECONDS).alias("end"), F.lag("text", 1, "").over(order).alias("_before"))
    return ended.filter(~F.col("text").eqNullSafe(F.col("_before"))).select("video_id", "seq", "start", "end", "text")


def sliding_chunks(segments: DataFrame, window: float = 45.0, stride: float = 35.0) -> DataFrame:
    """Overlapping windows from 0 while they begin before the last segment's end; a segment
    is in each window that holds its start. Windows are computed, not joined."""
    last_end = F.max_by("end", "seq").over(W.partitionBy("video_id"))
    lo = F.greatest(F.floor((F.col("start") - window) / stride) + 1, F.lit(0))
    hi = F.least(F.floor(F.col("start") / stride), F.ceil(F.col("_total") / stride) - 1)
    placed = segments.withColumn("_total", last_end).withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).filter("_lo <= _hi")
    exploded = placed.select("video_id", "seq", "text", F.explode(F.sequence("_lo", "_hi")).alias("k"))
    grouped = exploded.groupBy("video_id", "k").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_s"))
    n = F.row_number().over(W.partitionBy("video_id").orderBy("k")) - 1
    text = F.array_join(F.transform("_s", lambda x: x["text"]), " ")
    start = F.col("k") * F.lit(float(stride))
    return grouped.select(chunk_id(F.col("video_id"), n).alias("chunk_id"), "video_id", start.alias("start_time"), (start + window).alias("end_time"), text.alias("text"))


def frame_grid(videos: DataFrame, step: float = 15.0, dropped: DataFrame | None = None) -> DataFrame:
    """Sample times i * step below the duration; a frame that failed keeps its number."""
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration") / step).cast("long"))).alias("i")
    grid = videos.filter("duration > 0").select("video_id", "duration", i).filter(F.col("i") * F.lit(float(step)) < F.col("duration"))
    out = grid.select(frame_id(F.col("video_id"), F.col("i")).alias("frame_id"), "video_id", F.bround(F.col("i") * F.lit(float(step)), 2).alias("time"))
    return out.join(dropped.select("frame_id"), "frame_id", "left_anti") if dropped is not None else out


def sample_times(start: Column, end: Column, n: Column, duration: Column) -> Column:
    """n times spread over the span clipped to the video, both ends included; one time is
    the middle."""
    t0, t1 = F.greatest(start, F.lit(0.0)), F.least(end, duration)
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: t0 + i * (t1 - t0) / (n - 1))
    return F.when(n == 1, F.array((t0 + t1) / 2)).otherwise(spread)


def frames_per_hop(n_frames: Column, n_hops: Column, max_total: int | None) -> Column:
    return n_frames if max_total is None else F.least(n_frames, F.greatest(F.lit(1), F.call_function("div", F.lit(max_total).cast("long"), n_hops).cast("int")))


def renumber(rows: DataFrame, key: str, order: str, to: str, kind: str = "q", offset: int = 15) -> DataFrame:
    """Ids overwritten by position, from offset + 1."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order)) + offset
    return rows.withColumn(to, F.format_string(f"%s_{kind}%03d", F.col(key).cast("string"), n))


def in_hop_order(spans: Column) -> Column:
    """Spans by hop; of equal hops the order they came in."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["hop"].alias("hop"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def first_of(rows: DataFrame, position: str, video: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows of one video, if asked, and of these the first ``limit`` by input position."""
    chosen = rows.filter(video) if video is not None else rows
    return chosen.orderBy(position).limit(limit) if limit else chosen
