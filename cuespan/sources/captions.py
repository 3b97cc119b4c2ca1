"""WebVTT caption files to cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TIMING_LINE, strip, strip_tags, timestamp_seconds


def read_caption_files(spark: SparkSession, path: str) -> DataFrame:
    """video_id (the file's name before its first dot) and the whole text of each file."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(name, r"^([^.]+)", 1).alias("video_id"), F.col("value").alias("raw"))


def parse_cues(files: DataFrame) -> DataFrame:
    """Cues (video_id, seq, start, end, text_lines) of raw caption texts.

    Blocks are parted by empty lines (a line with one blank does not part them); a block's
    first timing line counts, later lines without their tags are its text, and blocks
    without timing or text are dropped."""
    raw = F.regexp_replace("raw", "\r\n?", "\n")
    blocks = files.select("video_id", F.posexplode(F.split(strip(raw), r"\n{2,}")).alias("seq", "_block"))
    lines = blocks.select("video_id", "seq", F.split(strip(F.col("_block")), "\n").alias("_l"))
    at = F.array_position(F.transform("_l", lambda x: x.rlike(TIMING_LINE)), F.lit(True))
    timed = lines.withColumn("_at", at.cast("int")).filter("_at > 0")
    row = F.element_at("_l", F.col("_at"))
    stamp = lambda i: timestamp_seconds(F.regexp_extract(row, r"(\d{2}:\d{2}:\d{2}\.\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}\.\d{3})", i))
    text = F.filter(F.transform(F.slice("_l", F.col("_at") + 1, F.size("_l")), strip_tags), lambda x: x != "")
    cues = timed.select("video_id", F.col("seq").cast("long").alias("seq"), stamp(1).alias("start"), stamp(2).alias("end"), text.alias("text_lines"))
    return cues.filter(F.size("text_lines") > 0)


def render_captions(segments: DataFrame) -> DataFrame:
    """Caption text of segments (video_id, seq, start, end, text): the parser's inverse."""
    ms = lambda x: F.round(x * 1000).cast("long")
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    stamp = lambda x: F.format_string("%02d:%02d:%02d.%03d", div(ms(x), 3_600_000), div(ms(x), 60_000) % 60, div(ms(x), 1000) % 60, ms(x) % 1000)
    cue = F.concat(stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end")), F.lit("\n"), F.col("text"))
    grouped = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seq", cue.alias("cue")))).alias("c"))
    return grouped.select("video_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("c", lambda x: x["cue"]), "\n\n")).alias("raw"))
