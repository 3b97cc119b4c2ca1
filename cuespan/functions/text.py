"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the caption format.
TIMESTAMP = r"(\d{2}):(\d{2}):(\d{2}\.\d{3})"
TIMING_LINE = r"\d{2}:\d{2}:\d{2}\.\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}\.\d{3}"
TAG = r"<[^>]+>"
VISUAL_MARK = "[frame caption:"


def strip(x: Column) -> Column:
    """Trim white space of every kind, not blanks alone."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_tags(x: Column) -> Column:
    return strip(F.regexp_replace(x, TAG, ""))


def timestamp_seconds(ts: Column) -> Column:
    """``HH:MM:SS.mmm`` as seconds; null where the text is no such stamp."""
    part = lambda i, kind: F.regexp_extract(ts, f"^{TIMESTAMP}$", i).try_cast(kind)
    return part(1, "int") * 3600 + part(2, "int") * 60 + part(3, "double")


def max_timestamp(raw: Column) -> Column:
    """Largest time anywhere in a caption file, inline marks included; null if none."""
    stamps = F.regexp_extract_all(raw, F.lit(r"(\d+:\d+:\d+\.\d+)"), 1)
    seconds = lambda s: F.split(s, ":")
    return F.array_max(F.transform(stamps, lambda s: seconds(s)[0].cast("int") * 3600 + seconds(s)[1].cast("int") * 60 + seconds(s)[2].cast("double")))


def mm_ss(seconds: Column) -> Column:
    """Minutes and seconds, truncated; minutes go on beyond 59."""
    whole = seconds.cast("long")
    return F.format_string("%02d:%02d", F.call_function("div", whole, F.lit(60)), whole % 60)


def numbered_id(prefix: Column, kind: str, n: Column) -> Column:
    return F.format_string(f"%s_{kind}%03d", prefix, n)


def chunk_id(video: Column, n: Column) -> Column:
    return numbered_id(video, "chunk_", n)


def frame_id(video: Column, n: Column) -> Column:
    return numbered_id(video, "frame_", n)


def qa_id(video: Column, n: Column) -> Column:
    return numbered_id(video, "q", n)


def youtube_id(given: Column, url: Column) -> Column:
    """The id itself, else what follows ``v=`` in the address; empty without either."""
    tail = F.element_at(F.split(url, "v="), -1)
    return F.coalesce(given, F.split(tail, "&")[0], F.lit(""))


def citation(video: Column, start: Column, end: Column, yt: Column) -> Column:
    return F.concat(F.lit("["), video, F.lit(" @ "), mm_ss(start), F.lit(" to "), mm_ss(end), F.lit("](https://youtu.be/"), yt, F.lit("?t="), start.cast("long").cast("string"), F.lit(")"))


def normalise(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " ")


def concept_hits(concepts: Column, text: Column) -> Column:
    """How many concepts appear in the text, both normalised; repeats count."""
    norm = normalise(text)
    return F.size(F.filter(concepts, lambda c: F.contains(norm, normalise(c))))


def evidence_coverage(hits: Column, n_concepts: Column) -> Column:
    return F.when(n_concepts == 0, F.lit(1.0)).otherwise(hits / n_concepts)


def span_error(coverage: Column, duration: Column) -> Column:
    return (1 - coverage) * duration / 2


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def flatten(x: Column) -> Column:
    """Line ends become blanks; trimmed."""
    return strip(F.translate(x, "\n", " "))


def preview(x: Column, n: int = 80) -> Column:
    return F.translate(F.substring(x, 1, n), "\n", " ")


def percent(part: Column, whole: Column) -> Column:
    return 100.0 * part / F.greatest(whole, F.lit(1))


def half_even(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals as Python's ``round`` does: by the binary value itself, of
    which the shortest decimal text may lie on the other side of a half; exact halves go to
    the even digit.

    The product with 10^digits is kept as a double and its exact error (Dekker's split), so
    the comparison with a half is exact; from 2^53 units on, a double has no such digits."""
    scale = float(10**digits)

    def split(a: Column) -> Column:
        high = a * 134217729.0 - (a * 134217729.0 - a)
        return F.struct(high.alias("h"), (a - high).alias("l"))

    bh = 134217729.0 * scale - (134217729.0 * scale - scale)
    bl = scale - bh
    value = F.transform(F.array(x.cast("double")), lambda v: F.struct(v.alias("x"), F.abs(v).alias("a"), (F.abs(v) * scale).alias("p")))
    parts = F.transform(value, lambda s: F.struct(s["x"].alias("x"), s["p"].alias("p"), F.floor(s["p"]).cast("double").alias("n"), split(s["a"]).alias("s")))
    exact = F.transform(parts, lambda s: F.struct(s["x"].alias("x"), s["p"].alias("p"), s["n"].alias("n"), (((s["s"]["h"] * bh - s["p"]) + s["s"]["h"] * bl + s["s"]["l"] * bh) + s["s"]["l"] * bl).alias("e")))

    def nearest(s: Column) -> Column:
        odd = s["n"] % 2 == 1
        above, below = (s["p"] - s["n"] - 0.5) + s["e"], (s["p"] - s["n"] + 0.5) + s["e"]
        whole = F.when((above > 0) | ((above == 0) & odd), s["n"] + 1).when((below < 0) | ((below == 0) & odd), s["n"] - 1).otherwise(s["n"])
        return F.when(s["p"] < float(1 << 53), F.when(s["x"] < 0, -(whole / scale)).otherwise(whole / scale)).otherwise(s["x"])

    return F.transform(exact, nearest)[0]


def signed(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}f", x)


def has_visual_mark(text: Column) -> Column:
    """Extension: in the source system this rule lives in review prompts only."""
    return F.contains(text, F.lit(VISUAL_MARK))


def answer_too_short(answer: Column, least: int = 10) -> Column:
    """Extension: written down as a rule, never enforced, in the source system."""
    return F.size(F.filter(F.split(F.coalesce(answer, F.lit("")), r"\s+"), lambda w: w != "")) < least


def answer_in_question(answer: Column, question: Column) -> Column:
    """Extension, as above."""
    return F.contains(F.lower(question), F.lower(answer)) & (F.length(answer) > 0)
