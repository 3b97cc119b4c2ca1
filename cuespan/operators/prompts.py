"""Deterministic prompt templates as Column expressions (wording is this project's own)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flatten, mm_ss


def evidence_prompt(hits: DataFrame, question: str = "question", key: str = "query_id") -> DataFrame:
    """Numbered evidence in rank order, then the question."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("video_id").cast("string"), F.lit(" @ "), mm_ss(F.col("start_time")), F.lit(" to "), mm_ss(F.col("end_time")), F.lit("\n"), F.col("text"), F.lit("\n"))
    g = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_b"), F.first(question).alias(question))
    return g.select(key, F.concat(F.array_join(F.transform("_b", lambda x: x["b"]), "\n"), F.lit("\nQuestion: "), F.col(question)).alias("prompt"))


def judge_prompt(question: Column, answer: Column, reference: Column, answerable: Column, n_hops: Column) -> Column:
    """Three forms: unanswerable, one span, several; without a usable reference it says so."""
    gold = F.when(~answerable | (F.coalesce(reference, F.lit("")) == ""), F.lit("(none: the lecture does not answer this)")).otherwise(reference)
    task = (
        F.when(~answerable, F.lit("The question can't be answered from the lecture; a good answer says so."))
        .when(n_hops <= 1, F.lit("The answer rests on one passage of the lecture."))
        .otherwise(F.concat(F.lit("The answer joins "), n_hops.cast("string"), F.lit(" passages of the lecture.")))
    )
    return F.concat(task, F.lit("\nQuestion: "), question, F.lit("\nReference: "), gold, F.lit("\nAnswer: "), answer, F.lit('\nReply as {"C1": n, "C2": n, "C3": n, "aggregate": n}, each from 1 to 5.'))


def generation_prompt(chunks: DataFrame) -> DataFrame:
    """One lecture's chunks with their time ranges."""
    line = F.concat(F.lit("["), F.col("chunk_id"), F.lit("] "), mm_ss(F.col("start_time")), F.lit("–"), mm_ss(F.col("end_time")), F.lit("\n"), F.col("text"))
    g = chunks.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", line.alias("b")))).alias("_b"))
    return g.select("video_id", F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("prompt"))


def regeneration_prompt(base: Column, constraints: Column, first: int = 16, last: int = 30) -> Column:
    """A base prompt after the constraints that earlier rejections triggered."""
    head = F.lit(f"Write new questions, numbered q{first:03d} to q{last:03d}.\n")
    return F.concat(head, F.array_join(F.transform(constraints, lambda c: F.concat(F.lit("- "), c)), "\n"), F.lit("\n\n"), base)


def review_prompt(question: Column, answer: Column, texts: Column, cross_check: bool = False) -> Column:
    """Evidence may be empty; the cross-check sees no answer."""
    evidence = F.concat(F.lit("Evidence:\n"), F.array_join(texts, "\n---\n"))
    tail = F.lit("\nCould this be answered without the lecture?") if cross_check else F.concat(F.lit("\nAnswer: "), answer)
    return F.concat(evidence, F.lit("\nQuestion: "), question, tail)


def video_system(frames_per_window: Column) -> Column:
    """What a video model is told of its pictures: one a window, or several in order."""
    return F.when(frames_per_window > 1, F.lit("You see several frames of each passage of a lecture, in order, and read what is said there.")).otherwise(F.lit("You see one frame of each passage of a lecture and read what is said there."))


def video_prompt(question: Column, segments: Column, frames_per_window: Column | None = None) -> Column:
    """Segments are titled only where there are several; with ``frames_per_window`` the system
    text comes first."""
    many = F.size(segments) > 1
    body = F.transform(segments, lambda s, i: F.when(many, F.concat(F.format_string("--- Segment %d ---\n", i + 1), s)).otherwise(s))
    head = F.lit("") if frames_per_window is None else F.concat(video_system(frames_per_window), F.lit("\n"))
    return F.concat(head, F.array_join(body, "\n"), F.lit("\nQuestion: "), question)


def claim_prompt(reference: Column, generated: Column) -> Column:
    return F.concat(F.lit("Reference: "), flatten(reference), F.lit("\nText: "), flatten(generated), F.lit("\nHow many of the reference's claims does the text support? End with Score: a/b"))
