"""Benchmark construction: validation rules, review decisions, coverage, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas
from ..functions.text import concept_hits, evidence_coverage, half_even, percent, span_error

MIN_GAP = 70.0
FAIL_SHARE = 0.30
_PAIR_TYPES = {"num_hops": "int", "ground_truth_spans": f"array<{schemas.SPAN}>", "source_chunk_ids": "array<string>", "answerable": "boolean", "key_concepts": "array<string>"}
TIERS = ("zero", "1-3", "4-9", "10-11", "12+")


def _messages(*rules: tuple[Column, Column | str]) -> Column:
    """The messages of the rules that are broken, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for broken, m in rules]), lambda x: x.isNotNull())


def span_gaps(spans: Column) -> Column:
    """Gaps between consecutive starts, in order of the starts."""
    starts = F.array_sort(F.transform(spans, lambda s: s["start"]))
    pairs = F.zip_with(F.slice(starts, F.lit(1), F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: b - a)
    return F.when(F.size(starts) > 1, pairs).otherwise(F.array().cast("array<double>"))


def rule_violations(pairs: DataFrame, min_gap: float = MIN_GAP) -> DataFrame:
    """``pairs`` with ``errors``: one message for each broken rule (schema, spans, hops).

    A null field, or a column that the table lacks, is a missing one; a missing
    ``answerable`` counts as true."""
    absent = [c for c in schemas.PAIR_FIELDS if c not in pairs.columns]
    given = pairs.columns
    pairs = pairs.withColumns({c: F.lit(None).cast(_PAIR_TYPES.get(c, "string")) for c in absent})
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in schemas.PAIR_FIELDS]), lambda x: x.isNotNull())
    t, spans = F.col("question_type"), F.col("ground_truth_spans")
    multi, none = t.isin(*schemas.MULTIHOP_TYPES), t == "unanswerable"
    answerable = F.coalesce(F.col("answerable"), F.lit(True))
    n = F.coalesce(F.when(spans.isNotNull(), F.size(spans)), F.lit(0))
    judged = ~none & (n > 0)
    no_time = lambda s: s["start"].isNull() | s["end"].isNull()
    each = F.transform(spans, lambda s, i: F.when(no_time(s), F.format_string("span %d has no start or no end", i)).when(s["end"] <= s["start"], F.format_string("span %d ends before it starts", i)))
    bad_end = F.filter(each, lambda x: x.isNotNull())
    bad_gap = F.transform(F.filter(span_gaps(spans), lambda g: g < min_gap), lambda g: F.format_string("span gap %.0f s is below %.0f s", g, F.lit(float(min_gap))))
    hops = F.coalesce(F.col("num_hops"), F.lit(0))
    schema = _messages(
        (F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))),
        (t.isNull() | ~t.isin(*schemas.QUESTION_TYPES), "invalid question_type"),
        (F.col("difficulty").isNull() | ~F.col("difficulty").isin(*schemas.DIFFICULTIES), "invalid difficulty"),
        (spans.isNull(), "ground_truth_spans must be a list"),
        (F.col("source_chunk_ids").isNull(), "source_chunk_ids must be a list"),
        (F.col("key_concepts").isNull(), "key_concepts must be a list"),
    )
    whole = _messages((none & (n > 0), "unanswerable question has spans"), (~none & answerable & (n == 0), "answerable question has no spans"))
    empty = F.array().cast("array<string>")
    ends = F.when(judged, bad_end).otherwise(empty)
    gaps = F.when(judged & multi & (n >= 2), bad_gap).otherwise(empty)
    counts = _messages((multi & (hops < 2), "multi-hop type with fewer than 2 hops"), (multi & (n < 2), "multi-hop type with fewer than 2 spans"), (~multi & ~none & (hops != 1), "single-hop type without exactly 1 hop"))
    return pairs.select(*given, F.concat(schema, whole, ends, gaps, counts).alias("errors"))


def batch_item_errors(items: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """``items`` of generated batches with ``errors``, in the order in which a batch is read:
    fields, type, hops, what an unanswerable question may not have, and spans that start
    after the video's end (``durations``: video_id, duration; a video without one, and
    regenerated batches, are not checked for that)."""
    t, hops = F.col("question_type"), F.col("num_hops")
    multi, none = t.isin(*schemas.MULTIHOP_TYPES), t == "unanswerable"
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in schemas.PAIR_FIELDS if c in items.columns]), lambda x: x.isNotNull())
    known = t.isin(*schemas.QUESTION_TYPES)
    rows, late = items, F.lit(False)
    if durations is not None:
        rows = items.join(durations.select(F.col("video_id").alias("of_video"), F.col("duration").alias("of_duration")), F.col("video_id") == F.col("of_video"), "left").drop("of_video")
        late = F.exists("ground_truth_spans", lambda s: s["start"] > F.col("of_duration"))
    found = _messages(
        (F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))),
        (~known, "invalid question_type"),
        (known & multi & (hops < 2), "multi-hop question with fewer than 2 hops"),
        (known & ~multi & (hops != 1), "single-hop question without exactly 1 hop"),
        (none & F.col("answerable"), "unanswerable question is marked answerable"),
        (none & (F.size("ground_truth_spans") > 0), "unanswerable question has spans"),
    )
    return rows.select(*items.columns, F.concat(found, _messages((late, "span starts after the video's end"))).alias("errors"))


def batch_verdict(items: DataFrame, batch: str, expected: dict[str, int], durations: DataFrame | None = None, position: str = "position") -> DataFrame:
    """One row a batch with ``violation``, null where it is accepted as a whole: the first
    broken rule of the first item that breaks one, the durations after all others, and the
    number of questions of each type last."""
    checked = batch_item_errors(items, durations)
    late = "span starts after the video's end"
    own = F.filter("errors", lambda e: e != late)
    first = checked.groupBy(batch).agg(
        F.min_by(F.when(F.size(own) > 0, own[0]), F.when(F.size(own) > 0, F.col(position))).alias("item"),
        F.bool_or(F.array_contains("errors", late)).alias("late"),
    )
    counts = distribution_check(items, batch, expected).select(F.col(batch), "ok")
    violation = F.coalesce(F.col("item"), F.when(F.col("late"), late), F.when(~F.col("ok"), "wrong question type distribution"))
    return first.join(counts, batch).select(batch, violation.alias("violation"))


def without_type(pairs: DataFrame, question_type: str = "unanswerable", key: str = "video_id") -> DataFrame:
    """Lectures that have no question of a type: a report, not an error."""
    has = F.bool_or(F.col("question_type").eqNullSafe(F.lit(question_type)))
    return pairs.groupBy(key).agg(has.alias("has")).filter(~F.col("has")).select(key)


def error_by_type(worst: DataFrame, types: tuple[str, ...] = ("multi-hop-visual", "visual", "multi-hop", "text")) -> DataFrame:
    """Mean error of the audited questions of each type, in a fixed order (``place``); types
    without any are left out."""
    place = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("question_type")).cast("int")
    by = worst.withColumn("place", place).filter("place > 0").groupBy("place", "question_type")
    return by.agg(F.count("*").alias("n"), half_even(F.avg("estimated_error_s"), 1).alias("mean_error_s"))


def merge_regenerated(stored: DataFrame, log: DataFrame, regenerated: DataFrame, key: str = "video_id", floor: int = 12, offset: int = 15) -> DataFrame:
    """Reviewed pairs after a regeneration: what is stored, and the accepted new ones (key,
    position, question, accepted) under ids from offset + 1 by position. Lectures with
    ``floor`` accepted reviews in the *first* run's log get none. Since neither the test nor
    the union looks at what is stored, a second run adds its pairs again under the same ids."""
    low = log.groupBy(key).agg(F.count_if(F.col("overall") == "ACCEPT").alias("had")).filter(F.col("had") < floor).select(key)
    new = regenerated.join(low, key, "left_semi")
    n = F.row_number().over(W.partitionBy(key).orderBy("position")) + offset
    numbered = new.withColumn("qa_id", F.format_string("%s_q%03d", F.col(key).cast("string"), n)).filter("accepted")
    return stored.unionByName(numbered.select(*stored.columns))


def distribution_check(items: DataFrame, batch: str, expected: dict[str, int]) -> DataFrame:
    """Do a batch's type counts equal the expected ones? A missing type counts 0."""
    wide = items.groupBy(batch).pivot("question_type", list(expected)).count().na.fill(0)
    ok = F.lit(True)
    for k, v in expected.items():
        ok = ok & (F.col(f"`{k}`") == v)
    others = items.groupBy(batch).agg(F.count_if(~F.col("question_type").isin(*expected)).alias("_o"))
    return wide.join(others, batch).withColumn("ok", ok & (F.col("_o") == 0)).drop("_o")


def review_decision(reviews: DataFrame) -> DataFrame:
    """Cross-check counts only where a question other than an unanswerable one passed the
    first criterion and was accepted; its failure turns the verdict."""
    due = (F.col("question_type") != "unanswerable") & (F.col("criterion_1") == "PASS") & (F.col("overall") == "ACCEPT")
    failed = due & (F.col("cross_check") == "FAIL")
    return reviews.select(
        "*",
        F.when(due, F.col("cross_check")).otherwise("SKIPPED").alias("cross_check_result"),
        F.when(failed, "REJECT").otherwise(F.col("overall")).alias("decision"),
        F.when(failed, "c1_knowledge_conflict").otherwise(F.col("rejection_reason")).alias("decision_reason"),
    )


def review_stats(reviews: DataFrame, key: str = "video_id") -> DataFrame:
    """Per lecture: accepted, rejected, share accepted."""
    a, r = F.count_if(F.col("decision") == "ACCEPT"), F.count_if(F.col("decision") == "REJECT")
    return reviews.groupBy(key).agg(F.count("*").alias("total"), a.alias("accepted"), r.alias("rejected"), half_even(percent(a, F.count("*")), 1).alias("accepted_pct"))


def rejection_reasons(reviews: DataFrame) -> DataFrame:
    """Reasons over the corpus, most frequent first; a missing reason is ``unknown``, an
    empty one is its own."""
    n = reviews.filter("decision = 'REJECT'").groupBy(F.coalesce("decision_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "reason")


def failure_triggers(reviews: DataFrame, key: str = "video_id", share: float = FAIL_SHARE) -> DataFrame:
    """Criteria that fail in at least ``share`` of a lecture's rejects, parse errors aside."""
    rejected = reviews.filter("decision = 'REJECT'")
    named = F.explode(F.array(*[F.struct(F.lit(f"criterion_{i}").alias("criterion"), F.col(f"criterion_{i}").alias("result"), F.col(f"reason_{i}").alias("reason")) for i in (1, 2, 3)])).alias("c")
    long = rejected.select(key, named).select(key, "c.*")
    fail = (F.col("result") == "FAIL") & ~F.coalesce(F.col("reason") == "parse error", F.lit(False))
    rate = long.groupBy(key, "criterion").agg(F.avg(fail.cast("double")).alias("fail_share"))
    return rate.filter(F.col("fail_share") >= share)


def coverage_tier(n: Column) -> Column:
    return F.when(n == 0, TIERS[0]).when(n <= 3, TIERS[1]).when(n <= 9, TIERS[2]).when(n <= 11, TIERS[3]).otherwise(TIERS[4])


def coverage_tiers(counts: DataFrame, minimum: int = 500) -> DataFrame:
    """Lectures and questions in each tier, and whether the total reaches the minimum."""
    by = counts.groupBy(coverage_tier(F.col("n")).alias("tier")).agg(F.count("*").alias("lectures"), F.sum("n").alias("questions"))
    total = F.sum("questions").over(W.partitionBy(F.lit(1)))  # five rows at most
    return by.withColumn("gate_met", total >= minimum)


def coverage_gate(before: DataFrame, after: DataFrame, minimum: int = 500, least_visual: int = 300) -> DataFrame:
    """One row: questions and visual ones after the fix (``after``: n, visual for each lecture),
    lectures without any before it, and the exit value. As in the source system a lecture that
    had nothing keeps the gate shut even if the fix has filled it: the next run opens it."""
    none = before.agg(F.count_if(F.col("n") == 0).alias("zero_before"))
    total = after.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("visual"), F.lit(0)).alias("visual"))
    both = total.join(none)  # one row each
    shut = (F.col("total") < minimum) | (F.col("visual") < least_visual) | (F.col("zero_before") > 0)
    return both.withColumn("exit_value", shut.cast("int"))


def lowest(counts: DataFrame, k: int = 10, below: int = 12) -> DataFrame:
    """Of the k lectures with the fewest questions, those below the target."""
    return counts.orderBy("n", "video_id").limit(k).filter(F.col("n") < below)


def manifest(pairs: DataFrame) -> DataFrame:
    """One row: counts, lectures, share visual and the number of each type (as a map)."""
    visual, multi = F.col("question_type").isin(*schemas.VISUAL_TYPES), F.col("question_type").isin(*schemas.MULTIHOP_TYPES)
    types = pairs.groupBy("question_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question_type", "n")))).alias("by_question_type"))
    one = pairs.agg(
        F.count("*").alias("total"),
        F.count_distinct("video_id").alias("n_lectures"),
        F.array_sort(F.collect_set("video_id")).alias("lectures"),
        F.count_if("answerable").alias("answerable"),
        F.count_if(visual).alias("visual"),
        F.count_if(multi).alias("multi_hop"),
        half_even(percent(F.count_if(visual), F.count("*")), 1).alias("visual_pct"),
    )
    return one.crossJoin(F.broadcast(types))  # one row each


def span_audit(spans: DataFrame) -> DataFrame:
    """Concept evidence of each audited span (concepts, chunk_text may be null, duration).
    Without a chunk the coverage is 0, even without concepts."""
    found = F.when(F.col("chunk_text").isNull(), 0).otherwise(concept_hits(F.col("concepts"), F.col("chunk_text")))
    cover = F.when(F.col("chunk_text").isNull(), 0.0).otherwise(evidence_coverage(F.col("concepts_found"), F.col("concepts_total")))
    return spans.withColumns({"concepts_found": found.cast("int"), "concepts_total": F.size("concepts")}).withColumn("evidence_coverage", cover).withColumn("estimated_error_s", span_error(F.col("evidence_coverage"), F.col("duration")))


def worst_span(audit: DataFrame, key: str = "qa_id") -> DataFrame:
    """Each question's worst span; the first of equals."""
    best = audit.groupBy(key).agg(F.max_by(F.struct("span_idx", "estimated_error_s", "evidence_coverage", "question_type"), F.struct("estimated_error_s", -F.col("span_idx"))).alias("w"))
    return best.select(key, "w.*")


def audit_gate(worst: DataFrame, good: float = 20.0, fair: float = 30.0) -> DataFrame:
    mean = F.avg("estimated_error_s")
    return worst.agg(
        F.count("*").alias("n"), F.bround(mean, 9).alias("mean_error_s"), F.max("estimated_error_s").alias("max_error_s"), F.min("estimated_error_s").alias("min_error_s"),
        F.bround(F.avg((F.col("evidence_coverage") >= 0.5).cast("double")), 9).alias("share_covered"),
        F.when(mean <= good, "pass").when(mean <= fair, "review").otherwise("fail").alias("decision"),
    )


def stratified_sample(pairs: DataFrame, seed: int = 42, per_stratum: int = 1) -> DataFrame:
    """Per lecture one visual and one other question, unanswerable ones left out; drawn by
    a hash of (seed, id), so the same on every run."""
    visual = F.col("question_type").isin(*schemas.VISUAL_TYPES)
    order = W.partitionBy("video_id", "is_visual").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("qa_id").cast("string"))), "qa_id")
    rows = pairs.filter(F.col("question_type") != "unanswerable").withColumn("is_visual", visual)
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= per_stratum).drop("_rn")


def completeness(results: DataFrame, pairs: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Per model: are there as many results as answerable questions?"""
    due = pairs.filter(F.coalesce("answerable", F.lit(True))).agg(F.count("*").alias("due"))
    have = results.groupBy("config").agg(F.count_distinct("qa_id").alias("n"))
    named = results.sparkSession.createDataFrame([(m,) for m in models], "config string")
    return named.join(have, "config", "left").crossJoin(F.broadcast(due)).select("config", F.coalesce("n", F.lit(0)).alias("n"), "due", (F.coalesce("n", F.lit(0)) >= F.col("due")).alias("complete"))
