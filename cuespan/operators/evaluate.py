"""Evaluation rows, pooled aggregates, agreement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import spans as S
from ..functions.text import half_even, strip
from .joins import with_every_config

METRICS = ("temporal_iou", "multihop_per_hop_iou", "multihop_union_iou", "multihop_per_hop_recall_at_5", "citation_accuracy", "iou_at_03", "iou_at_05", "hit_rate_at_1", "hit_rate_at_3", "hit_rate_at_5", "multihop_complete_at_5")
JUDGE = ("llm_judge_C1", "llm_judge_C2", "llm_judge_C3", "llm_judge_score")


def evaluate_rows(rows: DataFrame, threshold: float = 0.3, report: tuple[float, float] = (0.3, 0.5)) -> DataFrame:
    """All metrics of each (question, configuration).

    rows: answerable, hops, hits (array in rank order of start/end) and cited (the cited
    chunks' spans). Unanswerable questions and those without spans get zeros and false."""
    ready = rows.withColumns({"_p": S.merge_spans(F.col("cited")), "_ok": F.coalesce("answerable", F.lit(True)) & (F.size("hops") > 0)})
    zero = lambda c: F.when(F.col("_ok"), c).otherwise(F.lit(0.0))
    false = lambda c: F.when(F.col("_ok"), c).otherwise(F.lit(False))
    first = lambda k: F.slice("hits", 1, k)
    scored = ready.withColumn("_u", zero(S.union_iou(F.col("_p"), F.col("hops"))))
    return scored.withColumns(
        {
            "temporal_iou": F.col("_u"),
            "multihop_union_iou": F.col("_u"),
            "multihop_per_hop_iou": zero(S.per_hop_iou(F.col("_p"), F.col("hops"))),
            "multihop_per_hop_recall_at_5": zero(S.hop_recall(first(5), F.col("hops"), threshold)),
            "citation_accuracy": zero(S.hop_recall(F.col("cited"), F.col("hops"), threshold)),
            "iou_at_03": false(F.col("_u") >= report[0]),
            "iou_at_05": false(F.col("_u") >= report[1]),
            "hit_rate_at_1": false(S.hit(first(1), F.col("hops"), threshold)),
            "hit_rate_at_3": false(S.hit(first(3), F.col("hops"), threshold)),
            "hit_rate_at_5": false(S.hit(first(5), F.col("hops"), threshold)),
            "multihop_complete_at_5": false(S.complete(first(5), F.col("hops"), threshold)),
        }
    ).drop("_p", "_ok", "_u")


def fuse_judges(rows: DataFrame) -> DataFrame:
    """Mean of the two judges for each criterion; the overall score is the mean of their
    own aggregates."""
    mean = lambda c: (F.col(f"judge_1_{c}") + F.col(f"judge_2_{c}")) / 2.0
    return rows.withColumns({"llm_judge_C1": mean("C1"), "llm_judge_C2": mean("C2"), "llm_judge_C3": mean("C3"), "llm_judge_score": mean("aggregate")})


def hop_class(question_type: str = "question_type") -> Column:
    return F.when(F.col(question_type).isin(*schemas.MULTIHOP_TYPES), "multi_hop").otherwise("single_hop")


def means(columns: tuple[str, ...], digits: int = 9) -> list[Column]:
    return [F.bround(F.avg(F.col(c).cast("double")), digits).alias(c) for c in columns]


def pooled_means(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Means overall, by configuration, by question type and by hop class, each pooled over
    the rest: one pass of grouping sets."""
    base = rows.withColumn("hop_group", hop_class())
    aggs = ", ".join(f"bround(avg(cast({c} as double)), 9) AS {c}" for c in columns)
    spark = rows.sparkSession
    return spark.sql(
        f"""SELECT CASE grouping_id() WHEN 7 THEN 'overall' WHEN 3 THEN 'config' WHEN 5 THEN 'question_type' ELSE 'hop_group' END AS level,
        coalesce(config, question_type, hop_group, 'all') AS value, count(*) AS n, {aggs}
        FROM {{base}} GROUP BY GROUPING SETS ((), (config), (question_type), (hop_group))""",
        base=base,
    )


def _alpha() -> Column:
    """From n, the squared differences d, and sums t and squares q of all ratings."""
    big = 2.0 * F.col("n")
    observed = F.col("d") / F.greatest(F.col("n"), F.lit(1))
    expected = 2 * (big * F.col("q") - F.col("t") * F.col("t")) / F.greatest(big * (big - 1), F.lit(1.0))
    return F.when(F.col("n") < 2, 0.0).when(expected == 0, 1.0).otherwise(1 - observed / expected)


def krippendorff(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Interval alpha of two raters without gaps: 0 for fewer than two rows, 1 where all
    ratings are equal. One pass of sums."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = rows.agg(F.count("*").alias("n"), F.sum((x - y) * (x - y)).alias("d"), F.sum(x + y).alias("t"), F.sum(x * x + y * y).alias("q"))
    return s.select("n", _alpha().alias("alpha"))


def side_by_side(rows: DataFrame, columns: tuple[str, ...], configs: tuple[str, ...]) -> DataFrame:
    """One row a metric, one column a configuration."""
    by = rows.groupBy("config").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    long = by.select("config", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns])).alias("x")).select("config", "x.*")
    return long.groupBy("metric").pivot("config", list(configs)).agg(F.max("v"))


def agreement(rows: DataFrame, criteria: tuple[str, ...] = ("C1", "C2", "C3", "aggregate")) -> DataFrame:
    """Krippendorff's alpha of the two judges for each criterion: one pass over the rows."""
    pair = lambda c: F.struct(F.lit(c).alias("criterion"), F.col(f"judge_1_{c}").cast("double").alias("x"), F.col(f"judge_2_{c}").cast("double").alias("y"))
    long = rows.select(F.inline(F.array(*[pair(c) for c in criteria])))
    x, y = F.col("x"), F.col("y")
    s = long.groupBy("criterion").agg(F.count("*").alias("n"), F.sum((x - y) * (x - y)).alias("d"), F.sum(x + y).alias("t"), F.sum(x * x + y * y).alias("q"))
    return s.select("criterion", "n", _alpha().alias("alpha"))


def score_summary(results: DataFrame, pairs: DataFrame, scores: tuple[str, ...], by: str = "config", digits: int = 4) -> DataFrame:
    """Means of the scored answers for each ``by``, with how many there are (n), how many
    were left out without a gold answer (missing) or as empty, and how many have an error.

    results: qa_id, generated_answer, ``by``, the scores and ``error`` (null where none);
    pairs: qa_id, answer. The gold answers are looked up; scores of rows left out don't count."""
    gold = pairs.select(F.col("qa_id"), F.col("answer").alias("gold"))
    joined = results.join(gold, "qa_id", "left")
    missing = F.coalesce(F.col("gold"), F.lit("")) == ""
    empty = ~missing & (strip(F.coalesce(F.col("generated_answer"), F.lit(""))) == "")
    used = ~missing & ~empty
    mean = lambda c: F.coalesce(half_even(F.avg(F.when(used, F.col(c))), digits), F.lit(0.0)).alias(c)
    return joined.groupBy(by).agg(F.count_if(used).alias("n"), F.count_if(missing).alias("missing"), F.count_if(empty).alias("empty"), F.count_if(used & F.col("error").isNotNull()).alias("errors"), *[mean(c) for c in scores])


def with_question_type(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The question's type, ``unknown`` where the benchmark lacks the question, and whether
    it is a visual one."""
    types = pairs.select("qa_id", F.col("question_type").alias("found_type"))
    typed = rows.join(types, "qa_id", "left").withColumn("question_type", F.coalesce("found_type", F.lit("unknown"))).drop("found_type")
    return typed.withColumn("is_visual", F.col("question_type").isin(*schemas.VISUAL_TYPES))


def systems_table(results: DataFrame, pairs: DataFrame, systems: tuple[str, ...], scores: tuple[str, ...], digits: int = 4) -> DataFrame:
    """Comparison of systems: answers with a gold answer that are not empty, scored by
    ``scores`` (columns of ``results``); a system without any has n = 0 and zeros."""
    gold = pairs.filter(F.col("answer").isNotNull()).select("qa_id")
    used = results.filter(strip(F.coalesce(F.col("generated_answer"), F.lit(""))) != "").join(gold, "qa_id", "left_semi")
    by = used.groupBy("system").agg(F.count("*").alias("n"), *[half_even(F.avg(c), digits).alias(c) for c in scores])
    named = results.sparkSession.createDataFrame([(s,) for s in systems], "system string")
    return named.join(by, "system", "left").na.fill(0)


def entailment_table(scored: DataFrame, systems: tuple[str, ...], digits: int = 4) -> DataFrame:
    """Mean entailment of each system over all its answers and over those to visual and
    other questions; scored: system, is_visual, entail_p, entail_r. Nothing scored is 0."""
    groups = {"all": F.lit(True), "visual": F.col("is_visual"), "other": ~F.col("is_visual")}
    mean = lambda c, on: F.coalesce(half_even(F.avg(F.when(on, F.col(c))), digits), F.lit(0.0))
    by = scored.groupBy("system").agg(F.count("*").alias("n"), *[mean(f"entail_{k}", on).alias(f"entail_{k}_{name}") for k in "pr" for name, on in groups.items()])
    named = scored.sparkSession.createDataFrame([(s,) for s in systems], "system string")
    return named.join(by, "system", "left").na.fill(0)


def evaluate_all(pairs: DataFrame, configs: tuple[str, ...], done: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of every question under every configuration: those of ``done`` as they are,
    and what ``score`` makes of the (qa_id, config) that are left."""
    work = with_every_config(pairs.select("qa_id"), configs)
    todo = work.join(done.select("qa_id", "config").distinct(), ["qa_id", "config"], "left_anti")
    return done.unionByName(score(todo))
