"""Operator 3: mixing sources to target weights by Poisson replication.

Each source has a target share; its mean repetition rate is what brings its size there at
an unchanged total. A document's count is the inverse of the Poisson distribution at a
uniform number hashed from (seed, doc_id), so a rerun, a retry or another partitioning
gives the same mix. Documents are exploded by their counts and dealt out by a second
hash: a global shuffle, ordered by that hash inside each partition.

Defined edge cases: a null source is a source of its own; a null text has size 0; rows
with one doc_id get one count; a source without a target weight keeps rate 1 when
weights are given by name; an empty table gives an empty result; other columns pass
through, and the operator's own (``mix_rate``, ``mix_copy``, ``mix_key``) replace any of
the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table, unit_hash

SEED = 20240
ALPHA = 0.5
#: Up to here a source has a table of its distribution; beyond, each document sums it up.
TABLE_RATE = 64.0
#: Copies that one row of the first of two explodes stands for.
COPIES = 1 << 16


def text_size() -> Column:
    return F.coalesce(F.length("text"), F.lit(0)).cast("long")


def source_rates(docs: DataFrame, alpha: float = ALPHA, weights: dict[str, float] | None = None, max_rate: float | None = None) -> DataFrame:
    """One row a source: size, target share, mean repetition rate.

    Shares are ``weights`` if given, else proportional to size ** alpha. Sizes are code
    points over the whole table. Rates have no bound, so every source reaches its share;
    with ``max_rate`` sources that need more fall short of it, and the total shrinks."""
    sized = docs.groupBy("source").agg(F.sum(text_size()).alias("size"))
    if weights is not None:
        known = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "w_source string, weight double")
        sized = sized.join(known, F.col("source") == F.col("w_source"), "left").drop("w_source")
    else:
        sized = sized.withColumn("weight", F.sqrt("size") if alpha == 0.5 else F.pow("size", F.lit(alpha)))
    # only weighted sources share the total; one row of two sums
    both = sized.filter("weight is not null").agg(F.sum("size").cast("double").alias("all_size"), F.sum(F.bround(F.col("weight"), 6)).alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")
    if max_rate is not None:
        rate = F.least(rate, F.lit(float(max_rate)))
    return sized.crossJoin(F.broadcast(both)).select(
        "source",
        "size",
        F.when(F.col("weight").isNull() | (F.col("size") == 0) | (F.col("all_weight") == 0), 1.0).otherwise(rate).alias("mix_rate"),
    )


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities F(0), F(1), ... until the tail is below 2^-52.

    For rates up to TABLE_RATE: exp(-rate) does not underflow and some 200 terms do."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def poisson_count(rate: Column, u: Column) -> Column:
    """How many k have F(k) <= u, without a table, for rates above TABLE_RATE.

    Terms start twelve deviations below the mean (what is before them is less than 2^-52),
    the first one from its logarithm with Stirling's series, so no rate underflows; there
    are some 24 * sqrt(rate) of them, fewer than copies to write at rates above 576."""
    # a small rate starts at 0; it is cut in no other way
    first = F.when(rate > 512, F.floor(rate - 12 * F.sqrt(rate))).otherwise(0).cast("long")
    k = F.greatest(first, F.lit(1)).cast("double")
    ln = k * F.log1p((rate - k) / k) - (rate - k) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    p = F.exp(F.when(first > 0, ln).otherwise(-rate))
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("long")
    start = F.struct(p.alias("p"), p.alias("cdf"), (first + F.when(p <= u, 1).otherwise(0)).alias("n"))

    def step(acc: Column, i: Column) -> Column:
        q = acc["p"] * rate / i
        return F.struct(q.alias("p"), (acc["cdf"] + q).alias("cdf"), (acc["n"] + F.when(acc["cdf"] + q <= u, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(first + 1, last), start, step, lambda acc: acc["n"])


def poisson_mix(docs: DataFrame, seed: int = SEED, alpha: float = ALPHA, weights: dict[str, float] | None = None, max_rate: float | None = None, n_partitions: int | None = None) -> DataFrame:
    """``docs`` replicated and shuffled, with mix_rate, mix_copy (from 0) and mix_key."""
    steps = F.when(F.col("mix_rate") <= TABLE_RATE, poisson_steps(F.col("mix_rate"))).alias("cdf")
    rates = materialize(source_rates(docs, alpha, weights, max_rate).select("source", "mix_rate", steps).withColumnRenamed("source", "rate_source"), "mix-rates")
    keep = [c for c in docs.columns if c not in ("mix_rate", "mix_copy", "mix_key")]
    # a row travels as one column, so that none of its columns meets one of the operator's
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("source").alias("from_source"), F.col("doc_id").alias("id"))
    # the engine broadcasts the rates if they are small, else splits a hot source's partition
    drawn = whole.join(rates, F.col("from_source").eqNullSafe(F.col("rate_source"))).withColumn("u", unit_hash(seed, "id"))
    times = F.when(F.col("cdf").isNotNull(), F.size(F.filter("cdf", lambda p: p <= F.col("u"))).cast("long")).otherwise(poisson_count(F.col("mix_rate"), F.col("u")))
    # in two steps, so that no array holds all copies of a document
    runs = drawn.withColumn("times", times).filter("times > 0").select("row", "id", "mix_rate", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(COPIES).cast("long"))).alias("first"))
    copies = runs.select("row", "id", "mix_rate", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, F.col("times")) - 1)).alias("mix_copy"))
    keyed = copies.withColumn("mix_key", unit_hash(seed + 1, "id", "mix_copy"))
    # without a number the engine cuts the shuffle to the size of the mix
    dealt = keyed.repartition(n_partitions, "mix_key") if n_partitions else keyed.repartition("mix_key")
    return dealt.sortWithinPartitions("mix_key").select(*[F.col("row")[c].alias(c) for c in keep], "mix_rate", "mix_copy", "mix_key")


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = poisson_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", F.col("mix_copy").cast("long").alias("copy"), F.bround("mix_rate", 9).alias("rate"), F.bround("mix_key", 12).alias("mix_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def oracle() -> str:
    u = lambda seed, rest: f"('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR,''){rest}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return f"""
WITH RECURSIVE s AS (SELECT source, sum(coalesce(length(text),0))::BIGINT AS size FROM documents GROUP BY 1),
t AS (SELECT sum(size)::DOUBLE AS all_size, sum(round_even(sqrt(size), 6)) AS all_weight FROM s),
r AS (SELECT source, CASE WHEN size = 0 OR all_weight = 0 THEN 1.0::DOUBLE ELSE sqrt(size)/all_weight*all_size/size END AS rate FROM s, t),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS f FROM r
  UNION ALL SELECT source, rate, k+1, p*rate/(k+1), f + p*rate/(k+1) FROM c WHERE k + 1 <= ceil(rate + 12*sqrt(rate) + 24)),
d AS (SELECT doc_id, source, coalesce(text,'') AS text, {u(SEED, "")} AS u FROM documents),
n AS (SELECT d.doc_id, any_value(d.source) AS source, any_value(d.text) AS text, any_value(rate) AS rate, count(*) FILTER (f <= u) AS times FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id),
x AS (SELECT doc_id, source, text, rate, unnest(range(0, times)) AS copy FROM n)
SELECT doc_id, source, copy::BIGINT AS copy, round_even(rate, 9) AS rate, round_even({u(SEED + 1, " || '|' || copy::VARCHAR")}, 12) AS mix_key, sha256(text) AS text_sha256 FROM x"""


