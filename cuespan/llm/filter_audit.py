"""Operator 13: how filters interact, whatever the order in which they are applied.

Five filters judge every document on its own (A, B, C, D) or against the table (E: the text
is that of a smaller doc_id). Documents are then counted by the set of filters that they
fail, and every figure of every order follows from these counts.

Duplicates are found by partition refinement. Classes of documents begin with the length in
code points; each round splits the classes by the hash of the next block of the text, and
classes of one document are dropped, so a text that resembles no other leaves at the first
block that says so. Blocks grow (``BLOCK`` code points, ``GROWTH`` times as many each round),
so the rounds are logarithmic in the longest text; their hashes are made in one pass, and
rounds move narrow rows only. What is left at the end is compared as full text: texts are
the keys of an aggregate, whose partial step folds large groups of copies before anything
is shuffled. Two texts of one class, should hashes ever collide, are told apart there.

Defined edge cases: a null text is an empty one, and a copy of any other empty one; a null
language is the part of the empty string; a null doc_id is larger than all others and has no
labels; rows with one doc_id are judged each by its text, and equal ones are no copies of each
other, as neither has the smaller id; of several labels of a document, one that says good
(toxic) is enough; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import HOT_KEYS, NO_ID, WORD_GAP, hot_join, materialize, table

FILTERS = "ABCDE"
BLOCK, GROWTH = 512, 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def block_hashes(text: Column, block: int = BLOCK, growth: int = GROWTH) -> Column:
    """Hashes of successive blocks of the text; none for an empty text."""
    start = lambda r: (F.lit(block) * (F.pow(F.lit(growth), r) - 1) / (growth - 1)).cast("int")
    of = F.array(F.struct(text.alias("t"), F.length(text).alias("n")))

    def cut(s: Column) -> Column:
        last = F.ceil(F.log(float(growth), s["n"] * F.lit((growth - 1) / block) + 1)).cast("int")
        rounds = F.sequence(F.lit(0), last)  # one more than is needed, for the rounding of log
        blocks = F.transform(F.filter(rounds, lambda r: start(r) < s["n"]), lambda r: F.xxhash64(F.substring(s["t"], start(r) + 1, start(r + 1) - start(r))))
        return F.when(s["n"] > 0, blocks).otherwise(F.array().cast("array<bigint>"))

    return F.transform(of, cut)[0]


def judged(docs: DataFrame, block: int = BLOCK, growth: int = GROWTH) -> DataFrame:
    """A narrow row a document: id, h (hash of the text), part, n_chars, ``fails`` (the letters
    of the filters A to D that it fails) and the hashes of its blocks."""
    text = F.coalesce("text", F.lit(""))
    # transform over a one-element array splits a text once
    words = F.transform(F.array(F.filter(F.split(text, WORD_GAP), lambda w: w != "")), lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("d")))[0]
    upper = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), F.coalesce("lang", F.lit("")).alias("part"),
        F.length(text).alias("n_chars"), words.alias("w"), upper.alias("upper"), F.rlike(text, F.lit("[#$%&*|]")).alias("marked"), block_hashes(text, block, growth).alias("blocks"),
    )
    fails = {"A": F.col("w.n") < 100, "B": 100 * F.col("w.d") < 80 * F.col("w.n"), "C": 100 * F.col("upper") > 10 * F.col("n_chars"), "D": F.col("marked")}
    letters = F.concat(*[F.when(c, k).otherwise("") for k, c in fails.items()])
    return rows.select("id", "h", "part", "n_chars", letters.alias("fails"), "blocks")


def refined(rows: DataFrame) -> DataFrame:
    """(id, h, cls, n): the rows that share their length and all block hashes with another."""

    def shared(live: DataFrame) -> DataFrame:
        sizes = live.groupBy("cls").agg(F.count("*").alias("n"))
        keep, total = materialize(sizes.filter("n > 1"), "audit-classes"), live.count()
        return materialize(hot_join(live, keep, ["cls"], F.col("n") * HOT_KEYS > total), "audit-live")

    live = shared(rows.select("id", "h", "blocks", F.col("n_chars").cast("long").alias("cls")))
    done, at = [], 0
    while True:
        ended = F.size("blocks") <= at
        done.append(live.filter(ended).select("id", "h", "cls", "n"))
        if live.filter(~ended).isEmpty():
            return reduce(DataFrame.unionByName, done)
        split = F.xxhash64(F.col("cls"), F.element_at("blocks", at + 1)).alias("cls")
        live = shared(live.filter(~ended).select("id", "h", "blocks", split))
        at += 1


def copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, h) of the rows of ``docs`` whose text is that of a smaller id; rows: of ``judged``."""
    left = materialize(refined(rows), "audit-refined")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    # texts are shuffled once, at every size alike, and fetched for what has survived only
    full = texts.join(left.select("id", "h", "cls").distinct().hint("merge"), ["id", "h"])
    first = full.groupBy("cls", "text").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    first = first.withColumn("texts", F.count("*").over(W.partitionBy("cls")))
    # a class of one text, which is any class but for collisions, is known by its name
    first = materialize(first.filter("first < last").select("cls", "first", "texts", F.when(F.col("texts") > 1, F.col("text")).alias("text")), "audit-first")
    total = left.count()
    sizes = left.groupBy("cls").agg(F.count("*").alias("n"))
    known = first.filter("texts = 1").select("cls", "first").join(sizes, "cls")
    found = hot_join(left.select("id", "h", "cls"), known, ["cls"], F.col("n") * HOT_KEYS > total).select("id", "h", "first")
    if not first.filter("texts > 1").isEmpty():  # hashes collided
        found = found.unionByName(full.join(first.filter("texts > 1").select("cls", "text", "first"), ["cls", "text"]).select("id", "h", "first"))
    return found.filter("id > first").select("id", "h").distinct()


def mask_counts(docs: DataFrame, labels: DataFrame, block: int = BLOCK, growth: int = GROWTH) -> DataFrame:
    """(part, fails, n, good, toxic): documents by the set of filters that they fail."""
    rows = materialize(judged(docs, block, growth), "audit-judged")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).filter("id is not null")
    marked = copies(docs, rows).withColumn("e", F.lit("E"))
    all_rows = rows.select("id", "h", "part", "fails").join(marked, ["id", "h"], "left").join(known, "id", "left")
    fails = F.concat("fails", F.coalesce("e", F.lit(""))).alias("fails")
    return all_rows.groupBy("part", fails).agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters, step by step, from ``mask_counts`` alone."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = F.sequence(F.lit(1), F.lit(len(filters)))
    wide = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(steps))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    passed = F.call_function("translate", F.col("fails"), F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1), F.lit("")) == F.col("fails")
    bad = F.contains("fails", "letter")
    total = lambda on, c, name: F.sum(F.when(on, F.col(c)).otherwise(0)).cast("long").alias(name)
    table = wide.withColumn("letter", letter).groupBy("part", "filter_order", "step", "letter").agg(
        total(passed & ~bad, "n", "kept"), total(passed & bad, "n", "removed"), total(~passed & bad, "n", "redundant"),
        total(F.col("fails") == F.col("letter"), "n", "unique_fails"), total(passed & bad, "good", "good_lost"), total(passed & bad, "toxic", "toxic_lost"),
    )
    return table.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interactions(materialize(counts, "audit-counts"))


def oracle() -> str:
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT m.*, filter_order, step, substr(filter_order, step, 1) AS letter, contains(fails, substr(filter_order, step, 1)) AS bad, translate(fails, substr(filter_order, 1, step - 1), '') = fails AS passed
  FROM m, (SELECT unnest([{orders}]) AS filter_order), (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
t AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (passed AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (passed AND bad), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (NOT passed AND bad), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (passed AND bad), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (passed AND bad), 0)::BIGINT AS toxic_lost FROM o GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM t"""
