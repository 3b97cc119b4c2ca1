"""Operator 1: quality rules with adaptive thresholds.

Every document gets counts; per (language, source) the distribution of each derived
metric is kept in a mergeable quantile sketch; the fences read from the sketches
replace fixed cut-offs, and a join brings each document its group's fences.

The sketch is a log-linear histogram over integers (32 buckets an octave, so a value is
known to about 3 %): merging is addition, in any order, so partial sketches combine
map-side, source sketches add up to those of a language, and every run gives the same
bits. A group's fences are read from a weighted merge: its own sketch, and those of its
language and of the whole table as if each were ``PRIOR`` documents. So a group of ten
follows its language, and one of ten thousand itself, with no size at which it changes.

The upper fence is the 90th percentile, and ``REACH`` times as far again as that is from the
median; the lower one mirrors it (10th). Junk that is less than a tenth of a group can't move
it. Metrics that are 0 in half of a group's documents, or equal in most, have no such
distance. For them the sketch is read by octaves: from the 90th percentile on upwards, the
first cluster (octaves that hold more than 1 in ``CLUSTER`` documents) that ``GAP`` empty
octaves part from what is below it is fenced off; without such a cluster nothing is. So junk
can't set the fence that should reject it, and a tail that goes on from the bulk stays.

Rates count what is beyond ``CHANCE``: two symbols, two repeated lines or one passage of
fifteen words that comes twice are no evidence, and in a short text they would be a high rate.

Defined edge cases: a null or empty text has no words (all counts 0) and fails the base
rules; null languages and sources are groups of their own; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import ASCII_SPACE, materialize, some_rows, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
PRIOR = 50  # documents that a language's sketch counts for in that of a source, and the table's
REACH = 3
SCALE = 1_000_000  # weights are integers: one document is this much
NEAR = 900  # in thousandths: where the fences are read
CLUSTER, GAP = 500, 3
#: What is no evidence: symbols, repeated lines, words in repeated windows.
CHANCE = {"symbol_rate": 2, "dup_line_rate": 2, "repeat_rate": 6 * WINDOW}
#: The most that a metric can be, where there is such a thing.
LIMIT = {"dup_line_rate": 1000, "repeat_rate": 1000, "upper_rate": 1000}
#: metric -> two-sided. Per mille, but hundredths for the word length.
METRICS = {"symbol_rate": False, "dup_line_rate": False, "repeat_rate": False, "upper_rate": False, "word_length": True}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur twice or more, first occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) == n:
        return 0
    if len(known) < 6000:  # five digits in this base fit 63 bits: exact keys
        v = len(known)
        key = ids[: n - 4]
        for k in range(1, WINDOW):
            key = key * v + ids[k : n - 4 + k]
    else:  # exact as well: number the pairs, then pairs of pairs
        pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        quad = np.unique(pair[:-2] * (pair.max() + 1) + pair[2:], return_inverse=True)[1]
        key = quad[: n - 4] * len(known) + ids[4:]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[which] > 1)
    if not len(hit):
        return 0
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(step)[:n]))


def count_text(text: str | None) -> tuple[int, ...]:
    """The seven counts of COUNTS for one text."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0, 0, 0, 0, 0, 0, 0)
    spaces = len(raw) - len(raw.translate(None, ASCII_SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), _repeated_words(words), len(lines), upper)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_rows(batches):
            counts = np.array([count_text(t) for t in b.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(x) for x in counts.T], names=keep + names)

    keep, names = ["doc_id", "lang", "source"], [x.split()[0] for x in COUNTS.split(", ")]
    return docs.select(*keep, "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, source string, {COUNTS}")


def with_metrics(counts: DataFrame) -> DataFrame:
    per = lambda a, b, k, m="": F.when(F.col(b) > 0, F.floor(F.greatest(F.col(a) - CHANCE.get(m, 0), F.lit(0)) * k / F.col(b))).otherwise(0).cast("long")
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbol_rate": per("n_symbols", "n_words", 1000, "symbol_rate"),
            "dup_line_rate": per("n_dup_lines", "n_lines", 1000, "dup_line_rate"),
            "repeat_rate": per("n_repeat_words", "n_words", 1000, "repeat_rate"),
            "upper_rate": per("n_upper", "word_chars", 1000),
            "word_length": per("word_chars", "n_words", 100),
        }
    )


def bucket(v: Column) -> Column:
    """Log-linear bucket of an integer >= 0: exact below 64, then 32 an octave."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(32 * e + F.call_function("div", v, F.call_function("shiftleft", F.lit(1).cast("long"), e))).cast("long")


def bucket_floor(b: Column) -> Column:
    e = F.call_function("div", b, F.lit(32)) - 1
    return F.when(b < 64, b).otherwise((b - 32 * e) * F.call_function("shiftleft", F.lit(1).cast("long"), e.cast("int"))).cast("long")


def sketches(rows: DataFrame, *keys: str) -> DataFrame:
    """Mergeable sketches: (keys, metric, bucket, n) of the rows that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")
    long = rows.filter(~F.col("base_failed")).select(*keys, pairs)
    return long.groupBy(*keys, F.col("x.metric").alias("metric"), bucket(F.col("x.v")).alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def shrunk(by_source: DataFrame) -> DataFrame:
    """The weighted merge for each (lang, source): rows of (keys, metric, bucket, n), with n in
    units of 1 / SCALE documents. Of the levels above only sketches are joined, which have
    a few hundred rows a metric."""
    sized = lambda df, *keys: df.withColumn("total", F.sum("n").over(W.partitionBy(*keys, "metric")))
    part = F.call_function("div", F.col("n") * PRIOR * SCALE, F.col("total"))
    by_lang = sized(merge_sketches(by_source, "lang"), "lang").select(F.col("lang").alias("of"), "metric", "bucket", part.alias("n"))
    overall = sized(merge_sketches(by_source)).select("metric", "bucket", part.alias("n"))
    groups = by_source.select("lang", "source", "metric").distinct()
    from_lang = groups.join(by_lang.withColumnRenamed("metric", "m"), F.col("lang").eqNullSafe(F.col("of")) & (F.col("metric") == F.col("m"))).select("lang", "source", "metric", "bucket", "n")
    from_all = groups.join(overall, "metric").select("lang", "source", "metric", "bucket", "n")
    return merge_sketches(by_source.withColumn("n", F.col("n") * SCALE).unionByName(from_lang).unionByName(from_all), "lang", "source")


def octave(b: Column) -> Column:
    """How many binary digits the values of a bucket have."""
    return F.when(b == 0, 0).otherwise(F.length(F.bin(bucket_floor(b)))).cast("long")


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per group the low and high of each metric, read from its sketch alone: bucket floors
    for the median and below, the last value of the bucket above it."""
    by = W.partitionBy(*keys, "metric")
    ranked = sketch.withColumns({"total": F.sum("n").over(by), "upto": F.sum("n").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)), "octave": octave(F.col("bucket"))})
    # thousandths of the total first: 1000 * total may not fit a long
    at = lambda p: F.min(F.when(F.col("upto") >= F.call_function("div", F.col("total"), F.lit(1000)) * p, F.col("bucket")))
    points = (1000 - NEAR, 500, NEAR)
    is_cluster = F.sum("n") > F.call_function("div", F.first("total"), F.lit(CLUSTER))
    by_octave = ranked.groupBy(*keys, "metric", "octave").agg(F.max("bucket").alias("top"), F.min("bucket").alias("bottom"), is_cluster.alias("cluster"), *[at(p).alias(f"b{p}") for p in points])
    q = by_octave.groupBy(*keys, "metric").agg(
        *[F.min(f"b{p}").alias(f"b{p}") for p in points], F.max("top").alias("top"), F.min("bottom").alias("bottom"),
        F.array_sort(F.collect_list(F.when(F.col("cluster"), F.col("octave")))).alias("clusters"),
    )
    floor = lambda p: bucket_floor(F.col(f"b{p}"))
    last = lambda c: bucket_floor(F.col(c) + 1) - 1
    power = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e.cast("int"))
    near, far = F.col(f"b{NEAR}"), F.col(f"b{1000 - NEAR}")
    alone = lambda side, more: F.filter("clusters", lambda o: side(o) & ~F.exists("clusters", more(o)))
    # clusters beyond the bulk with none of GAP octaves below them, and the bulk itself further off
    above = alone(lambda o: o > octave(near) + GAP, lambda o: lambda x: (x < o) & (x >= o - GAP))
    below = alone(lambda o: o < octave(far) - GAP, lambda o: lambda x: (x > o) & (x <= o + GAP))
    q = q.withColumns({"first": F.array_min(above), "last": F.array_max(below)})
    limit = F.create_map(*[x for m, n in LIMIT.items() for x in (F.lit(m), F.lit(n).cast("long"))])[F.col("metric")]
    flat = F.col("b500") == 0
    up = F.when(flat | (near == F.col("b500")), F.coalesce(power(F.col("first") - 1) - 1, last("top"))).otherwise(last(f"b{NEAR}") + REACH * (last(f"b{NEAR}") - floor(500)))
    down = F.when(flat | (far == F.col("b500")), F.coalesce(power(F.col("last")), bucket_floor(F.col("bottom")))).otherwise(floor(1000 - NEAR) - REACH * (floor(500) - floor(1000 - NEAR)))
    q = q.select(*keys, "metric", F.least(up, limit).alias("high"), F.greatest(down, F.lit(0)).alias("low"))
    pick = lambda c, m: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    return q.groupBy(*keys).agg(*[pick("high", m) for m in METRICS], *[pick("low", m) for m, two in METRICS.items() if two])


def adaptive_rules(docs: DataFrame) -> DataFrame:
    """Counts, fences, base verdict and the adaptive verdict of every document."""
    rows = with_metrics(materialize(text_counts(docs), "quality-counts"))
    by_source = materialize(sketches(rows, "lang", "source"), "quality-sketches")
    limits = materialize(fences(shrunk(by_source), "lang", "source"), "quality-fences").withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    # a left join: a group whose rows all fail the base rules has no sketch, and needs none
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    ok = ~F.col("base_failed")
    for m, two in METRICS.items():
        ok = ok & (F.col(m) <= F.col(f"{m}_high"))
        if two:
            ok = ok & (F.col(m) >= F.col(f"{m}_low"))
    return joined.withColumn("kept", F.coalesce(ok, F.lit(False))).drop("t_lang", "t_source")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """DuckDB SQL of op1: the same integer arithmetic, written relationally."""
    metric_rows = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, {m} AS v FROM m WHERE NOT base_failed" for m in METRICS)
    two = ", ".join(f"'{m}'" for m, t in METRICS.items() if t)
    at = lambda p: f"min(bucket) FILTER (upto >= total // 1000 * {p})"
    floor = lambda b: f"CASE WHEN {b} < 64 THEN {b} ELSE ({b} - 32*({b}//32-1)) * (1::BIGINT << ({b}//32-1)::INT) END"
    digits = lambda v: f"(CASE WHEN {v} = 0 THEN 0 ELSE length(bin({v})) END)"
    limits = " ".join(f"WHEN '{m}' THEN {n}" for m, n in LIMIT.items())
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text,'') AS text, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, five FROM g GROUP BY ALL HAVING count(*) > 1),
rw AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT g.doc_id, unnest(range(i, i+5)) AS p FROM g JOIN rep USING (doc_id, five)) GROUP BY 1),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
   CASE WHEN len(ws)=0 THEN 0 ELSE length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) END::BIGINT AS n_symbols,
   length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
   coalesce(n_dup,0)::BIGINT AS n_dup_lines, coalesce(rw.n,0)::BIGINT AS n_repeat_words, coalesce(n_lines,0)::BIGINT AS n_lines
   FROM w LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id)),
m AS (SELECT *, (n_words < {MIN_WORDS} OR 100*n_repeat_words > 20*n_words) AS base_failed,
   CASE WHEN n_words>0 THEN greatest(n_symbols-{CHANCE["symbol_rate"]},0)*1000//n_words ELSE 0 END AS symbol_rate,
   CASE WHEN n_lines>0 THEN greatest(n_dup_lines-{CHANCE["dup_line_rate"]},0)*1000//n_lines ELSE 0 END AS dup_line_rate,
   CASE WHEN n_words>0 THEN greatest(n_repeat_words-{CHANCE["repeat_rate"]},0)*1000//n_words ELSE 0 END AS repeat_rate,
   CASE WHEN word_chars>0 THEN n_upper*1000//word_chars ELSE 0 END AS upper_rate,
   CASE WHEN n_words>0 THEN word_chars*100//n_words ELSE 0 END AS word_length FROM c),
lg AS ({metric_rows}),
sk AS (SELECT lang, source, metric, CASE WHEN v < 64 THEN v ELSE 32*(length(bin(v))-6) + (v >> (length(bin(v))-6)::INT) END AS bucket, count(*) AS n FROM lg GROUP BY ALL),
sl AS (SELECT lang, metric, bucket, sum(n)::BIGINT AS n FROM sk GROUP BY ALL), sa AS (SELECT metric, bucket, sum(n)::BIGINT AS n FROM sk GROUP BY ALL),
tl AS (SELECT lang, metric, sum(n)::BIGINT AS total FROM sk GROUP BY ALL), ta AS (SELECT metric, sum(n)::BIGINT AS total FROM sk GROUP BY ALL),
gr AS (SELECT DISTINCT lang, source, metric FROM sk),
mx AS (SELECT lang, source, metric, bucket, sum(n)::BIGINT AS n FROM (
   SELECT lang, source, metric, bucket, n * {SCALE} AS n FROM sk
   UNION ALL SELECT gr.lang, gr.source, gr.metric, sl.bucket, sl.n * {PRIOR * SCALE} // tl.total FROM gr JOIN sl ON gr.metric = sl.metric AND gr.lang IS NOT DISTINCT FROM sl.lang JOIN tl ON tl.metric = sl.metric AND tl.lang IS NOT DISTINCT FROM sl.lang
   UNION ALL SELECT gr.lang, gr.source, gr.metric, sa.bucket, sa.n * {PRIOR * SCALE} // ta.total FROM gr JOIN sa USING (metric) JOIN ta USING (metric)) GROUP BY ALL),
rk AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric) AS total, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto FROM mx),
fl AS (SELECT *, CASE WHEN bucket < 64 THEN bucket ELSE (bucket - 32*(bucket//32-1)) * (1::BIGINT << (bucket//32-1)::INT) END AS v FROM rk),
oc AS (SELECT lang, source, metric, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END AS o, sum(n) > any_value(total) // {CLUSTER} AS cluster FROM fl GROUP BY ALL),
cl AS (SELECT lang, source, metric, list(o) FILTER (cluster) AS os FROM oc GROUP BY ALL),
q AS (SELECT lang, source, metric, {at(1000 - NEAR)} AS blow, {at(500)} AS bmid, {at(NEAR)} AS bhigh, max(bucket) AS btop, min(bucket) AS bbottom FROM rk GROUP BY ALL),
v AS (SELECT lang, source, metric, {", ".join(f"{floor(f'b{x}')} AS {x}" for x in ("low", "mid", "high", "bottom"))}, {floor("(bhigh+1)")} - 1 AS high_last, {floor("(btop+1)")} - 1 AS top_last FROM q),
e AS (SELECT v.*, mid = 0 OR blow = bmid AS flat_low, mid = 0 OR bhigh = bmid AS flat_high,
   list_min(list_filter(os, lambda o: o > {digits("high")} + {GAP} AND len(list_filter(os, lambda x: x < o AND x >= o - {GAP})) = 0)) AS first,
   list_max(list_filter(os, lambda o: o < {digits("low")} - {GAP} AND len(list_filter(os, lambda x: x > o AND x <= o + {GAP})) = 0)) AS last
   FROM v JOIN q ON v.metric = q.metric AND v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source
   JOIN cl ON v.metric = cl.metric AND v.lang IS NOT DISTINCT FROM cl.lang AND v.source IS NOT DISTINCT FROM cl.source),
f AS (SELECT lang, source, metric, greatest(0, CASE WHEN flat_low THEN coalesce(1::BIGINT << last::INT, bottom) ELSE low - {REACH} * (mid - low) END) AS low,
   least(CASE WHEN flat_high THEN coalesce((1::BIGINT << (first - 1)::INT) - 1, top_last) ELSE high_last + {REACH} * (high_last - mid) END, CASE metric {limits} ELSE 9223372036854775807 END) AS high FROM e),
bad AS (SELECT DISTINCT lg.doc_id FROM lg JOIN f ON lg.metric = f.metric AND lg.lang IS NOT DISTINCT FROM f.lang AND lg.source IS NOT DISTINCT FROM f.source
   WHERE v > high OR (lg.metric IN ({two}) AND v < low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
   NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m"""
