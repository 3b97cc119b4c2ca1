"""Queries of the operators that have no bound on the size of one key: interval joins on a
grid, prefix scans, the vector index, resumable evaluation and the versioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import textmetrics
from ..operators import overlap, prompts, quality, scan
from ..operators.vector_index import VectorIndex
from ..sources import commits, media, tables
from . import virtual as V
from .catalogue import CONFIGS, ORACLES, _ranked, _topk_sql, query, r9

# --- prefix scans: five event types are the keys, however many events there are ----------

_EVENT_TIME = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE"
_EVENT_SPANS = f"o AS (SELECT event_type AS k, {_EVENT_TIME} AS s, {_EVENT_TIME} + 20 * (1 + user_id % 5) AS e FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts)") / F.lit(1e6)
    return V.table(spark, d, "events").withColumn("start", at).withColumn("end", at + 20 * (1 + F.col("user_id") % 5))


@query(f'WITH {_EVENT_SPANS}, {V.islands_sql("m", "o", "k")} SELECT k, s AS start, e AS "end", n::BIGINT AS n_spans FROM m')
def q88_scan_islands(spark: SparkSession, d: str) -> DataFrame:
    return scan.merge_islands(_events(spark, d).select(F.col("event_type").alias("k"), "start", "end"), "k")


@query(f"""WITH p AS (SELECT event_type AS video_id, event_id AS seq, {_EVENT_TIME} AS start, (user_id % 3)::VARCHAR AS text FROM events),
q AS (SELECT *, coalesce(lead(start) OVER w, start + 3.0) AS e, lag(text, 1, '') OVER w AS before FROM p WINDOW w AS (PARTITION BY video_id ORDER BY seq))
SELECT video_id, seq, start, e AS "end", text FROM q WHERE text <> before""")
def q89_scan_segments(spark: SparkSession, d: str) -> DataFrame:
    phrases = _events(spark, d).select(F.col("event_type").alias("video_id"), F.col("event_id").alias("seq"), "start", (F.col("user_id") % 3).cast("string").alias("text"))
    return scan.segments_of(phrases)


@query("SELECT event_id, event_type || '_q' || printf('%03d', row_number() OVER (PARTITION BY event_type ORDER BY event_id) + 15) AS qa_id FROM events")
def q90_scan_renumber(spark: SparkSession, d: str) -> DataFrame:
    return scan.renumber(V.table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", "qa_id").select("event_id", "qa_id")


# --- interval joins: shipments of a supplier, a day from dispatch for each piece ----------

_DAY = "date_diff('day', DATE '1992-01-01', {}::DATE)::DOUBLE"
_SHIPMENTS = f"""s AS (SELECT l_suppkey AS video_id, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS flag, {_DAY.format("l_shipdate")} AS s, {_DAY.format("l_shipdate")} + l_quantity::DOUBLE AS e FROM lineitem),
l AS (SELECT * FROM s WHERE flag = 'R'), r AS (SELECT * FROM s WHERE flag = 'A')"""
_IOU = V.iou_sql("l.s", "l.e", "r.s", "r.e")
THRESHOLD = 0.6


def _shipments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    rows = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag", day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_quantity").cast("double")).alias("end"))
    side = lambda flag, name: rows.filter(F.col("l_returnflag") == flag).withColumnRenamed("id", name).drop("l_returnflag")
    return side("R", "left_id"), side("A", "right_id")


@query(f"WITH {_SHIPMENTS} SELECT l.video_id, l.id AS left_id, r.id AS right_id, round_even({_IOU}, 9) AS iou FROM l JOIN r ON l.video_id = r.video_id AND {_IOU} >= {THRESHOLD}")
def q91_iou_threshold_join(spark: SparkSession, d: str) -> DataFrame:
    return overlap.iou_join(*_shipments(spark, d), THRESHOLD).withColumn("iou", r9("iou"))


_T, _RATIO = f"{THRESHOLD}::DOUBLE", (1 - THRESHOLD) / THRESHOLD
_WIDTH = f"(2.0 ** (level + 1) * {max(_RATIO, 0.25)!r}::DOUBLE)"
_REACH = f"(least(len, 2.0 ** (level + 1)) * {_RATIO!r}::DOUBLE * (1 + 1e-9) + 1e-9)"


@query(f"""WITH {_SHIPMENTS},
a AS (SELECT video_id, s, e - s AS len, unnest(range(floor(log2((e - s) * {_T}) - 1e-9)::BIGINT, floor(log2((e - s) / {_T}) + 1e-9)::BIGINT + 1)) AS level FROM l WHERE e > s),
ac AS (SELECT video_id, level, unnest(range(floor((s - {_REACH}) / {_WIDTH})::BIGINT, floor((s + {_REACH}) / {_WIDTH})::BIGINT + 1)) AS cell FROM a),
b AS (SELECT video_id, level, floor(s / {_WIDTH})::BIGINT AS cell FROM (SELECT *, floor(log2(e - s))::BIGINT AS level FROM r WHERE e > s)),
g AS (SELECT video_id, count(*) AS compared FROM ac JOIN b USING (video_id, level, cell) GROUP BY 1),
p AS (SELECT l.video_id, count(*) AS pairs, count(*) FILTER ({_IOU} >= {THRESHOLD}) AS linked FROM l JOIN r ON l.video_id = r.video_id GROUP BY 1)
SELECT video_id, pairs, coalesce(compared, 0) AS compared, linked FROM p LEFT JOIN g USING (video_id)""")
def q92_iou_join_work(spark: SparkSession, d: str) -> DataFrame:
    """For each supplier all pairs there are, those that the grid compares, and those linked."""
    left, right = _shipments(spark, d)
    iou = overlap.temporal_iou(F.col("ls"), F.col("le"), F.col("rs"), F.col("re"))
    some = overlap.iou_candidates(left, right, THRESHOLD).groupBy("video_id").agg(F.count("*").alias("compared"), F.count_if(iou >= THRESHOLD).alias("linked"))
    sizes = left.groupBy("video_id").agg(F.count("*").alias("a")).join(right.groupBy("video_id").agg(F.count("*").alias("b")), "video_id")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sizes.join(some, "video_id", "left").select("video_id", (F.col("a") * F.col("b")).alias("pairs"), none("compared"), none("linked"))


@query(f"WITH {_SHIPMENTS} SELECT l.video_id, l.id AS left_id, r.id AS right_id FROM l JOIN r ON l.video_id = r.video_id AND r.s <= l.s AND r.e >= l.e")
def q93_holding_join(spark: SparkSession, d: str) -> DataFrame:
    left, right = _shipments(spark, d)
    held = right.select("video_id", "right_id", F.col("start").alias("start_time"), F.col("end").alias("end_time"))
    return overlap.holding_join(left, held).select("video_id", "left_id", F.col("c_right_id").alias("right_id"))


# --- the vector index ---------------------------------------------------------------------


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = VectorIndex(spark, tables.scratch_folder(spark, "index")).build(vectors)
    return index.search(vectors.filter("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id"), 4)


@query(_topk_sql("true"))
def q94_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The result of q08, from the index."""
    return _ranked(_searched(spark, d)[0])


@query()
def q95_index_work(spark: SparkSession, d: str) -> DataFrame:
    """How much of the index each query needed; no SQL, as it depends on the fitted centres."""
    return _searched(spark, d)[1]


# --- commits ------------------------------------------------------------------------------

_BATCHES, _FIRST = 4, 2


@query(f"""WITH {V.EVAL}, b AS (SELECT *, ('0x' || substr(md5(qa_id::VARCHAR), 1, 8))::BIGINT % {_BATCHES} AS batch FROM ev)
SELECT qa_id, config, round_even(temporal_iou, 9) AS temporal_iou, CASE WHEN batch < {_FIRST} THEN 1 ELSE 2 END AS run FROM b""")
def q96_evaluate_resumed(spark: SparkSession, d: str) -> DataFrame:
    """An evaluation that stops half-way and is run again; ``run`` says which run scored a row."""
    work = commits.ResumableEvaluation(spark, tables.scratch_folder(spark, "evaluation"), "qa_id long, config string, temporal_iou double, run int")

    def score(run: int):
        def of(todo: DataFrame) -> DataFrame:
            rows = V.evaluated(spark, d, only=todo.select("qa_id").distinct()).join(todo, ["qa_id", "config"], "left_semi")
            return rows.select("qa_id", "config", "temporal_iou", F.lit(run).alias("run"))

        return of

    pairs = V.questions(spark, d).select("qa_id")
    work.run(pairs, CONFIGS, score(1), _BATCHES, stop_after=_FIRST)
    work.run(pairs, CONFIGS, score(2), _BATCHES)
    return work.results().withColumn("temporal_iou", r9("temporal_iou"))


@query(f"""WITH {V.CORPUS}, b AS (SELECT chunk_id, video_id, CASE WHEN video_id < 5 THEN 'first' ELSE 'second' END AS document FROM corpus)
SELECT 'before' AS reader, chunk_id, video_id, document FROM b UNION ALL SELECT 'after', chunk_id, video_id, CASE WHEN video_id < 2 THEN 'again' ELSE document END FROM b""")
def q97_versioned_store(spark: SparkSession, d: str) -> DataFrame:
    """A reader that opens the store before a rebuild, and one that opens it afterwards."""
    c = V.corpus(spark, d).select("chunk_id", "video_id")
    as_ = lambda rows, name: rows.withColumn("document", F.lit(name))
    store = commits.VersionedStore(spark, tables.scratch_folder(spark, "store"), "chunk_id long, video_id long, document string")
    store.write(as_(c.filter("video_id < 5"), "first"))
    store.write(as_(c, "second"))
    before = store.rows()
    store.write(as_(c.filter("video_id < 2"), "again"), replace=True)
    named = lambda rows, name: rows.select(F.lit(name).alias("reader"), "chunk_id", "video_id", "document")
    return named(before, "before").unionByName(named(store.rows(), "after"))


# --- files that are read in place ------------------------------------------------------------


@query("""SELECT s_suppkey::VARCHAR AS video_id, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE (CASE WHEN s_suppkey % 5 = 0 THEN n // 2 ELSE n END) / 8000.0::DOUBLE END AS seconds,
 CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 5 = 0 END AS truncated, CASE WHEN s_suppkey % 11 = 0 THEN 'not a WAV file' END AS problem,
 s_suppkey % 11 <> 0 AND (CASE WHEN s_suppkey % 5 = 0 THEN n // 2 ELSE n END) / 8000.0::DOUBLE < 0.8 * (n / 8000.0::DOUBLE) AS lost
FROM (SELECT s_suppkey, 100 + s_suppkey % 977 AS n FROM supplier)""")
def q98_wav_durations(spark: SparkSession, d: str) -> DataFrame:
    """A sound file a supplier, some cut short, some with a chunk of odd length before the
    data, some no sound at all: durations from their headers, and whether sound was lost."""
    s = V.table(spark, d, "supplier").select("s_suppkey", (100 + F.col("s_suppkey") % 977).alias("n"))
    hexes = lambda x, size: F.concat(*[F.lpad(F.hex(F.floor(x / 256**i) % 256), 2, "0") for i in range(size)])  # noqa: E731  little endian
    text = lambda t: F.lit(t.encode().hex())
    extra = F.when(F.col("s_suppkey") % 7 == 0, F.concat(text("LIST"), hexes(F.lit(3), 4), text("abc"), F.lit("00"))).otherwise("")
    form = F.concat(text("fmt "), hexes(F.lit(16), 4), hexes(F.lit(1), 2), hexes(F.lit(1), 2), hexes(F.lit(8000), 4), hexes(F.lit(8000), 4), hexes(F.lit(1), 2), hexes(F.lit(8), 2))
    there = F.when(F.col("s_suppkey") % 5 == 0, F.floor(F.col("n") / 2)).otherwise(F.col("n")).cast("int")
    body = F.concat(F.when(F.col("s_suppkey") % 11 == 0, text("JUNK")).otherwise(text("RIFF")), hexes(F.col("n") + 36, 4), text("WAVE"), form, extra, text("data"), hexes(F.col("n"), 4))
    content = F.unhex(F.concat(body, F.repeat(F.lit("80"), there)))
    folder = tables.scratch_folder(spark, "sound")
    media.write_files(s.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".wav")).alias("name"), content.alias("content")), folder)
    media.register(spark)
    found = spark.read.format("wav_headers").load(folder)
    both = found.join(s.select(F.col("s_suppkey").cast("string").alias("video_id"), (F.col("n") / 8000).alias("duration")), "video_id")
    lost = F.coalesce(tables.has_audio_loss("seconds"), F.lit(False))
    return both.select("video_id", "seconds", "truncated", "problem", lost.alias("lost"))


@query(ORACLES["q52_vtt_roundtrip"])
def q99_caption_cues(spark: SparkSession, d: str) -> DataFrame:
    """The cues of q52, from files that are read cue by cue."""
    folder = tables.scratch_folder(spark, "captions")
    files = V.caption_files(spark, d)
    media.write_files(files.select(F.concat(F.col("video_id"), F.lit(".en.vtt")).alias("name"), F.col("raw").cast("binary").alias("content")), folder)
    media.register(spark)
    cues = spark.read.format("caption_cues").load(folder)
    return cues.select("video_id", r9("start"), r9("end"), F.col("text_lines")[0].alias("text"))


# --- the other half, the gate, the system text -------------------------------------------------


@query(f"WITH {V.CORPUS}, s AS (SELECT DISTINCT video_id FROM corpus WHERE chunk_id % 7 = 0 AND video_id < 6) SELECT chunk_id, corpus.video_id, s.video_id IS NOT NULL AS stored FROM corpus LEFT JOIN s USING (video_id)")
def q100_existing_and_new(spark: SparkSession, d: str) -> DataFrame:
    c = V.corpus(spark, d).select("chunk_id", "video_id")
    stored = c.filter("chunk_id % 7 = 0 and video_id < 6")
    return tables.existing_keys(c, stored).withColumn("stored", F.lit(True)).unionByName(tables.new_keys(c, stored).withColumn("stored", F.lit(False)))


@query(f"""WITH {V.REVIEW}, s AS (SELECT DISTINCT source AS video_id FROM documents),
a AS (SELECT video_id, count(*) FILTER (decision = 'ACCEPT' AND toxic_free) AS n, count(*) FILTER (decision = 'ACCEPT' AND toxic_free AND question_type IN ('visual', 'multi-hop-visual')) AS visual, count(*) FILTER (decision = 'ACCEPT') AS n2, count(*) FILTER (decision = 'ACCEPT' AND question_type IN ('visual', 'multi-hop-visual')) AS visual2
  FROM (SELECT *, video_id NOT IN ('src1', 'src2') AS toxic_free FROM dec) GROUP BY 1),
f AS (SELECT s.video_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN coalesce(n2, 0) ELSE n END AS total, CASE WHEN coalesce(n, 0) = 0 THEN coalesce(visual2, 0) ELSE visual END AS visual FROM s LEFT JOIN a USING (video_id))
SELECT sum(total)::BIGINT AS total, sum(visual)::BIGINT AS visual, count(*) FILTER (n = 0)::BIGINT AS zero_before, CASE WHEN sum(total) < 500 OR sum(visual) < 300 OR count(*) FILTER (n = 0) > 0 THEN 1 ELSE 0 END AS exit_value FROM f""")
def q101_coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Two lectures have nothing accepted yet; the fix brings what their reviews accept."""
    accepted = quality.review_decision(V.reviews(spark, d)).filter("decision = 'ACCEPT'")
    keys = V.table(spark, d, "documents").select(F.col("source").alias("video_id")).distinct()
    visual = F.col("question_type").isin(*schemas.VISUAL_TYPES)
    by = accepted.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(visual).alias("visual"))
    after = keys.join(by, "video_id", "left").na.fill(0)
    before = after.withColumn("n", F.when(F.col("video_id").isin("src1", "src2"), 0).otherwise(F.col("n")))
    return quality.coverage_gate(before, after)


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 > 1 THEN 'You see several frames of each passage of a lecture, in order, and read what is said there.' ELSE 'You see one frame of each passage of a lecture and read what is said there.' END
 || chr(10) || CASE WHEN turn % 2 = 0 THEN text ELSE '--- Segment 1 ---' || chr(10) || text || chr(10) || '--- Segment 2 ---' || chr(10) || 'x' END || chr(10) || 'Question: q' AS prompt FROM conversations""")
def q102_video_system(spark: SparkSession, d: str) -> DataFrame:
    segments = F.when(F.col("turn") % 2 == 0, F.array("text")).otherwise(F.array(F.col("text"), F.lit("x")))
    return V.table(spark, d, "conversations").select("conv_id", "turn", prompts.video_prompt(F.lit("q"), segments, F.col("turn") % 3).alias("prompt"))


# --- METEOR with a lexicon -----------------------------------------------------------------------


@query()
def q103_meteor_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark with the same first five letters stand in for synonyms; no SQL, as
    q55 has none (stemmer): pytest has the matching by brute force."""
    words = V.table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"\W+")).alias("word")).filter(F.length("word") > 5).distinct()
    lexicon = words.select("word", F.substring("word", 1, 5).alias("set_id"))
    scored = textmetrics.with_meteor(V.text_pairs(spark, d), lexicon, ["conv_id", "turn"])
    return scored.select("conv_id", "turn", r9("meteor"))
