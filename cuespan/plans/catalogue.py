"""The query catalogue: each entry is a Spark query and, where SQL can say it, its DuckDB
counterpart. Names are numbered as the blueprint's query set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas
from ..functions import parsing, spans, text, textmetrics
from ..operators import evaluate, joins, overlap, prompts, quality, retrieval, sequence
from ..sources import captions as vtt
from ..sources import tables
from . import virtual as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CONFIGS, TYPES = schemas.CONFIGS, schemas.QUESTION_TYPES


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r9(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.bround(col, 9).alias(name or str(c))


# --- sequences and windows -------------------------------------------------------------


@query(f"""WITH {V.SEG}, p AS (SELECT *, coalesce(lead(start) OVER w, start+3.0) AS e, lag(text,1,'') OVER w AS before FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY seq))
SELECT video_id, seq, start, e AS "end", text FROM p WHERE text <> before""")
def q01_segments_lead_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = sequence.segments_of(V.segments(spark, d).select("video_id", "seq", "start", "text"))
    return s.select("video_id", "seq", "start", "end", "text")


@query(f"""WITH {V.SEG}, m AS (SELECT *, value < 10 AND user_id % 7 <> 0 AS short, bool_or(value < 10 AND user_id % 7 <> 0) OVER (PARTITION BY video_id) AS has_short FROM seg)
SELECT video_id, seq, start, CASE WHEN has_short THEN text ELSE props END AS text FROM m WHERE short OR NOT has_short""")
def q02_display_cue_fallback(spark: SparkSession, d: str) -> DataFrame:
    cues = V.segments(spark, d).withColumn("text_lines", F.array("text", "props"))
    return sequence.display_phrases(cues, (F.col("value") < 10) & (F.col("user_id") % 7 != 0)).select("video_id", "seq", "start", "text")


@query(f"WITH {V.SEG}, {V.CHUNK} SELECT * FROM chunk")
def q03_sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d)


@query(f"""WITH {V.SEG}, t AS (SELECT video_id, max(start)+3.0 AS dur FROM seg GROUP BY 1), g AS (SELECT video_id, dur, unnest(range(0, floor(dur/15.0)::BIGINT+1)) AS i FROM t)
SELECT video_id || '_frame_' || printf('%03d', i) AS frame_id, video_id, (i*15.0)::DOUBLE AS time FROM g WHERE i*15.0 < dur""")
def q04_frame_grid(spark: SparkSession, d: str) -> DataFrame:
    return sequence.frame_grid(V.segments(spark, d).groupBy("video_id").agg(F.max("end").alias("duration")))


@query(f"""WITH {V.SEG}, {V.CHUNK}, cap AS (SELECT video_id, seq, start AS t, text || ':' || json_extract_string(props, '$.k') AS caption FROM seg WHERE text = 'view'),
ins AS (SELECT chunk_id, seq, caption FROM chunk c JOIN cap p ON c.video_id=p.video_id AND t >= start_time AND t < end_time),
near AS (SELECT chunk_id, seq, caption FROM (SELECT chunk_id, seq, caption, row_number() OVER (PARTITION BY chunk_id ORDER BY abs(t-(start_time+end_time)/2), seq) AS rn FROM chunk c JOIN cap p ON c.video_id=p.video_id) WHERE rn=1 AND chunk_id NOT IN (SELECT chunk_id FROM ins)),
u AS (SELECT * FROM ins UNION ALL SELECT * FROM near), g AS (SELECT chunk_id, count(*) AS n, string_agg('[frame caption: ' || caption || ']', ' ' ORDER BY seq) AS m FROM u GROUP BY 1)
SELECT chunk_id, coalesce(n,0)::BIGINT AS n_captions, CASE WHEN m IS NULL THEN text ELSE text || ' ' || m END AS text FROM chunk LEFT JOIN g USING (chunk_id)""")
def q05_caption_assign_fallback(spark: SparkSession, d: str) -> DataFrame:
    out = joins.assign_captions(V.chunks(spark, d), V.captions(spark, d))
    return out.select("chunk_id", F.size("frame_captions").cast("long").alias("n_captions"), "text")


_HOPS_OF_USERS = "h AS (SELECT DISTINCT video_id, 60.0::DOUBLE*(user_id%10) AS hop FROM seg)"


@query(f"""WITH {V.SEG}, {V.CHUNK}, {_HOPS_OF_USERS}
SELECT h.video_id, hop, count(*)::BIGINT AS n_chunks, string_agg(text, ' ' ORDER BY chunk_id) AS text FROM h JOIN chunk c ON h.video_id=c.video_id AND start_time BETWEEN greatest(0.0, hop-120.0) AND hop+120.0 GROUP BY 1, 2""")
def q06_oracle_window_text(spark: SparkSession, d: str) -> DataFrame:
    hops = V.segments(spark, d).select("video_id", (60.0 * (F.col("user_id") % 10)).alias("start")).distinct()
    near = joins.oracle_window(hops, V.chunks(spark, d))
    g = near.groupBy("video_id", F.col("start").alias("hop")).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("c"))
    return g.select("video_id", "hop", F.size("c").cast("long").alias("n_chunks"), F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("text"))


@query(f"""WITH {V.CORPUS}, {V.QA}, n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY qa_id) > 1 THEN 2 ELSE 4 END AS n, greatest(gs-20.0, 0.0) AS t0, least(ge+20.0, 420.0) AS t1 FROM hops), g AS (SELECT *, unnest(range(0, n)) AS i FROM n)
SELECT qa_id, hop::BIGINT AS hop, i::BIGINT AS i, round_even(CASE WHEN n=1 THEN (t0+t1)/2 ELSE t0+i*(t1-t0)/(n-1) END, 9) AS t FROM g""")
def q07_oracle_frame_times(spark: SparkSession, d: str) -> DataFrame:
    h = V.questions(spark, d).select("qa_id", F.size("hops").alias("_n"), F.posexplode("hops").alias("p", "h"))
    n = sequence.frames_per_hop(F.lit(4), F.col("_n"), 4)
    times = sequence.sample_times(F.col("h.start") - 20.0, F.col("h.end") + 20.0, n, F.lit(420.0))
    return h.select("qa_id", (F.col("p") + 1).cast("long").alias("hop"), F.posexplode(times).alias("i", "t")).select("qa_id", "hop", F.col("i").cast("long").alias("i"), r9("t"))


# --- retrieval -------------------------------------------------------------------------

_SIM = "round_even(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9)"


def _topk_sql(on: str) -> str:
    return f"""WITH {V.CORPUS}, q AS (SELECT * FROM corpus WHERE chunk_id % 5 = 0), s AS (SELECT q.chunk_id AS query_id, c.chunk_id, {_SIM} AS score FROM q JOIN corpus c ON {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, rank::BIGINT AS rank, round_even(score, 6) AS score FROM r WHERE rank <= 4"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.bround("score", 6).alias("score"))


@query(_topk_sql("true"))
def q08_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    c = V.corpus(spark, d)
    return _ranked(retrieval.topk_blocks(c.filter("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id"), c, 4))


@query(_topk_sql("q.video_id = c.video_id"))
def q09_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    c = V.corpus(spark, d)
    return _ranked(retrieval.topk_within(c.filter("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id"), c, 4))


@query(f"WITH {V.CORPUS} SELECT chunk_id, video_id, start_time FROM corpus WHERE video_id >= 5")
def q10_incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    c = V.corpus(spark, d).select("chunk_id", "video_id", "start_time")
    return tables.new_keys(c, c.filter("video_id < 5 and chunk_id % 3 = 0"))


@query(f"WITH {V.CORPUS} SELECT chunk_id, video_id, CASE WHEN video_id < 3 THEN start_time + 1000 ELSE start_time END AS start_time FROM corpus")
def q11_rebuild_partition(spark: SparkSession, d: str) -> DataFrame:
    c = V.corpus(spark, d).select("chunk_id", "video_id", "start_time")
    return tables.replace_keys(c.filter("video_id < 3").withColumn("start_time", F.col("start_time") + 1000), c)


# --- interval algebra ------------------------------------------------------------------


def _hops(spark: SparkSession, d: str) -> DataFrame:
    return V.questions(spark, d).select("qa_id", "video_id", "question_type", F.posexplode("hops").alias("p", "h")).select("qa_id", "video_id", "question_type", (F.col("p") + 1).cast("long").alias("hop"), F.col("h.start").alias("gs"), F.col("h.end").alias("ge"))


@query(f"""WITH {V.CORPUS}, {V.QA} SELECT qa_id, hop::BIGINT AS hop, c.chunk_id, round_even({V.iou_sql("c.start_time", "c.end_time", "gs", "ge")}, 9) AS iou, {V.iou_sql("c.start_time", "c.end_time", "gs", "ge")} >= 0.3 AS hit
FROM hops h JOIN corpus c ON h.video_id = c.video_id""")
def q12_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    spans_of = _hops(spark, d).select("video_id", F.col("gs").alias("start"), F.col("ge").alias("end"), F.struct("qa_id", "hop").alias("left_id"))
    chunks = V.corpus(spark, d).select("video_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.col("chunk_id").alias("right_id"))
    p = overlap.all_pairs(spans_of, chunks, lambda a: {"iou": r9(spans.temporal_iou(*a), "iou"), "hit": spans.iou_at(*a, 0.3)})
    return p.select("left_id.*", F.col("right_id").alias("chunk_id"), "iou", "hit")


_ORDER_SPANS = "o AS (SELECT o_custkey AS k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE + 30 AS e FROM orders)"


def _order_spans(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return V.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), day.alias("start"), (day + 30).alias("end"))


@query(f'WITH {_ORDER_SPANS}, {V.islands_sql("m", "o", "k")} SELECT k, s AS start, e AS "end" FROM m')
def q13_merge_spans(spark: SparkSession, d: str) -> DataFrame:
    g = _order_spans(spark, d).groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    return g.select("k", F.inline(spans.merge_spans(F.col("s"))))


@query(f'WITH {_ORDER_SPANS}, {V.islands_sql("m", "o", "k")} SELECT k, s AS start, e AS "end", n::BIGINT AS n_spans FROM m')
def q14_merge_spans_islands(spark: SparkSession, d: str) -> DataFrame:
    return spans.merge_islands(_order_spans(spark, d), "k")


def _ev(*cols: str) -> str:
    flags = {"iou_at_03", "iou_at_05", "hit_rate_at_1", "hit_rate_at_3", "hit_rate_at_5", "multihop_complete_at_5", "question_type"}
    return f"WITH {V.EVAL} SELECT qa_id, config, {', '.join(c if c in flags else f'round_even({c}, 9) AS {c}' for c in cols)} FROM ev"


def _ev_rows(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    e = V.evaluated(spark, d)
    return e.select("qa_id", "config", *[r9(c) if dict(e.dtypes)[c] == "double" else F.col(c) for c in cols])


@query(_ev("multihop_union_iou"))
def q15_union_iou(spark: SparkSession, d: str) -> DataFrame:
    return _ev_rows(spark, d, "multihop_union_iou")


@query(_ev("multihop_per_hop_iou"))
def q16_per_hop_iou(spark: SparkSession, d: str) -> DataFrame:
    return _ev_rows(spark, d, "multihop_per_hop_iou")


@query(_ev("hit_rate_at_1", "hit_rate_at_3", "hit_rate_at_5"))
def q17_hit_rate_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _ev_rows(spark, d, "hit_rate_at_1", "hit_rate_at_3", "hit_rate_at_5")


@query(_ev("multihop_per_hop_recall_at_5"))
def q18_per_hop_recall(spark: SparkSession, d: str) -> DataFrame:
    return _ev_rows(spark, d, "multihop_per_hop_recall_at_5")


@query(_ev("multihop_complete_at_5"))
def q19_complete_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _ev_rows(spark, d, "multihop_complete_at_5")


@query(_ev("citation_accuracy"))
def q20_citation_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _ev_rows(spark, d, "citation_accuracy")


@query(_ev("question_type", *evaluate.METRICS, *evaluate.JUDGE))
def q21_eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return _ev_rows(spark, d, "question_type", *evaluate.METRICS, *evaluate.JUDGE)


# --- aggregates and reports ------------------------------------------------------------

_ALL = (*evaluate.METRICS, *evaluate.JUDGE)
_MEANS = ", ".join(f"round_even(avg({c}::DOUBLE), 9) AS {c}" for c in _ALL)


@query(f"""WITH {V.EVAL}, b AS (SELECT *, CASE WHEN question_type LIKE 'multi-hop%' THEN 'multi_hop' ELSE 'single_hop' END AS hg FROM ev)
SELECT 'overall' AS level, 'all' AS value, count(*)::BIGINT AS n, {_MEANS} FROM b UNION ALL SELECT 'config', config, count(*), {_MEANS} FROM b GROUP BY config
UNION ALL SELECT 'question_type', question_type, count(*), {_MEANS} FROM b GROUP BY question_type UNION ALL SELECT 'hop_group', hg, count(*), {_MEANS} FROM b GROUP BY hg""")
def q22_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pooled_means(V.evaluated(spark, d), _ALL)


@query("""WITH s AS (SELECT count(*) AS n, sum((quality-toxic)**2)::DOUBLE AS d, sum(quality+toxic)::DOUBLE AS t, sum(quality**2+toxic**2)::DOUBLE AS q FROM labels)
SELECT n::BIGINT AS n, round_even(1 - (d/n)/(2*(2.0*n*q-t*t)/(2.0*n*(2.0*n-1))), 9)::DOUBLE AS alpha FROM s""")
def q23_krippendorff(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.krippendorff(V.table(spark, d, "labels"), "quality", "toxic").select("n", r9("alpha"))


@query(f"WITH {V.CORPUS}, {V.QA}, c AS (SELECT unnest({list(CONFIGS)}) AS config) SELECT qa_id, config FROM qa, c WHERE NOT (qa_id % 3 = 0 AND config = '{CONFIGS[0]}')")
def q24_resume_anti(spark: SparkSession, d: str) -> DataFrame:
    work = joins.with_every_config(V.questions(spark, d).select("qa_id"), CONFIGS)
    return tables.pair_of_outputs(work, work.filter((F.col("qa_id") % 3 == 0) & (F.col("config") == CONFIGS[0])), ("qa_id", "config"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def q25_checkpoint_last_wins(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return tables.last_wins(e, ("user_id", "event_type"), ("event_id",))


def _pivot_sql(columns: tuple[str, ...]) -> str:
    a = [f"SELECT '{c}' AS metric, round_even(avg({c}::DOUBLE) FILTER (config='{CONFIGS[0]}'), 9) AS {CONFIGS[0]}, round_even(avg({c}::DOUBLE) FILTER (config='{CONFIGS[1]}'), 9) AS {CONFIGS[1]} FROM ev" for c in columns]
    return f"WITH {V.EVAL} {' UNION ALL '.join(a)}"


@query(_pivot_sql(_ALL))
def q26_table_overall(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.side_by_side(V.evaluated(spark, d), _ALL, CONFIGS).select("metric", *[r9(c) for c in CONFIGS])


_GROUPS = "g AS (SELECT *, unnest(CASE WHEN question_type IN ('visual','multi-hop-visual') THEN [question_type, 'all visual'] ELSE [question_type] END) AS grp FROM ev)"


def _with_groups(e: DataFrame) -> DataFrame:
    visual = F.col("question_type").isin(*schemas.VISUAL_TYPES)
    return e.withColumn("grp", F.explode(F.when(visual, F.array("question_type", F.lit("all visual"))).otherwise(F.array("question_type"))))


@query(f"""WITH {V.EVAL}, {_GROUPS}, m AS (SELECT grp, printf('%.3f', (avg(temporal_iou) FILTER (config='{CONFIGS[0]}'))::DOUBLE)::DOUBLE AS c1, printf('%.3f', (avg(temporal_iou) FILTER (config='{CONFIGS[1]}'))::DOUBLE)::DOUBLE AS c2 FROM g GROUP BY 1)
SELECT grp, c1, c2, round_even(c2-c1, 6) AS delta FROM m""")
def q27_table_by_type(spark: SparkSession, d: str) -> DataFrame:
    p = _with_groups(V.evaluated(spark, d)).groupBy("grp").pivot("config", list(CONFIGS)).agg(F.avg("temporal_iou"))
    m = p.select("grp", text.half_even(F.col(CONFIGS[0]), 3).alias("c1"), text.half_even(F.col(CONFIGS[1]), 3).alias("c2"))
    return m.withColumn("delta", F.bround(F.col("c2") - F.col("c1"), 6))


_HR = ("hit_rate_at_1", "hit_rate_at_3", "hit_rate_at_5")


@query(f"""WITH {V.EVAL} SELECT question_type, {", ".join(f"round_even(avg({c}::INT) FILTER (config='{cfg}'), 9) AS {c}_{i}" for c in _HR for i, cfg in enumerate(CONFIGS, 1))} FROM ev GROUP BY 1""")
def q28_table_hr(spark: SparkSession, d: str) -> DataFrame:
    e = V.evaluated(spark, d)
    mean = lambda c, cfg: F.bround(F.avg(F.when(F.col("config") == cfg, F.col(c).cast("double"))), 9)
    return e.groupBy("question_type").agg(*[mean(c, cfg).alias(f"{c}_{i}") for c in _HR for i, cfg in enumerate(CONFIGS, 1)])


@query(f"""WITH {V.CORPUS}, {V.QA}, t AS (SELECT question_type AS label, count(*) AS n FROM qa GROUP BY 1 UNION ALL SELECT CASE WHEN question_type IN ('visual','multi-hop-visual') THEN 'group: visual' ELSE 'group: other' END, count(*) FROM qa GROUP BY 1)
SELECT label, n::BIGINT AS n, printf('%.1f', (100.0::DOUBLE*n/(SELECT count(*) FROM qa))::DOUBLE)::DOUBLE AS pct FROM t""")
def q30_fig_distribution(spark: SparkSession, d: str) -> DataFrame:
    group = F.when(F.col("question_type").isin(*schemas.VISUAL_TYPES), "group: visual").otherwise("group: other")
    labels = V.questions(spark, d).select(F.explode(F.array("question_type", group)).alias("label"), F.lit(1).alias("one"))
    by = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1))) / 2  # each question counts under two labels; a handful of rows
    return by.select("label", "n", text.half_even(100.0 * F.col("n") / total, 1).alias("pct"))


@query(f"""WITH {V.EVAL}, t AS (SELECT unnest({list(TYPES)}) AS question_type), c AS (SELECT unnest({list(CONFIGS)}) AS config)
SELECT t.question_type, c.config, coalesce(round_even(avg(temporal_iou), 9), 0.0::DOUBLE) AS mean_iou FROM t CROSS JOIN c LEFT JOIN ev USING (question_type, config) GROUP BY 1, 2""")
def q31_fig_iou(spark: SparkSession, d: str) -> DataFrame:
    p = V.evaluated(spark, d).groupBy("question_type").pivot("config", list(CONFIGS)).agg(F.bround(F.avg("temporal_iou"), 9)).na.fill(0.0)
    every = spark.createDataFrame([(t,) for t in TYPES], "question_type string").join(p, "question_type", "left").na.fill(0.0)
    return every.select("question_type", F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.col(c).alias("mean_iou")) for c in CONFIGS])).alias("x")).select("question_type", "x.*")


@query(f"""WITH {V.EVAL}, u AS ({" UNION ALL ".join(f"SELECT CASE WHEN question_type LIKE 'multi-hop%' THEN 'multi_hop' ELSE 'single_hop' END AS hop_group, config, {k} AS k, hit_rate_at_{k}::DOUBLE AS v FROM ev" for k in (1, 3, 5))})
SELECT hop_group, config, k::BIGINT AS k, round_even(avg(v), 9) AS hit_rate FROM u GROUP BY ALL""")
def q32_fig_hr_curve(spark: SparkSession, d: str) -> DataFrame:
    e = V.evaluated(spark, d).withColumn("hop_group", evaluate.hop_class())
    long = e.select("hop_group", "config", F.expr("stack(3, 1L, hit_rate_at_1, 3L, hit_rate_at_3, 5L, hit_rate_at_5) AS (k, v)"))
    return long.groupBy("hop_group", "config", "k").agg(F.bround(F.avg(F.col("v").cast("double")), 9).alias("hit_rate"))


# --- benchmark construction ------------------------------------------------------------


@query(f"""WITH {V.CORPUS}, {V.QA}, m AS (SELECT count(*) AS total, count(DISTINCT video_id) AS n_lectures, count(*) FILTER (question_type <> 'unanswerable') AS answerable, count(*) FILTER (question_type LIKE '%visual') AS visual, count(*) FILTER (question_type LIKE 'multi-hop%') AS multi_hop, string_agg(DISTINCT video_id::VARCHAR, ',' ORDER BY video_id::VARCHAR) AS lectures FROM qa),
t AS (SELECT question_type, count(*) AS n FROM qa GROUP BY 1)
SELECT total::BIGINT AS total, n_lectures::BIGINT AS n_lectures, lectures, answerable::BIGINT AS answerable, visual::BIGINT AS visual, multi_hop::BIGINT AS multi_hop, printf('%.1f', (100.0::DOUBLE*visual/total)::DOUBLE)::DOUBLE AS visual_pct, question_type, n::BIGINT AS n FROM m, t""")
def q33_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = quality.manifest(V.questions(spark, d).withColumn("video_id", F.col("video_id").cast("string")))
    return m.select("total", "n_lectures", F.array_join("lectures", ",").alias("lectures"), "answerable", "visual", "multi_hop", "visual_pct", F.explode("by_question_type").alias("question_type", "n"))


def _pairs_to_validate(spark: SparkSession, d: str) -> DataFrame:
    q = V.questions(spark, d)
    shift = F.when(F.col("qa_id") % 7 == 0, -60.0).otherwise(0.0)
    gt = F.transform("hops", lambda s, i: F.struct(s["start"].alias("start"), (s["end"] + shift).alias("end"), (i + 1).alias("hop"), F.lit("").alias("description")))
    # an unanswerable question with a span now and then
    extra = F.array(F.struct(F.lit(1.0).alias("start"), F.lit(2.0).alias("end"), F.lit(1).alias("hop"), F.lit("").alias("description")))
    gt = F.when((F.col("question_type") == "unanswerable") & (F.col("qa_id") % 3 == 0), extra).otherwise(gt)
    level = F.element_at(F.array(*[F.lit(x) for x in ("easy", "medium", "hard", "odd")]), (F.col("qa_id") % 4 + 1).cast("int"))
    # a span without an end, and fields that are missing
    gt = F.when(F.col("qa_id") % 55 == 0, F.transform(gt, lambda s: F.struct(s["start"].alias("start"), F.lit(None).cast("double").alias("end"), s["hop"].alias("hop"), s["description"].alias("description")))).otherwise(gt)
    some = lambda c, every: F.when(F.col("qa_id") % every != 0, c)
    return q.select(
        "qa_id", "video_id", "question_type", "answerable", gt.alias("ground_truth_spans"), level.alias("difficulty"), (F.col("qa_id") % 3).cast("int").alias("num_hops"),
        F.lit("q").alias("question"), some(F.lit("a"), 25).alias("answer"), some(F.array(F.lit("c")), 45).alias("source_chunk_ids"), some(F.array(F.lit("k")), 65).alias("key_concepts"),
    )


_VALIDATE = f"""WITH {V.CORPUS}, {V.QA}, sp AS (SELECT qa_id, hop, gs, ge - CASE WHEN qa_id%7=0 THEN 60.0 ELSE 0.0 END AS ge FROM hops UNION ALL SELECT qa_id, 1, 1.0, 2.0 FROM qa WHERE question_type='unanswerable' AND qa_id%3=0),
b AS (SELECT qa.qa_id, question_type AS t, qa.qa_id%3 AS nh, qa.qa_id%4=3 AS odd, (SELECT count(*) FROM sp WHERE sp.qa_id=qa.qa_id) AS n FROM qa),
gp AS (SELECT qa_id, lead(gs) OVER (PARTITION BY qa_id ORDER BY gs) - gs AS gap FROM sp),
mf AS (SELECT qa_id, concat_ws(', ', CASE WHEN qa_id%25=0 THEN 'answer' END, CASE WHEN qa_id%45=0 THEN 'source_chunk_ids' END, CASE WHEN qa_id%65=0 THEN 'key_concepts' END) AS f FROM qa),
e AS (SELECT qa_id, 10 AS o, 0 AS i, 'invalid difficulty' AS m FROM b WHERE odd
 UNION ALL SELECT qa_id, 5, 0, 'missing fields: ' || f FROM mf WHERE f <> ''
 UNION ALL SELECT qa_id, 12, 0, 'source_chunk_ids must be a list' FROM b WHERE qa_id%45=0
 UNION ALL SELECT qa_id, 14, 0, 'key_concepts must be a list' FROM b WHERE qa_id%65=0
 UNION ALL SELECT sp.qa_id, 30, hop, 'span ' || (hop-1)::VARCHAR || ' has no start or no end' FROM sp JOIN b USING (qa_id) WHERE t<>'unanswerable' AND sp.qa_id%55=0
 UNION ALL SELECT qa_id, 20, 0, 'unanswerable question has spans' FROM b WHERE t='unanswerable' AND n>0
 UNION ALL SELECT sp.qa_id, 30, hop, 'span ' || (hop-1)::VARCHAR || ' ends before it starts' FROM sp JOIN b USING (qa_id) WHERE t<>'unanswerable' AND sp.qa_id%55<>0 AND ge<=gs
 UNION ALL SELECT gp.qa_id, 40, 0, 'span gap ' || printf('%.0f', gap) || ' s is below 70 s' FROM gp JOIN b USING (qa_id) WHERE t LIKE 'multi-hop%' AND gap < 70
 UNION ALL SELECT qa_id, 50, 0, 'multi-hop type with fewer than 2 hops' FROM b WHERE t LIKE 'multi-hop%' AND nh<2
 UNION ALL SELECT qa_id, 70, 0, 'single-hop type without exactly 1 hop' FROM b WHERE t IN ('visual','text') AND nh<>1)
SELECT b.qa_id, count(e.m)::BIGINT AS n_errors, coalesce(string_agg(e.m, '; ' ORDER BY o, i), '') AS errors FROM b LEFT JOIN e USING (qa_id) GROUP BY 1"""


@query(_VALIDATE)
def q34_validate_rules(spark: SparkSession, d: str) -> DataFrame:
    v = quality.rule_violations(_pairs_to_validate(spark, d))
    return v.select("qa_id", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", "; ").alias("errors"))


@query(f"""WITH {V.CORPUS}, {V.QA}, g AS (SELECT qa_id, lead(gs) OVER (PARTITION BY qa_id ORDER BY gs) - gs AS gap FROM hops) SELECT qa_id, round_even(gap, 9) AS gap, gap < 70 AS too_close FROM g WHERE gap IS NOT NULL""")
def q35_num_hops_gap(spark: SparkSession, d: str) -> DataFrame:
    g = V.questions(spark, d).select("qa_id", F.explode(quality.span_gaps(F.col("hops"))).alias("gap"))
    return g.select("qa_id", r9("gap"), (F.col("gap") < quality.MIN_GAP).alias("too_close"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return quality.review_decision(V.reviews(spark, d))


@query(f"""WITH {V.REVIEW} SELECT video_id, count(*)::BIGINT AS total, count(*) FILTER (decision='ACCEPT')::BIGINT AS accepted, count(*) FILTER (decision='REJECT')::BIGINT AS rejected, printf('%.1f', (100.0::DOUBLE*count(*) FILTER (decision='ACCEPT')/count(*))::DOUBLE)::DOUBLE AS accepted_pct FROM dec GROUP BY 1""")
def q36_review_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.review_stats(_decided(spark, d))


@query(f"WITH {V.REVIEW} SELECT coalesce(decision_reason, 'unknown') AS reason, count(*)::BIGINT AS n FROM dec WHERE decision='REJECT' GROUP BY 1")
def q37_corpus_rejections(spark: SparkSession, d: str) -> DataFrame:
    return quality.rejection_reasons(_decided(spark, d))


@query(f"""WITH {V.REVIEW}, l AS ({" UNION ALL ".join(f"SELECT video_id, 'criterion_{i}' AS criterion, (criterion_{i}='FAIL' AND reason_{i}<>'parse error')::INT AS f FROM dec WHERE decision='REJECT'" for i in (1, 2, 3))})
SELECT video_id, criterion, round_even(avg(f), 9) AS fail_share FROM l GROUP BY 1, 2 HAVING avg(f) >= 0.3""")
def q38_failure_triggers(spark: SparkSession, d: str) -> DataFrame:
    return quality.failure_triggers(_decided(spark, d)).select("video_id", "criterion", r9("fail_share"))


_COUNTS = "n AS (SELECT s.video_id, count(a.qa_id) AS n FROM (SELECT DISTINCT source AS video_id FROM documents) s LEFT JOIN (SELECT * FROM dec WHERE decision='ACCEPT') a USING (video_id) GROUP BY 1)"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    keys = V.table(spark, d, "documents").select(F.col("source").alias("video_id")).distinct()
    return joins.counts_with_zero(keys, _decided(spark, d).filter("decision = 'ACCEPT'"))


@query(f"""WITH {V.REVIEW}, {_COUNTS} SELECT CASE WHEN n=0 THEN 'zero' WHEN n<=3 THEN '1-3' WHEN n<=9 THEN '4-9' WHEN n<=11 THEN '10-11' ELSE '12+' END AS tier, count(*)::BIGINT AS lectures, sum(n)::BIGINT AS questions, (SELECT sum(n) FROM n) >= 500 AS gate_met FROM n GROUP BY 1""")
def q39_coverage_tiers(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage_tiers(_counts(spark, d))


@query(f"WITH {V.REVIEW}, {_COUNTS} SELECT video_id, n::BIGINT AS n FROM (SELECT * FROM n ORDER BY n, video_id LIMIT 10) WHERE n < 12")
def q40_lowest_lectures(spark: SparkSession, d: str) -> DataFrame:
    return quality.lowest(_counts(spark, d)).select("video_id", "n")


@query(f"WITH {V.REVIEW} SELECT qa_id, cross_check_result, decision, decision_reason FROM dec")
def q41_review_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("qa_id", "cross_check_result", "decision", "decision_reason")


_CONCEPTS = ["The", "tion", "de la", "xyz", "re."]


def _audit(spark: SparkSession, d: str) -> DataFrame:
    h = V.questions(spark, d).select("qa_id", "video_id", "question_type", F.posexplode("hops").alias("span_idx", "h"))
    h = h.select("qa_id", "video_id", "question_type", "span_idx", F.col("h.start").alias("start"), F.col("h.end").alias("end"))
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    c = V.corpus(spark, d).drop("embedding").withColumnRenamed("idx", "seq").join(docs.select("chunk_id"), "chunk_id", "left_semi")
    found = joins.with_chosen_texts(h, joins.chosen_chunks(h, c), docs)
    concepts = F.when(F.col("qa_id") % 4 == 0, F.slice(F.array(*[F.lit(x) for x in _CONCEPTS]), 1, 0)).otherwise(F.slice(F.array(*[F.lit(x) for x in _CONCEPTS]), F.lit(1), (F.col("qa_id") % 5 + 1).cast("int")))
    return quality.span_audit(found.withColumns({"concepts": concepts, "duration": F.col("end") - F.col("start")}))


_NORM = "regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')"
_AUDIT = f"""{V.CORPUS}, {V.QA}, ch AS (SELECT chunk_id, video_id, idx AS seq, start_time, end_time, text FROM corpus JOIN documents ON chunk_id = doc_id),
pr AS (SELECT h.*, c.seq, c.text, row_number() OVER (PARTITION BY h.qa_id, h.hop ORDER BY CASE WHEN start_time <= gs AND end_time >= ge THEN 0 ELSE 1 END, CASE WHEN start_time <= gs AND end_time >= ge THEN seq ELSE abs(start_time-gs) END, seq) AS rn
 FROM hops h LEFT JOIN ch c ON h.video_id = c.video_id AND ((start_time <= gs AND end_time >= ge) OR abs(start_time-gs) < 50)),
cc AS (SELECT *, CASE WHEN qa_id%4=0 THEN [] ELSE {_CONCEPTS!r}[1:(qa_id%5+1)::INT] END AS cs FROM pr WHERE rn=1),
au AS (SELECT qa_id, hop-1 AS span_idx, question_type, seq, len(cs) AS total, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(cs, lambda c: contains({_NORM.format(x="text")}, {_NORM.format(x="c")}))) END AS found, text IS NULL AS lost, ge-gs AS dur FROM cc),
ad AS (SELECT *, CASE WHEN lost THEN 0.0::DOUBLE WHEN total=0 THEN 1.0::DOUBLE ELSE found/total::DOUBLE END AS cov FROM au), ae AS (SELECT *, (1-cov)*dur/2 AS err FROM ad)"""


@query(f"WITH {_AUDIT} SELECT qa_id, span_idx::BIGINT AS span_idx, seq AS chunk_seq, found::BIGINT AS concepts_found, total::BIGINT AS concepts_total, round_even(cov, 9) AS evidence_coverage, round_even(err, 9) AS estimated_error_s FROM ae")
def q42_span_audit(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d)
    return a.select("qa_id", F.col("span_idx").cast("long").alias("span_idx"), "chunk_seq", F.col("concepts_found").cast("long").alias("concepts_found"), F.col("concepts_total").cast("long").alias("concepts_total"), r9("evidence_coverage"), r9("estimated_error_s"))


@query(f"""WITH {_AUDIT}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY err DESC, span_idx) AS rn FROM ae) WHERE rn=1)
SELECT count(*)::BIGINT AS n, round_even(avg(err), 9) AS mean_error_s, max(err) AS max_error_s, min(err) AS min_error_s, round_even(avg((cov >= 0.5)::INT), 9) AS share_covered, CASE WHEN avg(err) <= 20 THEN 'pass' WHEN avg(err) <= 30 THEN 'review' ELSE 'fail' END AS decision FROM w""")
def q43_audit_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.audit_gate(quality.worst_span(_audit(spark, d)))


@query(f"""WITH {V.CORPUS}, {V.QA}, s AS (SELECT qa_id, video_id, question_type, question_type IN ('visual','multi-hop-visual') AS is_visual FROM qa WHERE question_type <> 'unanswerable')
SELECT qa_id, video_id, question_type, is_visual FROM (SELECT *, row_number() OVER (PARTITION BY video_id, is_visual ORDER BY md5('42|' || qa_id::VARCHAR), qa_id) AS rn FROM s) WHERE rn = 1""")
def q44_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return quality.stratified_sample(V.questions(spark, d)).select("qa_id", "video_id", "question_type", "is_visual")


@query(f"""WITH {V.CORPUS}, {V.QA} SELECT video_id, {", ".join(f"count(*) FILTER (question_type='{t}')::BIGINT AS {t.replace('-', '_')}" for t in TYPES)}, ({" AND ".join(f"count(*) FILTER (question_type='{t}') = {2 if t != 'text' else 3}" for t in TYPES)}) AS ok FROM qa GROUP BY 1""")
def q45_type_distribution_check(spark: SparkSession, d: str) -> DataFrame:
    q = V.questions(spark, d).select("video_id", "question_type")
    out = quality.distribution_check(q, "video_id", {t: 2 if t != "text" else 3 for t in TYPES})
    return out.select("video_id", *[F.col(f"`{t}`").alias(t.replace("-", "_")) for t in TYPES], "ok")


# --- parsing and prompts ---------------------------------------------------------------


def _raw_citations(spark: SparkSession, d: str) -> DataFrame:
    q = V.questions(spark, d).select("qa_id")
    a = F.concat(F.lit('{"answer": "a'), F.col("qa_id").cast("string"), F.lit('", "citations": ['), (F.col("qa_id") % 4).cast("string"), F.lit(", 2]}"))
    odd = F.element_at(F.array(*[F.lit(x) for x in ('["1"]', "[1.0]", "[true, 2]", "[]", "7", "[[1]]", "[1, null]", "[2 , 4]")]), (F.call_function("div", F.col("qa_id"), F.lit(35)) % 8 + 1).cast("int"))
    a = F.when(F.col("qa_id") % 7 == 0, F.concat(F.lit('{"answer": "a'), F.col("qa_id").cast("string"), F.lit('", "citations": '), odd, F.lit("}"))).otherwise(a)
    return q.select("qa_id", F.when(F.col("qa_id") % 3 == 0, F.concat(F.lit("```json\n"), a, F.lit("\n```"))).when(F.col("qa_id") % 11 == 0, F.lit('{"answer": "x"}')).otherwise(a).alias("raw"))


@query(f"""WITH {V.CORPUS}, {V.QA}, b AS (SELECT qa_id, qa_id%3<>0 AND qa_id%11=0 AS miss, qa_id%4=0 AS zero, CASE WHEN qa_id%7=0 THEN qa_id//35%8 END AS odd FROM qa),
e AS (SELECT *, CASE WHEN miss THEN 'missing citations' WHEN odd=4 THEN 'citations must be a list' WHEN odd IN (0,1,5,6) THEN 'citation out of range' WHEN odd IS NULL AND zero THEN 'citation out of range' END AS error FROM b)
SELECT qa_id, CASE WHEN error IS NULL THEN 'a' || qa_id::VARCHAR END AS answer, CASE WHEN error IS NULL THEN CASE odd WHEN 2 THEN '1,2' WHEN 3 THEN '' WHEN 7 THEN '2,4' ELSE (qa_id%4)::VARCHAR || ',2' END END AS indices, error FROM e""")
def q46_parse_citations(spark: SparkSession, d: str) -> DataFrame:
    p = _raw_citations(spark, d).select("qa_id", parsing.parse_citations(F.col("raw"), F.lit(4)).alias("p"))
    return p.select("qa_id", "p.answer", F.array_join("p.indices", ",").alias("indices"), "p.error")


@query(f"""WITH {V.CORPUS}, {V.QA}, b AS (SELECT qa_id, qa_id//5%4 AS f, 1+qa_id%5 AS v FROM qa)
SELECT qa_id, (CASE WHEN f=3 THEN 0 ELSE v END)::BIGINT AS c1, (CASE WHEN f=3 THEN 0 ELSE 1+(qa_id+1)%5 END)::BIGINT AS aggregate FROM b""")
def q47_parse_judge(spark: SparkSession, d: str) -> DataFrame:
    q = V.questions(spark, d).select("qa_id")
    v = lambda i: (1 + (F.col("qa_id") + i) % 5).cast("string")
    say = lambda k: F.concat(F.lit(f"{{{k}C1{k}: "), v(0), F.lit(f", {k}C2{k}: 3, {k}C3{k}: 4, {k}aggregate{k}: "), v(1), F.lit("}"))
    form = F.call_function("div", F.col("qa_id"), F.lit(5)) % 4
    raw = F.when(form == 0, say('"')).when(form == 1, F.concat(F.lit("```\n"), say(""), F.lit("\n```"))).when(form == 2, F.concat(F.lit("C1: "), v(0), F.lit(" C2: 3.0, C3: 4 aggregate: "), v(1))).otherwise("no scores")
    p = q.select("qa_id", parsing.parse_judge(raw).alias("p"))
    return p.select("qa_id", F.coalesce("p.C1", F.lit(0)).cast("long").alias("c1"), F.coalesce("p.aggregate", F.lit(0)).cast("long").alias("aggregate"))


@query(f"""WITH {V.CORPUS}, {V.QA}, b AS (SELECT qa_id, qa_id%9 AS a, qa_id%6 AS b, qa_id//5%4 = 3 AS apart FROM qa) SELECT qa_id, CASE WHEN NOT apart AND b>0 AND a<=b THEN round_even(a/b::DOUBLE, 9) END AS score FROM b""")
def q48_parse_score(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("Some claims hold.\nScore: "), (F.col("qa_id") % 9).cast("string"), F.when(F.call_function("div", F.col("qa_id"), F.lit(5)) % 4 == 3, " / ").otherwise("/"), (F.col("qa_id") % 6).cast("string"))
    return V.questions(spark, d).select("qa_id", r9(parsing.parse_score(raw), "score"))


_MMSS = "printf('%02d:%02d', ({x})::BIGINT//60, ({x})::BIGINT%60)"


@query(f"""WITH {V.CORPUS}, {V.QA}, {V.HITS} SELECT h.qa_id, config, rank::BIGINT AS rank, '[' || q.video_id::VARCHAR || ' @ ' || {_MMSS.format(x="floor(cs*9)")} || ' to ' || {_MMSS.format(x="floor(ce*9)")} || '](https://youtu.be/v' || q.video_id::VARCHAR || '?t=' || floor(cs*9)::BIGINT::VARCHAR || ')' AS citation FROM hits h JOIN qa q USING (qa_id)""")
def q49_citation_format(spark: SparkSession, d: str) -> DataFrame:
    h = V.hits(spark, d)
    yt = text.youtube_id(F.lit(None).cast("string"), F.concat(F.lit("https://www.youtube.com/watch?v=v"), F.col("video_id").cast("string"), F.lit("&t=1")))
    c = text.citation(F.col("video_id").cast("string"), F.col("start_time") * 9, F.col("end_time") * 9, yt)
    return h.select(F.col("query_id").alias("qa_id"), "config", F.col("rank").cast("long").alias("rank"), c.alias("citation"))


@query(f"""WITH {V.CORPUS}, {V.QA}, {V.HITS}, b AS (SELECT h.qa_id, config, rank, '[' || rank::VARCHAR || '] ' || q.video_id::VARCHAR || ' @ ' || {_MMSS.format(x="cs")} || ' to ' || {_MMSS.format(x="ce")} || chr(10) || 'chunk ' || h.chunk_id::VARCHAR || chr(10) AS b FROM hits h JOIN qa q USING (qa_id))
SELECT qa_id || '/' || config AS query_id, string_agg(b, chr(10) ORDER BY rank) || chr(10) || 'Question: What about ' || qa_id::VARCHAR || '?' AS prompt FROM b GROUP BY qa_id, config""")
def q50_prompt_text(spark: SparkSession, d: str) -> DataFrame:
    h = V.hits(spark, d).withColumns({"text": F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")), "question": F.concat(F.lit("What about "), F.col("query_id").cast("string"), F.lit("?")), "query_id": F.concat_ws("/", F.col("query_id").cast("string"), "config")})
    return prompts.evidence_prompt(h)


@query(f"""WITH {V.CORPUS}, {V.QA}, i AS (SELECT qa_id, unnest([qa_id, qa_id+1, 1000000+qa_id, qa_id]) AS id, unnest([1,2,3,4]) AS pos FROM qa WHERE question_type <> 'unanswerable')
SELECT qa.qa_id, coalesce(string_agg(coalesce('t' || c.chunk_id::VARCHAR, '[chunk text not found]'), '|' ORDER BY pos) FILTER (pos IS NOT NULL), '') AS texts FROM qa LEFT JOIN i USING (qa_id) LEFT JOIN corpus c ON c.chunk_id = i.id GROUP BY 1""")
def q51_prompt_chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = V.questions(spark, d)
    ids = F.when(F.col("answerable"), F.array("qa_id", F.col("qa_id") + 1, F.col("qa_id") + 1000000, "qa_id")).otherwise(F.slice(F.array("qa_id"), 1, 0))
    c = V.corpus(spark, d).select("chunk_id", F.concat(F.lit("t"), F.col("chunk_id").cast("string")).alias("text"))
    out = joins.lookup_texts(q.select("qa_id", ids.alias("source_chunk_ids")), c, "qa_id")
    return out.select("qa_id", F.array_join("texts", "|").alias("texts"))


@query(r"""SELECT conv_id::VARCHAR AS video_id, (turn*10.5)::DOUBLE AS start, round_even(turn*10.5+0.05, 9)::DOUBLE AS "end", trim(regexp_replace(trim(replace(text, chr(10), ' ')), '<[^>]+>', '', 'g')) AS text FROM conversations WHERE trim(regexp_replace(trim(replace(text, chr(10), ' ')), '<[^>]+>', '', 'g')) <> ''""")
def q52_vtt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = vtt.parse_cues(V.caption_files(spark, d))
    return c.select("video_id", r9("start"), r9("end"), F.col("text_lines")[0].alias("text"))


_TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"


def _bleu_sql() -> str:
    grams = " UNION ALL ".join(f"SELECT conv_id, turn, {n} AS n, '{s}' AS side, unnest(list_transform(range(1, greatest(len({s})-{n - 1}, 0)+1), lambda i: array_to_string({s}[i:i+{n - 1}], ' '))) AS g FROM t" for n in (1, 2, 3, 4) for s in ("r", "h"))
    return f"""WITH {V.PAIRS}, t AS (SELECT conv_id, turn, {_TOK.format(x="reference")} AS r, {_TOK.format(x="answer")} AS h FROM tp),
g AS ({grams}), c AS (SELECT conv_id, turn, n, g, count(*) FILTER (side='r') AS cr, count(*) FILTER (side='h') AS ch FROM g GROUP BY ALL),
m AS (SELECT conv_id, turn, n, sum(least(cr, ch)) AS k, sum(ch) AS tot FROM c GROUP BY ALL),
a AS (SELECT t.conv_id, t.turn, len(r) AS lr, len(h) AS lh, {", ".join(f"coalesce(max(k) FILTER (n={n}), 0) AS k{n}, greatest(coalesce(max(tot) FILTER (n={n}), 0), 1) AS t{n}" for n in (1, 2, 3, 4))} FROM t LEFT JOIN m USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id, turn, round_even(CASE WHEN lh=0 OR k1=0 THEN 0.0::DOUBLE ELSE (CASE WHEN lh>lr THEN 1.0 ELSE exp(1-lr/lh::DOUBLE) END) * exp(({" + ".join(f"ln((CASE WHEN k{n}=0 THEN 0.1 ELSE k{n} END)::DOUBLE/t{n})" for n in (1, 2, 3, 4))})/4) END, 9) AS bleu FROM a"""


@query(_bleu_sql())
def q53_bleu(spark: SparkSession, d: str) -> DataFrame:
    p = V.text_pairs(spark, d)
    return p.select("conv_id", "turn", r9(textmetrics.bleu(F.col("reference"), F.col("answer")), "bleu"))


#: The longest common subsequence, word by word of the answer: ``row[j]`` is its length for the
#: first j words of the reference, and a running maximum of what each word can add.
_LCS = """w AS (SELECT conv_id, turn, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r, regexp_extract_all(lower(answer), '[a-z0-9]+') AS h FROM tp),
st AS (SELECT conv_id, turn, 0 AS k, list_transform(range(0, len(r)+1), lambda j: 0) AS l FROM w
 UNION ALL SELECT s.conv_id, s.turn, k+1, list_prepend(0, list_transform(range(1, len(r)+1), lambda j: list_max(list_transform(range(1, j+1), lambda i: greatest(l[i+1], l[i] + (r[i] = h[k+1])::INT)))))
 FROM st s JOIN w ON s.conv_id = w.conv_id AND s.turn = w.turn WHERE k < len(h))"""


@query(f"""WITH RECURSIVE {V.PAIRS}, {_LCS}
SELECT w.conv_id, w.turn, round_even(CASE WHEN len(r)=0 OR len(h)=0 THEN 0.0 ELSE 2.0::DOUBLE*l[len(l)]/(len(r)+len(h)) END, 9)::DOUBLE AS rouge_l FROM w JOIN st ON w.conv_id = st.conv_id AND w.turn = st.turn AND k = len(h)""")
def q54_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    """Without the stemmer, which SQL can't say."""
    p = V.text_pairs(spark, d)
    return p.select("conv_id", "turn", r9(textmetrics.rouge_l_plain(F.col("reference"), F.col("answer")), "rouge_l"))


@query()
def q54_rouge_l_stemmed(spark: SparkSession, d: str) -> DataFrame:
    p = V.text_pairs(spark, d)
    return p.select("conv_id", "turn", r9(textmetrics.rouge_l(F.col("reference"), F.col("answer")), "rouge_l"))


@query()
def q55_meteor(spark: SparkSession, d: str) -> DataFrame:
    return V.text_pairs(spark, d).select("conv_id", "turn", r9(textmetrics.meteor(F.col("reference"), F.col("answer")), "meteor"))


@query(f"""WITH {V.PAIRS}, b AS (SELECT conv_id, turn, (length(reference)%5)/4.0::DOUBLE AS p, (length(answer)%5)/4.0::DOUBLE AS r FROM tp) SELECT conv_id, turn, round_even(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0.0 END, 9)::DOUBLE AS f1 FROM b""")
def q56_claim_f1(spark: SparkSession, d: str) -> DataFrame:
    p, r = (F.length("reference") % 5) / 4.0, (F.length("answer") % 5) / 4.0
    return V.text_pairs(spark, d).select("conv_id", "turn", r9(text.f1(p, r), "f1"))


@query("SELECT conv_id::VARCHAR AS video_id, round_even(max(turn)*10.5+0.05, 9)::DOUBLE AS max_time FROM conversations GROUP BY 1")
def q57_max_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return V.caption_files(spark, d).select("video_id", r9(text.max_timestamp(F.col("raw")), "max_time"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS text FROM pages""".replace("\\\\", "\\"))
def q58_strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query(f"""WITH {V.CORPUS}, {V.QA}, due AS (SELECT count(*) AS due FROM qa WHERE question_type <> 'unanswerable'), m AS (SELECT unnest(['full','half','none']) AS config)
SELECT config, (CASE config WHEN 'full' THEN (SELECT count(*) FROM qa) WHEN 'half' THEN (SELECT count(*) FROM qa WHERE qa_id%2=0) ELSE 0 END)::BIGINT AS n, due::BIGINT AS due, (CASE config WHEN 'full' THEN (SELECT count(*) FROM qa) WHEN 'half' THEN (SELECT count(*) FROM qa WHERE qa_id%2=0) ELSE 0 END) >= due AS complete FROM m, due""")
def q59_completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    q = V.questions(spark, d).select("qa_id", "answerable")
    done = q.select("qa_id", F.lit("full").alias("config")).unionByName(q.filter("qa_id % 2 = 0").select("qa_id", F.lit("half").alias("config")))
    return quality.completeness(done, q, ("full", "half", "none"))
