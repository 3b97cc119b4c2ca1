"""Virtual lectures: the driver's tables in the role of segments, chunks, questions, hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas
from ..operators import retrieval, sequence
from ..sources.captions import render_captions

TYPES = schemas.QUESTION_TYPES
CONFIGS = schemas.CONFIGS


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as segments of a lecture; hours count as seconds."""
    e = table(spark, d, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts)") / F.lit(3.6e9)
    s = e.select(F.col("user_id").cast("string").alias("video_id"), seq.cast("long").alias("seq"), start.alias("start"), F.col("event_type").alias("text"), "value", "props", "user_id")
    return s.withColumn("end", F.col("start") + sequence.LAST_SECONDS)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return sequence.sliding_chunks(segments(spark, d).select("video_id", "seq", "start", "end", "text"))


def captions(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).filter("text = 'view'")
    return s.select("video_id", "seq", F.col("start").alias("time"), F.concat("text", F.lit(":"), F.get_json_object("props", "$.k")).alias("caption"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    idx = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    c = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("video_id"), idx.cast("long").alias("idx"), "embedding")
    return c.withColumn("start_time", 35.0 * (F.col("idx") % 12)).withColumn("end_time", F.col("start_time") + 45.0)


def questions(spark: SparkSession, d: str) -> DataFrame:
    q = corpus(spark, d).filter("chunk_id % 5 = 0")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), ((F.call_function("div", F.col("chunk_id"), F.lit(5)) % 5) + 1).cast("int"))
    second = 35.0 * ((F.col("idx") + 5) % 12) + 10.0
    one = F.struct((F.col("start_time") + 10.0).alias("start"), (F.col("start_time") + 45.0).alias("end"))
    two = F.struct(second.alias("start"), (second + 35.0).alias("end"))
    q = q.withColumn("question_type", kind)
    hops = F.when(F.col("question_type") == "unanswerable", F.slice(F.array(one), 1, 0)).when(F.col("question_type").isin(*schemas.MULTIHOP_TYPES), F.array(one, two)).otherwise(F.array(one))
    return q.select(F.col("chunk_id").alias("qa_id"), "video_id", "question_type", (F.col("question_type") != "unanswerable").alias("answerable"), hops.alias("hops"), "embedding")


def hits(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """Top five of the question's video under both configurations, the question itself left
    out: vectors folded in half (each pair of dimensions added), and vectors as they are.
    ``only`` has the qa_id of the questions that are asked."""
    asked = questions(spark, d) if only is None else questions(spark, d).join(only.select("qa_id"), "qa_id", "left_semi")
    q, c = asked.select(F.col("qa_id").alias("query_id"), "video_id", "embedding"), corpus(spark, d)
    half = lambda x: F.call_function("div", F.size(x), F.lit(2)).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda a, b: a.cast("double") + b.cast("double"))
    both = retrieval.topk_views(q, c, 5, dict(zip(CONFIGS, (folded, lambda x: x.cast("array<double>")), strict=True)), exclude_self=True)
    return both.withColumn("cited", (F.col("rank") <= 4) & ((F.col("query_id") + F.col("rank")) % 2 == 0))


def evidence(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """One row a (question, configuration): hops, hits in rank order, cited spans."""
    span = lambda: F.struct("rank", F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    h = hits(spark, d, only).groupBy(F.col("query_id").alias("qa_id"), "config").agg(
        F.array_sort(F.collect_list(span())).alias("hits"), F.array_sort(F.collect_list(F.when(F.col("cited"), span()))).alias("cited"))
    return questions(spark, d).drop("embedding").join(h, "qa_id")


def evaluated(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    from ..operators.evaluate import evaluate_rows, fuse_judges

    rows = evaluate_rows(evidence(spark, d, only))
    cfg = F.when(F.col("config") == CONFIGS[0], 0).otherwise(1)
    judge = {f"judge_{j}_{c}": (1 + (F.col("qa_id") * j + i + cfg) % 5).cast("int") for j in (1, 2) for i, c in enumerate(("C1", "C2", "C3", "aggregate"))}
    return fuse_judges(rows.withColumns(judge))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), ((F.col("doc_id") % 5) + 1).cast("int"))
    reason = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("span"), F.lit("hop"), F.lit("visual"), F.lit("hop")), ((F.col("doc_id") % 6) + 1).cast("int"))
    crit = lambda i: F.when((F.col("doc_id") + i) % 4 == 0, "FAIL").otherwise("PASS")
    why = lambda i: F.when((F.col("doc_id") + i) % 8 == 0, "parse error").otherwise("weak")
    return r.select(
        F.col("doc_id").alias("qa_id"), F.col("source").alias("video_id"), kind.alias("question_type"),
        F.when(F.col("quality") == 1, "ACCEPT").otherwise("REJECT").alias("overall"), reason.alias("rejection_reason"),
        *[crit(i).alias(f"criterion_{i}") for i in (1, 2, 3)], *[why(i).alias(f"reason_{i}") for i in (1, 2, 3)],
        F.when(F.col("toxic") == 1, "FAIL").otherwise("PASS").alias("cross_check"),
    )


def text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A turn and the next one of its conversation, as reference and answer."""
    c = table(spark, d, "conversations")
    nxt = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.col("text").alias("reference"), nxt.alias("answer")).filter("answer is not null")


def caption_files(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import flatten

    c = table(spark, d, "conversations")
    start = F.col("turn") * 10.5
    return render_captions(c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("seq"), start.alias("start"), (start + 0.05).alias("end"), flatten(F.col("text")).alias("text")))


# --- the same views in DuckDB SQL ------------------------------------------------------

_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
SEG = "seg AS (SELECT user_id, user_id::VARCHAR AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE AS start, event_type AS text, value, props FROM events)"
CHUNK = """tot AS (SELECT video_id, max(start) + 3.0::DOUBLE AS total FROM seg GROUP BY 1),
win AS (SELECT video_id, unnest(range(0, ceil(total/35.0)::BIGINT)) AS k FROM tot),
cw AS (SELECT w.video_id, w.k, string_agg(s.text, ' ' ORDER BY s.seq) AS text FROM win w JOIN seg s ON s.video_id = w.video_id AND s.start >= w.k*35.0 AND s.start < w.k*35.0 + 45.0 GROUP BY 1, 2),
chunk AS (SELECT video_id || '_chunk_' || printf('%03d', row_number() OVER (PARTITION BY video_id ORDER BY k) - 1) AS chunk_id, video_id, (k*35.0)::DOUBLE AS start_time, (k*35.0+45.0)::DOUBLE AS end_time, text FROM cw)"""
CORPUS = "corpus AS (SELECT vec_id AS chunk_id, label::BIGINT AS video_id, idx, 35.0::DOUBLE*(idx%12) AS start_time, 35.0::DOUBLE*(idx%12)+45.0 AS end_time, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM embeddings))"
QA = f"""qa AS (SELECT chunk_id AS qa_id, video_id, idx, start_time, embedding, {_TYPE_LIST}[((chunk_id//5)%5+1)::INT] AS question_type FROM corpus WHERE chunk_id % 5 = 0),
hops AS (SELECT qa_id, video_id, question_type, 1 AS hop, start_time+10.0 AS gs, start_time+45.0 AS ge FROM qa WHERE question_type <> 'unanswerable'
 UNION ALL SELECT qa_id, video_id, question_type, 2, 35.0::DOUBLE*((idx+5)%12)+10.0, 35.0::DOUBLE*((idx+5)%12)+45.0 FROM qa WHERE question_type LIKE 'multi-hop%')"""
_RANK = "row_number() OVER (PARTITION BY q.qa_id ORDER BY {s} DESC, c.chunk_id)"
_FOLD = "list_transform(range(1, len({x}.embedding)//2+1), lambda i: {x}.embedding[i]::DOUBLE + {x}.embedding[i+len({x}.embedding)//2]::DOUBLE)"


def _hits(config: str, vector: str) -> str:
    s = f"round_even(list_cosine_similarity({vector.format(x='q')}, {vector.format(x='c')}), 9)"
    return f"SELECT q.qa_id, c.chunk_id, c.start_time AS cs, c.end_time AS ce, {s} AS score, {_RANK.format(s=s)} AS rank, '{config}' AS config FROM qa q JOIN corpus c ON q.video_id = c.video_id AND q.qa_id <> c.chunk_id"


HITS = f"hits AS (SELECT *, rank <= 4 AND (qa_id + rank) % 2 = 0 AS cited FROM ({_hits(CONFIGS[0], _FOLD)} UNION ALL {_hits(CONFIGS[1], '{x}.embedding::DOUBLE[]')}) WHERE rank <= 5)"
IOU = "CASE WHEN ({pe}-{ps})+({ge}-{gs})-greatest(0.0,least({pe},{ge})-greatest({ps},{gs})) > 0 THEN greatest(0.0,least({pe},{ge})-greatest({ps},{gs}))/(({pe}-{ps})+({ge}-{gs})-greatest(0.0,least({pe},{ge})-greatest({ps},{gs}))) ELSE 0.0 END"


def iou_sql(ps: str, pe: str, gs: str, ge: str) -> str:
    return IOU.format(ps=ps, pe=pe, gs=gs, ge=ge)


def islands_sql(name: str, source: str, keys: str) -> str:
    """CTEs that coalesce spans (keys, s, e) of ``source``."""
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""{name}_a AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e {rows} 1 PRECEDING) AS reach FROM {source}),
{name}_b AS (SELECT *, CASE WHEN s <= reach THEN 0 ELSE 1 END AS opens FROM {name}_a),
{name}_c AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY s, e, opens DESC {rows} CURRENT ROW) AS isl FROM {name}_b),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e, count(*) AS n FROM {name}_c GROUP BY {keys}, isl)"""


EVAL = f"""{SEG.replace("seg AS", "unused_seg AS")}, {CORPUS}, {QA}, {HITS},
qc AS (SELECT qa.qa_id, qa.video_id, question_type, config FROM qa JOIN (SELECT DISTINCT qa_id, config FROM hits) USING (qa_id)),
cs AS (SELECT qa_id, config, cs AS s, ce AS e FROM hits WHERE cited),
{islands_sql("pm", "cs", "qa_id, config")},
hs AS (SELECT qa_id, gs AS s, ge AS e FROM hops),
{islands_sql("gm", "hs", "qa_id")},
pl AS (SELECT qa_id, config, sum(e-s) AS l FROM pm GROUP BY ALL), gl AS (SELECT qa_id, sum(e-s) AS l FROM gm GROUP BY ALL),
il AS (SELECT pm.qa_id, config, sum(greatest(0.0, least(pm.e, gm.e)-greatest(pm.s, gm.s))) AS l FROM pm JOIN gm USING (qa_id) GROUP BY ALL),
ui AS (SELECT qa_id, config, il.l/(pl.l+gl.l-il.l) AS u FROM il JOIN pl USING (qa_id, config) JOIN gl USING (qa_id)),
ph AS (SELECT qa_id, config, avg(b) AS v FROM (SELECT h.qa_id, hop, config, max({iou_sql("pm.s", "pm.e", "gs", "ge")}) AS b FROM hops h JOIN pm USING (qa_id) GROUP BY ALL) GROUP BY ALL),
cov AS (SELECT h.qa_id, hop, t.config, t.rank, t.cited, {iou_sql("cs", "ce", "gs", "ge")} >= 0.3 AS ok FROM hops h JOIN hits t USING (qa_id)),
byhop AS (SELECT qa_id, config, hop, bool_or(ok AND rank<=1) AS h1, bool_or(ok AND rank<=3) AS h3, bool_or(ok) AS h5, bool_or(ok AND cited) AS hc FROM cov GROUP BY ALL),
agg AS (SELECT qa_id, config, bool_or(h1) AS h1, bool_or(h3) AS h3, bool_or(h5) AS h5, avg(h5::INT) AS rec, bool_and(h5) AS comp, avg(hc::INT) AS ca FROM byhop GROUP BY ALL),
ev AS (SELECT qc.qa_id, qc.video_id, question_type, qc.config, coalesce(u, 0.0::DOUBLE) AS temporal_iou, coalesce(ph.v, 0.0::DOUBLE) AS multihop_per_hop_iou, coalesce(u, 0.0::DOUBLE) AS multihop_union_iou,
  coalesce(rec, 0.0::DOUBLE) AS multihop_per_hop_recall_at_5, coalesce(ca, 0.0::DOUBLE) AS citation_accuracy, coalesce(u,0) >= 0.3 AS iou_at_03, coalesce(u,0) >= 0.5 AS iou_at_05,
  coalesce(h1, false) AS hit_rate_at_1, coalesce(h3, false) AS hit_rate_at_3, coalesce(h5, false) AS hit_rate_at_5, coalesce(comp, false) AS multihop_complete_at_5,
  {", ".join(f"(2 + (qc.qa_id + {i} + c) % 5 + (qc.qa_id*2 + {i} + c) % 5)/2.0::DOUBLE AS llm_judge_{n}" for i, n in enumerate(("C1", "C2", "C3", "score")))}
  FROM (SELECT *, CASE WHEN config = '{CONFIGS[0]}' THEN 0 ELSE 1 END AS c FROM qc) qc LEFT JOIN ui USING (qa_id, config) LEFT JOIN ph USING (qa_id, config) LEFT JOIN agg USING (qa_id, config))"""
REVIEW = f"""rv AS (SELECT d.doc_id AS qa_id, source AS video_id, {_TYPE_LIST}[(d.doc_id%5+1)::INT] AS question_type, CASE WHEN quality=1 THEN 'ACCEPT' ELSE 'REJECT' END AS overall,
  [NULL, '', 'span', 'hop', 'visual', 'hop'][(d.doc_id%6+1)::INT] AS rejection_reason, CASE WHEN toxic=1 THEN 'FAIL' ELSE 'PASS' END AS cross_check,
  {", ".join(f"CASE WHEN (d.doc_id+{i})%4=0 THEN 'FAIL' ELSE 'PASS' END AS criterion_{i}, CASE WHEN (d.doc_id+{i})%8=0 THEN 'parse error' ELSE 'weak' END AS reason_{i}" for i in (1, 2, 3))}
  FROM documents d JOIN labels USING (doc_id)),
dec AS (SELECT *, CASE WHEN due THEN cross_check ELSE 'SKIPPED' END AS cross_check_result, CASE WHEN due AND cross_check='FAIL' THEN 'REJECT' ELSE overall END AS decision, CASE WHEN due AND cross_check='FAIL' THEN 'c1_knowledge_conflict' ELSE rejection_reason END AS decision_reason
  FROM (SELECT *, question_type <> 'unanswerable' AND criterion_1='PASS' AND overall='ACCEPT' AS due FROM rv))"""
PAIRS = "tp AS (SELECT * FROM (SELECT conv_id, turn, text AS reference, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE answer IS NOT NULL)"
