"""The second half of the catalogue: reports on text scores, generated batches, files and
sinks, prompts, and the parsers that the first half leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import models, schemas
from ..functions import parsing, spans, text, textmetrics
from ..operators import evaluate, joins, prompts, quality, sequence
from ..sources import tables
from . import virtual as V
from .catalogue import _LCS, _MMSS, CONFIGS, TYPES, _bleu_sql, query, r9

# --- text scores and comparison of systems ---------------------------------------------

SYSTEMS = ("a", "b", "c", "absent")
_SYSTEM = "['a','b','c'][(turn%3+1)::INT]"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns as answers of three systems to questions; every seventh answer is blank."""
    p = V.text_pairs(spark, d)
    system = F.element_at(F.array(*[F.lit(s) for s in SYSTEMS[:3]]), (F.col("turn") % 3 + 1).cast("int"))
    said = F.when(F.col("conv_id") % 7 == 0, F.lit(" \n")).otherwise(F.col("answer"))
    return p.select((F.col("conv_id") * 100 + F.col("turn")).alias("qa_id"), "conv_id", "turn", system.alias("system"), "reference", said.alias("generated_answer"), F.when(F.col("turn") % 4 == 1, "judge failed").alias("error"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark: some questions have no answer in it, and some aren't in it."""
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("conv_id") % 5 + 1).cast("int"))
    p = V.text_pairs(spark, d).filter("conv_id % 11 <> 3")
    return p.select((F.col("conv_id") * 100 + F.col("turn")).alias("qa_id"), F.when(F.col("conv_id") % 11 != 5, F.col("reference")).alias("answer"), kind.alias("question_type"))


_ANSWERS = f"{V.PAIRS}, an AS (SELECT *, {_SYSTEM} AS system, CASE WHEN conv_id%7=0 THEN '' ELSE trim(answer) END AS said, conv_id%11 IN (3,5) OR coalesce(reference,'')='' AS missing FROM tp)"
_SCORES = f"sc AS (SELECT conv_id, turn, bleu, rouge_l FROM ({_bleu_sql()}) JOIN (WITH RECURSIVE {V.PAIRS}, {_LCS} SELECT w.conv_id, w.turn, CASE WHEN len(r)=0 OR len(h)=0 THEN 0.0 ELSE 2.0::DOUBLE*l[len(l)]/(len(r)+len(h)) END AS rouge_l FROM w JOIN st ON w.conv_id = st.conv_id AND w.turn = st.turn AND k = len(h)) USING (conv_id, turn))"


@query(f"""WITH {_ANSWERS}, {_SCORES}, s AS (SELECT unnest({list(SYSTEMS)}) AS system), x AS (SELECT * FROM an JOIN sc USING (conv_id, turn) WHERE said <> '' AND NOT missing)
SELECT system, count(bleu)::BIGINT AS n, coalesce(printf('%.4f', (avg(bleu))::DOUBLE)::DOUBLE, 0.0)::DOUBLE AS bleu, coalesce(printf('%.4f', (avg(rouge_l))::DOUBLE)::DOUBLE, 0.0)::DOUBLE AS rouge_l FROM s LEFT JOIN x USING (system) GROUP BY 1""")
def q29_systems(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    scored = a.withColumns({"bleu": textmetrics.bleu(F.col("reference"), F.col("generated_answer")), "rouge_l": textmetrics.rouge_l_plain(F.col("reference"), F.col("generated_answer"))})
    return evaluate.systems_table(scored, _gold(spark, d), SYSTEMS, ("bleu", "rouge_l"))


@query(f"""WITH {_ANSWERS}, {_SCORES} SELECT system, count(*) FILTER (NOT missing AND said <> '')::BIGINT AS n, count(*) FILTER (missing)::BIGINT AS missing, count(*) FILTER (NOT missing AND said = '')::BIGINT AS empty,
 count(*) FILTER (NOT missing AND said <> '' AND turn%4=1)::BIGINT AS errors, coalesce(printf('%.4f', (avg(bleu) FILTER (NOT missing AND said <> ''))::DOUBLE)::DOUBLE, 0.0)::DOUBLE AS bleu FROM an JOIN sc USING (conv_id, turn) GROUP BY 1""")
def q60_score_summary(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).withColumn("bleu", textmetrics.bleu(F.col("reference"), F.col("generated_answer")))
    return evaluate.score_summary(a, _gold(spark, d), ("bleu",), by="system")


_SHARE = "CASE WHEN len({b})=0 THEN 0.0::DOUBLE ELSE len(list_filter({b}, lambda w: list_contains({a}, w)))/len({b})::DOUBLE END"
_WORDS = r"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> ''))"


@query(f"""WITH {_ANSWERS}, w AS (SELECT system, CASE WHEN conv_id%11=3 THEN 'unknown' ELSE {list(TYPES)}[(conv_id%5+1)::INT] END IN ('visual','multi-hop-visual') AS vis, {_WORDS.format(x="reference")} AS r, {_WORDS.format(x="said")} AS h FROM an),
e AS (SELECT system, vis, {_SHARE.format(a="r", b="h")} AS p, {_SHARE.format(a="h", b="r")} AS q FROM w), s AS (SELECT unnest({list(SYSTEMS)}) AS system)
SELECT system, count(p)::BIGINT AS n, {", ".join(f"coalesce(printf('%.4f', (avg({c}) FILTER ({on}))::DOUBLE)::DOUBLE, 0.0)::DOUBLE AS entail_{k}_{name}" for k, c in (("p", "p"), ("r", "q")) for name, on in (("all", "true"), ("visual", "vis"), ("other", "NOT vis")))} FROM s LEFT JOIN e USING (system) GROUP BY 1""")
def q61_entailment(spark: SparkSession, d: str) -> DataFrame:
    """With the stand-in model: which share of one text's words the other has."""
    pairs = evaluate.with_question_type(_answers(spark, d), _gold(spark, d)).withColumn("answer", F.col("generated_answer"))
    return evaluate.entailment_table(models.with_entailment(pairs, models.overlap_entailment), SYSTEMS)


# --- generated batches -----------------------------------------------------------------


def _batch_items(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen documents make a batch; some break rules."""
    i = F.col("doc_id")
    batch, position = F.call_function("div", i, F.lit(15)), i % 15
    order = [t for t, n in schemas.BATCH_DISTRIBUTION.items() for _ in range(n)]
    kind = F.element_at(F.array(*[F.lit(t) for t in order]), (position + 1).cast("int"))
    kind = F.when((batch % 5 == 1) & (position == 3), "riddle").when((batch % 7 == 2) & (position == 0), "text").otherwise(kind)
    hops = F.when(kind.isin(*schemas.MULTIHOP_TYPES) & ~((batch % 6 == 3) & (position == 2)), 2).otherwise(1)
    none = kind == "unanswerable"
    span = F.array(F.struct((position * 10.0).alias("start"), (position * 10.0 + 5).alias("end"), F.lit(1).alias("hop"), F.lit("").alias("description")))
    return V.table(spark, d, "documents").select(
        batch.alias("batch"), position.alias("position"), batch.alias("video_id"), F.when(~((batch % 8 == 5) & (position == 4)), "a").alias("answer"), kind.alias("question_type"), hops.alias("num_hops"),
        (~none | (batch % 9 == 4)).alias("answerable"), F.when(none & (batch % 10 != 6), F.slice(span, 1, 0)).otherwise(span).alias("ground_truth_spans"),
    )


_MIX = schemas.BATCH_DISTRIBUTION


@query(f"""WITH b AS (SELECT doc_id//15 AS batch, doc_id%15 AS pos FROM documents), k AS (SELECT *, CASE WHEN batch%5=1 AND pos=3 THEN 'riddle' WHEN batch%7=2 AND pos=0 THEN 'text' ELSE {[t for t, n in _MIX.items() for _ in range(n)]}[(pos+1)::INT] END AS t FROM b),
e AS (SELECT batch, pos, t, CASE WHEN batch%8=5 AND pos=4 THEN 'missing fields: answer' WHEN t='riddle' THEN 'invalid question_type' WHEN t LIKE 'multi-hop%' AND batch%6=3 AND pos=2 THEN 'multi-hop question with fewer than 2 hops'
  WHEN t='unanswerable' AND batch%9=4 THEN 'unanswerable question is marked answerable' WHEN t='unanswerable' AND batch%10=6 THEN 'unanswerable question has spans' END AS m, pos*10.0 > 100 + batch%3*40 AND NOT (t='unanswerable' AND batch%10<>6) AS late FROM k)
SELECT batch, coalesce(arg_min(m, pos) FILTER (m IS NOT NULL), CASE WHEN bool_or(late) THEN 'span starts after the video''s end' END, CASE WHEN NOT ({" AND ".join(f"count(*) FILTER (t='{t}')={n}" for t, n in _MIX.items())}) OR count(*) FILTER (t='riddle')>0 THEN 'wrong question type distribution' END) AS violation FROM e GROUP BY 1""")
def q62_batch_verdict(spark: SparkSession, d: str) -> DataFrame:
    items = _batch_items(spark, d)
    durations = items.select("video_id").distinct().withColumn("duration", (100.0 + F.col("video_id") % 3 * 40.0))
    return quality.batch_verdict(items, "batch", dict(_MIX), durations)


@query(f"""WITH {V.REVIEW}, lo AS (SELECT video_id FROM rv GROUP BY 1 HAVING count(*) FILTER (overall='ACCEPT') < 14), st AS (SELECT video_id, video_id || '_q' || printf('%03d', qa_id%15+1) AS qa_id FROM rv WHERE overall='ACCEPT'),
ng AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY doc_id) + 15 AS n, doc_id%3=0 AS ok FROM (SELECT doc_id, source AS video_id FROM documents) JOIN lo USING (video_id))
SELECT video_id, qa_id FROM st UNION ALL SELECT video_id, video_id || '_q' || printf('%03d', n) FROM ng WHERE ok UNION ALL SELECT video_id, video_id || '_q' || printf('%03d', n) FROM ng WHERE ok""")
def q63_merge_regenerated(spark: SparkSession, d: str) -> DataFrame:
    """A run and its rerun, which adds the same questions again."""
    log = V.reviews(spark, d)
    stored = log.filter("overall = 'ACCEPT'").select("video_id", F.format_string("%s_q%03d", "video_id", F.col("qa_id") % 15 + 1).alias("qa_id"))
    new = V.table(spark, d, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("position"), (F.col("doc_id") % 3 == 0).alias("accepted"))
    once = quality.merge_regenerated(stored, log, new, floor=14)
    return quality.merge_regenerated(once, log, new, floor=14)


@query(f"""WITH {V.CORPUS}, {V.QA}, w AS (SELECT qa_id, question_type, max(ge-gs + qa_id%7) AS err FROM hops GROUP BY ALL)
SELECT place::INT AS place, question_type, count(*)::BIGINT AS n, printf('%.1f', (avg(err))::DOUBLE)::DOUBLE AS mean_error_s FROM w JOIN (SELECT unnest([1,2,3,4]) AS place, unnest(['multi-hop-visual','visual','multi-hop','text']) AS question_type) USING (question_type) GROUP BY ALL""")
def q64_error_by_type(spark: SparkSession, d: str) -> DataFrame:
    h = V.questions(spark, d).select("qa_id", "question_type", F.posexplode("hops").alias("span_idx", "h"))
    audit = h.select("qa_id", "question_type", "span_idx", (F.col("h.end") - F.col("h.start") + F.col("qa_id") % 7).alias("estimated_error_s"), F.lit(1.0).alias("evidence_coverage"))
    return quality.error_by_type(quality.worst_span(audit))


@query(f"WITH {V.REVIEW} SELECT video_id || '/' || (qa_id%40)::VARCHAR AS video_id FROM rv GROUP BY 1 HAVING count(*) FILTER (question_type='unanswerable') = 0")
def q65_without_unanswerable(spark: SparkSession, d: str) -> DataFrame:
    p = V.reviews(spark, d).withColumn("video_id", F.concat_ws("/", "video_id", (F.col("qa_id") % 40).cast("string")))
    return quality.without_type(p)


@query(f"WITH {V.CORPUS}, {V.QA} SELECT qa_id, video_id FROM (SELECT * FROM qa WHERE video_id = 3 ORDER BY qa_id LIMIT 7)")
def q66_first_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.first_of(V.questions(spark, d), "qa_id", F.col("video_id") == 3, 7).select("qa_id", "video_id")


@query(f"WITH {V.CORPUS}, {V.QA} SELECT qa_id, string_agg(gs::INT::VARCHAR, ',' ORDER BY (hop + qa_id)%2, hop) AS starts FROM hops GROUP BY 1")
def q67_hop_order(spark: SparkSession, d: str) -> DataFrame:
    hop = lambda s, i: F.struct(s["start"].alias("start"), ((i + 1 + F.col("qa_id")) % 2).alias("hop"))
    q = V.questions(spark, d).filter(F.size("hops") > 0).withColumn("spans", F.transform("hops", hop))
    ordered = F.transform(sequence.in_hop_order(F.col("spans")), lambda s: s["start"].cast("int").cast("string"))
    return q.select("qa_id", F.array_join(ordered, ",").alias("starts"))


_JUDGED = "(1 + (qa_id*{j} + {i} + CASE WHEN config = '" + CONFIGS[0] + "' THEN 0 ELSE 1 END) % 5)::DOUBLE"


@query(f"""WITH {V.EVAL}, j AS ({" UNION ALL ".join(f"SELECT '{c}' AS criterion, {_JUDGED.format(j=1, i=i)} AS x, {_JUDGED.format(j=2, i=i)} AS y FROM ev" for i, c in enumerate(("C1", "C2", "C3", "aggregate")))}),
s AS (SELECT criterion, count(*) AS n, sum((x-y)**2) AS d, sum(x+y) AS t, sum(x*x+y*y) AS q FROM j GROUP BY 1)
SELECT 'alpha' AS section, criterion AS name, n::BIGINT AS n, round_even(1 - (d/n)/(2*(2.0*n*q-t*t)/(2.0*n*(2.0*n-1))), 9)::DOUBLE AS value FROM s
UNION ALL SELECT 'mean', config, count(*), round_even(avg(temporal_iou), 9) FROM ev GROUP BY config UNION ALL SELECT 'mean', 'all', count(*), round_even(avg(temporal_iou), 9) FROM ev""")
def q68_evaluate_all(spark: SparkSession, d: str) -> DataFrame:
    """Questions under each configuration, those done before left alone, then the summary."""
    score = lambda todo: V.evaluated(spark, d).join(todo, ["qa_id", "config"], "left_semi")
    done = V.evaluated(spark, d).filter((F.col("qa_id") % 15 == 0) & (F.col("config") == CONFIGS[0]))
    rows = evaluate.evaluate_all(V.questions(spark, d).select("qa_id"), CONFIGS, done, score)
    alpha = evaluate.agreement(rows).select(F.lit("alpha").alias("section"), F.col("criterion").alias("name"), "n", r9("alpha", "value"))
    means = evaluate.pooled_means(rows, ("temporal_iou",)).filter("level in ('overall', 'config')")
    return alpha.unionByName(means.select(F.lit("mean").alias("section"), F.col("value").alias("name"), "n", F.col("temporal_iou").alias("value")))


# --- scans and sinks -------------------------------------------------------------------


@query(f"""WITH {V.SEG}, c AS (SELECT *, start + value/100 AS fin FROM seg), m AS (SELECT *, fin - start < 0.1 AS short, bool_or(fin - start < 0.1) OVER (PARTITION BY video_id) AS has FROM c)
SELECT video_id, seq, CASE WHEN has THEN text ELSE props END AS text FROM m WHERE short OR NOT has""")
def q69_display_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues shorter than a tenth of a second are the ones displayed."""
    cues = V.segments(spark, d).withColumns({"end": F.col("start") + F.col("value") / 100, "text_lines": F.array("text", "props")})
    return sequence.display_phrases(cues).select("video_id", "seq", "text")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q70_json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """One array a region, written and read again."""
    n = V.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = tables.scratch_folder(spark, "arrays")
    n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value")).select("n_regionkey", "value").write.partitionBy("n_regionkey").text(path)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in n.schema)
    return tables.read_json_arrays(spark, f"{path}/*", kind)


@query("SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS position, n_name FROM nation")
def q71_wrapped_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Even regions as bare arrays, the others under a key."""
    n = V.table(spark, d, "nation")
    path = tables.scratch_folder(spark, "wrapped")
    g = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("rows"))
    value = F.when(F.col("n_regionkey") % 2 == 0, F.to_json("rows")).otherwise(F.to_json(F.struct(F.lit("v1").alias("version"), F.col("rows").alias("qa_pairs"))))
    g.select(F.col("n_regionkey").alias("r"), value.alias("value")).write.partitionBy("r").text(path)
    rows = tables.read_wrapped_arrays(spark, f"{path}/*", "n_nationkey long, n_name string, n_regionkey long", "qa_pairs")
    return rows.select("n_regionkey", F.col("position").cast("long").alias("position"), "n_name")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def q72_checkpoint_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two appends, of which the later one brings some keys anew, and a repeated append."""
    e = V.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    last = tables.last_wins(e, ("user_id", "event_type"), ("event_id",))
    path = tables.scratch_folder(spark, "checkpoint")
    for batch, rows in enumerate((last.filter("user_id % 2 = 0").withColumn("value", F.lit(-1.0)), last, last)):
        tables.append_checkpoint(rows.repartition(3), path, f"{min(batch, 1):06d}")
    return tables.read_checkpoint(spark, path, "user_id long, event_type string, value double", ("user_id", "event_type"))


@query("SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM documents WHERE lang='fr') THEN 'augmented' ELSE 'plain' END AS origin FROM documents WHERE lang='fr' OR source NOT IN (SELECT source FROM documents WHERE lang='fr')")
def q74_prefer_source(spark: SparkSession, d: str) -> DataFrame:
    """A lecture's augmented chunks if there are any, else its plain ones."""
    c = V.table(spark, d, "documents").select("doc_id", "source", "lang")
    chosen = tables.prefer_source(c.filter("lang = 'fr'").withColumn("origin", F.lit("augmented")), c.withColumn("origin", F.lit("plain")), "source")
    return chosen.select("doc_id", "source", "origin")


@query("""WITH f AS (SELECT 'v' || (page_id//4)::VARCHAR AS video_id, ['.mp4','.en.vtt','.txt','.webm'][(page_id%5%4+1)::INT] AS ext FROM pages)
SELECT video_id, bool_or(ext IN ('.mp4','.webm')) AS has_video, bool_or(ext='.en.vtt') AS has_captions FROM f GROUP BY 1""")
def q75_source_state(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".en.vtt", ".txt", ".webm")]), (F.col("page_id") % 5 % 4 + 1).cast("int"))
    files = V.table(spark, d, "pages").select(F.concat(F.lit("/data/v"), F.call_function("div", F.col("page_id"), F.lit(4)).cast("string"), ext).alias("path"))
    return tables.source_state(files)


@query("SELECT event_id, 0.01*value < 0.8*(event_id%3)::DOUBLE AS lost FROM events")
def q76_audio_loss(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select("event_id", (F.col("value") * 0.01).alias("audio_seconds"), (F.col("event_id") % 3).cast("double").alias("duration"))
    return e.select("event_id", tables.has_audio_loss().alias("lost"))


@query("""WITH k AS (SELECT c_custkey AS key, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1)
SELECT 'zero' AS policy, key, n::BIGINT AS n FROM k UNION ALL SELECT 'skip', key, n FROM k WHERE n > 0""")
def q77_missing_policy(spark: SparkSession, d: str) -> DataFrame:
    keys = V.table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    rows = V.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    both = [tables.missing_policy(keys, rows, "key", p).select(F.lit(p).alias("policy"), "key", "n") for p in ("zero", "skip")]
    return both[0].unionByName(both[1])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey, lower(n_name), n_regionkey FROM nation WHERE n_regionkey = 2")
def q78_partition_sink(spark: SparkSession, d: str) -> DataFrame:
    """A table a region, of which one is written anew."""
    n = V.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = tables.scratch_folder(spark, "partitions")
    tables.write_partitioned(n, path, "n_regionkey")
    tables.overwrite_partitions(n.filter("n_regionkey = 2").withColumn("n_name", F.lower("n_name")), path, "n_regionkey")
    return spark.read.schema(n.schema).parquet(path)


@query(f"WITH {V.CORPUS} SELECT chunk_id::VARCHAR AS chunk_id, video_id::VARCHAR AS video_id, CASE WHEN video_id < 2 THEN 'again' WHEN video_id < 5 THEN 'first' ELSE 'second' END AS document FROM corpus")
def q79_vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Skip what is there, add what is new, rebuild what is asked for."""
    c = V.corpus(spark, d)
    v = c.select(F.lit("c").alias("collection"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("video_id").cast("string").alias("video_id"), "start_time", "end_time", "embedding", F.col("video_id").alias("number"))
    as_ = lambda rows, name: rows.withColumn("document", F.lit(name)).select("collection", "chunk_id", "video_id", "start_time", "end_time", "document", "embedding")
    store = tables.VectorStore(spark, tables.scratch_folder(spark, "vectors"))
    store.ingest(as_(v.filter("number < 5"), "first"))
    store.ingest(as_(v, "second"))
    store.ingest(as_(v.filter("number < 2"), "again"), rebuild=True)
    return store.rows().select("chunk_id", "video_id", "document")


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey%3=0) ON c_custkey = o_custkey")
def q80_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = V.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("video_id"), "c_name")
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("video_id"))
    return joins.with_metadata(o, meta).select("o_orderkey", F.col("video_id").alias("o_custkey"), "c_name")


# --- prompts ---------------------------------------------------------------------------

_FLAT = "trim(replace({x}, chr(10), ' '))"


@query(f"""WITH {V.PAIRS}, b AS (SELECT *, conv_id%4=0 AS none, turn%3 AS hops FROM tp)
SELECT conv_id, turn,
 CASE WHEN none THEN 'The question can''t be answered from the lecture; a good answer says so.' WHEN hops <= 1 THEN 'The answer rests on one passage of the lecture.' ELSE 'The answer joins ' || hops::VARCHAR || ' passages of the lecture.' END
  || chr(10) || 'Question: Q' || turn::VARCHAR || chr(10) || 'Reference: ' || CASE WHEN none OR reference = '' THEN '(none: the lecture does not answer this)' ELSE reference END || chr(10) || 'Answer: ' || answer || chr(10) || 'Reply as {{"C1": n, "C2": n, "C3": n, "aggregate": n}}, each from 1 to 5.' AS judge,
 'Write new questions, numbered q016 to q030.' || chr(10) || CASE WHEN none THEN '' ELSE '- no spans under 70 s' || chr(10) || '- look at the frames' END || chr(10) || chr(10) || reference AS regeneration,
 'Evidence:' || chr(10) || CASE WHEN none THEN '' ELSE reference || chr(10) || '---' || chr(10) || answer END || chr(10) || 'Question: Q' || chr(10) || 'Answer: A' AS review,
 'Evidence:' || chr(10) || CASE WHEN none THEN '' ELSE reference || chr(10) || '---' || chr(10) || answer END || chr(10) || 'Question: Q' || chr(10) || 'Could this be answered without the lecture?' AS cross_check,
 CASE WHEN none THEN reference ELSE '--- Segment 1 ---' || chr(10) || reference || chr(10) || '--- Segment 2 ---' || chr(10) || answer END || chr(10) || 'Question: Q' AS video,
 'Reference: ' || {_FLAT.format(x="reference")} || chr(10) || 'Text: ' || {_FLAT.format(x="answer")} || chr(10) || 'How many of the reference''s claims does the text support? End with Score: a/b' AS claim FROM b""")
def q81_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = V.text_pairs(spark, d)
    none, ref, ans = F.col("conv_id") % 4 == 0, F.col("reference"), F.col("answer")
    rules = F.array(F.lit("no spans under 70 s"), F.lit("look at the frames"))
    nothing = F.slice(F.array(ref), 1, 0)
    texts = F.when(none, nothing).otherwise(F.array(ref, ans))
    return p.select(
        "conv_id", "turn",
        prompts.judge_prompt(F.concat(F.lit("Q"), F.col("turn").cast("string")), ans, ref, ~none, F.col("turn") % 3).alias("judge"),
        prompts.regeneration_prompt(ref, F.when(none, F.slice(rules, 1, 0)).otherwise(rules)).alias("regeneration"),
        prompts.review_prompt(F.lit("Q"), F.lit("A"), texts).alias("review"),
        prompts.review_prompt(F.lit("Q"), F.lit("A"), texts, cross_check=True).alias("cross_check"),
        prompts.video_prompt(F.lit("Q"), F.when(none, F.array(ref)).otherwise(F.array(ref, ans))).alias("video"),
        prompts.claim_prompt(ref, ans).alias("claim"),
    )


@query(f"""WITH {V.SEG}, {V.CHUNK} SELECT video_id, string_agg('[' || chunk_id || '] ' || {_MMSS.format(x="floor(start_time)")} || '–' || {_MMSS.format(x="floor(end_time)")} || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_id) AS prompt FROM chunk GROUP BY 1""")
def q82_generation_prompt(spark: SparkSession, d: str) -> DataFrame:
    return prompts.generation_prompt(V.chunks(spark, d))


# --- parsers and small functions -------------------------------------------------------


@query("""WITH b AS (SELECT doc_id, doc_id%4 AS f, CASE WHEN doc_id%3=0 THEN 'FAIL' ELSE 'PASS' END AS c FROM documents)
SELECT doc_id, CASE WHEN f=3 THEN 'REJECT' ELSE 'ACCEPT' END AS overall, CASE WHEN f=3 THEN 'FAIL' ELSE c END AS c1, CASE WHEN f=3 THEN 'parse error' ELSE 'why' END AS why, CASE WHEN f=3 THEN 'parse error' WHEN f=1 THEN 'hop' END AS rejection_reason FROM b""")
def q83_parse_review(spark: SparkSession, d: str) -> DataFrame:
    form = F.col("doc_id") % 4
    crit = lambda i: F.concat(F.lit(f'"criterion_{i}": {{"result": "'), F.when(F.col("doc_id") % 3 == 0, "FAIL").otherwise("PASS"), F.lit('", "reason": "why"}'))
    body = F.concat(F.lit('{"overall": "ACCEPT", '), crit(1), F.lit(", "), crit(2), F.lit(", "), crit(3), F.when(form == 1, ', "rejection_reason": "hop"}').otherwise("}"))
    raw = F.when(form == 0, body).when(form == 1, F.concat(F.lit("My verdict:\n"), body, F.lit("\nDone."))).when(form == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise("I can't say")
    p = V.table(spark, d, "documents").select("doc_id", parsing.parse_review(raw).alias("p"))
    return p.select("doc_id", "p.overall", F.col("p.criterion_1.result").alias("c1"), F.col("p.criterion_1.reason").alias("why"), "p.rejection_reason")


@query(r"""WITH b AS (SELECT doc_id, [ '\(x\)', '\n', '\\(', 'a\\', 'plain', 'é\q', '\\\(', '\"\/\b' ][(doc_id%8+1)::INT] AS raw FROM documents)
SELECT doc_id, raw, regexp_replace(raw, '^', '') = raw AS same, CASE doc_id%8 WHEN 0 THEN '\\(x\\)' WHEN 5 THEN 'é\\q' ELSE raw END AS repaired FROM b""")
def q84_repair_escapes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in (r"\(x\)", r"\n", r"\\(", "a\\\\", "plain", r"é\q", r"\\\(", r"\"\/\b")]), (F.col("doc_id") % 8 + 1).cast("int"))
    return V.table(spark, d, "documents").select("doc_id", raw.alias("raw"), (F.regexp_replace(raw, "^", "") == raw).alias("same"), parsing.repair_escapes(raw).alias("repaired"))


@query("""SELECT conv_id, turn, replace(substring(text, 1, 80), chr(10), ' ') AS preview, contains(text || CASE WHEN turn%3=0 THEN ' [frame caption: x]' ELSE '' END, '[frame caption:') AS visual,
 len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) < 10 AS short, contains(lower(text), lower(substring(text, 5, 6))) AND length(substring(text, 5, 6)) > 0 AS given, CASE WHEN conv_id%2=0 THEN '+' ELSE '-' END || printf('%.3f', (turn+1)/8.0) AS delta FROM conversations""".replace("\\\\", "\\"))
def q85_text_rules(spark: SparkSession, d: str) -> DataFrame:
    c, t = V.table(spark, d, "conversations"), F.col("text")
    marked = F.concat(t, F.when(F.col("turn") % 3 == 0, " [frame caption: x]").otherwise(""))
    delta = F.when(F.col("conv_id") % 2 == 0, 1.0).otherwise(-1.0) * (F.col("turn") + 1) / 8.0
    return c.select("conv_id", "turn", text.preview(t).alias("preview"), text.has_visual_mark(marked).alias("visual"), text.answer_too_short(t).alias("short"), text.answer_in_question(F.substring(t, 5, 6), t).alias("given"), text.signed(delta).alias("delta"))


@query(f"WITH {V.CORPUS}, {V.QA} SELECT qa.qa_id, coalesce(min(gs), 0.0::DOUBLE) AS lo, coalesce(max(ge), 0.0::DOUBLE) AS hi FROM qa LEFT JOIN hops USING (qa_id) GROUP BY 1")
def q86_bounding_span(spark: SparkSession, d: str) -> DataFrame:
    s = V.questions(spark, d).select("qa_id", spans.bounding_span(F.col("hops")).alias("s"))
    return s.select("qa_id", F.col("s.start").alias("lo"), F.col("s.end").alias("hi"))


@query("""SELECT event_id, CASE WHEN event_id%5=0 THEN 'not an object' WHEN event_id%7=0 THEN 'missing: event_type' END AS problem, CASE WHEN event_id%5<>0 AND event_id%7<>0 THEN event_type END AS event_type FROM events""")
def q87_row_validity(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the required keys, and the others with what is wrong with them."""
    e = V.table(spark, d, "events").select("event_id", "event_type")
    raw = F.when(F.col("event_id") % 5 == 0, "oops").when(F.col("event_id") % 7 == 0, F.to_json(F.struct("event_id"))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    good, bad = tables.split_valid(e.select("event_id", raw.alias("raw")), "event_id long, event_type string", ("event_id", "event_type"))
    return good.select("event_id", F.lit(None).cast("string").alias("problem"), F.col("row.event_type").alias("event_type")).unionByName(bad.select("event_id", "problem"), allowMissingColumns=True)
