import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespan import models, schemas
from cuespan.operators import evaluate, joins, prompts, quality, retrieval, sequence
from cuespan.settings import load_settings
from cuespan.sources import captions, tables
from cuespan.streaming import ingest

from .conftest import SMALL


def seg(spark, rows):
    return spark.createDataFrame([("v", i, float(a), float(b), t) for i, (a, b, t) in enumerate(rows)], schemas.SEGMENT)


def chunks(spark, rows):
    return [(r.chunk_id, r.start_time, r.text) for r in sequence.sliding_chunks(seg(spark, rows)).orderBy("chunk_id").collect()]


def test_chunking(spark):
    assert sequence.sliding_chunks(seg(spark, [(3 * i, 3 * i + 3, "x") for i in range(1600)])).count() == 138
    got = chunks(spark, [(0, 3, "a"), (40, 43, "b"), (45, 48, "c")])
    assert [t for _, _, t in got] == ["a b", "b c"]
    gap = chunks(spark, [(0, 5, "a"), (300, 303, "b")])
    assert [(i, t) for i, _, t in gap] == [("v_chunk_000", "a"), ("v_chunk_001", "b")]  # windows without a segment are left out, and ids have no gap
    assert chunks(spark, []) == []


VTT = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\nfirst <c>line</c>\nsecond\n\n00:00:03.000 --> 00:00:03.010\n<b>clean</b>\n\nno timing\n\n00:00:05.000 --> 00:00:05.050\nclean\n\n00:00:07.000 --> 00:00:07.050\nnext\n \n00:00:09.000 --> 00:00:09.010\nnot a block of its own\n"


def test_captions_to_segments(spark, tmp_path):
    (tmp_path / "vid.en.vtt").write_text(VTT)
    cues = captions.parse_cues(captions.read_caption_files(spark, str(tmp_path)))
    assert cues.filter("video_id = 'vid'").count() == 4
    s = sequence.segments_of(sequence.display_phrases(cues)).orderBy("start").collect()
    # the repeat is dropped after its start ended the row before it
    assert [(r.start, r.end, r.text) for r in s] == [(3.0, 5.0, "clean"), (7.0, 10.0, "next")]
    rolling = cues.withColumn("end", F.col("end") + 1)
    assert [r.text for r in sequence.display_phrases(rolling).orderBy("seq").collect()][0] == "second"


def test_caption_assignment(spark):
    c = spark.createDataFrame([("c0", "v", 0.0, 45.0, "t0"), ("c1", "v", 35.0, 80.0, "t1"), ("c2", "w", 0.0, 45.0, "t2")], schemas.CHUNK)
    f = spark.createDataFrame([("v", 0, 10.0, "a"), ("v", 1, 44.0, "b"), ("v", 2, 45.0, "c")], "video_id string, seq long, time double, caption string")
    got = {r.chunk_id: r for r in joins.assign_captions(c, f).collect()}
    assert got["c0"].text == "t0 [frame caption: a] [frame caption: b]"
    assert [x.caption for x in got["c1"].frame_captions] == ["b", "c"]
    assert got["c2"].text == "t2" and got["c2"].frame_captions == []
    far = spark.createDataFrame([("v", 0, 100.0, "x"), ("v", 1, 100.0, "y")], f.schema)
    assert [x.caption for x in {r.chunk_id: r for r in joins.assign_captions(c, far).collect()}["c0"].frame_captions] == ["x"]


def test_containment_then_nearest(spark):
    c = spark.createDataFrame([("v", 0, 0.0, 45.0, "a"), ("v", 1, 35.0, 80.0, "b")], "video_id string, seq long, start_time double, end_time double, text string")
    s = spark.createDataFrame([("v", 1, 36.0, 44.0), ("v", 2, 70.0, 120.0), ("v", 3, 85.0, 90.0), ("w", 4, 0.0, 1.0)], "video_id string, span_id int, start double, end double")
    got = {r.span_id: r.chunk_text for r in joins.containing_or_near(s, c).collect()}
    assert got == {1: "a", 2: "b", 3: None, 4: None}


def test_retrieval(spark):
    eye = np.eye(4).tolist()
    c = spark.createDataFrame([(i, "v" if i < 2 else "w", e) for i, e in enumerate(eye)], "chunk_id long, video_id string, embedding array<float>")
    q = c.withColumnRenamed("chunk_id", "query_id")
    top = retrieval.topk_scan(q, c, 1).collect()
    assert all(r.query_id == r.chunk_id and r.score == pytest.approx(1) for r in top) and len(top) == 4
    within = retrieval.topk_within(q, c, 5).collect()
    assert len(within) == 8 and {r.video_id for r in within if r.query_id == 0} == {"v"}
    with pytest.raises(ValueError):
        retrieval.topk_scan(q, c, 1, max_queries=2)
    p = {(r.query_id, r.k): r.chunk_ids for r in retrieval.prefixes(retrieval.topk_scan(q, c, 3), (1, 3)).collect()}
    assert p[(2, 1)] == [2] and len(p[(2, 3)]) == 3


def test_any_number_of_queries(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 3)).astype(float)  # many ties, some zero vectors
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(3)
    n = np.linalg.norm(x, axis=1)
    score = np.round(x @ x.T / np.maximum(np.outer(n, n), 1e-30), 9)
    want = {(q, k + 1): int(i) for q in range(300) for k, i in enumerate(np.lexsort((np.arange(300), -score[q]))[:4])}
    for block in (7, 300, 1000):
        got = retrieval.topk_blocks(c.withColumnRenamed("chunk_id", "query_id"), c, 4, block=block).collect()
        assert {(r.query_id, r["rank"]): r.chunk_id for r in got} == want and len(got) == 1200
    assert retrieval.topk_blocks(c.withColumnRenamed("chunk_id", "query_id").limit(0), c, 4).count() == 0


def test_query_catalogue_top_k_beyond_a_block(spark, monkeypatch):
    from cuespan.plans.catalogue import QUERIES

    whole = QUERIES["q08_topk_cosine"](spark, SMALL).count()
    for f in (retrieval.topk_scan, retrieval.topk_blocks):
        monkeypatch.setattr(f, "__defaults__", (30, 9))
    assert QUERIES["q08_topk_cosine"](spark, SMALL).count() == whole == 400


def test_alpha_edges(spark):
    a = lambda rows: evaluate.krippendorff(spark.createDataFrame(rows, "a int, b int"), "a", "b").first().alpha
    assert a([(1, 1), (5, 5), (3, 3)]) == pytest.approx(1.0)
    assert a([(1, 2)]) == 0.0
    assert a([(3, 3), (3, 3)]) == 1.0
    assert a([]) == 0.0


def test_unanswerable_row_is_zero(spark):
    span = "array<struct<rank:int,start:double,end:double>>"
    r = spark.createDataFrame([("q", False, [], [(1, 0.0, 45.0)], [(1, 0.0, 45.0)])], f"qa_id string, answerable boolean, hops array<struct<start:double,end:double>>, hits {span}, cited {span}")
    got = evaluate.evaluate_rows(r).first()
    assert got.temporal_iou == 0 and got.hit_rate_at_5 is False and got.citation_accuracy == 0


def test_rules_and_sources(spark, tmp_path):
    pair = spark.createDataFrame([("a", "multi-hop", None, [(10.0, 20.0), (80.0, 90.0)], "easy", 2), ("b", "multi-hop", True, [(10.0, 20.0), (79.0, 90.0)], "easy", 2), ("c", None, True, None, "x", 1)], "qa_id string, question_type string, answerable boolean, ground_truth_spans array<struct<start:double,end:double>>, difficulty string, num_hops int")
    got = {r.qa_id: r.errors for r in quality.rule_violations(pair).collect()}
    assert "ground_truth_spans must be a list" in got["c"] and "span gap 69 s is below 70 s" in got["b"]
    assert all(e[0].startswith("missing fields: video_id, question, answer") for e in got.values())  # columns that the table lacks
    whole = pair.withColumns({"video_id": F.lit("v"), "question": F.lit("q"), "answer": F.lit("a"), "source_chunk_ids": F.array(F.lit("c")), "key_concepts": F.array(F.lit("k"))})
    got = {r.qa_id: r.errors for r in quality.rule_violations(whole.filter("qa_id <> 'c'")).collect()}
    assert got == {"a": ["missing fields: answerable"], "b": ["span gap 69 s is below 70 s"]}
    (tmp_path / "a.json").write_text('[{"qa_id": "1"}, {"qa_id": "2"}]')
    (tmp_path / "b.json").write_text('{"qa_pairs": [{"qa_id": "3"}]}')
    assert sorted(r.qa_id for r in tables.read_wrapped_arrays(spark, str(tmp_path), "qa_id string", "qa_pairs").collect()) == ["1", "2", "3"]
    assert tables.read_json_arrays(spark, str(tmp_path / "a.json"), "qa_id string").count() == 2
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.jsonl").write_text('{"k": "1", "v": 1}\n\n{"k": "2", "v": 2}\n{"k": "1", "v": 3}\n')
    assert {r.k: r.v for r in tables.read_checkpoint(spark, str(tmp_path / "c"), "k string, v int", ("k",)).collect()} == {"1": 3, "2": 2}
    keys, rows = spark.createDataFrame([("a",), ("b",)], "video_id string"), spark.createDataFrame([("a",)], "video_id string")
    assert {r.video_id: r.n for r in tables.missing_policy(keys, rows, "video_id", "zero").collect()} == {"a": 1, "b": 0}
    assert tables.missing_policy(keys, rows, "video_id", "skip").count() == 1
    with pytest.raises(Exception, match="no rows for"):
        tables.missing_policy(keys, rows, "video_id", "fail").collect()
    files = spark.createDataFrame([("/x/v1.mp4",), ("/x/v1.en.vtt",), ("/x/v2.webm",)], "path string")
    assert {r.video_id: (r.has_video, r.has_captions) for r in tables.source_state(files).collect()} == {"v1": (True, True), "v2": (True, False)}


def test_vector_store_is_idempotent(spark, tmp_path):
    store = tables.VectorStore(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([("c", f"k{i}", "v", 0.0, 1.0, "d", [1.0]) for i in range(3)], schemas.VECTOR)
    store.ingest(rows)
    store.ingest(rows)
    assert store.rows().count() == 3
    store.ingest(rows.limit(2), rebuild=True)
    assert store.rows().count() == 2


def test_models_and_prompts(spark):
    rows = spark.createDataFrame([("q1", "hello world"), ("q2", None)], "qa_id string, text string")
    e = models.with_embedding(rows, "text", lambda: models.hashing_embedder(16)).collect()
    assert len(e[0].embedding) == 16
    calls = models.with_reply(rows, "text", lambda: lambda p: 1 / 0 if not p else p.upper()).orderBy("qa_id").collect()
    assert calls[0].reply == "HELLO WORLD" and "ZeroDivisionError" in calls[1].reply_error
    r = spark.createDataFrame([("a", "text", "PASS", "ACCEPT"), ("b", "unanswerable", "PASS", "ACCEPT")], "qa_id string, question_type string, criterion_1 string, overall string")
    s = {x.qa_id: x.cross_check for x in models.staged_review(r, lambda d: d.withColumn("cross_check", F.lit("FAIL"))).collect()}
    assert s == {"a": "FAIL", "b": None}
    pairs = spark.createDataFrame([("a b", "a")], "reference string, answer string")
    assert models.with_entailment(pairs, models.overlap_entailment).first().entail_r == 0.5
    one = spark.range(1)
    assert "--- Segment 2 ---" in one.select(prompts.video_prompt(F.lit("q"), F.array(F.lit("a"), F.lit("b")))).first()[0]
    assert "Segment" not in one.select(prompts.video_prompt(F.lit("q"), F.array(F.lit("a")))).first()[0]
    none = one.select(prompts.judge_prompt(F.lit("q"), F.lit("a"), F.lit("ref"), F.lit(False), F.lit(0))).first()[0]
    assert "ref" not in none.split("Answer")[0].replace("Reference", "")


def test_streaming_ingest(spark, tmp_path):
    rows = spark.createDataFrame([("v1", 1), ("v2", 2)], "video_id string, x int")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest_once(ingest.stream_rows(spark, str(tmp_path / "in"), "video_id string, x int"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("chunking: {window_seconds: 60, unknown: 1}\nretrieval: {k_values: [1, 2]}\npaths: {raw: data}\n")
    s = load_settings(str(tmp_path / "c.yaml"))
    assert s.chunking.stride == 50 and s.retrieval.k_values == (1, 2) and s.paths["raw"] == str(tmp_path / "data")
    assert load_settings().evaluation.hit_iou == 0.3
