import datetime
import random

import pytest
from pyspark.sql import functions as F

from cuespan import models, schemas
from cuespan.functions import parsing, text
from cuespan.operators import evaluate, joins, quality, sequence
from cuespan.plans.registry import QUERIES
from cuespan.sources import tables
from cuespan.streaming import ingest

JUDGE = '{"C1": 5, "C2": 4, "C3": 3, "aggregate": 4}'


def test_captions_by_brute_force(spark):
    """Against every pair: ties, videos without captions, chunks of uneven length."""
    rng = random.Random(2)
    chunks = [(f"{v}_{i}", v, float(a), float(a + n), f"t{i}") for v in "abc" for i in range(40) for a, n in [(rng.randrange(900), rng.choice([1, 20, 45, 200]))]]
    captions = [(v, i, float(rng.randrange(0, 900, 30)), f"c{i}") for v in "ab" for i in range(25 if v == "a" else 3)]
    got = joins.assign_captions(spark.createDataFrame(chunks, schemas.CHUNK), spark.createDataFrame(captions, "video_id string, seq long, time double, caption string")).collect()
    assert len(got) == len(chunks)
    for r in got:
        mine = sorted((s, t, c) for v, s, t, c in captions if v == r.video_id)
        inside = [x for x in mine if r.start_time <= x[1] < r.end_time]
        middle = (r.start_time + r.end_time) / 2
        want = inside or sorted(mine, key=lambda x: (abs(x[1] - middle), x[0]))[:1]
        assert [(x.time, x.caption) for x in r.frame_captions] == [(t, c) for _, t, c in want]


def test_two_judges_and_pauses(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "qa_id int, prompt string").coalesce(1)

    def flaky():
        seen = []

        def reply(p):
            seen.append(p)
            return JUDGE if seen.count(p) == 3 else "hm" if len(seen) % 2 else 1 / 0

        return reply

    got = models.two_judges(rows, "prompt", flaky, lambda: lambda p: "never", wait=0.01).orderBy("qa_id").collect()
    assert [(r.judge_1_C1, r.judge_1_aggregate, r.judge_1_error) for r in got] == [(5, 4, None)] * 2
    assert all(r.judge_2_C1 is None and r.judge_2_error == "reply turned down" for r in got)
    slow = models.with_reply(rows.limit(1), "prompt", lambda: lambda p: 1 / 0, attempts=3, wait=0.05)
    began = datetime.datetime.now()
    assert slow.first().reply_error.startswith("ZeroDivisionError")
    assert (datetime.datetime.now() - began).total_seconds() >= 0.15  # 0.05 and 0.1


def test_video_models_over_a_table(spark):
    rows = spark.createDataFrame([(1, [b"ab", b"c"], "what?"), (2, [], "what?"), (3, None, None)], "qa_id int, frames array<binary>, prompt string")
    assert [r.generated_answer for r in models.from_frames(rows, "frames", "prompt", models.EchoVideoModel).orderBy("qa_id").collect()] == ["2 frames: what?", "", ""]

    class Broken(models.VideoModel):
        def generate(self, images, prompt):
            raise RuntimeError

    assert {r.caption for r in models.from_frames(rows, "frames", "prompt", Broken, name="caption").collect()} == {""}


def test_merge_in_place_and_tee(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "video_id string, n int")
    read = lambda: sorted((r.video_id, r.n) for r in spark.read.schema("n int, video_id string").parquet(path).collect())
    tables.merge_in_place(rows, path, skip_existing=True)
    later = spark.createDataFrame([("b", 2), ("c", 2)], rows.schema)
    tables.merge_in_place(later, path, skip_existing=True)
    assert read() == [("a", 1), ("b", 1), ("c", 2)]
    tables.merge_in_place(later, path)
    assert read() == [("a", 1), ("b", 2), ("c", 2)]
    shown = tables.show_table(rows.orderBy("video_id"), tee=f"file://{tmp_path}/log")
    assert "video_id" in shown and [r.value for r in spark.read.text(f"file://{tmp_path}/log", wholetext=True).collect()][0].strip() == shown.strip()


def test_missing_policy_fails_loudly(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "video_id string")
    with pytest.raises(Exception, match="no rows for b"):
        tables.missing_policy(keys, keys.limit(1), "video_id", "fail").collect()
    with pytest.raises(ValueError):
        tables.missing_policy(keys, keys, "video_id", "hope")


def test_small_operators(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, n int, v string")
    assert sorted((r.k, r.v) for r in joins.last_per_key(rows, ["k"], "n").collect()) == [("a", "y"), ("b", "z")]
    assert [r.id for r in sequence.renumber(rows, "k", "n", "id").orderBy("k", "n").collect()] == ["a_q016", "a_q017", "b_q016"]
    assert [r.v for r in sequence.first_of(rows, "n", limit=2).collect()] == ["x", "z"] and sequence.first_of(rows, "n").count() == 3
    assert spark.range(1).select(text.preview(F.lit("a\n" * 60))).first()[0] == "a " * 40
    assert evaluate.score_summary(spark.createDataFrame([], "qa_id int, generated_answer string, config string, error string, s double"), spark.createDataFrame([], "qa_id int, answer string"), ("s",)).count() == 0


def test_batches(spark):
    order = [t for t, n in schemas.BATCH_DISTRIBUTION.items() for _ in range(n)]
    assert len(order) == 15
    item = lambda b, i, t, **k: (b, i, "v", t, 2 if t in schemas.MULTIHOP_TYPES else 1, t != "unanswerable", [] if t == "unanswerable" else [(k.get("start", 1.0),)])
    rows = [item("good", i, t) for i, t in enumerate(order)] + [item("short", i, t) for i, t in enumerate(order[:-1])]
    rows += [item("late", i, t, start=99.0 if i == 2 else 1.0) for i, t in enumerate(order)]
    rows += [(b, i, v, t, 1 if i in (4, 5) else h, a, s) for b, i, v, t, h, a, s in (item("hops", i, t, start=99.0) for i, t in enumerate(order))]
    items = spark.createDataFrame(rows, "batch string, position int, video_id string, question_type string, num_hops int, answerable boolean, ground_truth_spans array<struct<start:double>>")
    lengths = spark.createDataFrame([("v", 50.0)], "video_id string, duration double")
    got = {r.batch: r.violation for r in quality.batch_verdict(items, "batch", schemas.BATCH_DISTRIBUTION, lengths).collect()}
    assert got == {"good": None, "short": "wrong question type distribution", "late": "span starts after the video's end", "hops": "multi-hop question with fewer than 2 hops"}
    assert {r.batch: r.violation for r in quality.batch_verdict(items, "batch", schemas.BATCH_DISTRIBUTION).collect()}["late"] is None


@pytest.mark.parametrize("raw, want", [(r"\(x\)", r"\\(x\\)"), (r"\\(", r"\\("), (r"\\\(", r"\\\("), (r"a\n\"bé", r"a\n\"bé"), ("", ""), ("\\", "\\\\")])
def test_escapes(spark, raw, want):
    assert spark.range(1).select(parsing.repair_escapes(F.lit(raw))).first()[0] == want


@pytest.mark.parametrize("listed, indices", [("[1, 3, 1]", [1, 3, 1]), ("[]", []), ("[true]", [1]), ('["1"]', None), ("[1.0]", None), ("[false]", None), ("[null]", None), ("[[1]]", None), ("[99999999999]", None), ("[-1]", None)])
def test_citation_indices_are_integers(spark, listed, indices):
    got = spark.range(1).select(parsing.parse_citations(F.lit(f'{{"answer": "a", "citations": {listed}}}'), F.lit(3)).alias("p")).first().p
    assert got.indices == indices and got.error == (None if indices is not None else "citation out of range")


def test_scores_have_no_blanks_around_the_slash(spark):
    score = lambda s: spark.range(1).select(parsing.parse_score(F.lit(s))).first()[0]
    assert score("x Score:  1.5/2 y") == 0.75 and score("Score: 1 / 2") is None and score("Score: 1/ 2") is None


def test_windows_of_a_stream(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 0, s),) for s in (0, 10, 40, 50)], "ts timestamp").write.parquet(src)
    rows = ingest.stream_rows(spark, src, "ts timestamp")
    q = ingest.sliding_counts(rows).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    assert q.awaitTermination(60)
    got = {(r.start, r.end): r.n for r in spark.table("counts").collect()}
    want: dict = {}
    for s in (0, 10, 40, 50):
        t = datetime.datetime(2024, 1, 1, 0, 0, s)
        epoch = datetime.datetime(1970, 1, 1)
        k = int((t - epoch).total_seconds() // 35)
        for j in (k - 1, k):
            start = epoch + datetime.timedelta(seconds=35 * j)
            if start <= t < start + datetime.timedelta(seconds=45):
                want[start, start + datetime.timedelta(seconds=45)] = want.get((start, start + datetime.timedelta(seconds=45)), 0) + 1
    assert got == want
    spark.catalog.dropTempView("counts")


def test_pooled_means_leave_no_view(spark):
    rows = spark.createDataFrame([("c", "visual", 1.0), ("d", "text", 0.0)], "config string, question_type string, x double")
    assert {(r.level, r.value): r.x for r in evaluate.pooled_means(rows, ("x",)).collect()}["config", "c"] == 1.0
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]


def test_repaired_escapes_say_whether_they_came_through_whole(spark, tmp_path):
    spark.createDataFrame([(0,), (7,), (None,)], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.same for r in QUERIES["q84_repair_escapes"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 7: True, None: None}
