import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespan.functions import spans as plain
from cuespan.operators import joins, overlap, retrieval, scan, sequence
from cuespan.operators.vector_index import VectorIndex
from cuespan.sources import commits

# --- prefix scans ------------------------------------------------------------------------


def same(a, b):
    return Counter(map(tuple, a.collect())) == Counter(map(tuple, b.select(a.columns).collect()))


def test_one_key_of_a_million_rows_is_many_tasks(spark):
    rows = spark.range(1_000_000).select(F.lit("v").alias("video_id"), F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(10**8)) / 10).alias("start"))
    rows = rows.withColumn("end", F.col("start") + F.pmod(F.xxhash64("seq", F.lit(1)), F.lit(40)) / 2).withColumn("text", (F.pmod(F.xxhash64("seq", F.lit(2)), F.lit(3))).cast("string"))
    cut = scan.Ranges(rows, "video_id", ["start", "end"])
    sizes = [r["count"] for r in cut.rows.groupBy("_part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 500_000
    found, want = scan.merge_islands(rows, "video_id"), plain.merge_islands(rows, "video_id")
    assert 100_000 < found.count() < 900_000
    assert found.exceptAll(want.select(found.columns)).count() == 0 == want.select(found.columns).exceptAll(found).count()
    phrases = rows.select("video_id", "seq", "start", "text")
    found, want = scan.segments_of(phrases), sequence.segments_of(phrases)
    assert found.count() > 500_000
    assert found.exceptAll(want).count() == 0 == want.exceptAll(found).count()
    numbers = scan.renumber(phrases.select("video_id", "seq"), "video_id", "seq", "id")
    assert numbers.filter(F.col("id") != F.format_string("v_q%03d", F.col("seq") + 16)).count() == 0


def test_scans_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 9), rng.choice([None, 1, 2, 5])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(3)
    cut = scan.Ranges(df, "k", ["o"]).running("sum", F.col("v"), "s").running("max", F.col("v"), "m", inclusive=True).neighbour("v", "p", -1).neighbour("v", "n", 1).numbered("i")
    got = cut.rows.orderBy("k", "_part", "_row").collect()
    for k in ("a", "b", None):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.i)
        assert [r.i for r in mine] == list(range(1, len(mine) + 1)) and [r.o for r in mine] == sorted(r.o for r in mine)
        for j, r in enumerate(mine):
            before = [x.v for x in mine[:j] if x.v is not None]
            upto = [x.v for x in mine[: j + 1] if x.v is not None]
            assert r.s == (sum(before) if before else None) and r.m == max(upto, default=None)
            assert r.p == (mine[j - 1].v if j else None) and r.n == (mine[j + 1].v if j + 1 < len(mine) else None)
    none = scan.Ranges(df.limit(0), "k", ["o"]).numbered("i").neighbour("v", "p", 1).done()
    assert none.count() == 0 and none.columns == ["k", "o", "v", "i", "p"]


# --- interval joins ------------------------------------------------------------------------


def random_spans(rng, n):
    out = []
    for i in range(n):
        start = round(rng.uniform(-50, 400), 1)
        length = rng.choice([0.0, 0.1, 1.0, 7.5, 45.0, 45.0, 64.0, 300.0, -3.0, round(rng.expovariate(0.05), 2)])
        out.append((rng.choice(["v", "w"]), i, None if i % 41 == 40 else start, None if i % 43 == 42 else start + length))
    return out


def iou(a, b, c, d):
    inter = max(0.0, min(b, d) - max(a, c))
    union = (b - a) + (d - c) - inter
    return inter / union if union > 0 else 0.0


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.77, 1.0])
def test_iou_join_by_brute_force(spark, threshold):
    rng = random.Random(7)
    left, right = random_spans(rng, 250), random_spans(rng, 250)
    left[:5] = [(k, i, s, e) for (_, i, _, _), (k, _, s, e) in zip(left, right[10:15], strict=False)]  # equal spans
    df = lambda rows, name: spark.createDataFrame(rows, f"video_id string, {name} int, start double, end double")
    got = Counter((r.left_id, r.right_id) for r in overlap.iou_join(df(left, "left_id"), df(right, "right_id"), threshold).collect())
    fine = lambda s: s[2] is not None and s[3] is not None and s[3] > s[2]
    want = Counter((a[1], b[1]) for a in left for b in right if fine(a) and fine(b) and a[0] == b[0] and iou(*a[2:], *b[2:]) >= threshold)
    assert got == want and want
    with pytest.raises(ValueError):
        overlap.iou_join(df(left, "left_id"), df(right, "right_id"), 0)


def test_grid_compares_few_pairs_of_a_long_video(spark):
    rows = spark.range(20_000).select(F.lit("v").alias("video_id"), F.col("id").alias("left_id"), (F.pmod(F.xxhash64("id"), F.lit(10**7)) / 10).alias("start"))
    rows = rows.withColumn("end", F.col("start") + 5 + F.pmod(F.xxhash64("left_id", F.lit(1)), F.lit(400)) / 10)
    compared = overlap.iou_candidates(rows, rows.withColumnRenamed("left_id", "right_id"), 0.5).count()
    linked = overlap.iou_join(rows, rows.withColumnRenamed("left_id", "right_id"), 0.5).count()
    assert linked >= 20_000 and compared < 20_000**2 / 1000 and compared < 20 * linked


def test_pairs_of_spans_and_chunks_do_not_grow_with_rows(spark):
    """Many chunks and spans of the same few times: candidates are made of different ones."""
    n = 3000
    chunks = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("seq"), (35.0 * (F.col("id") % 12)).alias("start_time"), F.col("id").alias("chunk_id")).withColumn("end_time", F.col("start_time") + 45.0)
    spans = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("span_id"), (35.0 * (F.col("id") % 12) + 10.0).alias("start")).withColumn("end", F.col("start") + 35.0)
    chosen = joins.chosen_chunks(spans, chunks).collect()
    assert sorted((r.start, r.chunk_seq) for r in chosen) == [(35.0 * i + 10.0, i) for i in range(12)]
    texts = chunks.select("chunk_id", F.concat(F.lit("t"), "chunk_id").alias("text"))
    got = joins.with_chosen_texts(spans, joins.chosen_chunks(spans, chunks), texts)
    assert got.filter(F.col("chunk_text") == F.concat(F.lit("t"), F.col("span_id") % 12)).count() == n


@pytest.mark.parametrize("block, pairs", [(2048, 4_000_000), (16, 500)])
def test_all_pairs_by_brute_force(spark, block, pairs):
    rng = random.Random(11)
    a, b = random_spans(rng, 90), random_spans(rng, 70)
    left = spark.createDataFrame(a, "video_id string, left_id int, start double, end double")
    right = spark.createDataFrame(b, "video_id string, right_id int, start double, end double")
    got = overlap.all_pairs(left, right, lambda x: {"gap": x[0] - x[2], "reach": x[1] - x[3]}, block=block, pairs=pairs)
    minus = lambda p, q: None if p is None or q is None else p - q
    want = Counter((x[0], x[1], y[1], minus(y[2], x[2]), minus(y[3], x[3])) for x in a for y in b if x[0] is not None and x[0] == y[0])
    assert Counter((r.video_id, r.left_id, r.right_id, r.gap, r.reach) for r in got.collect()) == want and want
    if block == 16:  # one key, and many tasks
        one = lambda r: r.withColumn("video_id", F.lit("v"))
        found = overlap.all_pairs(one(left), one(right), lambda x: {"gap": x[0] - x[2]}, block=16, pairs=500)
        assert found.count() == len(a) * len(b) and found.groupBy(F.spark_partition_id().alias("p")).count().count() > 4


def test_holding_and_nearest_by_brute_force(spark):
    rng = random.Random(9)
    spans = [s for s in random_spans(rng, 200) if s[3] is None or s[2] is None or s[3] >= s[2]]
    chunks = [(k, i, s, e, f"t{i}") for k, i, s, e in random_spans(rng, 120) if s is not None]
    chunks += [("v", 1000 + i, 35.0 * i, 35.0 * i + 45, f"c{i}") for i in range(8)]
    a = spark.createDataFrame(spans, "video_id string, span_id int, start double, end double")
    b = spark.createDataFrame(chunks, "video_id string, seq long, start_time double, end_time double, text string")
    holds = lambda s, c: s[0] == c[0] and None not in (s[2], s[3], c[3]) and c[2] <= s[2] and c[3] >= s[3]
    got = Counter((r.span_id, r.c_seq) for r in overlap.holding_join(a, b).collect())
    assert got == Counter((s[1], c[1]) for s in spans for c in chunks if holds(s, c)) and got
    best = {r.span_id: r.chunk_seq for r in joins.containing_or_near(a, b, 20.0).collect()}
    for s in spans:
        inside = [c[1] for c in chunks if holds(s, c)]
        near = [(abs(c[2] - s[2]), c[1]) for c in chunks if s[0] == c[0] and s[2] is not None and abs(c[2] - s[2]) < 20]
        assert best[s[1]] == (min(inside) if inside else min(near)[1] if near else None)
    assert joins.containing_or_near(a, b.limit(0)).filter("chunk_seq is not null").count() == 0


# --- the vector index ----------------------------------------------------------------------


def full_scan(queries, vectors, k):
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    score = np.round(unit(queries) @ unit(vectors).T, 9)
    return {(q, r + 1): int(i) for q in range(len(queries)) for r, i in enumerate(np.lexsort((np.arange(len(vectors)), -score[q]))[:k])}


def table(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>").repartition(3)


def test_index_prunes_and_is_exact_on_clusters(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(100, 16)) for c in centres])
    asked = x[::37] + 0.01 * rng.normal(size=x[::37].shape)
    index = VectorIndex(spark, str(tmp_path / "ix")).build(table(spark, x, "chunk_id"))
    best, work = index.search(table(spark, asked, "query_id"), 5)
    assert {(r.query_id, r["rank"]): r.chunk_id for r in best.collect()} == full_scan(asked, x, 5)
    w = work.toPandas()
    assert len(w) == len(asked) and w["scored"].mean() < 0.1 * len(x) and (w["vectors"] == len(x)).all()


@pytest.mark.parametrize("cells", [1, 7, None])
def test_index_with_ties_and_zero_vectors(spark, tmp_path, cells):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 3)).astype(float)
    index = VectorIndex(spark, str(tmp_path / f"ix{cells}")).build(table(spark, x, "chunk_id"), cells=cells)
    for block in (40, 8192):
        best, _ = index.search(table(spark, x[:60], "query_id"), 4, block=block)
        assert {(r.query_id, r["rank"]): r.chunk_id for r in best.collect()} == full_scan(x[:60], x, 4)
    best, _ = index.search(table(spark, x[:3], "query_id"), 1000)
    assert best.count() == 900
    none = VectorIndex(spark, str(tmp_path / f"none{cells}")).build(table(spark, x, "chunk_id").limit(0))
    assert none.search(table(spark, x[:3], "query_id"), 4)[0].count() == 0


def test_search_reads_the_folders_of_asked_cells_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.01 * rng.normal(size=(50, 8)) for c in 3 * np.eye(8)])
    index = VectorIndex(spark, str(tmp_path / "ix")).build(table(spark, x, "chunk_id"), cells=8)
    best, _ = index.search(table(spark, x[:1], "query_id"), 3)
    best.collect()
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") or "PartitionFilters: [" in plan and "cell" in plan


def test_grid_of_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 6))
    rows = table(spark, x, "chunk_id").select((F.col("chunk_id") % 3).alias("g"), "chunk_id", F.col("embedding").alias("vector"), F.concat(F.lit("n"), F.col("chunk_id").cast("string")).alias("name"))
    q = rows.select("g", F.col("chunk_id").alias("query_id"), "vector")
    q = q.unionByName(q.limit(1).withColumn("g", F.lit(None).cast("long"))).unionByName(q.limit(1).withColumn("vector", F.lit(None).cast("array<double>")))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (8, 500):
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.name) for r in retrieval.grid_topk(q, rows, 2, ["g"], block, exclude_self=True).collect()}
        assert len(got) == 300
        for i in range(150):
            other = [j for j in range(i % 3, 150, 3) if j != i]
            best = sorted(other, key=lambda j: (-round(float(unit[i] @ unit[j]), 9), j))[:2]
            assert [got[i, r] for r in (1, 2)] == [(j, f"n{j}") for j in best]


# --- commits -------------------------------------------------------------------------------


def test_evaluation_survives_a_crash(spark, tmp_path):
    pairs = spark.range(200).select(F.col("id").alias("qa_id"))
    configs = ("a", "b")
    schema = "qa_id long, config string, score double, run int"
    work = commits.ResumableEvaluation(spark, str(tmp_path / "e"), schema)
    score = lambda run: lambda todo: todo.withColumn("score", F.col("qa_id") * 2.0).withColumn("run", F.lit(run))

    def crash(todo):
        bad = todo.agg(F.max("qa_id")).first()[0]
        return score(2)(todo).withColumn("score", F.when(F.col("qa_id") == bad, F.raise_error(F.lit("lost"))).otherwise(F.col("score")).cast("double"))

    assert work.run(pairs, configs, score(1), 5, stop_after=2) == 2
    first = work.results().count()
    assert 0 < first < 400
    with pytest.raises(Exception, match="lost"):
        work.run(pairs, configs, crash, 5)
    assert work.results().count() == first  # the attempt doesn't count
    # another driver, with another number of batches: nothing is scored twice
    again = commits.ResumableEvaluation(spark, str(tmp_path / "e"), schema)
    assert again.run(pairs, configs, score(3), 3) == 3
    rows = again.results().collect()
    assert sorted((r.qa_id, r.config) for r in rows) == sorted((i, c) for i in range(200) for c in configs)
    assert Counter(r.run for r in rows) == {1: first, 3: 400 - first}
    assert again.run(pairs, configs, score(4), 3) == 0 == again.run(pairs, configs, score(4), 5) - 3 + again.log.names("batches").count("x")
    assert again.sweep() >= 1 and again.results().count() == 400


def test_readers_of_the_store_see_one_version(spark, tmp_path):
    store = commits.VersionedStore(spark, str(tmp_path / "s"), "video_id string, x int")
    rows = lambda n, *keys: spark.createDataFrame([(k, n) for k in keys for _ in range(3)], "video_id string, x int")
    seen = lambda df: Counter((r.video_id, r.x) for r in df.collect())
    assert seen(store.rows()) == {}
    assert store.write(rows(0, "a", "b", None)) == 0
    assert store.write(rows(1, "b", None)) is None
    assert store.write(rows(1, "b", "c")) == 1
    want = {("a", 0): 3, ("b", 0): 3, (None, 0): 3, ("c", 1): 3}
    assert seen(store.rows()) == want
    # a reader in the middle of a rebuild: data is there, but not published
    before = store.rows()
    claim, during = commits.CommitLog.claim, []

    def look(self, kind, name, attempt):
        during.append(seen(store.rows()))
        return claim(self, kind, name, attempt)

    commits.CommitLog.claim = look
    try:
        assert store.write(rows(2, "a", "b"), replace=True) == 2
    finally:
        commits.CommitLog.claim = claim
    after = {("a", 2): 3, ("b", 2): 3, (None, 0): 3, ("c", 1): 3}
    assert during == [want] and seen(before) == want and seen(store.rows()) == after and seen(store.rows(1)) == want
    # a crash before the marker leaves nothing that counts
    store.log.write(rows(9, "z"), ("video_id",))
    assert seen(store.rows()) == after
    # another writer is faster: the second one publishes upon its version
    raced = []

    def lose(self, kind, name, attempt):
        if not raced:
            raced.append(1)
            commits.CommitLog.claim = claim
            assert store.write(rows(5, "d", "e")) == 3
        return claim(self, kind, name, attempt)

    commits.CommitLog.claim = lose
    try:
        assert store.write(rows(6, "e", "f")) == 4
    finally:
        commits.CommitLog.claim = claim
    final = {**after, ("d", 5): 3, ("e", 5): 3, ("f", 6): 3}
    assert seen(store.rows()) == final
    assert store.vacuum() >= 2 and store.versions() == [4] and seen(store.rows()) == final


def test_a_bundle_has_about_a_block_of_vectors():
    from cuespan.operators.vector_index import bundles_of

    bundle, parts = bundles_of(np.array([3, 4, 5, 25, 1, 1]), 10)
    assert bundle.tolist() == [0, 0, 1, 2, 3, 3] and parts.tolist() == [1, 1, 3, 1]


def test_a_query_is_sent_to_a_bundle_once(spark, tmp_path):
    """Vectors that point everywhere: all cells are asked for, in as few copies as there are blocks."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 24))
    index = VectorIndex(spark, str(tmp_path / "ix")).build(table(spark, x, "chunk_id"), cells=50)
    best, work = index.search(table(spark, x[:40], "query_id"), 3, block=200)
    assert {(r.query_id, r["rank"]): r.chunk_id for r in best.collect()} == full_scan(x[:40], x, 3)
    assert work.filter("cells > 40").count() > 30
    cells = index._cells()
    asked = spark.createDataFrame([(i, v.tolist(), cells["cell"].tolist()) for i, v in enumerate(x[:40])], "query_id long, vector array<double>, cells array<int>")
    plan = index._scored(asked, 3, cells, 200, 9)
    # 3 rows of each query and bundle, and not of each cell
    assert plan.count() <= 40 * 3 * 4 < 40 * 3 * len(cells)
