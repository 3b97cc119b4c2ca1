import base64
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuespan.llm import components, hilbert_sharding, jaccard_join, scaled_sketch
from cuespan.llm._common import hot_join

from ..conftest import SMALL
from .conftest import odd_rows


def shingles(text, k, lower=False):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if lower:
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words]
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(zip(*[words[i:] for i in range(k)], strict=False))


def brute_components(rows, k, num, den):
    sets = [shingles(r[1], k, True) for r in rows]
    big = 1 << 62
    ids = [big if r[0] is None else r[0] for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), big), ids[i])
    show = lambda x: None if x == big else x
    return sorted(((show(ids[i]), len(sets[i]), show(low[find(i)])) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("how", [{}, {"size": 5, "num": 80}, {"block_tokens": 50}, {"local_hot": 1}])
def test_join_odd(spark, odd, empty, how):
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(odd, **how).collect()), key=repr)
    assert got == brute_components(odd_rows(), how.get("size", 4), how.get("num", 85), 100)


def test_join_empty(spark, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0


def test_keep_one_decides_by_row(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    near = text(0) + " tail"
    rows = [(5, text(0)), (5, text(0)), (None, near), (None, text(1)), (None, text(1)), (None, text(2)), (7, near), (7, text(3)), (3, text(4)), (4, text(4)), (8, None), (8, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(repr, map(tuple, jaccard_join.keep_one(docs).collect())))
    assert got == sorted(map(repr, [(5, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (3, text(4)), (8, None), (8, None), (None, "")]))


def test_join_on_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=repr)
    assert got == brute_components(rows, 4, 85, 100)


@pytest.mark.parametrize("how", [{}, {"block_tokens": 300, "local_hot": 3}])
def test_every_link_is_counted(spark, how):
    rng = random.Random(7)
    rows = odd_rows()
    rows = [(r[0], r[1]) for r in rows]
    for i in range(40):
        w = [f"w{j}" for j in range(60)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{i}"
        rows.append((1000 + i, " ".join(w)))
    sets = [shingles(t, 4, True) for _, t in rows]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    want = sorted(((d, len(a), sum(near(a, b) for k, b in enumerate(sets) if k != i)) for i, ((d, _), a) in enumerate(zip(rows, sets, strict=True))), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard_join.link_counts(docs, **how).collect()), key=repr) == want
    assert jaccard_join.link_counts(docs.limit(0)).count() == 0


def test_join_near_groups(spark):
    """Large groups of near copies, small blocks: chunk pairs and several rounds."""
    rng = random.Random(3)
    rows = []
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(60)]
        for i in range(60):
            w = list(words)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((g * 60 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for how in ({}, {"block_tokens": 900, "local_hot": 3}):
        got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs, **how).collect()), key=repr)
        assert got == brute_components(rows, 4, 85, 100)


def test_merge_skip_by_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        t = rng.randint(1, len(lists))
        want = sorted((k, n) for k, n in Counter(x for y in lists for x in y).items() if n >= t)
        assert list(jaccard_join.merge_skip(lists, t)) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(80)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(6)
    got = {r.u: r.v for r in components.connected_components(df).collect()}
    assert got == dict(components.spanning_stars(edges))
    assert components.connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("edges_a_task", [3, 40, 10_000])
def test_components_in_any_number_of_tasks(spark, edges_a_task):
    rng = random.Random(edges_a_task)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(6)
    got = {tuple(r) for r in components.connected_components(edges, edges_a_task=edges_a_task).collect()}
    assert got == set(components.spanning_stars(pairs))


def brute_sketch(text):
    """Every shingle's hash below a sixteenth of 2^48, or the smallest one: words folded into a
    64-bit hash, low 48 bits."""
    out = set()
    for words in shingles(text, 5):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), h)
        out.add(h & (1 << 48) - 1)
    return sorted(h for h in out if h < 1 << 44) or sorted(out)[:1]


def brute_print(hashes):
    return base64.b64encode(b"".join(h.to_bytes(6, "big") for h in hashes)).decode()


def alike(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 1.0


@pytest.mark.parametrize("parts", [1, 3])
def test_sketch_by_brute_force(spark, parts):
    """The query's rows, exactly: next document, edited text, fingerprints and likenesses."""
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] is not None and r[0] != 9] + [(-5, "a text " * 40), (10**12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    pairs = scaled_sketch.edited_pairs(docs)
    print_ = scaled_sketch.fingerprint
    got = {r.doc_id: r for r in pairs.select("*", print_(F.col("sketch")).alias("fp"), print_(F.col("edited_sketch")).alias("efp"), scaled_sketch.jaccard(F.col("sketch"), F.col("edited_sketch")).alias("near"), scaled_sketch.jaccard(F.col("sketch"), F.col("next_sketch")).alias("near_next"), scaled_sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("inside")).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, r in enumerate(order):
        a, b = r[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(a) // 3
        e, g = a[: len(a) - cut] + b[:cut], got[r[0]]
        x, y, z = brute_sketch(a), brute_sketch(e), brute_sketch(b)
        assert g.edited == e and g.n_chars == len(a)
        assert g.fp == brute_print(x) and g.efp == brute_print(y)
        assert g.near == alike(x, y) and g.near_next == alike(x, z)
        assert g.inside == (len(set(x) & set(y)) / len(x) if x else 1.0)


def test_sketch_odd_and_empty(spark, odd, empty):
    out = scaled_sketch.edited_pairs(odd).collect()
    assert len(out) == len(odd_rows()) and [r.doc_id for r in out].count(None) == 1
    assert len({(r.edited, r.n_chars) for r in out if r.doc_id == 9}) == 1  # equal rows are treated alike
    assert scaled_sketch.edited_pairs(empty).count() == 0
    one = scaled_sketch.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited == "abcdab"


def test_sketch_estimates_containment_of_unequal_texts(spark):
    words = [f"w{i}" for i in range(6000)]
    one = spark.createDataFrame([(" ".join(words[2000:2400] + [f"x{i}" for i in range(400)]), " ".join(words))], "a string, b string")
    r = one.select(scaled_sketch.containment(scaled_sketch.sketch(F.col("a")), scaled_sketch.sketch(F.col("b"))).alias("c")).first()
    assert r.c == pytest.approx(396 / 796, abs=0.2)  # three standard errors of 50 hashes


def test_sketch_error_and_size_by_length(spark):
    """Likeness of a text and one that shares half of it: the error is as the docstring says."""
    rng = random.Random(3)
    for n in (100, 400, 1600):
        rows = []
        for _ in range(150):
            a = [f"w{rng.getrandbits(30)}" for _ in range(n)]
            rows.append((" ".join(a), " ".join(a[: 2 * n // 3] + [f"x{rng.getrandbits(30)}" for _ in range(n - 2 * n // 3)])))
        df = spark.createDataFrame(rows, "a string, b string").select("a", scaled_sketch.sketch(F.col("a")).alias("x"), scaled_sketch.sketch(F.col("b")).alias("y"))
        got = df.select(scaled_sketch.jaccard(F.col("x"), F.col("y")).alias("j"), F.length("a").alias("n"), F.length(scaled_sketch.fingerprint(F.col("x"))).alias("m")).toPandas()
        error = np.sqrt(np.mean((got["j"] - 0.5) ** 2))
        assert error < 1.4 * (2 / n) ** 0.5 and abs(got["j"].mean() - 0.5) < 0.05
        assert got["m"].sum() < 0.1 * got["n"].sum()


def test_sketch_merges(spark):
    text = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    rows = [(text("a", 300), text("b", 40)), (text("c", 5), text("d", 300)), (text("e", 5), text("f", 5)), (text("g", 6), ""), ("", "")]
    s = lambda c: scaled_sketch.sketch(F.col(c))
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", scaled_sketch.merge(s("a"), s("b")).alias("m")).collect():
        both = {*brute_sketch(r.a), *brute_sketch(r.b)}
        assert r.m == (sorted(h for h in both if h < 1 << 44) or sorted(both)[:1])


def test_hilbert_curve(spark):
    cells = spark.range(4096).select((F.col("id") % 16).alias("x"), (F.floor(F.col("id") / 16) % 16).alias("y"), F.floor(F.col("id") / 256).alias("z"))
    rows = cells.select("x", "y", "z", hilbert_sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")]).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(4096))
    p = np.array([r[:3] for r in rows])
    assert (np.abs(np.diff(p, axis=0)).sum(axis=1) == 1).all()  # each step goes to a neighbour


@pytest.mark.parametrize("target", [4096, 3])
def test_shards_odd(spark, odd, empty, target):
    out = hilbert_sharding.hilbert_shards(odd.select("doc_id", "text", "lang", "source", "n_chars", "shard"), ["lang", "source", "n_chars"], n_shards=5, target_buckets=target).collect()
    assert len(out) == len(odd_rows())
    by = Counter(r.shard for r in out)
    assert max(by.values()) - min(by.values()) <= 1
    for s, n in by.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert hilbert_sharding.hilbert_shards(empty, ["lang", "source", "n_chars"]).count() == 0


def test_shards_follow_the_curve_and_prune(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["de", "en", "en", "fr", None]), f"https://a.very.long.prefix.of/{rng.choice('aabbbcdefgh')}", rng.randrange(1000)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long").repartition(4)
    got = hilbert_sharding.hilbert_shards(docs, ["lang", "source", "n_chars"], n_shards=12, target_buckets=64).collect()

    def cells(values, cuts):
        return {v: 0 if v is None else sum(v > c for c in cuts) for v in values}

    langs, sources = cells({r[1] for r in rows}, hilbert_sharding.value_cuts(docs, "lang", 16)), cells({r[2] for r in rows}, hilbert_sharding.value_cuts(docs, "source", 16))
    assert len(set(sources.values())) == 8  # whole values, not their first bytes
    for dim, at in (("lang", langs), ("source", sources)):  # equal depth: no cut is left out that could be made
        vals = sorted(r[dim] for r in got if r[dim] is not None)
        assert set(hilbert_sharding.value_cuts(docs, dim, 16)) == {vals[-(-k * len(vals) // 16) - 1] for k in range(1, 16)} - {vals[-1]}
        assert at
    sizes = dict(tuple(r) for r in docs.select("n_chars", hilbert_sharding.quantised(docs, ["n_chars"])[0]).collect())
    assert [sizes[v] for v in sorted(sizes)] == sorted(sizes.values()) and max(abs(n - 75) for n in Counter(sizes[r[3]] for r in rows).values()) <= 8
    curve = {tuple(r[:3]): r.h for r in spark.range(4096).select((F.col("id") % 16).alias("x"), (F.floor(F.col("id") / 16) % 16).alias("y"), F.floor(F.col("id") / 256).alias("z")).select("x", "y", "z", hilbert_sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")]).alias("h")).collect()}
    at = [curve[langs[r.lang], sources[r.source], sizes[r.n_chars]] for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert at == sorted(at)  # shards are runs of the curve
    spans = [sorted(r.n_chars for r in got if r.shard == s) for s in range(12)]
    assert sum(x[0] <= 500 <= x[-1] for x in spans) < 12  # a file's least and largest value rule it out


def test_shards_of_one_repeated_row(spark):
    docs = spark.range(20000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    out = hilbert_sharding.hilbert_shards(docs, ["lang", "source", "doc_id"], target_buckets=16)
    got = out.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert len(got) == 24 and all(r.n == r.d == r.m + 1 and r.n in (833, 834) for r in got)


def test_shards_on_table(spark, tmp_path):
    got = hilbert_sharding.op8_hilbert_sharding(spark, SMALL)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = got.collect()
    assert all(r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    hilbert_sharding.write_shards(got, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("shard=*"))) == 24


def test_scratch(spark, odd):
    from cuespan.llm import _common

    _common.materialize(odd.select("doc_id"), "swept")
    assert _common.sweep_scratch(spark, hours=24) == 0
    assert _common.sweep_scratch(spark, hours=-1) > 0 and _common.sweep_scratch(spark, hours=-1) == 0


@pytest.mark.parametrize("master, fine", [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[3,2,1000]", False), ("spark://x:7077", False), ("yarn", False)])
def test_no_local_folder_on_a_cluster(master, fine):
    from types import SimpleNamespace

    from cuespan.llm import _common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    if fine:
        assert _common.scratch_path(session, "t").startswith("file://")
    else:
        with pytest.raises(RuntimeError):
            _common.scratch_path(session, "t")


def test_components_edge_cases(spark):
    edges = spark.createDataFrame([(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4)], "u long, v long")
    assert [tuple(r) for r in components.connected_components(edges).collect()] == [(5, 4)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_is_a_join(spark, how):
    rows = spark.createDataFrame([(i, None if i % 5 == 4 else i % 3 + i % 2 * i, i % 2) for i in range(60)], "id long, k long, j long")
    few = spark.createDataFrame([(k, k % 2, f"of {k}") for k in range(0, 50, 2)] + [(k, 1, f"of {k}") for k in range(1, 30)], "k long, j long, what string").dropDuplicates(["k", "j"])
    for hot in (F.lit(False), F.lit(True), F.col("k") == 1):
        got = hot_join(rows, few, ["k", "j"], hot, how).select("id", "k", "j", "what")
        assert sorted(got.collect(), key=repr) == sorted(rows.join(few, ["k", "j"], how).select("id", "k", "j", "what").collect(), key=repr)


def test_bands_part_a_passage_of_texts_of_all_lengths(spark):
    """A passage in texts of 60 to 4,000 words joins those of like length only, and near copies
    are found whatever band their sizes fall into."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(55)]
    rows = []
    for i in range(240):
        own = [f"w{rng.getrandbits(40)}" for _ in range(int(5 * 1.028**i))]
        rows.append((i, " ".join(passage + own)))
    for i in range(0, 240, 7):  # copies a little longer or shorter
        words = rows[i][1].split()
        rows.append((1000 + i, " ".join(words[: len(words) - len(words) // 20])))
        rows.append((2000 + i, " ".join([*words, *[f"x{i}y{k}" for k in range(len(words) // 15)]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    how = {"local_hot": 8}
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(docs, **how).collect()), key=repr) == brute_components(rows, 4, 85, 100)
    lists = jaccard_join.in_bands(jaccard_join.short_lists(jaccard_join.window_rows(docs, **how), **how))
    assert max(r["count"] for r in lists.groupBy("band").count().collect()) < len(rows) / 4


def test_partners_share_a_band(spark):
    for num, den in ((85, 100), (80, 100), (1, 2)):
        starts = jaccard_join.band_starts(num, den)
        own = lambda n: sum(s <= n for s in starts)
        for n in range(1, 2000):
            most = n * den // num
            assert own(most) - own(n) in (0, 1)
        got = jaccard_join.in_bands(spark.range(1, 300).select(F.col("id").alias("sid"), F.col("id").alias("n")), num, den).collect()
        assert {(r.n, r.band) for r in got} == {(n, own(n) - k) for n in range(1, 300) for k in (0, 1)}


@pytest.mark.parametrize("every", [False, True])
def test_a_group_of_near_copies_is_not_probed_pair_by_pair(monkeypatch, every):
    """Sets that share most of a text and mostly don't link: searches grow with sets, not pairs."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 120)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(96, 118))], rng.integers(0, 1 << 62, int(rng.integers(0, 20)))])).astype(np.uint64) for _ in range(250)]
    want = {(i, j) for i in range(250) for j in range(i) if 100 * len(c := np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]) - len(c))}
    calls, search = [], np.searchsorted
    monkeypatch.setattr(jaccard_join.np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    got = jaccard_join.link_block(sets, every=every)
    assert len(calls) < 10 * len(sets)
    if every:
        assert {(max(p), min(p)) for p in got} == want and len(got) == len(want) > 100
    else:
        name = list(range(250))
        for pairs in (got, want):
            for a, b in pairs:
                if pairs is want:
                    assert name[a] == name[b]
                name = [name[a] if x == name[b] else x for x in name]
        assert len(set(name)) == 250 - len(got) and {(max(p), min(p)) for p in got} <= want
