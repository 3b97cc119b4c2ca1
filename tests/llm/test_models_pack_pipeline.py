import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuespan.llm import language_id, mixing, packing, pu_quality

from ..conftest import SMALL
from .conftest import odd_rows


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language_id.op4_language_id(spark, SMALL).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd(spark, odd, empty):
    model = language_id.train(["aaa bbb aab"] * 3 + ["xyz zyx xxz"] * 3, ["a"] * 3 + ["x"] * 3)
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0 and got[0].rejected
    assert language_id.identify(odd, model).count() == len(odd_rows())
    assert model.predict("12 345 !!") == ("und", 0.0) and model.predict("aab bba")[0] == "a"
    none = language_id.train_bags(*language_id.training_sample(empty))
    assert none.languages == [] and {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def brute_buckets(text, n_buckets):
    """Every n-gram of the padded text, hashed letter by letter with whole numbers."""
    padded, out = f" {text.lower()} ", []
    for n in (2, 3, 4):
        for i in range(len(padded) - n + 1):
            h = n
            for c in padded[i : i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % (1 << 64)
                h ^= h >> 29
            out.append(h % n_buckets)
    return out


@pytest.mark.parametrize("text", ["abc déf", "x", "long text " * 50, "日本 Ünï 1"])
def test_prediction_by_brute_force(text):
    rng = np.random.default_rng(2)
    model = language_id.LanguageModel(["a", "b", "c"], rng.normal(size=(64, 3)), np.array([0.1, -0.2, 0.0]), temperature=0.4)
    grams = brute_buckets(text, 64)
    logits = [sum(model.table[g][k] for g in grams) / len(grams) + model.bias[k] for k in range(3)]
    assert np.allclose(model.logits(text), logits)
    p = [np.exp(z / 0.4) for z in logits]
    lang, score = model.predict(text)
    assert lang == "abc"[int(np.argmax(p))] and score == pytest.approx(max(p) / sum(p))


def test_threshold_keeps_the_precision_on_rows_that_were_not_fitted():
    """A third of the texts of two languages have no letters of their own: only rejection helps."""
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    texts, langs = [], []
    for i in range(900):
        lang = "ab"[i % 2]
        letters = "xyz" if i % 3 == 0 else {"a": "klm", "b": "rst"}[lang]
        texts.append(" ".join(word(letters) for _ in range(6)))
        langs.append(lang)
    model = language_id.train(texts, langs, target_precision=0.97)
    held = np.random.default_rng(7).permutation(900)[:180]  # the fifth that is kept apart
    found = [(model.predict(texts[i]), langs[i]) for i in held]
    sure = [lang == gold for (lang, score), gold in found if score >= model.threshold]
    assert np.mean([lang == gold for (lang, _), gold in found]) < 0.95
    assert np.mean(sure) >= 0.97 and len(sure) > 90


def test_any_number_of_languages_is_learned(spark):
    words = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(8))
    docs = spark.range(1300).select("id").collect()
    docs = spark.createDataFrame([(r.id, words(r.id % 130), f"l{r.id % 130}") for r in docs], "doc_id long, text string, lang string")
    bags, langs = language_id.training_sample(docs, max_rows=260)
    assert len(set(langs)) > 100 and len(bags) < 2 * 260
    bags, langs = language_id.training_sample(docs)
    model = language_id.train_bags(bags, langs)
    assert len(model.languages) == 130
    got = language_id.identify(docs, model).join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9


def test_subword_blocks_cover_the_text(monkeypatch):
    text = "abcdefghij" * 30
    whole = np.sort(np.concatenate(list(language_id.subwords(text))))
    monkeypatch.setattr(language_id, "BLOCK", 17)
    assert (np.sort(np.concatenate(list(language_id.subwords(text)))) == whole).all()


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = pu_quality.op7_pu_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(8, 30)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = pu_quality.fit(odd, labels)
    got = pu_quality.score(odd, model, "doc_id", "text").collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    for docs, lab in ((empty, labels), (odd, labels.limit(0)), (odd, labels.withColumn("quality", F.lit(0)))):
        flat = pu_quality.fit(docs, lab)
        assert not flat.usable and len({r.score for r in pu_quality.score(odd, flat, "doc_id").collect()}) == 1
    assert pu_quality.score(empty, model, "doc_id").count() == 0


def test_rare_positives_are_all_sampled(spark, monkeypatch):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Some text "), F.when(F.col("id") % 25 == 0, F.lit("good")).otherwise(F.lit("#|#|")), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 25 == 0).cast("int").alias("quality"))
    sizes, learn = [], pu_quality.learn
    monkeypatch.setattr(pu_quality, "learn", lambda pos, unl: (sizes.append((len(pos), len(unl))), learn(pos, unl))[1])
    found = [pu_quality.fit(docs.repartition(n), labels.repartition(n), max_positives=50, max_unlabelled=300) for n in (2, 5)]
    assert sizes == [(50, 300)] * 2
    assert np.array_equal(found[0].weight, found[1].weight) and found[0].slope == found[1].slope


def test_negatives_are_not_learned_from(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    a, b = pu_quality.fit(docs, labels), pu_quality.fit(docs, labels.filter("quality = 1"))
    assert np.array_equal(a.weight, b.weight) and (a.prior, a.slope, a.shift) == (b.prior, b.slope, b.shift)


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_risk_gradient_by_finite_differences(prior):
    rng = np.random.default_rng(3)
    xp, xu, theta = rng.normal(1, 1, (40, 4)), rng.normal(0, 1, (60, 4)), rng.normal(0, 0.5, 4)
    _, _, g_pos, g_neg = pu_quality.risk(theta, xp, xu, prior)
    for i in range(4):
        step = np.eye(4)[i] * 1e-6
        up, down = pu_quality.risk(theta + step, xp, xu, prior), pu_quality.risk(theta - step, xp, xu, prior)
        assert g_pos[i] == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-6) and g_neg[i] == pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-6)


def test_step_turns_where_the_risk_is_negative():
    rng = np.random.default_rng(3)
    xp, xu = rng.normal(2, 1, (40, 4)), rng.normal(-2, 1, (60, 4))
    for theta, turned in ((np.zeros(4), False), (np.ones(4) * 3, True)):
        _, negative, g_pos, g_neg = pu_quality.risk(theta, xp, xu, 0.9)
        assert (negative < 0) == turned
        assert np.array_equal(pu_quality.step_direction(theta, xp, xu, 0.9), -g_neg if turned else g_pos + g_neg)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_prior_is_estimated(share):
    rng = np.random.default_rng(1)
    n = 6000
    unl = np.concatenate([rng.normal(2, 1, int(n * share)), rng.normal(-2, 1, n - int(n * share))])
    assert pu_quality.positive_share(rng.normal(2, 1, 3000), unl) == pytest.approx(share, abs=0.04)


def brute_features(text):
    raw = (text or "").encode()
    kinds = [set(b"abcdefghijklmnopqrstuvwxyz"), set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set(b"0123456789"), set(b" \t\r\x0b\x0c"), set(b"\n"), set(b"."), set(b","), set(b"!?"), set(b"|"), set(b"#*$%&<>^~=+_\\/{}[]"), set(b":;'\"()-"), set(b"@")]
    kind = [1 if c > 127 else next((k + 2 for k, s in enumerate(kinds) if c in s), 0) for c in raw]
    n_kinds, size = len(kinds) + 2, max(len(raw), 1)
    out = [np.log1p(200 * kind.count(k) / size) for k in range(n_kinds)]
    pairs = Counter(zip(kind, kind[1:], strict=False))
    out += [np.log1p(200 * pairs[i, j] / size) for i in range(n_kinds) for j in range(n_kinds)]
    words, lines = raw.split(), [x.strip() for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    out += [np.log1p(n), len(raw) / max(n, 1) / 10, len(set(words)) / max(n, 1) ** 0.5, 1 - len(set(lines)) / max(len(lines), 1)]
    out += [sum(words[i] == words[i + 1] for i in range(n - 1)) / max(n, 1), 1 - len({(words[i], words[i + 1]) for i in range(n - 1)}) / (n - 1) if n > 1 else 0, np.log1p(n / max(len(lines), 1))]
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "a", "the the cat", "A b, c.\nA b, c.\n\n### |x| é 12! @you", "word " * 40 + "\nword word"])
def test_features_by_brute_force(text):
    assert np.allclose(pu_quality.features(text), brute_features(text), atol=1e-5)


def test_calibration_has_the_least_risk():
    rng = np.random.default_rng(9)
    pos, unl = rng.normal(2, 1, (500, 1)), np.concatenate([rng.normal(2, 1, (600, 1)), rng.normal(-1, 1, (400, 1))])
    model = pu_quality.QualityModel(np.zeros(1), np.ones(1), np.array([0.7]), 0.3, 0.6)
    zp, zu = model.raw(pos), model.raw(unl)
    loss = lambda a, b: np.mean(np.log1p(np.exp(a * zu + b))) - 0.6 * np.mean(a * zp + b) + 5e-4 * ((a - 1) ** 2 + b * b)
    pu_quality.calibrate(model, pos, unl)
    best = loss(model.slope, model.shift)
    assert all(best <= loss(model.slope + x, model.shift + y) + 1e-12 for x in (-0.05, 0, 0.05) for y in (-0.05, 0, 0.05))
    assert best < loss(1.0, 0.0)


def test_repeated_ids_are_sampled_alike_in_any_order(spark):
    rows = [(i // 4, f"text {i} " + ("good words here" if i // 4 % 2 else "|#|# x")) for i in range(800)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [pu_quality.fit(docs.repartition(n, "text"), labels, max_positives=30, max_unlabelled=60) for n in (1, 7)]
    assert np.array_equal(found[0].weight, found[1].weight) and found[0].shift == found[1].shift


def test_feature_blocks(monkeypatch):
    text = "Ab 1!\n" * 50
    whole = pu_quality.features(text)
    monkeypatch.setattr(pu_quality, "BLOCK", 7)
    assert np.allclose(pu_quality.features(text), whole)


def test_risk_is_kept_non_negative():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1, 1, (400, 3)), rng.normal(-1, 1, (200, 3))
    unl = np.concatenate([rng.normal(1, 1, (400, 3)), neg])
    m = pu_quality.nnpu(pos, unl, prior=2 / 3)
    assert (m.score(pos) > 0.5).mean() > 0.9 and (m.score(neg) < 0.5).mean() > 0.8


def test_fill_window_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, rng.integers(1, 5))}
        cap = int(rng.integers(1, 60))
        sums = {0}
        for k, n in counts.items():
            sums |= {s + k * i for s in sums for i in range(1, n + 1) if s + k * i <= cap}
        used = packing.fill_window(counts, cap)
        assert sum(k * n for k, n in used.items()) == max(sums)
        assert all(n <= counts[k] for k, n in used.items())


def test_tokenizer_cache_is_exact(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer_path()
    plain, cached = Tokenizer.from_file(path), packing.WordCachedTokenizer(path, cache_words=50)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    texts += ["", "  ", "don't STOP... 1234!!", "ΣΑΣ İstanbul", "a<|endoftext|>b", "é é x y", "it's,; x. 'tis we'll.", "日本語 text。", "a\x1cb \x1d c\x1e\x1fd\x85e\u3000f", None, "the, the; the. the", "l'été,,, x'#"]
    texts += [" ".join(f"a{chr(c)}b {chr(c)} {chr(c).upper()}x{chr(c)}, x{chr(c)}#" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x3400, 64)]
    for some in (texts, *[[t] for t in texts[:90]]):
        ids, sizes = cached.many(pa.array(some, pa.string()))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in some]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def check_packing(docs, rows, capacity):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer_path())
    want = Counter()
    for r in docs:  # every piece, from the tokenizer itself
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), capacity):
            part = np.array(ids[at : at + capacity], "<u4")
            want[r[0], at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_pack_odd(spark, odd, empty):
    for how in ({}, {"group_docs": 4}, {"capacity": 64}, {"with_ids": True}):
        rows = packing.pack(odd, **how).collect()
        check_packing(odd_rows(), rows, how.get("capacity", 4096))
        assert len({r.doc_id for r in rows}) == len({r[0] for r in odd_rows()})
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in packing.pack(odd, with_ids=True).collect())
    assert packing.pack(empty).count() == 0


def test_little_padding(spark):
    p = packing.padding(packing.op5_minimum_bin_slack(spark, "/root/testdata/sf0.01")).first()
    assert p.padding < 0.01 * p.tokens


def test_pipeline(spark, odd, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, n = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        n = docs.count()
        assert n > 0 and (name not in ("quality_classifier", "near_duplicates") or n <= before.count())
    assert corpus_pipeline.run(spark, SMALL).count() == n
    for rows in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SMALL).count()
    assert corpus_pipeline.near_duplicates(spark, odd, SMALL).filter("doc_id in (21, 22, 23)").count() == 0


def test_pipeline_stages_by_brute_force(spark, duck):
    """What each stage of the pipeline leaves, on its own input, worked out anew."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from .test_rules_lines_mix import brute_lines
    from .test_sketch_shard_join import brute_components

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = stages["quality_classifier"](spark, docs, SMALL)
    model = pu_quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {i for i, t in rows if model.score(np.array([brute_features(t)]).astype(np.float32).astype(np.float64))[0] >= 0.5}
    assert {r.doc_id for r in kept.collect()} == want
    cleaned = stages["line_dedup"](spark, docs, SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in cleaned) == sorted(brute_lines(rows, 2)) and all(r.n_chars == len(r.text) for r in cleaned)
    one = stages["near_duplicates"](spark, docs, SMALL).collect()
    assert sorted(r.doc_id for r in one) == [i for i, _, c in sorted(brute_components(rows, 5, 80, 100)) if i == c]
    mixed = stages["source_mix"](spark, docs, SMALL)
    assert mixed.columns == docs.columns and mixed.join(docs, docs.columns, "left_anti").count() == 0
    times = duck.sql(f"SELECT doc_id, count(*) FROM ({mixing.oracle()}) GROUP BY 1").fetchall()
    assert Counter(r.doc_id for r in mixed.collect()) == dict(times) and len({n for _, n in times}) > 1
    check_packing(rows, stages["packing"](spark, docs, SMALL).collect(), 4096)
