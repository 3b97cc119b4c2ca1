import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cuespan.llm import line_dedup, mixing, quality_rules, registry, token_counts

from ..conftest import SMALL, same_rows
from .conftest import odd_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, spark, duck):
    same_rows(registry.QUERIES[name](spark, SMALL).toPandas(), duck.sql(registry.ORACLES[name]).df())


def brute_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), sum(n - 1 for n in Counter(lines).values()), len(hit))


@pytest.mark.parametrize("text", [None, "", "a " * 7, "a b c d e a b c d e", "x\nx\n\n x\ny#|", " ".join(f"w{i}" for i in range(7000)) + " q r s t u v q r s t u"])
def test_counts_by_brute_force(text):
    assert quality_rules.count_text(text)[:5] == brute_counts(text)


def test_bucket_inverts(spark):
    v = spark.range(0, 100000, 7).select("id", quality_rules.bucket(F.col("id")).alias("b")).withColumn("f", quality_rules.bucket_floor(F.col("b")))
    assert v.filter("f > id or f < id * 0.96 - 1").count() == 0


def test_rules_odd_and_empty(spark, odd, empty):
    got = quality_rules.adaptive_rules(odd).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got}
    assert by[0].n_words == 0 and by[0].base_failed and not by[0].kept
    assert by[5].base_failed is True and by[9].kept and by[100].kept
    assert quality_rules.adaptive_rules(empty).count() == 0


def brute_fences(values, above, most=1 << 62):
    """Fences of one group and metric: ``above`` are the values of its language and the table."""
    def weights(vs, each):
        out = Counter()
        for v, n in Counter(map(bucket_of, vs)).items():
            out[v] += each(n, len(vs))
        return out

    total = weights(values, lambda n, _: n * 10**6)
    for vs in above:
        total += weights(vs, lambda n, size: n * 50 * 10**6 // size)
    size, upto, at = sum(total.values()), 0, {}
    octaves = Counter()
    for v in sorted(total):
        upto += total[v]
        octaves[floor_of(v).bit_length()] += total[v]
        for p in (100, 500, 900):
            if upto >= size // 1000 * p:
                at.setdefault(p, v)
    clusters = [o for o, n in octaves.items() if n > size // 500]
    mid, last = floor_of(at[500]), lambda v: floor_of(v + 1) - 1
    high, low = last(at[900]) + 3 * (last(at[900]) - mid), floor_of(at[100]) - 3 * (mid - floor_of(at[100]))
    if mid == 0 or at[900] == at[500]:
        beyond = [o for o in clusters if o > floor_of(at[900]).bit_length() + 3 and not {o - 1, o - 2, o - 3} & set(clusters)]
        high = 2 ** (min(beyond) - 1) - 1 if beyond else last(max(total))
    if mid == 0 or at[100] == at[500]:
        beyond = [o for o in clusters if o < floor_of(at[100]).bit_length() - 3 and not {o + 1, o + 2, o + 3} & set(clusters)]
        low = 2 ** max(beyond) if beyond else floor_of(min(total))
    return max(low, 0), min(high, most)


def bucket_of(v):
    e = max(0, v.bit_length() - 6)
    return v if v < 64 else 32 * e + (v >> e)


def floor_of(b):
    e = b // 32 - 1
    return b if b < 64 else (b - 32 * e) << e


def test_fences_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for source, n, length, marks in (("a", 400, 4, 0), ("b", 300, 9, 3), ("c", 7, 6, 1)):
        for _ in range(n):
            words = ["".join(rng.choice("abcXYZ") for _ in range(max(1, round(rng.gauss(length, 1))))) + str(rng.randrange(10**6)) for _ in range(40)]
            words += ["#"] * (rng.randrange(marks + 1) if rng.random() < 0.4 else 0)
            rows.append((len(rows), " ".join(words) + "\nx" * rng.randrange(3), "en", source))
    rows.append((len(rows), " ".join(f"{i}" * 20 for i in range(20, 40)), "en", "a"))  # words of 40 characters
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = quality_rules.adaptive_rules(docs).collect()
    ok = [r for r in got if not r.base_failed]
    limits = {}
    for m, two in quality_rules.METRICS.items():
        every = [r[m] for r in ok]
        for s in "abc":
            low, high = limits[s, m] = brute_fences([r[m] for r in ok if r.source == s], [every, every], quality_rules.LIMIT.get(m, 1 << 62))
            mine = {(r[f"{m}_high"], r[f"{m}_low"] if two else low) for r in got if r.source == s}
            assert mine == {(high, low)}
    assert limits["a", "word_length"] != limits["b", "word_length"]  # the group decides
    for r in got:
        want = not r.base_failed and all(r[m] <= limits[r.source, m][1] and (not two or r[m] >= limits[r.source, m][0]) for m, two in quality_rules.METRICS.items())
        assert r.kept == want
    assert not [r for r in got if r.doc_id == len(rows) - 1][0].kept


@pytest.mark.parametrize("junk", ["symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "word_length"])
def test_a_hundredth_of_junk_is_rejected_and_the_rest_kept(spark, junk):
    """990 clean documents, a few of them with a mark, a repeated line or passage; 10 of junk."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))

    def clean(i):
        words = [word(rng.randint(3, 8)) for _ in range(rng.randint(150, 400))]
        words = [w.capitalize() if rng.random() < 0.05 else w for w in words]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        if i % 50 == 1:
            lines[0] += " 5% | 7%"
        if i % 50 == 2:
            lines.append(lines[0])
        return "\n".join(lines)

    def bad():
        if junk == "symbol_rate":
            return " ".join(["####", "||||", "$$$$", word(5)][k % 4] + str(k) for k in range(120))
        if junk == "dup_line_rate":
            return "\n".join(["home", "about us"] * 30 + [word(6) + " " + word(6) for _ in range(40)])
        if junk == "repeat_rate":
            passage = " ".join(word(5) for _ in range(30))
            return "\n".join([passage + " " + " ".join(word(6) for _ in range(290)), passage])
        if junk == "upper_rate":
            return clean(0).upper()
        return " ".join(word(30) for _ in range(80))

    rows = [(i, bad() if i >= 990 else clean(i), "en", "s") for i in range(1000)]
    got = quality_rules.adaptive_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()
    assert not [r for r in got if r.base_failed and junk not in ("repeat_rate", "dup_line_rate")]
    assert sum(r.kept for r in got if r.doc_id >= 990) <= 1
    assert sum(not r.kept for r in got if r.doc_id < 990) <= 9
    for r in got[:1]:
        assert all(0 <= r[f"{m}_high"] <= quality_rules.LIMIT.get(m, 10**5) for m in quality_rules.METRICS)


def test_sketches_merge(spark, odd):
    rows = quality_rules.with_metrics(quality_rules.text_counts(odd))
    key = lambda df: sorted((r.metric, r.bucket, r.n) for r in df.collect())
    assert key(quality_rules.merge_sketches(quality_rules.sketches(rows, "lang", "source"))) == key(quality_rules.sketches(rows))


def brute_lines(rows, min_docs):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    big = 1 << 63
    held = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            held[key(x)].add(big if r[0] is None else r[0])
    out = []
    for r in rows:
        me = big if r[0] is None else r[0]
        out.append((r[0], "\n".join(x for x in (r[1] or "").split("\n") if not (len(key(x)) >= 10 and len(held[key(x)]) >= min_docs and me > min(held[key(x)])))))
    return out


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_odd(spark, odd, empty, min_docs):
    out = line_dedup.dedup_lines(odd, min_docs=min_docs)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.filter("n_dropped < 0").count() == 0
    flat = lambda x: sorted(map(repr, x))
    assert flat((r.doc_id, r.text) for r in out.collect()) == flat(brute_lines(odd_rows(), min_docs))
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("hot_keys", [1, 30, 10_000])
def test_lines_by_brute_force(spark, monkeypatch, hot_keys):
    """Line ends that are none, blanks of all kinds, repeated lines, ids with several texts."""
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot_keys)
    rng = random.Random(8)
    ends = ["", "\x85", "\u2028", "\u2029", "\xa0", " ", "\t\r", "\x0b\x0c", "\x1c"]
    pool = [f"{a}Some Line number {i % 7}{b}" for i, (a, b) in enumerate((a, b) for a in ends for b in ends)] + ["short", "", "  ", "just nine", "exactly 10"]
    rows = [(rng.choice([i, i, i // 2, None]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    flat = lambda x: sorted(map(repr, x))
    for min_docs in (2, 3, 20):
        got = line_dedup.dedup_lines(docs, min_docs=min_docs).collect()
        assert flat((r.doc_id, r.text) for r in got) == flat(brute_lines(rows, min_docs))
        assert sum(r.n_lines - r.n_dropped for r in got) >= sum(len(r.text.split("\n")) for r in got if r.text)


def test_columns_may_have_any_name(spark, odd):
    """Columns called as what the operators use inside pass through unchanged."""
    from cuespan.llm import hilbert_sharding, jaccard_join

    names = "_n _kept _h _s _u _rank _crc _before _q0 _times _cdf _source _drop_id _row _comp _gone row id h u a b pos part slice number rank n before drops lines first last times cdf rate_source from_source hash by mix slot_ sid block text_crc32 k.l".split()
    wide = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{x}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(x) for x in names])
    for out in (line_dedup.dedup_lines(wide), mixing.poisson_mix(wide), hilbert_sharding.hilbert_shards(wide, ["lang", "source", "n_chars"]), jaccard_join.keep_one(wide)):
        assert set(wide.columns) <= set(out.columns)
        for r in out.collect():
            assert all(r[x] == f"{x}-{'?' if r['doc_id'] is None else r['doc_id']}" for x in names)


def test_mix_means_and_repeats(spark, odd, empty):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    w = {"a": 1.0, "b": 1.0}
    got = {r.source: r for r in mixing.poisson_mix(docs, weights=w).groupBy("source").agg(F.count("*").alias("n"), F.max("mix_rate").alias("rate"), F.sum(F.col("mix_copy")).alias("c")).collect()}
    for s, n in (("a", 18000), ("b", 2000)):
        assert got[s].rate == pytest.approx(10000 / n)
        assert got[s].n == pytest.approx(10000, rel=0.04)
    again = lambda p: sorted((r.doc_id, r.mix_copy) for r in mixing.poisson_mix(docs.repartition(p), weights=w).select("doc_id", "mix_copy").collect())
    assert again(2) == again(5)
    out = mixing.poisson_mix(odd)
    assert out.columns.count("mix_copy") == 1
    assert mixing.poisson_mix(empty).count() == 0


def test_mix_reaches_rates_beyond_any_table(spark):
    docs = spark.range(4020).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "x" * 2).otherwise("x" * 1000).alias("text"), F.when(F.col("id") < 20, "b").otherwise("a").alias("source"))
    w = {"a": 0.5, "b": 0.5}  # b has 40 of 4,000,040 characters: it needs rate 50,000
    got = {r.source: r for r in mixing.poisson_mix(docs, weights=w).groupBy("source").agg(F.count("*").alias("n"), F.max("mix_rate").alias("rate"), F.count_distinct("doc_id", "mix_copy").alias("d"), F.sum(F.length("text")).alias("size")).collect()}
    total = 20 * 2 + 4000 * 1000
    assert got["b"].rate == pytest.approx(total / 2 / 40) and got["b"].d == got["b"].n
    for r in got.values():
        assert r["size"] == pytest.approx(total / 2, rel=0.05)


@pytest.mark.parametrize("rate", [64.5, 190.0, 512.0, 513.0, 5000.0, 1e6])
def test_poisson_count(spark, rate):
    us = [1e-9, 0.01, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    rows = spark.createDataFrame(list(enumerate(us)), "i int, u double").select("i", mixing.poisson_count(F.lit(rate), F.col("u")).alias("n"))
    # exact: from the mode outwards in long decimals
    r, tiny, k, w, parts = Decimal(rate), Decimal(10) ** -22, int(rate), Decimal(1), {}
    while w > tiny:
        parts[k] = w
        k, w = k + 1, w * r / (k + 1)
    k, w = int(rate), Decimal(1)
    while k > 0 and w > tiny:
        k, w = k - 1, w * k / r
        parts[k] = w
    total, cdf, want = sum(parts.values()), Decimal(0), []
    for k in sorted(parts):
        cdf += parts[k] / total
        while len(want) < len(us) and cdf > Decimal(us[len(want)]):
            want.append(k)
    assert [x.n for x in rows.orderBy("i").collect()] == want


def test_poisson_steps(spark):
    import math

    cdf = spark.range(1).select(mixing.poisson_steps(F.lit(2.5)).alias("x")).first().x
    want, total = [], 0.0
    for k in range(len(cdf)):
        total += math.exp(-2.5) * 2.5**k / math.factorial(k)
        want.append(total)
    assert cdf == pytest.approx(want) and 1 - cdf[-1] < 1e-12


VERSIONS = {"words-1": None, "words-2": None}


def test_rollup(spark, odd, empty, tmp_path):
    store = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert store.totals().count() == 0
    rows = token_counts.measured(odd, VERSIONS)
    load = token_counts.counted(rows, "words-1")
    assert store.commit("b1", load) and not store.commit("b1", load)
    total = lambda: {tuple(r[:3]): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    first = total()
    assert sum(n for n, _ in first.values()) == len(odd_rows())
    assert sum(n for _, n in first.values()) == sum(len((r[1] or "").split()) for r in odd_rows())
    store.commit("b2", token_counts.recounted(rows.filter("lang = 'en'"), "words-1", "words-2"))
    assert store.compact()
    assert not store.commit("b1", load)
    assert {k[2] for k in total() if k[1] == "en"} == {"words-2"}
    store.commit("b3", token_counts.recounted(rows.filter("lang = 'en'"), "words-2", "words-1"))
    assert total() == first
    # a half-written batch has no marker and does not count
    token_counts.signed_deltas(load).write.parquet(f"file://{tmp_path}/r/attempts/half")
    assert total() == first and store.commit("b4", token_counts.counted(token_counts.measured(empty, VERSIONS), "words-1"))
    store.vacuum()
    assert total() == first and not (tmp_path / "r" / "attempts" / "half").exists() and not store.commit("b2", load)
    for name in ("a/b", "", ".x", "_x", "a\tb"):
        with pytest.raises(ValueError):
            store.commit(name, load)
    with pytest.raises(Exception, match="unknown change"):
        token_counts.signed_deltas(load.withColumn("op", F.lit("odd"))).collect()


def test_rollup_of_drivers_at_once(spark, odd, tmp_path):
    """Two attempts of a batch, and a commit during a compaction, count once."""
    one, two = (token_counts.TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    load = token_counts.counted(token_counts.measured(odd, VERSIONS), "words-1")
    plain = one._claim

    def late(folder, name, attempt):
        one._claim = plain
        assert two.commit(name, load)
        return plain(folder, name, attempt)

    one._claim = late
    assert not one.commit("b1", load)  # the other was faster
    docs = lambda: sum(r.n_docs for r in one.totals().collect())
    assert docs() == len(odd_rows())

    def meanwhile(folder, name, attempt):
        one._claim = plain
        assert two.commit("b2", load)
        return plain(folder, name, attempt)

    one._claim = meanwhile
    assert one.compact() and docs() == 2 * len(odd_rows())  # b2 is not in the snapshot, and counts once
    assert one.compact() and docs() == 2 * len(odd_rows())
    one.vacuum()
    assert docs() == 2 * len(odd_rows())


@pytest.mark.parametrize("end", ["", "\x85", "\u2028", "\u2029", "\x1c", " ", "\x0b"])
def test_words_are_runs_of_anything_but_ascii_space(spark, end):
    text = f" one two#{end} \t three{end}"
    got = spark.createDataFrame([(text,)], "t string").select(token_counts.words_v1(F.col("t")).alias("a"), token_counts.words_v2(F.col("t")).alias("b")).first()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert got.a == len(words) and got.b == len(re.findall(r"[^\x20\x09-\x0D]+", text.replace("#", " "))) + 1


def test_versions_may_be_vocabularies(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    files = {"bytes": "byte_bpe_50k.json", "words": "word_bpe_49k.json"}
    rows = token_counts.measured(odd, {"words-1": None} | {k: public_tokenizers.path(f) for k, f in files.items()}).collect()
    texts = sorted((r[1] or "") for r in odd_rows())
    for k, f in files.items():
        plain = Tokenizer.from_file(public_tokenizers.path(f))
        plain.encode_special_tokens = True
        assert sorted(r.tokens[k] for r in rows) == sorted(len(plain.encode(t, add_special_tokens=False).ids) for t in texts)
    assert all(set(r.tokens) == {"words-1", *files} for r in rows)


@pytest.mark.parametrize("name", token_counts.VOCABULARIES)
def test_cached_counts_are_those_of_whole_texts(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(f"{name}.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(80).collect()]
    texts += ["", "  ", "don't STOP... 1234!!", "a<|endoftext|>b", "é é  x \n\n y\t\tz ", "日本語 text。", "a\x1cb \x1d c\x1e\x1fd\x85e\u3000f\u00a0 \u2003g", "\n\nx ", "it's,; x. 'tis we'll. 's 'll x'", "a\u200bb \u200b c", "\r\n x\r\n"]
    want = [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    import pyarrow as pa

    assert token_counts.counter_of(path)(pa.array(texts, pa.string())) == want
    few = token_counts.CachedCounter(path, limit=10)
    assert [few.counts([t])[0] for t in texts] == want


def test_totals_by_vocabulary_are_those_of_a_recount(spark):
    """Deletes, revisions and replays of the registered query, against a plain count at the end."""
    import public_tokenizers
    from tokenizers import Tokenizer

    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.toxic == 1}
    plain = [Tokenizer.from_file(public_tokenizers.path(f"{v}.json")) for v in token_counts.VOCABULARIES]
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        if r.doc_id not in toxic:
            k = int(r.lang == "en")
            total = want[r.source, r.lang, token_counts.VOCABULARIES[k]]
            total[0] += 1
            total[1] += len(plain[k].encode(r.text or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in token_counts.op10_token_counts(spark, SMALL).collect()}
    assert got == want and toxic


def test_a_long_history_is_not_read_again(spark, tmp_path, monkeypatch):
    store = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    one = spark.createDataFrame([("insert", 1, "s", "en", "v", 5, None, None)], "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long, old_tokenizer_version string, old_n_tokens long")
    for i in range(12):
        assert store.commit(f"{i:04d}", one)
    store.compact()
    opened, attempt = [], token_counts.TokenRollup._attempt
    monkeypatch.setattr(token_counts.TokenRollup, "_attempt", lambda self, folder, name: (opened.append((folder, name)), attempt(self, folder, name))[1])
    store.commit("later", one)
    assert not store.commit("0003", one)
    total = store.totals().first()
    assert (total.n_docs, total.n_tokens) == (13, 65)
    assert opened == [("snapshots", "000000000000"), ("batches", "later")]
