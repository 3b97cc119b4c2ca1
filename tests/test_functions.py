import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuespan.functions import parsing, spans, text, textmetrics


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def arr(*pairs):
    if not pairs:
        return F.array().cast("array<struct<start:double,end:double>>")
    return F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end")) for a, b in pairs])


@pytest.mark.parametrize("p,g,want", [((0, 45), (0, 45), 1.0), ((0, 45), (50, 95), 0.0), ((0, 45), (30, 75), 0.2), ((10, 10), (0, 45), 0.0), ((10, 30), (0, 45), 20 / 45), ((5, 5), (5, 5), 0.0)])
def test_iou(spark, p, g, want):
    got = value(spark, spans.temporal_iou(*[F.lit(float(x)) for x in (*p, *g)]))
    assert got == pytest.approx(want)


def test_threshold_is_inclusive(spark):
    assert value(spark, spans.iou_at(F.lit(0.0), F.lit(3.0), F.lit(0.0), F.lit(10.0), 0.3))


def test_merge(spark):
    m = lambda *p: [(x.start, x.end) for x in value(spark, spans.merge_spans(arr(*p)))]
    assert m((0, 10), (10, 20)) == [(0, 20)]
    assert m((30, 40), (0, 10)) == [(0, 10), (30, 40)]
    assert m((0, 50), (10, 20), (60, 70)) == [(0, 50), (60, 70)]
    assert m() == []


def test_bounding_and_union(spark):
    assert tuple(value(spark, spans.bounding_span(arr((50, 150), (10, 20))))) == (10, 150)
    assert tuple(value(spark, spans.bounding_span(arr()))) == (0, 0)
    assert value(spark, spans.union_iou(arr((0, 45)), arr((0, 95)))) == pytest.approx(45 / 95)
    assert value(spark, spans.union_iou(arr(), arr((0, 95)))) == 0
    assert value(spark, spans.per_hop_iou(arr((0, 45)), arr((0, 45), (100, 145)))) == pytest.approx(0.5)
    assert value(spark, spans.hop_recall(arr((0, 45)), arr((0, 45), (100, 145)), 0.3)) == 0.5
    assert value(spark, spans.hit(arr((30, 75)), arr((0, 45)), 0.3)) is False
    assert value(spark, spans.hit(arr((30, 75)), arr(), 0.3)) is False
    assert value(spark, spans.complete(arr((0, 45)), arr((0, 45), (100, 145)), 0.3)) is False


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 40)), max_size=6))
def test_merge_property(spark, items):
    pairs = [(a, a + n) for a, n in items]
    got = [(x.start, x.end) for x in value(spark, spans.merge_spans(arr(*pairs)))]
    want: list[list[float]] = []
    for a, b in sorted(pairs):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert got == [tuple(map(float, x)) for x in want]


def test_text_functions(spark):
    assert value(spark, text.strip(F.lit(" \t\na b \n"))) == "a b"
    assert value(spark, text.timestamp_seconds(F.lit("01:02:03.500"))) == 3723.5
    assert value(spark, text.timestamp_seconds(F.lit("1:02:03.500"))) is None
    assert value(spark, text.mm_ss(F.lit(59.99))) == "00:59"
    assert value(spark, text.mm_ss(F.lit(4800.0))) == "80:00"
    assert value(spark, text.chunk_id(F.lit("v"), F.lit(7))) == "v_chunk_007"
    assert value(spark, text.youtube_id(F.lit(None).cast("string"), F.lit("https://x/watch?v=abc&t=3"))) == "abc"
    assert value(spark, text.youtube_id(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ""
    assert value(spark, text.half_even(F.lit(2.5), 0)) == 2.0
    assert value(spark, text.concept_hits(F.array(F.lit("Big-O"), F.lit("zz"), F.lit("")), F.lit("the big o notation"))) == 2
    assert value(spark, text.signed(F.lit(0.0641))) == "+0.064"
    assert value(spark, text.percent(F.lit(1), F.lit(0))) == 100.0
    assert value(spark, text.has_visual_mark(F.lit("x [frame caption: y]")))
    assert value(spark, text.answer_too_short(F.lit("one two")))
    assert value(spark, text.answer_in_question(F.lit("Two"), F.lit("is it two?")))


def parsed(spark, raw, n=3):
    return value(spark, parsing.parse_citations(F.lit(raw), F.lit(n)))


def test_citation_parsing(spark):
    ok = parsed(spark, '```json\n{"answer": "a", "citations": [1, 3, 1]}\n```')
    assert ok.answer == "a" and ok.indices == [1, 3, 1] and ok.error is None
    assert parsed(spark, '{"answer": "a", "citations": [0]}').error == "citation out of range"
    assert parsed(spark, '{"answer": "a", "citations": [4]}').error == "citation out of range"
    assert parsed(spark, '{"answer": "a", "citations": ["x"]}').error == "citation out of range"
    assert parsed(spark, '{"answer": "a", "citations": 1}').error == "citations must be a list"
    assert parsed(spark, '{"citations": []}').error == "missing answer"
    assert parsed(spark, '{"answer": "a"}').error == "missing citations"
    assert parsed(spark, "no json").error == "not valid JSON"
    assert parsed(spark, r'{"answer": "\(x\)", "citations": []}').answer == r"\(x\)"


def judged(spark, raw):
    return value(spark, parsing.parse_judge(F.lit(raw)))


def test_judge_cascade(spark):
    assert tuple(judged(spark, '{"C1": 5, "C2": 4, "C3": 3, "aggregate": 4}')) == (5, 4, 3, 4)
    assert tuple(judged(spark, "{C1: 5, C2: 4, C3: 3, aggregate: 4}")) == (5, 4, 3, 4)
    assert tuple(judged(spark, "C1: 5 C2: 3.0 C3: 45 aggregate: 1")) == (5, 3, 4, 1)
    assert judged(spark, '{"C1": 9}') is None
    assert judged(spark, "") is None


def test_score_review_keys(spark):
    assert value(spark, parsing.parse_score(F.lit("Score: 3/4"))) == 0.75
    assert value(spark, parsing.parse_score(F.lit("Score: 5/4"))) is None
    assert value(spark, parsing.parse_score(F.lit("Score: 0/0"))) is None
    bad = value(spark, parsing.parse_review(F.lit("hm")))
    assert bad.overall == "REJECT" and bad.criterion_2.reason == "parse error"
    good = value(spark, parsing.parse_review(F.lit('x {"overall": "ACCEPT", "criterion_1": {"result": "FAIL", "reason": "r"}} y')))
    assert good.overall == "ACCEPT" and good.criterion_1.result == "FAIL"
    assert value(spark, parsing.missing_keys(F.lit('{"a": null}'), ("a", "b"))) == ["b"]
    assert value(spark, parsing.bracketed(F.lit("a [1] b [2] c"), "[", "]")) == "[1] b [2]"
    assert value(spark, parsing.bracketed(F.lit("] a ["), "[", "]")) is None


def test_text_metrics(spark):
    assert textmetrics.bleu_value("a b c d e", "a b c d e") == pytest.approx(1.0)
    assert textmetrics.bleu_value("a b", "") == 0 and textmetrics.bleu_value("a b", "x y") == 0
    assert textmetrics.bleu_value("the cat sat on the mat", "the cat sat") == pytest.approx(math.exp(-1) * (0.1) ** 0.25)
    assert textmetrics.lcs_length(list("abcbdab"), list("bdcaba")) == 4
    assert textmetrics.rouge_l_value("the cats sat", "the cat sat") == pytest.approx(1.0)
    assert textmetrics.meteor_value("a b c d", "a b c d") == pytest.approx(1 - 0.5 / 64)
    assert textmetrics.meteor_value("a", "z") == 0
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "effective": "effect", "probate": "probat", "rate": "rate", "controlling": "control", "sky": "sky"}
    assert {w: textmetrics.porter_stem(w) for w in words} == words


def test_rounding_is_that_of_the_binary_value(spark):
    import random

    from cuespan.functions.text import half_even

    rng = random.Random(5)
    values = [2.675, 0.28535, 0.15, 0.35, 12.35, 0.0005, 0.25, 0.125, 2.5, -2.675, -0.04, 0.0, 1e15 + 0.5, 2.0**52 + 1, 2.0**52 - 0.5, 4503599627370.4975, 9007199254740.993, 1e300, -1e22]
    values += [k / 2000 for k in range(3001)] + [k / 20000 for k in range(4001)]  # next to halves
    values += [rng.uniform(-1, 1) * 10 ** rng.uniform(-8, 16) for _ in range(300_000)] + [rng.random() for _ in range(100_000)]
    values += [rng.getrandbits(53) / 8000 for _ in range(50_000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", *[half_even(F.col("x"), n).alias(f"d{n}") for n in (0, 1, 3, 4)]).toPandas()
    for n in (0, 1, 3, 4):
        wrong = [(x, y) for x, y in zip(rows["x"].tolist(), rows[f"d{n}"].tolist(), strict=True) if round(x, n) != y]
        assert not wrong, (n, wrong[:5])
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),)], "x double").select(half_even(F.col("x"), 3).alias("y")).collect()
    assert odd[0].y is None and odd[1].y == float("inf") and odd[2].y != odd[2].y


def brute_meteor(ref, hyp, sets):
    """Stage by stage with nested loops from the end, as the published scorer does."""
    h, r, matches = list(enumerate(textmetrics.tokens(hyp))), list(enumerate(textmetrics.tokens(ref))), []
    none = frozenset()
    for same in (lambda a, b: a == b, lambda a, b: textmetrics.porter_stem(a) == textmetrics.porter_stem(b), lambda a, b: bool(sets.get(a, none) & sets.get(b, none))):
        for i in range(len(h) - 1, -1, -1):
            for j in range(len(r) - 1, -1, -1):
                if same(h[i][1], r[j][1]):
                    matches.append((h[i][0], r[j][0]))
                    h.pop(i)
                    r.pop(j)
                    break
    if not matches:
        return 0.0
    m, matches = len(matches), sorted(matches)
    p, q = m / len(textmetrics.tokens(hyp)), m / len(textmetrics.tokens(ref))
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(matches, matches[1:], strict=False))
    return p * q / (0.9 * p + 0.1 * q) * (1 - 0.5 * (chunks / m) ** 3)


def test_meteor_with_a_lexicon(spark):
    import random

    rng = random.Random(6)
    words = ["car", "auto", "cars", "runs", "running", "quick", "fast", "swift", "the", "a", "."]
    sets = {"car": {"1"}, "auto": {"1"}, "quick": {"2", "3"}, "fast": {"2"}, "swift": {"3"}}
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
    rows = [(i, line(), line()) for i in range(300)] + [(1000, None, "a"), (1001, "The CAR .", "the auto .")]
    pairs = spark.createDataFrame(rows, "k int, reference string, answer string").repartition(3)
    lexicon = spark.createDataFrame([(w.upper(), s) for w, x in sets.items() for s in x] + [(None, "9"), ("x", None)], "word string, set_id string")
    got = {r.k: r.meteor for r in textmetrics.with_meteor(pairs, lexicon, ["k"]).collect()}
    for k, a, b in rows:
        assert got[k] == pytest.approx(brute_meteor(a or "", b or "", {w: frozenset(x) for w, x in sets.items()}))
    assert got[1001] > textmetrics.meteor_value("The CAR .", "the auto .")
    none = {r.k: r.meteor for r in textmetrics.with_meteor(pairs, lexicon.limit(0), ["k"]).collect()}
    assert all(none[k] == pytest.approx(textmetrics.meteor_value(a or "", b or "")) for k, a, b in rows)
