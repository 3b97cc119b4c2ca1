import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from cuespan.llm import filter_audit, merkle_manifest, suffix_dedup

from .conftest import odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(digests, fan=16):
    """Root and, for each leaf, the siblings of every level as (left, right)."""
    level, paths, at = list(digests), [[] for _ in digests], list(range(len(digests)))
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for leaf, p in enumerate(at):
            run = runs[p // fan]
            paths[leaf].append(("".join(run[: p % fan]), "".join(run[p % fan + 1 :])))
            at[leaf] = p // fan
        level = [h("".join(r)) for r in runs]
    return level[0], paths


def brute_manifest(rows):
    def leaf(r, text):
        fields = [r[0], r[3], r[2], r[4], text]
        return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups[r[3]].append((r[0] is None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].translate(LOWER) if hit and r[1] is not None else r[1])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort()
    trees = [brute_tree([x[2] for x in groups[s]]) for s in names]
    root, tops = brute_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for (no_id, i, digest, test), path in zip(groups[s], paths, strict=True):
            for left, right in path + top:
                test = h(left + test + right)
            out.append((None if no_id else i, digest, subroot, root, h("".join(a + b for a, b in path + top)), test, test == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_by_brute_force(spark, height):
    rng = random.Random(height)
    size = {"a": 600, "b": 257, "é": 1, None: 17, "": 16, "z": 16**2}
    rows = [(i, rng.choice([None, "", "Some Text", "lower", "Ünï"]) if i % 3 else f"Text {i}", "en", s, i % 7) for i, s in enumerate(s for s, n in size.items() for _ in range(n))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = merkle_manifest.manifest(merkle_manifest.document_leaves(docs), height).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)


def test_manifest_odd_and_empty(spark, odd, empty):
    got = sorted((tuple(r) for r in merkle_manifest.manifest(merkle_manifest.document_leaves(odd)).collect()), key=repr)
    assert got == brute_manifest([r[:5] for r in odd_rows()])
    assert merkle_manifest.manifest(merkle_manifest.document_leaves(empty)).count() == 0


def test_manifest_of_many_sources(spark):
    rows = [(i, "T", "en", f"s{i % 300}", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle_manifest.manifest(merkle_manifest.document_leaves(docs), 1).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)


# --- operator 12 -----------------------------------------------------------------------


@pytest.mark.parametrize("letters", [1, 2, 4, 255])
def test_suffix_array_and_prefixes(letters):
    rng = random.Random(letters)
    for _ in range(60):
        n = rng.randint(1, 150)
        data = np.array([rng.randint(0, letters) for _ in range(n)], np.uint8)
        raw = data.tobytes()
        sa = suffix_dedup.suffix_array(data)
        assert sa.tolist() == [n, *sorted(range(n), key=lambda i: raw[i:])]
        found = suffix_dedup.permuted_prefixes(data, sa, np.zeros(n, bool), n)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            same = 0
            while max(i, j) + same < n and raw[i + same] == raw[j + same]:
                same += 1
            assert found[i] == same


def brute_strings(rows, length):
    """Rows equal in id and text are one document; one id's texts come in any fixed order."""
    order = sorted(set((r[0] is None, r[0] or 0, r[1] or "") for r in rows))
    seen, out = set(), {}
    for key in order:
        raw = key[2].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[key] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(raw, gone, strict=True) if not x)).hexdigest())
    return sorted(((r[0], *out[r[0] is None, r[0] or 0, r[1] or ""]) for r in rows), key=repr)


def removed(docs, **how):
    got = suffix_dedup.dedup_strings(docs, **how).collect()
    for r in got:
        assert r.n_bytes - len(r.kept) == sum(s["size"] for s in r.spans)
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=repr)


def planted():
    rng = random.Random(3)
    w = lambda n: "".join(rng.choice("ab") for _ in range(n))
    texts = [None, "", "a" * 5000, "a" * 99, "a" * 100, "ab" * 400, "ba" * 60, w(300) * 3, w(30) * 20, "é" * 300, "\x00" * 500, "x" * 50 + "\x00" * 120, w(40) + "a" * 150]
    passage, page = w(150), w(700)
    texts += [w(30) + passage + w(30) for _ in range(30)] + [page, page, page[:400] + "!" + page[400:], w(20) + page]
    return list(enumerate(texts)) + [(None, page), (2, "a" * 5000)]


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 500}, {"gram": 60}, {"length": 20, "gram": 7}])
def test_strings_by_brute_force(spark, how):
    docs = spark.createDataFrame(planted(), "doc_id long, text string").repartition(3)
    assert removed(docs, **how) == brute_strings(planted(), how.get("length", 100))


def test_chunks_and_batches_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame(planted(), "doc_id long, text string").coalesce(1)
    raw, off = suffix_dedup.batch_bytes(__import__("pyarrow").array([(t or "").encode() for _, t in planted()], "binary"))
    whole = suffix_dedup.batch_segments(raw, off, 100, 24)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 333)
    cut = suffix_dedup.batch_segments(raw, off, 100, 24)
    strings = lambda x: sorted((s + i, a) for s, n, a in zip(*[c.tolist() for c in x[:3]], strict=True) for i in range(n))
    assert strings(whole) == strings(cut)
    assert len(removed(docs)) == len(planted())


def test_strings_odd_and_empty(spark, odd, empty):
    rows = [r[:2] for r in odd_rows()]
    assert removed(odd) == brute_strings(rows, 100)
    assert removed(empty) == []


# --- operator 13 -----------------------------------------------------------------------


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", 1 << 62), 1 << 62 if i is None else i)
    counts = defaultdict(lambda: [0, 0, 0])
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), (1 << 62 if i is None else i) > first[t]]
        key = (lang or "", "".join(c for c, x in zip("ABCDE", fails, strict=True) if x))
        marks = [x for x in labels if i is not None and x[0] == i]
        for k, add in enumerate((1, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks))):
            counts[key][k] += add
    out = []
    for part in {p for p, _ in counts}:
        mine = {f: c for (p, f), c in counts.items() if p == part}
        shapley = Counter()
        table = []
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                letter, before = order[step - 1], set(order[: step - 1])
                here = [c for f, c in mine.items() if letter in f and not before & set(f)]
                gone = sum(c[0] for c in here)
                shapley[letter] += gone
                kept = sum(c[0] for f, c in mine.items() if not (before | {letter}) & set(f))
                late = sum(c[0] for f, c in mine.items() if letter in f and before & set(f))
                table.append((part, order, step, kept, gone, late, mine.get(letter, [0])[0], sum(c[1] for c in here), sum(c[2] for c in here), letter))
        out += [(*r[:-1], shapley[r[-1]]) for r in table]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("how", [{}, {"block": 2, "growth": 2}, {"block": 1, "growth": 3}])
def test_audit_by_brute_force(spark, odd, empty, how):
    rows = [r[:3] for r in odd_rows()]
    labels = [(5, 1, 0), (6, 1, 1), (6, 0, None), (9, 1, 1), (100, 1, 1), (None, 1, 1), (4000, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(filter_audit.mask_counts(odd, marks, **how)).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, labels)
    assert filter_audit.interactions(filter_audit.mask_counts(empty, marks, **how)).count() == 0


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    rows = [(1, "aaaa"), (2, "bbbb"), (3, "aaaa"), (4, "bbbb"), (5, "cccc"), (6, "dd"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang")
    narrow = filter_audit.judged(docs)
    from pyspark.sql import functions as F

    same = narrow.withColumn("blocks", F.transform("blocks", lambda _: F.lit(0).cast("long")))  # every hash collides
    got = filter_audit.copies(docs, same).collect()
    assert sorted(r.id for r in got) == [3, 4, 8]


def test_blocks_cover_the_text_once(spark):
    from pyspark.sql import functions as F

    rows = [(n, "é" * n) for n in [0, 1, 2, 3, 7, 8, 9, 500, 511, 512, 513, 2560, 2561, 200_000]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block, growth in ((512, 4), (1, 2), (3, 3)):
        for r in docs.select("doc_id", F.size(filter_audit.block_hashes(F.col("text"), block, growth)).alias("n")).collect():
            need, reach = 0, 0
            while reach < r.doc_id:
                reach += block * growth**need
                need += 1
            assert r.n == need


def test_segments_that_share_an_anchor_and_no_string_stay_behind(spark):
    """A phrase of forty bytes in texts that differ around it makes no segment travel; a passage
    of 130 bytes does, and so does one with a letter's run, wherever its anchor lies."""
    rng = random.Random(12)
    w = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    phrase, passage, run = w(40), w(130), w(60) + "z" * 90 + w(60)
    plain = [(i, w(400) + phrase + w(400)) for i in range(40)]
    shared = [(100 + i, w(300) + (passage if i % 2 else run) + w(300)) for i in range(20)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rows = lambda docs: suffix_dedup.segment_rows(docs.select(*suffix_dedup._document(docs)), 100, 24)
    assert rows(df(plain)).count() == 0
    assert removed(df(plain + shared)) == brute_strings(plain + shared, 100)
    assert 0 < rows(df(plain + shared)).filter("id >= 100").count() and rows(df(plain + shared)).filter("id < 100").count() < 10


def test_side_keys_of_random_texts_by_brute_force(spark):
    rng = random.Random(13)
    blocks = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(blocks) for _ in range(rng.randint(1, 14)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for how in ({}, {"length": 31, "gram": 8}, {"length": 24, "gram": 24}):
        assert removed(docs, **how) == brute_strings(rows, how.get("length", 100))
