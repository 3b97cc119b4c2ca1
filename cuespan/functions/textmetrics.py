"""Text-similarity scores as Arrow UDFs over pairs.

Tokens are runs of word characters and single marks, lower-cased; the stemmer is Porter's
(1980). METEOR has the exact and the stem stage, and with a lexicon, given as a table of words
and the sets they are in, the synonym stage; none is available offline, so values without it
are not comparable with those of a full METEOR. Matches are made greedily from the end, as in
the scorer that published values come from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+|[^\w\s]")
_ALNUM = re.compile(r"[a-z0-9]+")
EPSILON = 0.1  # smoothing of a zero n-gram count


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def bleu_value(ref: str, hyp: str) -> float:
    """Sentence BLEU-4; a zero n-gram count becomes EPSILON, no unigram match gives 0."""
    r, h = tokens(ref), tokens(hyp)
    if not h:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        have = Counter(zip(*[h[i:] for i in range(n)], strict=False))
        want = Counter(zip(*[r[i:] for i in range(n)], strict=False))
        match = sum((have & want).values())
        if n == 1 and match == 0:
            return 0.0
        logs += math.log((match or EPSILON) / max(1, sum(have.values())))
    brevity = 1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h))
    return brevity * math.exp(logs / 4)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one numpy row a token of the shorter side."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(a))}
    x = np.array([ids[w] for w in a])
    row = np.zeros(len(a) + 1, np.int64)
    for w in b:
        take = np.where(x == ids.get(w, -1), row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(take)
    return int(row[-1])


_VOWELS = set("aeiou")


def _is_consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return True if w[i] != "y" or i == 0 else not _is_consonant(w, i - 1)


def _measure(stem: str) -> int:
    kinds = ["c" if _is_consonant(stem, i) else "v" for i in range(len(stem))]
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(not _is_consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _is_consonant(w, n - 3) and not _is_consonant(w, n - 2) and _is_consonant(w, n - 1) and w[-1] not in "wxy"


# Suffix tables of the published algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(w: str, table: dict[str, str], least: int) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + table[end] if _measure(stem) > least else w
    return w


@lru_cache(100_000)
def porter_stem(word: str) -> str:
    """Porter's stemmer."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((e for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2, 0), _STEP3, 0)
    ends = sorted([*_STEP4, "ion"], key=len, reverse=True)
    end = next((e for e in ends if w.endswith(e)), None)
    if end:
        stem = w[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _stems(text: str) -> list[str]:
    return [porter_stem(w) if len(w) > 3 else w for w in _ALNUM.findall(text.lower())]


def rouge_l_value(ref: str, hyp: str, stem: bool = True) -> float:
    """F-measure of the longest common subsequence."""
    a, b = (_stems(ref), _stems(hyp)) if stem else (_ALNUM.findall(ref.lower()), _ALNUM.findall(hyp.lower()))
    if not a or not b:
        return 0.0
    n = lcs_length(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


def meteor_value(ref: str, hyp: str, sets: dict[str, frozenset] | None = None, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Exact, then stem matches, then words that share one of their ``sets``, each greedily from
    the end, with the chunk penalty."""
    r, h = tokens(ref), tokens(hyp)
    if not h or not r:
        return 0.0
    pairs: list[tuple[int, int]] = []
    left_h, left_r = list(enumerate(h)), list(enumerate(r))
    for form in (str, porter_stem):
        where: dict[str, list[int]] = {}
        for i, w in left_r:
            where.setdefault(form(w), []).append(i)
        rest = []
        for i, w in reversed(left_h):
            at = where.get(form(w))
            if at:
                pairs.append((i, at.pop()))
            else:
                rest.append((i, w))
        used = {j for _, j in pairs}
        left_h, left_r = rest[::-1], [(i, w) for i, w in left_r if i not in used]
    for i, w in reversed(left_h) if sets else ():
        mine = sets.get(w, frozenset())
        at = next((k for k in range(len(left_r) - 1, -1, -1) if mine & sets.get(left_r[k][1], frozenset())), None)
        if at is not None:
            pairs.append((i, left_r.pop(at)[0]))
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum((b[0] - a[0], b[1] - a[1]) != (1, 1) for a, b in zip(pairs, pairs[1:], strict=False))
    m = len(pairs)
    p, q = m / len(h), m / len(r)
    mean = p * q / (alpha * p + (1 - alpha) * q)
    return mean * (1 - gamma * (chunks / m) ** beta)


def _scored(value: Callable[[str, str], float], ref: Column, hyp: Column) -> Column:
    def run(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([value(a or "", b or "") for a, b in zip(r, h, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(ref, hyp)


def bleu(ref: Column, hyp: Column) -> Column:
    return _scored(bleu_value, ref, hyp)


def rouge_l(ref: Column, hyp: Column) -> Column:
    return _scored(rouge_l_value, ref, hyp)


def rouge_l_plain(ref: Column, hyp: Column) -> Column:
    return _scored(lambda a, b: rouge_l_value(a, b, stem=False), ref, hyp)


def meteor(ref: Column, hyp: Column) -> Column:
    return _scored(meteor_value, ref, hyp)


def with_meteor(pairs: DataFrame, lexicon: DataFrame, keys: list[str], ref: str = "reference", hyp: str = "answer", to: str = "meteor") -> DataFrame:
    """``pairs``, of which ``keys`` are unique, with METEOR by a lexicon (word, set_id): the words
    of a pair are joined with it, so a task holds the sets of its pairs' words and no lexicon."""

    def distinct(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sorted({*tokens(x or ""), *tokens(y or "")}) for x, y in zip(a, b, strict=True)])

    def score(a: pd.Series, b: pd.Series, known: pd.Series) -> pd.Series:
        each = ({} if k is None else {x["word"]: frozenset(x["sets"]) for x in k} for k in known)
        return pd.Series([meteor_value(x or "", y or "", sets) for x, y, sets in zip(a, b, each, strict=True)], dtype="float64")

    words = pairs.select(*keys, F.explode(F.pandas_udf(distinct, "array<string>")(ref, hyp)).alias("word"))
    sets = lexicon.filter("word is not null and set_id is not null").groupBy(F.lower("word").alias("word")).agg(F.collect_set(F.col("set_id").cast("string")).alias("sets"))
    known = words.join(sets, "word").groupBy(*keys).agg(F.collect_list(F.struct("word", "sets")).alias("_known"))
    scored = pairs.join(known, keys, "left")
    return scored.withColumn(to, F.pandas_udf(score, "double")(ref, hyp, "_known")).drop("_known")
