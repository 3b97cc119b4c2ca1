"""Operator 4: language identification with hashed subword embeddings.

Character n-grams of the lower-cased text are hashed into buckets; a document is the
average of their embeddings, and a linear softmax reads the language from it. Embeddings
and softmax are trained together by stochastic gradient descent in numpy, on a bounded
sample that the training folds give: ``per_language`` texts of each language there is, or an
equal share of ``max_rows`` where there are many, none over ``max_train_chars``. Executors
turn them into n-gram counts, and only these reach the driver. A temperature
fitted on texts set aside calibrates the score, and the smallest score at which the texts
set aside reach the target precision becomes the rejection threshold.

Prediction reads whole texts, in blocks of bounded size, and nothing but the text.

Defined edge cases: null texts and texts without a letter are ``und`` with score 0; with
no labelled training row every text is ``und``; null languages are not learned; repeated
rows get one answer; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_fold, materialize, some_rows, table, unit_hash

FOLDS = 5
HELD_OUT = 0
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
DIM = 16
BLOCK = 1 << 19
UND = "und"


def subwords(text: str, n_buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of all character n-grams of a text, block by block."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    overlap = max(ORDERS) - 1
    for at in range(0, max(1, len(x) - overlap), BLOCK):
        part = x[at : at + BLOCK + overlap]
        for n in ORDERS:
            h = np.full(max(0, min(BLOCK, len(part) - n + 1)), n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ part[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h % np.uint64(n_buckets)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    #: embeddings times softmax weights: a bucket's contribution to each logit
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for h in subwords(text, len(self.table)):
            if len(h):
                total += np.bincount(h, minlength=len(self.table)) @ self.table if len(h) > len(self.table) else self.table[h].sum(axis=0, dtype=np.float64)
                n += len(h)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UND, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(z.argmax())
        return self.languages[best], float(p[best] / p.sum())


def bag(text: str, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, and the share of each."""
    ids, n = np.unique(np.concatenate(list(subwords(text, n_buckets))), return_counts=True)
    return ids, (n / n.sum()).astype(np.float32)


def train(texts: list[str], langs: list[str], **how: float) -> LanguageModel:
    return train_bags([bag(t) for t in texts], langs, **how)


def train_bags(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 7, epochs: int = 12, rate: float = 20.0, target_precision: float = 0.995) -> LanguageModel:
    """Stochastic gradient descent over average embeddings and a linear softmax."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order[:0]
    fit = order[len(held) :]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            ids, w = rows[i]
            doc = w @ emb[ids]
            z = doc @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = soft @ p
            soft -= 0.05 * step * np.outer(doc, p)
            bias -= 0.001 * step * p
            emb[ids] -= (step * w)[:, None] * back[None, :]
    model = LanguageModel(names, emb @ soft, bias.astype(np.float64))
    if len(held):
        z = np.array([rows[i][1].astype(np.float64) @ model.table[rows[i][0]] + model.bias for i in held])
        gold = y[held]

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), gold]))

        model.temperature = float(min(np.geomspace(0.05, 20, 120), key=loss))
        s = z / model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        top, right = p.max(axis=1), p.argmax(axis=1) == gold
        rank = np.argsort(-top)
        good = np.cumsum(right[rank]) / np.arange(1, len(rank) + 1) >= target_precision
        model.threshold = float(top[rank][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def training_sample(docs: DataFrame, per_language: int = 1500, max_rows: int = 12_000, max_train_chars: int = 20_000, seed: int = 11) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Bags and languages of a bounded sample of labelled training rows. Every row's chance is
    a hash of its id below the share that its language needs, so no task sorts a language."""
    usable = docs.filter((id_fold(FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") > 0) & (F.length("text") <= max_train_chars)).select("doc_id", "text", "lang")
    counts = materialize(usable.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    n_languages = counts.count()
    if not n_languages:
        return [], []
    each = max(1, min(per_language, max_rows // n_languages))
    chosen = usable.join(counts, "lang").filter(unit_hash(seed, "doc_id") < F.lit(each) / F.col("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_rows(batches):
            bags = [bag(t) for t in b.column("text").to_pylist()]
            ids, shares = [x.astype("<u2").tobytes() for x, _ in bags], [w.astype("<f4").tobytes() for _, w in bags]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["doc_id", "lang", "ids", "shares"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chosen.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, ids binary, shares binary").collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, bytes(r.ids), bytes(r.shares)))
    return [(np.frombuffer(r.ids, "<u2").astype(np.int64), np.frombuffer(r.shares, "<f4")) for r in rows], [r.lang for r in rows]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, and rejected: the score is below the calibrated threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_rows(batches):
            found = [model.predict(t) for t in b.column("text").to_pylist()]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            off = [x == UND or s < model.threshold for x, s in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(off, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_bags(*training_sample(docs))
    return identify(docs, model).select("doc_id", (id_fold(FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
