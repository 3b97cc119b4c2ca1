"""Operator 7: a quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a logistic scorer under the non-negative
unbiased risk ``prior * R+(f) + max(0, Ru-(f) - prior * R-(f))`` (Kiryo et al. 2017): where
the part in the maximum turns negative in a batch, the step goes against it. Labelled
negatives are not used, neither for the fit nor for what follows:

* The class prior is estimated from scores of positives and unlabelled text that a first
  scorer has not seen: the least ratio of their shares above a threshold, each with its
  confidence bound (best bin estimation, Garg et al. 2021).
* The logistic calibration that turns scores into probabilities minimises the unbiased
  risk too, on rows apart from those of the fit.

Features are computed on the executors over whole texts: rates of character classes and
of their pairs, repetition of words and lines, word lengths. The driver gets a bounded
sample of feature vectors only (``max_positives``, ``max_unlabelled`` rows, chosen by a hash
of the id); model and scores never see labels, lang, source or doc_id as inputs.

Defined edge cases: null and empty texts have the features of an empty text, and so one
score; without positives among the training rows every score is the prior, 0.5; null labels
are no labels; repeated rows score alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_fold, some_rows, table, unit_hash

FOLDS = 4
HELD_OUT = 2
KEEP_AT = 0.7
BLOCK = 1 << 20


def _classes() -> np.ndarray:
    """A class for each byte; marks that junk is made of get one each."""
    out = np.zeros(256, np.int64)
    out[128:] = 1
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!?", "|", "#*$%&<>^~=+_\\/{}[]", ":;'\"()-", "@"]
    for k, chars in enumerate(groups):
        for c in chars:
            out[ord(c)] = k + 2
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
N_FEATURES = N_CLASSES + N_CLASSES**2 + 7


def features(text: str | None) -> np.ndarray:
    """The feature vector of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    x = CLASSES[np.frombuffer(raw, np.uint8)] if len(raw) <= BLOCK else None
    single, pair = np.zeros(N_CLASSES), np.zeros(N_CLASSES**2)
    for at in range(0, len(raw), BLOCK):
        part = x if x is not None else CLASSES[np.frombuffer(raw[at : at + BLOCK + 1], np.uint8)]
        single += np.bincount(part[:BLOCK], minlength=N_CLASSES)
        pair += np.bincount(part[:-1] * N_CLASSES + part[1:], minlength=N_CLASSES**2)
    words = raw.split()
    lines = [s for s in (line.strip() for line in raw.split(b"\n")) if s]
    n, m = len(words), len(lines)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    shape = [
        np.log1p(n),
        len(raw) / max(n, 1) / 10,
        len(set(words)) / np.sqrt(max(n, 1)),
        1 - len(set(lines)) / max(m, 1),
        same / max(n, 1),
        1 - pairs / max(n - 1, 1) if n > 1 else 0.0,
        float(np.log1p(n / max(m, 1))),
    ]
    rate = lambda c: np.log1p(200 * c / max(len(raw), 1))
    return np.concatenate([rate(single), rate(pair), shape]).astype(np.float32)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    usable: bool = True

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def risk(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the unbiased logistic risk, ``prior * R+`` and ``Ru- - prior * R-``, and
    their gradients; rows of ``xp`` and ``xu`` end in a one."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    xp, xu = xp.astype(np.float64), xu.astype(np.float64)
    zp, zu = xp @ theta, xu @ theta
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_pos = -prior * ((1 - sig(zp))[:, None] * xp).mean(axis=0)
    g_neg = (sig(zu)[:, None] * xu).mean(axis=0) - prior * (sig(zp)[:, None] * xp).mean(axis=0)
    return float(positive), float(negative), g_pos, g_neg


def step_direction(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the risk, or, where its second part is negative, the way back from that."""
    _, negative, g_pos, g_neg = risk(theta, xp, xu, prior)
    return g_pos + g_neg if negative >= 0 else -g_neg


def nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 60, batch: int = 256, rate: float = 0.02, l2: float = 1e-4, seed: int = 5) -> QualityModel:
    """Minimise the non-negative risk of a linear scorer with logistic loss (Adam steps)."""
    rng = np.random.default_rng(seed)
    mean = unl.mean(axis=0, dtype=np.float64)
    scale = unl.std(axis=0, dtype=np.float64) + 0.05

    def with_one(x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), x.shape[1] + 1), np.float32)
        for at in range(0, len(x), 1024):  # the driver holds one copy, in single precision
            out[at : at + 1024, :-1] = np.clip((x[at : at + 1024] - mean) / scale, -8, 8)
        return out

    p, u = with_one(pos), with_one(unl)
    theta = np.zeros(p.shape[1])
    m, v, t = np.zeros(len(theta)), np.zeros(len(theta)), 0
    steps = max(1, len(u) // batch)
    for _ in range(epochs):
        for ub in np.array_split(rng.permutation(len(u)), steps):
            pb = rng.choice(len(p), min(len(p), batch), replace=False)
            g = step_direction(theta, p[pb], u[ub], prior) + l2 * theta
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return QualityModel(mean, scale, theta[:-1], float(theta[-1]), prior)


def positive_share(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores that the scorer was not fitted on.

    Above any threshold there are at least share * (positives' rate) of the unlabelled, with
    equality where no negative scores that high: the threshold with the least upper bound
    of the ratio is taken."""
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    p, u = np.sort(p), np.sort(u)
    at = np.unique(p)
    rate_p = 1 - np.searchsorted(p, at) / len(p)
    rate_u = 1 - np.searchsorted(u, at) / len(u)
    best = int(np.argmin((rate_u + slack) / rate_p))
    return float(np.clip(rate_u[best] / rate_p[best], 0.02, 0.98))


def calibrate(model: QualityModel, pos: np.ndarray, unl: np.ndarray, steps: int = 200) -> None:
    """Slope and shift of least unbiased logistic risk, which is convex in them: Newton steps,
    with a weak pull to slope 1."""
    if len(pos) < 10 or len(unl) < 10:
        return
    zu, gain = model.raw(unl), model.prior * np.array([model.raw(pos).mean(), 1.0])
    a, b = 1.0, 0.0
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(a * zu + b, -30, 30)))
        r = s * (1 - s) + 1e-9
        g = np.array([(s * zu).mean() - gain[0] + 1e-3 * (a - 1), s.mean() - gain[1] + 1e-3 * b])
        h = np.array([[(r * zu * zu).mean() + 1e-3, (r * zu).mean()], [(r * zu).mean(), r.mean() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - 0.5 * d[0], b - 0.5 * d[1]
    model.slope, model.shift = max(float(a), 1e-3), float(b)


def learn(pos: np.ndarray, unl: np.ndarray) -> QualityModel:
    """Prior, scorer and calibration. Rows take turns: of three, two fit and one checks."""
    check_p, check_u = np.arange(len(pos)) % 3 == 2, np.arange(len(unl)) % 3 == 2
    if check_p.sum() < 10 or check_u.sum() < 10:  # too few to part
        check_p, check_u = np.ones(len(pos), bool), np.ones(len(unl), bool)
        fit_p, fit_u = check_p, check_u
    else:
        fit_p, fit_u = ~check_p, ~check_u
    first = nnpu(pos[fit_p], unl[fit_u], 0.5, epochs=20)
    prior = positive_share(first.raw(pos[check_p]), first.raw(unl[check_u]))
    model = nnpu(pos[fit_p], unl[fit_u], prior)
    calibrate(model, pos[check_p], unl[check_u])
    return model


def vectors(docs: DataFrame, *keep: str) -> DataFrame:
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_rows(batches):
            found = pa.array([features(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [found], names=[*keep, "features"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, features binary")


def fit(docs: DataFrame, labels: DataFrame, max_positives: int = 9000, max_unlabelled: int = 18000, seed: int = 3) -> QualityModel:
    """Train on the folds that are not held out."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    good = marks.filter((F.col("y") == 1) & (id_fold(FOLDS) != HELD_OUT)).select(F.col("doc_id").alias("good_id")).withColumn("hash", unit_hash(seed, "good_id"))
    pool = docs.select("doc_id", "text").filter(id_fold(FOLDS) != HELD_OUT).withColumn("hash", unit_hash(seed + 1, "doc_id"))
    n_good, total = good.count(), pool.count()
    flat = QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5, usable=False)
    if not n_good or not total:
        return flat
    # the smallest hashes; the filter only spares the sort rows. Ids are chosen first: texts
    # stay where they are, and the tables of ids are bounded by the limits
    least = lambda df, most, of, name: df.filter(F.col("hash") < (2 * most + 40) / of).orderBy("hash", name).limit(most).select(F.col(name).alias("chosen"))
    some = least(good, max_positives, n_good, "good_id").withColumn("y", F.lit(1)).unionByName(least(pool.filter("doc_id is not null"), max_unlabelled, total, "doc_id").withColumn("y", F.lit(0)))
    sample = pool.join(F.broadcast(some), F.col("doc_id") == F.col("chosen")).select("doc_id", "text", "y")
    # ids may repeat: of their texts one stands for the id, the same in every run, so no more
    # rows reach the driver than ids were chosen
    got = vectors(sample, "doc_id", "y").groupBy("doc_id", "y").agg(F.min("features").alias("features")).toPandas()
    x = np.frombuffer(b"".join(got["features"]), np.float32).reshape(-1, N_FEATURES)
    y, ids = got["y"].to_numpy(), got["doc_id"].to_numpy()
    del got
    if not (y == 1).any():
        return flat
    order = np.lexsort((x[:, 0], ids, np.array([zlib.crc32(str(i).encode()) for i in ids])))  # whatever order the tasks came in
    x, y = x[order], y[order]
    return learn(x[y == 1], x[y == 0])


def score(docs: DataFrame, model: QualityModel, *keep: str) -> DataFrame:
    """``keep`` and the score of every whole text."""
    fields = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_rows(batches):
            x = np.array([features(t) for t in b.column("text").to_pylist()], dtype=np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(model.score(x))], names=[*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}score double")


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, "doc_id")
    return out.select("doc_id", (id_fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
