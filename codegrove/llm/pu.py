"""Non-negative positive-unlabelled text classifiers.

A model is learnt from trusted positives and unlabelled texts alone: it minimises
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) with the logistic loss, so its scores estimate
the probability of label 1. Rows of label 0 are never looked at. The class prior pi is
estimated from positives and unlabelled texts too: models learnt on parts of them
rank the other parts, and pi is the least ratio, over all thresholds, of the share of
unlabelled texts above a threshold to the share of positives above it, at the threshold
where that ratio is smallest once both shares are moved by their standard errors.

A text is described by piecewise-constant functions of some twenty surface statistics and
by the presence of words that positives hold significantly more or less often than
unlabelled texts. Statistics and words come from the whole text.

The fitting sample is at most `sample` positives and `sample` unlabelled documents, those
whose XXH64 of doc_id is smallest, one text of each; features are computed on the
executors, and what reaches the driver is bounded by the sample, BINS and MAX_WORDS.
Scoring maps every document.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codegrove.llm.common import materialize

SAMPLE = 10_000
#: Quantiles of a statistic at which its bins end. A value that falls on several is in the lowest bin, so what few texts have at all is told from what none has.
QUANTILES = (0.02, 0.05, *(k / 12 for k in range(1, 12)), 0.95, 0.98, 0.99)
BINS = len(QUANTILES) + 1
MAX_WORDS = 1024
#: A word is a feature if its share among positives is so many standard errors off.
MIN_Z = 6.0
ROUNDS = 600
#: Weight decay times the number of positives, and rounds, of the models that only rank for the prior: smoother than the final model, as they learn from half of the sample.
RANK_STRENGTH, RANK_ROUNDS = 10.0, 150
LEAST_POSITIVES = 20
#: A tail holds such a share of the positives at least.
LEAST_TAIL = 0.1
_WORD = re.compile(r"[^\W\d_]+")


def statistics(text: str) -> tuple[np.ndarray, set[str]]:
    """Surface statistics of a text, and its distinct lower-case words."""
    n = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    words = _WORD.findall(text.lower())
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    size, tokens = max(1, int(n.sum())), text.split()
    per, of = lambda x: x / size, lambda x: x / max(1, len(words))
    upper, lower, digit, space = n[65:91].sum(), n[97:123].sum(), n[48:58].sum(), n[9:14].sum() + n[32]
    marks = n[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    symbol = n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum() - marks
    same = sum(a == b for a, b in zip(words, words[1:]))
    most = max(Counter(words).values(), default=0)
    return np.array([
        np.log1p(size), np.log1p(len(words)), np.log1p(len(lines)), per(upper), per(lower), per(digit), per(space), per(marks), per(symbol), per(n[128:].sum()),
        per(n[124]), per(n[[35, 36, 37, 38, 42]].sum()), per(n[33]), per(n[[60, 62, 91, 93, 123, 125]].sum()), per(n[[47, 64, 58]].sum()), per(n[:9].sum() + n[14:32].sum()),
        np.log1p(symbol), np.log1p(upper), of(len(distinct)), of(same), of(most), len(tokens) / max(1, len(lines)), of(sum(map(len, words))),
        1 - len(set(lines)) / max(1, len(lines)), of(len(tokens)),
    ], dtype=np.float32), distinct


@dataclass
class Model:
    edges: np.ndarray  # (statistics, BINS - 1)
    words: dict[str, int]
    weights: np.ndarray  # statistics * BINS, then words
    bias: float
    prior: float

    def columns(self, stats: np.ndarray, words) -> list[int]:
        at = [k * BINS + int(np.searchsorted(e, x, side="left")) for k, (e, x) in enumerate(zip(self.edges, stats))]
        return at + [len(self.edges) * BINS + self.words[w] for w in words if w in self.words]

    def score(self, text: str) -> float:
        if not self.prior:
            return 0.0
        z = self.bias + float(self.weights[self.columns(*statistics(text))].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """pi * R_p(+), the estimate R_u(-) - pi * R_p(-) of the risk on negatives, and the gradients of the two. w: weights, then the bias."""
    narrow = w[:-1].astype(positive.dtype)  # products of one type: the matrices are not copied
    zp, zu = ((x @ narrow).astype(np.float64) + w[-1] for x in (positive, unlabelled))
    loss = lambda z: np.logaddexp(0, z).mean()  # noqa: E731  logistic, of a negative label at score z
    on = lambda g, x: np.r_[g.astype(x.dtype) @ x, g.sum()]
    sp = _sigmoid(zp) / len(zp)
    of_positives = on(sp, positive)
    return prior * loss(-zp), loss(zu) - prior * loss(zp), prior * (of_positives - on(np.full(len(zp), 1 / len(zp)), positive)), on(_sigmoid(zu) / len(zu), unlabelled) - prior * of_positives


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS, decay: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (Adam, full batches). Where the risk on negatives is estimated below zero, a step goes up that estimate."""
    w = np.zeros(positive.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, negative, up, down = risk(w, positive, unlabelled, prior)
        g = (up + down if negative >= 0 else -down) + np.r_[decay * w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def tail_ratio(positive: np.ndarray, unlabelled: np.ndarray, errors: float = 2.0) -> float:
    """The prior as a ratio of upper tails of two sets of scores, at the tail where the ratio is smallest with both shares moved by so many standard errors."""
    cuts = np.unique(positive)

    def above(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x) - np.searchsorted(np.sort(x), cuts, side="left")
        share = (n + 1) / (len(x) + 2)
        return n / len(x), np.sqrt(share * (1 - share) / (len(x) + 2))

    (p, p_error), (u, u_error) = above(positive), above(unlabelled)
    low = p - errors * p_error
    best = int(np.argmin(np.where((low > 0) & (p >= LEAST_TAIL), (u + errors * u_error) / np.where(low > 0, low, 1), np.inf)))
    return float(u[best] / p[best])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, at least one in a thousand and at most all but that.

    Each part of both is ranked by a model of the other parts; a positive's place is the share
    of its part's unlabelled rows that it surpasses. With fewer than LEAST_POSITIVES, which tell
    nothing reliable, the share of positives in the sample.
    """
    sizes = len(positive), len(unlabelled)
    if min(sizes) < LEAST_POSITIVES:
        return float(np.clip(sizes[0] / sum(sizes), 1e-3, 1 - 1e-3))
    parts = 5 if sizes[0] < 1000 else 2
    places, ranks = [], []
    for part in range(parts):
        own = [np.arange(n) % parts == part for n in sizes]
        w, b = minimise(positive[~own[0]], unlabelled[~own[1]], 0.5, RANK_ROUNDS, RANK_STRENGTH / sizes[0])
        p, u = (x[k] @ w.astype(x.dtype) + b for x, k in zip((positive, unlabelled), own))
        u = np.sort(u)
        for scores, out in ((p, places), (u, ranks)):
            out.append(np.searchsorted(u, scores, side="left") / len(u))
    return float(np.clip(tail_ratio(np.concatenate(places), np.concatenate(ranks)), 1e-3, 1 - 1e-3))


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def fit(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sample: int = SAMPLE, prior: float | None = None, strength: float = 1.0) -> Model:
    """Learn from the rows of labels and docs whose remainder is not held. Null ids and labels are skipped; a document with several labels is positive if one of them is 1, and of rows that share a doc_id the smallest text is learnt from. strength: weight decay times the number of positives."""
    ids = F.col("doc_id")
    positives = labels.where(ids.isNotNull() & (F.col(label).cast("int") == 1) & (remainder(ids, folds) != held)).select(ids.cast("long").alias("doc_id")).distinct()
    texts = docs.select(ids.cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(ids.isNotNull() & (remainder(ids, folds) != held))
    nothing = Model(np.zeros((0, BINS - 1)), {}, np.zeros(0), 0.0, 0.0)

    first = lambda rows: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = first(positives).withColumn("role", F.lit(1)).union(first(texts.select("doc_id").distinct()).withColumn("role", F.lit(0)))

    def describe(batches):
        for b in batches:
            stats, words = zip(*(statistics(t.as_py()) for t in b.column("text"))) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("role"), pa.array([s.tolist() for s in stats], pa.list_(pa.float32())), pa.array([sorted(w) for w in words], pa.list_(pa.string()))], names=["role", "stats", "words"]
            )

    # at most 2 * sample ids, so their broadcast is bounded
    learnt = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "role").agg(F.min("text").alias("text"))
    described = materialize(learnt.select("role", "text").mapInArrow(describe, "role int, stats array<float>, words array<string>"), "described")
    sizes = {r.role: r["count"] for r in described.groupBy("role").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return nothing
    p, u = F.col("p") / sizes[1], (F.col("u") + 1) / (sizes[0] + 2)
    seen = described.select("role", F.explode("words").alias("word")).groupBy("word").agg(F.sum("role").alias("p"), F.sum(1 - F.col("role")).alias("u"))
    z = F.abs(p - u) / F.sqrt(u * (1 - u) * (1 / sizes[1] + 1 / sizes[0]))
    top = seen.where("p + u >= 8").withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(MAX_WORDS)
    words = {r.word: k for k, r in enumerate(top.collect())}
    rows = described.select("role", "stats", F.array_intersect("words", F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")).alias("words")).toArrow()

    roles, stats = np.array(rows["role"].to_pylist()), np.array(rows["stats"].to_pylist(), dtype=np.float32)
    edges = np.quantile(stats, QUANTILES, axis=0).T.astype(np.float32)
    model = Model(edges, words, np.zeros(0), 0.0, 0.0)
    x = np.zeros((len(roles), len(edges) * BINS + len(words)), dtype=np.float32)
    for i, (s, w) in enumerate(zip(stats, rows["words"].to_pylist())):
        x[i, model.columns(s, w)] = 1
    positive, unlabelled, decay = x[roles == 1], x[roles == 0], strength / sizes[1]
    del x
    model.prior = prior or estimate_prior(positive, unlabelled)
    model.weights, model.bias = minimise(positive, unlabelled, model.prior, decay=decay)
    return model


def score(text: Column, model: Model) -> Column:
    """The score of a text column; only that column passes through Python. Null counts as empty."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py() or "") for t in texts], pa.float64())

    return scores(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, threshold: float = 0.3, sample: int = SAMPLE, strength: float = 1.0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null texts count as empty and are scored like any text; rows with a null or repeated
    doc_id are scored each by its own text. Without a positive to learn from, every score
    is 0. An empty table gives an empty result; columns besides doc_id and text are not read.
    """
    model = fit(docs, labels, label, folds, held, sample, strength=strength)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
