"""Quality from weak labels.

Overlapping heuristic labellers call a text good or bad or abstain.
Expectation-maximisation over the counts of their vote patterns estimates how
accurate each of them is, without any true label, and with that the posterior of
every pattern. The posteriors of a sample then train a linear scorer over hashed
word features, which also judges texts on which the labellers abstain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAD, GOOD, ABSTAIN = 0, 1, 2
DIMENSIONS = 1 << 14
TOKEN_SCALE = 5.0

# Name, limits of the good range, limits outside which a text is bad. Between them the labeller abstains.
LABELLERS = (
    ("symbols per character", (0.0, 0.01), (0.0, 0.04)),
    ("capitals per letter", (0.0, 0.12), (0.0, 0.35)),
    ("exclamation marks per word", (0.0, 0.05), (0.0, 0.25)),
    ("bars per word", (0.0, 0.02), (0.0, 0.15)),
    ("bytes per word", (3.0, 8.0), (2.0, 11.0)),
    ("distinct lines per line", (0.9, 1.0), (0.5, 1.0)),
    ("words per sentence end", (3.0, 40.0), (1.0, 120.0)),
    ("distinct words per word", (0.3, 1.0), (0.1, 1.0)),
    ("words", (30.0, np.inf), (1.0, np.inf)),
)
SYMBOLS = np.frombuffer(b"#$%&*+<=>@[\\]^_`{}~|", np.uint8)


def measures(text: str | None) -> list[float]:
    """What the labellers look at, in their order; all zero for a text without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(LABELLERS)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    capitals, letters = seen[65:91].sum(), seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()
    lines = [x for x in raw.split(b"\n") if x]
    ends = seen[ord(".")] + seen[ord("?")] + seen[ord("!")]
    n = len(words)
    return [
        seen[SYMBOLS].sum() / len(raw), capitals / max(1, letters), seen[ord("!")] / n, seen[ord("|")] / n,
        sum(map(len, words)) / n, len(set(lines)) / len(lines), n / max(1, ends), len(set(words)) / n, n,
    ]


def votes(values: Sequence[float]) -> int:
    """The labellers' votes as one number, a base-three digit each."""
    code = 0
    for value, (_, (a, b), (low, high)) in zip(values, LABELLERS, strict=True):
        vote = GOOD if a <= value <= b else BAD if value < low or value > high else ABSTAIN
        code = 3 * code + vote
    return code


def digits(codes: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return np.stack([codes // 3 ** (n - 1 - k) % 3 for k in range(n)], axis=1)


def posteriors(codes: np.ndarray, counts: np.ndarray, rounds: int = 200, false_alarm: float = 0.002, trust: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each vote pattern, and each labeller's estimated accuracy.

    The first guess doubts every text with a bad vote: labellers that look for
    different faults rarely agree on a bad text, so a majority would hide it.
    For the same reason a good text is believed beforehand to be called bad with
    a chance of ``false_alarm``, and that belief weighs ``trust`` times as much as
    the rows; how often a labeller finds a bad text is free. They are taken as
    independent given the class; an abstention says nothing. A
    pattern of abstentions alone gets the share of good texts.
    """
    vote = digits(codes)
    good = np.where((vote == BAD).any(axis=1), 0.1, np.where((vote == GOOD).any(axis=1), 0.9, 0.5))
    right = np.zeros((2, vote.shape[1]))
    for _ in range(rounds):
        before = good
        share = ((good * counts).sum() + 1) / (counts.sum() + 2)
        for cls, w in ((BAD, (1 - good) * counts), (GOOD, good * counts)):
            hit = (w[:, None] * (vote == cls)).sum(axis=0)
            all_ = (w[:, None] * (vote != ABSTAIN)).sum(axis=0)
            belief = trust * counts.sum() if cls == GOOD else 2.0
            right[cls] = (hit + belief * ((1 - false_alarm) if cls == GOOD else 0.5)) / (all_ + belief)
        to_good = np.where(vote == GOOD, np.log(right[GOOD]), np.where(vote == BAD, np.log(1 - right[GOOD]), 0)).sum(axis=1) + np.log(share)
        to_bad = np.where(vote == BAD, np.log(right[BAD]), np.where(vote == GOOD, np.log(1 - right[BAD]), 0)).sum(axis=1) + np.log(1 - share)
        good = 1 / (1 + np.exp(np.clip(to_bad - to_good, -500, 500)))
        if np.abs(good - before).max(initial=0) < 1e-9:
            break
    return good, right.mean(axis=0)


def token_features(token: str) -> list[int]:
    """Hashed word, ends and shape of a token."""
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token[:24])
    short = shape[:1] + "".join(b for a, b in zip(shape, shape[1:]) if a != b)  # noqa: B905
    low = token.lower()
    return [zlib.crc32(f"{k}{x}".encode()) % DIMENSIONS for k, x in (("w", low), ("p", low[:3]), ("s", low[-3:]), ("f", short), ("n", min(len(token), 20)))]


def text_features(values: Sequence[float]) -> list[int]:
    """Hashed order of magnitude of every measure of a text."""
    return [zlib.crc32(f"m{k}:{np.log2(v + 1e-3):.0f}".encode()) % DIMENSIONS for k, v in enumerate(values)]


def fit_linear(rows: Sequence[tuple[Sequence[int], Sequence[float]]], target: np.ndarray, rounds: int = 250, rate: float = 1.0, pull: float = 1e-5) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer on soft targets, by gradient descent with momentum."""
    weights = np.zeros(DIMENSIONS + 1)
    if not len(rows):
        return weights
    at = np.concatenate([np.asarray(i, np.int64) for i, _ in rows])
    x = np.concatenate([np.asarray(v, np.float64) for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    speed = np.zeros_like(weights)
    for _ in range(rounds):
        margin = np.bincount(owner, x * weights[at], len(rows)) + weights[-1]
        miss = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) / len(rows)
        slope = np.append(np.bincount(at, x * miss[owner], DIMENSIONS), miss.sum()) + pull * np.append(weights[:-1], 0)
        speed = 0.9 * speed - rate * slope
        weights = weights + speed
    return weights


class Scorer:
    """Mean token weight and measure weights of a text through the logistic curve; tokens are remembered per worker."""

    def __init__(self, weights: np.ndarray, memory: int = 600_000):
        self.weights, self.memory, self.known = weights, memory, {}

    def weight(self, token: str) -> float:
        return float(self.weights[token_features(token)].sum())

    def score(self, text: str | None, values: Sequence[float]) -> float:
        tokens = (text or "").split()
        if len(self.known) > self.memory:
            self.known.clear()
        got = list(map(self.known.get, tokens))
        if None in got:
            for t in {t for t, w in zip(tokens, got, strict=True) if w is None}:
                self.known[t] = self.weight(t)
            got = list(map(self.known.__getitem__, tokens))
        margin = TOKEN_SCALE * sum(got) / max(1, len(got)) + self.weights[text_features(values)].sum() + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


@dataclass
class QualityModel:
    """Posterior by vote pattern, accuracy by labeller, and the linear scorer."""

    posterior: dict[int, float]
    accuracy: dict[str, float]
    weights: np.ndarray


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000) -> QualityModel:
    """Labellers are weighed over all rows; about ``sample`` rows, by the hash of their id, train the scorer."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            codes, n = np.unique(np.array([votes(measures(texts[i].as_py())) for i in range(len(texts))], np.int64), return_counts=True)
            yield pa.record_batch([pa.array(codes), pa.array(n, pa.int64())], names=["code", "n"])

    text = F.col(text_col).alias("text")
    rows = df.select(text).mapInArrow(vote, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most 3^9 patterns
    codes, counts = np.array([r.code for r in rows], np.int64), np.array([r.n for r in rows], np.float64)
    if not len(rows):
        return QualityModel({}, {}, np.zeros(DIMENSIONS + 1))
    good, right = posteriors(codes, counts)
    posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                tokens = (value or "").split()
                values = measures(value)
                at, n = np.unique(np.array([f for t in tokens for f in token_features(t)], np.int64), return_counts=True)
                x = (TOKEN_SCALE * n / max(1, len(tokens))).tolist() + [1.0] * len(values)
                out.append((at.tolist() + text_features(values), x, posterior[votes(values)]))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["at", "x", "good"])

    turn = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)).cast("double") / (1 << 30)
    picked = df.filter(turn * float(counts.sum()) < sample).select(text)
    points = picked.mapInArrow(describe, "at array<bigint>, x array<double>, good double").collect()
    weights = fit_linear([(p.at, p.x) for p in points], np.array([p.good for p in points]))
    return QualityModel(posterior, dict(zip((x[0] for x in LABELLERS), right.tolist(), strict=True)), weights)


def score_texts(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, posterior (of the labellers alone) and score (of the scorer) of every row, 1 for good.

    Null and empty texts are voted bad by most labellers; the scorer gives them
    its bias, so their score is the posterior instead. Repeated rows and null ids
    come back as given; only the two named columns are read.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kept: dict[int, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if 0 not in kept:
            kept[0] = Scorer(held.value.weights)
        for batch in batches:
            texts, good, score = batch.column(1), [], []
            for i in range(len(texts)):
                text = texts[i].as_py()
                values = measures(text)
                good.append(held.value.posterior.get(votes(values), 0.5))
                score.append(kept[0].score(text, values) if text and not text.isspace() else good[-1])
            yield pa.record_batch([batch.column(0), pa.array(good, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "posterior", "score"])

    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, posterior double, score double")
