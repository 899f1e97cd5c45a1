"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer rewrites words to symbols with weights: insult, threat,
target, negation, reporting verb, end of clause, other. Small transducers then
read the symbols and mark insults and threats: in the scope of a negation,
inside reported speech, aimed at a target named before or after. Their
composition is one table that walks a text once and yields matched clauses with
a weight. Clause weights, not words, make up the features of a document; a
logistic curve fitted on labels turns them into a score.

The insult lexicon and the curve are learned from labelled texts; without labels
the prior below is used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from observatory.session import materialise

# Cue words in four languages.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown dumm trottel abschaum idiota imbécile ordure basura"
THREATS = "kill hurt destroy murder strangle töten umbringen verprügeln tuer frapper détruire matar golpear destruir"
TARGETS = "you your yours yourself du dich dir dein deine euch tu toi ton ta vous votre tú usted ustedes vosotros"
NEGATIONS = "not no never neither nicht kein keine nie niemals pas jamais ni nunca tampoco"
REPORTS = "said says told wrote claimed quoted sagte sagt schrieb behauptete dit écrit affirme dijo dice escribió"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
NEGATED, REPORTED, AIMED, AIMED_LATE = 1, 2, 4, 8
SCOPE = 3
CLAUSE_END = ".,;:!?\n"
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
STEMS = range(4, 9)
FACTOR = {NEGATED: 0.5, REPORTED: 0.6, AIMED: 1.25}


@dataclass
class Transducer:
    """States from 0; ``step(state, symbol)`` gives the next state and the marks of this symbol."""

    arcs: dict[tuple[int, int], tuple[int, int]]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, 0))


def negation() -> Transducer:
    """Marks insults and threats at most ``SCOPE`` words after a negation in its clause."""
    arcs = {}
    for s in range(SCOPE + 1):
        for symbol in (OTHER, INSULT, THREAT, TARGET, REPORT):
            arcs[s, symbol] = (max(0, s - 1), NEGATED if s and symbol in (INSULT, THREAT) else 0)
        arcs[s, NEGATION], arcs[s, END] = (SCOPE, 0), (0, 0)
    return Transducer(arcs)


def reporting() -> Transducer:
    """Marks insults and threats after a reporting verb, to the end of the next clause."""
    arcs = {}
    for s in range(3):
        arcs[s, REPORT], arcs[s, END] = (2, 0), (max(0, s - 1), 0)
        for symbol in (INSULT, THREAT):
            arcs[s, symbol] = (s, REPORTED if s else 0)
    return Transducer(arcs)


def targeting() -> Transducer:
    """Marks insults and threats whose clause names a target: before them, or after (then at the target)."""
    return Transducer({
        (0, TARGET): (1, 0), (1, INSULT): (1, AIMED), (1, THREAT): (1, AIMED), (1, END): (0, 0),
        (0, INSULT): (2, 0), (0, THREAT): (2, 0), (2, TARGET): (1, AIMED_LATE), (2, END): (0, 0),
    })


def compose(machines: Sequence[Transducer]) -> list[list[tuple[int, int]]]:
    """One table [state][symbol] -> (state, marks) that runs all machines side by side; states by first use."""
    start = (0,) * len(machines)
    number, table, todo = {start: 0}, [], [start]
    while todo:
        states = todo.pop(0)
        row = []
        for symbol in range(END + 1):
            steps = [m.step(s, symbol) for m, s in zip(machines, states, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], sum(mark for _, mark in steps)))
        table.append(row)
    return table


GRAMMAR = compose([negation(), reporting(), targeting()])


def weight_of(weight: float, marks: int) -> float:
    for mark, factor in FACTOR.items():
        if marks & mark:
            weight *= factor
    return weight


# Features: bias, log clause weight, log matches, heaviest clause, log matches per 1,000 words, log words if any match, log threats.
PRIOR = np.array([-4.5, 1.0, 0.8, 0.2, 0.3, -0.3, 2.0])


@dataclass
class ToxicityModel:
    """``terms``: weights of whole words (with ``$``) and of stems; ``curve``: weights of the features."""

    terms: dict[str, float] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=PRIOR.copy)


class Reader:
    """Tokens to symbols, remembered per worker up to ``memory`` tokens, and texts to matched clauses."""

    def __init__(self, terms: dict[str, float], memory: int = 600_000):
        self.terms, self.memory = terms, memory
        self.cues = {w: (k, 0.0) for words, k in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words.split()}
        self.cues |= {w: (THREAT, 4.0) for w in THREATS.split()} | {w: (INSULT, 4.0) for w in INSULTS.split()}
        self.known: dict[str, tuple[int, float, bool] | int] = {}

    def symbol(self, token: str) -> tuple[int, float, bool] | int:
        """Symbol, weight and whether a clause ends; 0 for plain words."""
        word, ends = EDGE.sub("", token), token[-1] in CLAUSE_END
        found = self.terms.get(word + "$")
        if found is None:
            found = next((self.terms[word[:n]] for n in reversed(STEMS) if len(word) >= n and word[:n] in self.terms), None)
        kind, weight = (INSULT, found) if found is not None else self.cues.get(word, (OTHER, 0.0))
        return (kind, weight, ends) if kind or ends else 0

    def clauses(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        """(weight, insults, threats) of every matched clause, and the number of words."""
        if len(self.known) > self.memory:
            self.known.clear()
        tokens = text.lower().split()
        known = self.known
        symbols = list(map(known.get, tokens))
        if None in symbols:
            for t in {t for t, s in zip(tokens, symbols, strict=True) if s is None}:
                known[t] = self.symbol(t)
            symbols = list(map(known.__getitem__, tokens))
        if not any(s and s[0] in (INSULT, THREAT) for s in set(symbols)):
            return [], len(tokens)
        out, state, open_ = [], 0, []
        for s in symbols:
            kind, weight, ends = s or (OTHER, 0.0, False)
            state, marks = GRAMMAR[state][kind]
            if kind in (INSULT, THREAT):
                open_.append((kind, weight, marks))
            elif marks & AIMED_LATE:
                open_ = [(k, w, m | AIMED) for k, w, m in open_]
            if ends:
                state, _ = GRAMMAR[state][END]
                out, open_ = self._closed(out, open_), []
        return self._closed(out, open_), len(tokens)

    @staticmethod
    def _closed(out: list, matches: list[tuple[int, float, int]]) -> list:
        """A threat counts only when it is aimed and not negated."""
        hits = [(k, weight_of(w, m)) for k, w, m in matches if k == INSULT or (m & AIMED and not m & NEGATED)]
        if hits:
            threats = sum(k == THREAT for k, _ in hits)
            out.append((sum(w for _, w in hits), len(hits) - threats, threats))
        return out

    def features(self, text: str | None) -> np.ndarray:
        clauses, words = self.clauses(text or "")
        n = sum(c[1] for c in clauses)
        return np.array([
            1.0, math.log1p(sum(c[0] for c in clauses)), math.log1p(n), max((c[0] for c in clauses), default=0.0) / 4,
            math.log1p(1000 * n / (words + 20)), math.log1p(words) if clauses else 0.0, math.log1p(sum(c[2] for c in clauses)),
        ])


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 40, pull: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards the prior; the prior itself unless both labels occur."""
    w = PRIOR.copy()
    if len(np.unique(y)) < 2:
        return w
    strength = np.full(len(w), pull)
    strength[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + strength * (w - PRIOR)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w


def fold(row_id: Column, folds: int = 4) -> Column:
    return F.crc32(row_id.cast("string").cast("binary")) % folds


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: documents and occurrences of every term by label; the empty term has the totals."""
    names = ["term", "toxic_docs", "clean_docs", "toxic_n", "clean_n"]
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string())]
        columns += [pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4)]
        counts.clear()
        return pa.record_batch(columns, names=names)

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = 0 if toxic else 1
            seen = Counter(EDGE.sub("", t) for t in (text or "").lower().split())
            terms: Counter = Counter({"": sum(seen.values())})
            for word, n in seen.items():
                if word:
                    terms[word + "$"] += n
                    for k in STEMS:
                        if len(word) >= k:
                            terms[word[:k]] += n
            for term, n in terms.items():
                row = counts.get(term)
                if row is None:
                    row = counts[term] = [0, 0, 0, 0]
                row[at] += 1
                row[at + 2] += n
            if len(counts) > 400_000:
                yield flush()
    yield flush()


def learn(
    df: DataFrame, labels: DataFrame, sample: int = 8000, terms: int = 20_000, evidence: float = 20.0,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> ToxicityModel:
    """Lexicon and curve from at most ``sample`` labelled rows, picked by the hash of their id.

    A term enters the lexicon when at least three toxic texts have it and its
    log-likelihood ratio against the share of toxic texts reaches ``evidence``;
    the ``terms`` with most evidence are kept. Its weight is the log ratio of
    its rates. Labels that are null or have no text teach nothing; a document
    labelled twice counts as toxic if it once was.
    """
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    rows = materialise(texts.join(picked, "_id").select("text", (F.col("_toxic") > 0).alias("toxic")), "labelled")
    counts = materialise(
        rows.mapInArrow(_term_counts, "term string, toxic_docs bigint, clean_docs bigint, toxic_n bigint, clean_n bigint")
        .groupBy("term").agg(*[F.sum(c).alias(c) for c in ("toxic_docs", "clean_docs", "toxic_n", "clean_n")]).filter("toxic_docs >= 3"),
        "terms",
    )
    total = counts.filter("term = ''").first()
    model = ToxicityModel()
    if total and total.clean_docs:
        base = total.toxic_docs / (total.toxic_docs + total.clean_docs)
        a, n = F.col("toxic_docs"), F.col("toxic_docs") + F.col("clean_docs")
        rest = F.when(a < n, (n - a) * F.log((1 - a / n) / (1 - base))).otherwise(0.0)
        gain = F.when(a / n > base, 2 * (a * F.log(a / n / base) + rest)).otherwise(0.0)
        weight = F.log((F.col("toxic_n") + 0.5) / total.toxic_n) - F.log((F.col("clean_n") + 0.5) / max(1, total.clean_n))
        best = counts.filter("term <> ''").select("term", gain.alias("gain"), weight.alias("weight"))
        best = best.filter((F.col("gain") >= evidence) & (F.col("weight") > 1.5)).orderBy(F.desc("gain"), "term").limit(terms)
        model.terms = {r.term: r.weight for r in best.collect()}
    lexicon = model.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            x = [reader.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    points = rows.mapInArrow(run, "x array<double>, toxic boolean").collect()
    if points:
        model.curve = fit_curve(np.array([p.x for p in points]), np.array([float(p.toxic) for p in points]))
    return model


def score_texts(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and matches (insults and threats in matched clauses) of every row.

    Null and empty texts get the score of a text without matches. Repeated rows
    and null ids come back as given; only the two named columns are read.
    """
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return with_scores(slim, model).select("row.doc_id", "score", "matches")


def with_scores(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """Every row of ``df`` as a struct ``row``, with its score and matches."""
    held = df.sparkSession.sparkContext.broadcast(model)
    readers: dict[int, Reader] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if 0 not in readers:
            readers[0] = Reader(held.value.terms)
        reader, curve = readers[0], held.value.curve
        for batch in batches:
            texts, x, n = batch.column(0).field(text_col), [], []
            for i in range(len(texts)):
                row = reader.features(texts[i].as_py())
                x.append(float(row @ curve))
                n.append(round(math.expm1(row[2]) + math.expm1(row[6])))
            scores = 1 / (1 + np.exp(-np.clip(np.array(x, np.float64), -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(scores), pa.array(n, pa.int64())], names=["row", "score", "matches"])

    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = T.StructType([*whole.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("matches", T.LongType())])
    return whole.mapInArrow(run, schema)
