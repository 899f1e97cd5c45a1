"""Language identification of mixed text: script ranges, word scores and a Viterbi path.

The script of a word's first letter narrows the languages that it may belong to.
Each candidate scores the word by its letter trigrams; a path through the words
of a text that pays a penalty for every switch of language labels the spans.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.session import materialise

# First and last code point of the letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)],
}
OTHER = len(SCRIPTS)
UNKNOWN = "und"


def script_of(letter: str) -> int:
    """Number of the letter's script; ``OTHER`` outside all ranges."""
    code = ord(letter)
    for k, ranges in enumerate(SCRIPTS.values()):
        if any(a <= code <= b for a, b in ranges):
            return k
    return OTHER


def letters_of(token: str) -> str:
    """The letters of a token, lower-cased; empty if it has none."""
    if token.isalpha():
        return token.lower()
    return "".join(c for c in token if c.isalpha()).lower()


def grams_of(word: str) -> list[str]:
    """Letter trigrams with word ends."""
    padded = f" {word} "
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


class LanguageModel:
    """Trigram log-probabilities and script candidates of the learned languages."""

    def __init__(self, counts: Sequence[tuple[str, str, int]], scripts: Sequence[tuple[str, int, int]], share: float = 0.01):
        """``counts``: language, trigram, count. ``scripts``: language, script, words.

        A language is a candidate for a script that at least ``share`` of its
        words have; for a script nobody has, all are.
        """
        self.languages = sorted({c[0] for c in counts} | {s[0] for s in scripts})
        at = {x: i for i, x in enumerate(self.languages)}
        grams = sorted({c[1] for c in counts})
        self.gram = {g: i for i, g in enumerate(grams)}
        table = np.zeros((len(grams) + 1, len(at)))
        for lang, gram, n in counts:
            table[self.gram[gram], at[lang]] += n
        self.scores = np.log((table + 0.05) / (table.sum(axis=0) + 0.05 * len(table))).astype(np.float32)
        seen = np.zeros((OTHER + 1, len(at)))
        for lang, script, n in scripts:
            seen[script, at[lang]] += n
        usual = seen >= share * np.maximum(1, seen.sum(axis=0))
        usual[~usual.any(axis=1)] = True
        self.barred = np.where(usual, 0, -1e4).astype(np.float32)

    def score_words(self, words: Sequence[str]) -> np.ndarray:
        """A row of log-probabilities per word, one column per language."""
        ids, starts, unknown = [], [], len(self.gram)
        for w in words:
            starts.append(len(ids))
            ids += [self.gram.get(g, unknown) for g in grams_of(w)]
        out = np.add.reduceat(self.scores[ids], starts, axis=0) if words else np.zeros((0, len(self.languages)), np.float32)
        return out + self.barred[[script_of(w[0]) for w in words]] if words else out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The column of each row on the best path, where every change of column costs ``penalty``.

    One column throughout is the best path if no other column gains more than
    the penalty over any stretch, nor over a start and an end together: then
    switches cost more than all they bring. Most texts end there; the others
    take the full pass.
    """
    n, k = scores.shape
    if not n or not k:
        return np.full(n, -1)
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    rise = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, best:best + 1], axis=0, dtype=np.float64, out=rise[1:])
    stretch = (rise - np.minimum.accumulate(rise, axis=0)).max()
    if k == 1 or (stretch <= penalty and rise.max() + (rise[-1] - rise).max() <= penalty):
        return np.full(n, best)
    rows = scores.tolist()
    value, back, tops = rows[0], [], []
    for row in rows[1:]:
        top = max(value)
        floor = top - penalty
        tops.append(value.index(top))
        back.append([v < floor for v in value])
        value = [(v if v >= floor else floor) + s for v, s in zip(value, row, strict=True)]
    path = np.zeros(n, np.int64)
    at = path[-1] = value.index(max(value))
    for t in range(n - 2, -1, -1):
        if back[t][at]:
            at = tops[t]
        path[t] = at
    return path


class Labeller:
    """Words of texts to score rows, remembered per worker up to ``memory`` words."""

    def __init__(self, model: LanguageModel, penalty: float, memory: int = 600_000):
        self.model, self.penalty, self.memory = model, penalty, memory
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.model.languages)), np.float32)
        self.sizes = np.zeros(1 << 12, np.int32)
        self.used = 0

    def path(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Tokens of a text, their language number (-1 without letters) and their number of letters."""
        if len(self.known) > self.memory:
            self.reset()
        tokens = text.split()
        rows = list(map(self.known.get, tokens))
        if None in rows:
            fresh = {t: letters_of(t) for t, r in zip(tokens, rows, strict=True) if r is None}
            worded = [t for t, w in fresh.items() if w]
            while self.used + len(worded) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            if worded:
                new = slice(self.used, self.used + len(worded))
                self.table[new] = self.model.score_words([fresh[t] for t in worded])
                self.sizes[new] = [len(fresh[t]) for t in worded]
                self.known.update(zip(worded, range(new.start, new.stop), strict=True))
                self.used = new.stop
            self.known.update((t, -1) for t, w in fresh.items() if not w)
            rows = list(map(self.known.__getitem__, tokens))
        at = np.array(rows, np.int64)
        found, lang, sizes = at >= 0, np.full(len(at), -1), np.zeros(len(at), np.int64)
        lang[found] = viterbi(self.table[at[found]], self.penalty)
        sizes[found] = self.sizes[at[found]]
        return tokens, lang, sizes

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Maximal runs of one language as (start, end, language) in characters."""
        out, position = [], 0
        tokens, lang, _ = self.path(text)
        for token, k in zip(tokens, lang.tolist(), strict=True):
            start = text.index(token, position)
            position = start + len(token)
            if k < 0:
                continue
            name = self.model.languages[k]
            if out and out[-1][2] == name:
                out[-1] = (out[-1][0], position, name)
            else:
                out.append((start, position, name))
        return out

    def label(self, text: str | None) -> tuple[str, float]:
        """The language with most letters on the path, and its share of all letters."""
        _, lang, sizes = self.path(text or "")
        if not self.model.languages or not (lang >= 0).any():
            return UNKNOWN, 0.0
        weight = np.bincount(lang[lang >= 0], sizes[lang >= 0], len(self.model.languages))
        best = int(weight.argmax())
        return self.model.languages[best], float(weight[best] / weight.sum())


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1500, grams: int = 60_000) -> LanguageModel:
    """A model of the ``lang_col`` values, from about ``per_language`` texts of each, picked by the hash of their id.

    Trigrams are counted in tasks and summed in Spark; the most frequent
    ``grams`` pairs of language and trigram come to the driver. Rows without a
    text or a language teach nothing.
    """
    usable = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = materialise(usable.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n")), "languages")
    turn = F.pmod(F.xxhash64(F.col("_id")), F.lit(1 << 30)).cast("double") / (1 << 30)
    texts = usable.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("text"))
    chosen = texts.join(counts, "_lang").filter(turn * F.col("_n") < per_language).select(F.col("_lang").cast("string").alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.split())
            grams_, scripts_ = Counter(), Counter()
            for lang, counted in words.items():
                for token, n in counted.items():
                    word = letters_of(token)
                    if word:
                        scripts_[lang, str(script_of(word[0]))] += n
                        for g in grams_of(word):
                            grams_[lang, g] += n
            rows = [(*k, n, False) for k, n in grams_.items()] + [(*k, n, True) for k, n in scripts_.items()]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "item", "n", "is_script"])

    counted = chosen.select("lang", "text").mapInArrow(run, "lang string, item string, n bigint, is_script boolean")
    summed = counted.groupBy("is_script", "lang", "item").agg(F.sum("n").alias("n"))
    rows = summed.orderBy(F.desc("is_script"), F.desc("n"), "lang", "item").limit(grams).collect()
    return LanguageModel([(r.lang, r.item, r.n) for r in rows if not r.is_script], [(r.lang, int(r.item), r.n) for r in rows if r.is_script])


def _labeller(df: DataFrame, model: LanguageModel, penalty: float):
    held = df.sparkSession.sparkContext.broadcast(model)
    kept: dict[int, Labeller] = {}

    def get() -> Labeller:
        if 0 not in kept:
            kept[0] = Labeller(held.value, penalty)
        return kept[0]

    return get


def label_texts(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    Null and empty texts and texts without a letter are ``und`` with score 0, as
    is everything when the model has no language. Ties go to the language first
    by name. Repeated rows and null ids come back as given; only the two named
    columns are read.
    """
    get = _labeller(df, model, penalty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = get()
        for batch in batches:
            texts = batch.column(1)
            got = [labeller.label(texts[i].as_py()) for i in range(len(texts))]
            yield pa.record_batch(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def label_spans(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """doc_id, start, end, lang: the spans of every text, one row each; texts without letters have none."""
    get = _labeller(df, model, penalty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = get()
        for batch in batches:
            rows = [(i, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in labeller.spans(t or "")]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "end", "lang"])

    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, start bigint, end bigint, lang string")


def fold(row_id: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of an id's digits; null ids are in none."""
    return F.crc32(row_id.cast("string").cast("binary")) % folds
