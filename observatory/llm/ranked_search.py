"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time.

The index is cut into shards of neighbouring rows, each a row of flat arrays:
terms, their posting lists end to end, and the documents' ids and lengths. Within
a shard the postings of an item's rare terms are summed into accumulators, term
by term; these then are one more sorted list with a bound of its own, and the
documents are met block by block through it and the lists of the common terms.
Lists whose bounds together stay below the k-th best score are only looked up
for documents that others brought, blocks that cannot reach it are skipped whole.

A task keeps its best k per item over all its shards, so later shards start from
a high bar, and only these few rows are shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.session import materialise

SHARD_DOCS, SHARD_TOKENS = 1 << 14, 1 << 20
SLICE = 1 << 22
# Terms that the index may be held to, as a set in every worker; with more of them it takes all terms of the documents.
VOCABULARY = 1 << 18
# (item, term) pairs that every worker holds at a time; more are searched in blocks of items.
PAIRS = 1 << 18
BLOCK_BITS = 9
# A list is short if it holds no more than this share of the shard's documents.
SHORT = 1 / 16

_KEPT = lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if _KEPT(c) else 32 for c in range(256))
INDEX = "doc_ids array<bigint>, lengths array<bigint>, n_docs bigint, n_terms bigint, terms array<binary>, dfs array<bigint>, docs binary, tfs binary"
_ARROW = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
    ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int64())), ("docs", pa.binary()), ("tfs", pa.binary()),
])


def words(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, slice by slice: runs of ASCII letters, digits and all other characters; only A-Z lower-cased."""
    folded, start = text.translate(FOLD), 0
    while start < len(folded):
        stop = folded.find(b" ", start + SLICE)
        stop = len(folded) if stop < 0 else stop
        yield folded[start:stop].split()
        start = stop


class Shard:
    """Documents on their way into one row of the index."""

    def __init__(self, known: dict[bytes, int] | None, tokens: int = SHARD_TOKENS):
        self.limit = tokens
        self.ids, self.lengths = [], []
        self.numbers = known
        if known is None:
            self.numbers = defaultdict()
            self.numbers.default_factory = self.numbers.__len__
        self.open = known is None
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting, self.n_waiting, self.tokens = [], 0, 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        at, n = len(self.ids), 0
        for part in words(text):
            n += len(part)
            found = map(self.numbers.__getitem__, part) if self.open else map(self.numbers.get, part, repeat(-1))
            numbers = np.fromiter(found, np.int64, len(part))
            numbers = numbers[numbers >= 0]
            self.waiting.append(numbers * SHARD_DOCS + at)
            self.n_waiting += len(numbers)
            if self.n_waiting >= 2 * SHARD_TOKENS:
                self.settle()
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.tokens += n

    def settle(self) -> None:
        """Fold the waiting occurrences into counts."""
        keys, at = np.unique(np.concatenate([self.keys, *self.waiting]), return_inverse=True)
        ones = np.concatenate([self.counts, np.ones(self.n_waiting, np.int64)])
        self.keys, self.counts = keys, np.bincount(at, weights=ones, minlength=len(keys)).astype(np.int64)
        self.waiting, self.n_waiting = [], 0

    def full(self) -> bool:
        return len(self.ids) == SHARD_DOCS or self.tokens >= self.limit

    def row(self) -> pa.RecordBatch:
        self.settle()
        numbers, dfs = np.unique(self.keys // SHARD_DOCS, return_counts=True)
        names = list(self.numbers) if self.open else None
        terms = [names[i] for i in numbers.tolist()] if self.open else self.named(numbers)
        row = {
            "doc_ids": self.ids, "lengths": self.lengths, "n_docs": sum(n > 0 for n in self.lengths), "n_terms": self.tokens, "terms": terms, "dfs": dfs.tolist(),
            "docs": (self.keys % SHARD_DOCS).astype("<i4").tobytes(), "tfs": self.counts.astype("<i4").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)

    def named(self, numbers: np.ndarray) -> list[bytes]:
        wanted = set(numbers.tolist())
        found = {i: t for t, i in self.numbers.items() if i in wanted}
        return [found[i] for i in numbers.tolist()]


def build_index(
    documents: DataFrame, vocabulary: Collection[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """One row per shard, written; every row of ``documents`` is in one, with its length in terms.

    ``vocabulary``: terms that posting lists are kept for, at most ``VOCABULARY``
    of them; None keeps all. A null text has no terms, ids may be null or repeat:
    every row is a document of its own.
    """
    if vocabulary is not None and len(vocabulary) > VOCABULARY:
        raise ValueError("a vocabulary this large belongs into no worker's memory; index all terms")
    known = None if vocabulary is None else documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(sorted(vocabulary))})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = None if known is None else known.value
        shard = Shard(numbers, shard_tokens)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                shard.add(doc_id, text.as_py() or b"")
                if shard.full():
                    yield shard.row()
                    shard = Shard(numbers, shard_tokens)
        if shard.ids:
            yield shard.row()

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return materialise(rows.mapInArrow(gather, INDEX), "lexical-index")


@dataclass
class Postings:
    """A sorted list of documents with what it adds to each, and the most it adds in every block of documents."""

    docs: np.ndarray
    scores: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, docs: np.ndarray, scores: np.ndarray, n_blocks: int) -> Postings:
        starts = np.searchsorted(docs, np.arange(n_blocks + 1) << BLOCK_BITS)
        bounds, filled = np.zeros(n_blocks, np.int64), np.flatnonzero(np.diff(starts))
        if len(filled):
            bounds[filled] = np.maximum.reduceat(scores, starts[filled])
        return cls(docs, scores, starts, bounds)

    def times(self, n: int) -> Postings:
        return self if n == 1 else Postings(self.docs, self.scores * n, self.starts, self.bounds * n)


def accumulated(lists: list[Postings], n_blocks: int) -> Postings:
    """Short lists summed term by term into one."""
    docs, at = np.unique(np.concatenate([p.docs for p in lists]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    first = 0
    for p in lists:
        sums[at[first:first + len(p.docs)]] += p.scores
        first += len(p.docs)
    return Postings.of(docs, sums, n_blocks)


def hybrid(lists: list[Postings], n_docs: int, k: int, bar: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard and their scores: all of the k best (ties included) that reach ``bar``, and perhaps some more."""
    n_blocks = (n_docs >> BLOCK_BITS) + 1
    short = [p for p in lists if len(p.docs) <= SHORT * n_docs]
    runs = [p for p in lists if len(p.docs) > SHORT * n_docs]
    if short:
        runs.append(accumulated(short, n_blocks))
        sums = runs[-1].scores
        if len(sums) >= k:  # other terms only add to these
            bar = max(bar, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
    none = np.empty(0, np.int64)
    if not runs:
        return none, none
    runs.sort(key=lambda p: int(p.bounds.max()))
    upto = np.cumsum([p.bounds for p in runs], axis=0)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    reached = none
    for b in np.argsort(-upto[-1], kind="stable").tolist():
        if upto[-1, b] < bar:
            break
        first, total = b << BLOCK_BITS, np.zeros(1 << BLOCK_BITS, np.int64)
        needed = int(np.searchsorted(upto[:, b], bar))  # the lists before it cannot reach the bar without the others
        for p in runs[needed:]:
            here = slice(p.starts[b], p.starts[b + 1])
            total[p.docs[here] - first] += p.scores[here]
        docs = np.flatnonzero(total)
        for i in range(needed - 1, -1, -1):
            docs = docs[total[docs] + upto[i, b] >= bar]
            if not len(docs):
                break
            p = runs[i]
            here = slice(p.starts[b], p.starts[b + 1])
            listed = p.docs[here] - first
            at = np.searchsorted(listed, docs)
            hit = np.flatnonzero(at < len(listed))
            hit = hit[listed[at[hit]] == docs[hit]]
            total[docs[hit]] += p.scores[here][at[hit]]
        docs = docs[total[docs] >= bar]
        if len(docs):
            found.append((docs + first, total[docs]))
            reached = np.sort(np.concatenate([reached, total[docs]]))[-k:]
            if len(reached) == k:
                bar = max(bar, int(reached[0]))
    if not found:
        return none, none
    docs, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    return docs[scores >= bar], scores[scores >= bar]


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term and q, how often the item has it. Rows of one id are one item: the terms of all its different texts."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
    rows = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    rows = rows.select("item_id", F.explode(terms).alias("term"))
    return rows.groupBy("item_id", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("q"))


def search(index: DataFrame, terms: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by doc_id (null last).

    ``terms``: as ``item_terms`` gives them. Items without a term in the index,
    an empty index and an empty table of terms give no rows.
    """
    spark = index.sparkSession
    seen = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_all, l_all = int(seen.n or 0), int(seen.l or 0)
    listed = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select("t.terms", "t.dfs")
    dfs = listed.groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln((2.0 * F.lit(n_all) + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint")
    weighed = materialise(terms.join(dfs, "term").select("item_id", "term", "q", weight.alias("w")).filter("w > 0"), "weighed-terms")
    pairs = weighed.count()
    if not pairs:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    n_blocks = -(-pairs // PAIRS)
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    out = None
    for block in range(n_blocks):
        mine = weighed.filter(dealt == block).toArrow().to_pydict()
        part = _search_block(index, mine, n_all, l_all, k)
        out = part if out is None else out.union(part)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, rows: dict[str, list], n_all: int, l_all: int, k: int) -> DataFrame:
    weights = dict(zip(rows["term"], rows["w"], strict=True))
    asked: dict[int | None, list[tuple[bytes, int]]] = {}
    for item, term, q in zip(rows["item_id"], rows["term"], rows["q"], strict=True):
        asked.setdefault(item, []).append((term, q))
    shared = index.sparkSession.sparkContext.broadcast((weights, asked))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked = shared.value
        kept: dict[int | None, list[tuple[int, bool, int | None]]] = defaultdict(list)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch[name][i] for name in ("doc_ids", "lengths", "terms", "dfs", "docs", "tfs")}
                ids, lengths = row["doc_ids"].as_py(), row["lengths"].as_py()
                lists = _postings(row, weights, lengths, n_all, l_all)
                n_docs = len(ids)
                for item, terms in asked.items():
                    own = [lists[t].times(q) for t, q in terms if t in lists]
                    mine = kept[item]
                    docs, scores = hybrid(own, n_docs, k, -mine[-1][0] if len(mine) == k else 1)
                    if len(docs):
                        new = [(-s, ids[d] is None, ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                        kept[item] = sorted(mine + new, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        found = [(item, doc, -score) for item, rows in kept.items() for score, _, doc in rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    return index.mapInArrow(best, "item_id bigint, doc_id bigint, score bigint")


def _postings(row: dict[str, pa.Scalar], weights: dict[bytes, int], lengths: list[int], n_all: int, l_all: int) -> dict[bytes, Postings]:
    """Lists of the asked terms of a shard; how much a document adds is exact 64-bit arithmetic."""
    long = np.array([25 + 75 * n * n_all // l_all for n in lengths], np.int64)
    docs, tfs = (np.frombuffer(row[name].as_buffer(), "<i4") for name in ("docs", "tfs"))
    ends = np.cumsum(row["dfs"].values.to_numpy())
    out, n_blocks = {}, (len(lengths) >> BLOCK_BITS) + 1
    for term, end, n in zip(row["terms"].as_py(), ends.tolist(), row["dfs"].as_py(), strict=True):
        weight = weights.get(term)
        if weight is not None:
            mine, tf = docs[end - n:end], tfs[end - n:end].astype(np.int64)
            out[term] = Postings.of(mine, weight * (1_000_000_000 * tf // (1000 * tf + 8 * long[mine])), n_blocks)
    return out


def ranked(documents: DataFrame, items: DataFrame, k: int = 10, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The k best documents of every item: an index over the items' terms if they are few, over all terms otherwise."""
    terms = materialise(item_terms(items), "item-terms")
    some = terms.select("term").distinct().limit(VOCABULARY + 1).toArrow()["term"].to_pylist()
    index = build_index(documents, some if len(some) <= VOCABULARY else None, shard_tokens=shard_tokens)
    return search(index, terms, k)
