"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits agree in at least five
of their eight bytes. Posting lists are keyed by byte positions and their bytes:
of the two halves of a fingerprint one holds at least three of the five agreeing
bytes, so keys of three positions out of one half (four per half, eight in all)
bring every such pair together. Within a list the bytes that two fingerprints
share in place are tallied, pairs below five are dropped, and the rest verified
by their bits.

Copies share a fingerprint and are one entry of the index. A long list is dealt
out in blocks, and a block writes links of a spanning forest, at most one per
entry, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from observatory.llm.links import components, local_roots
from observatory.session import materialise

KEYS = [(*half,) for start in (0, 4) for half in combinations(range(start, start + 4), 3)]
SLICE_WORDS = 1 << 18


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The 64 majority bits of the XXH64 of all ``words``-word shingles of a text; 0 without words.

    A-Z are lower-cased, words end at ASCII white space, repeats count. Fewer
    words than a shingle are one shingle together. A bit is set when more than
    half of the hashes set it.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    total, ones = max(1, len(parts) - words + 1), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for first in range(0, total, SLICE_WORDS):
        here = parts[first:min(first + SLICE_WORDS, total) + words - 1]
        line = b" ".join(here)
        ends = np.cumsum(np.fromiter(map(len, here), np.int64, len(here)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = ends[words - 1:] if len(here) >= words else ends[-1:]
        hashes = [digest(line[s:e], seed) for s, e in zip(starts.tolist(), last.tolist(), strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed 64-bit integer) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            marks = np.array([fingerprint(texts[i].as_py()) for i in range(len(texts))], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, fp bigint")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes are zero in each XOR of two fingerprints."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def block_links(keys: np.ndarray, fps: np.ndarray, distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all pairs within ``distance`` bits of equal, adjacent keys.

    Every entry is compared with the next of its list, then with the next but
    one, and so on; verified pairs are folded into roots as they add up.
    """
    n = len(keys)
    root = np.arange(n)
    list_end = np.searchsorted(keys, keys, side="right")
    at, step, held_a, held_b, held = np.arange(n), 1, [], [], 0
    u = fps.view(np.uint64)
    while True:
        at = at[at + step < list_end[at]]
        if not len(at):
            break
        x = u[at] ^ u[at + step]
        near = shared_bytes(x) >= 8 - distance
        a, x = at[near], x[near]
        a = a[np.bitwise_count(x) <= distance]
        if len(a):
            held_a.append(a)
            held_b.append(a + step)
            held += len(a)
        if held > 1 << 20:
            root = local_roots(n, np.concatenate([*held_a, np.arange(n)]), np.concatenate([*held_b, root]))
            held_a, held_b, held = [], [], 0
        step += 1
    root = local_roots(n, np.concatenate([*held_a, np.arange(n)]), np.concatenate([*held_b, root]))
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def links(marks: DataFrame, distance: int = 3, block: int = 1024) -> DataFrame:
    """Links a-b between distinct fingerprints that connect the same ones as all pairs within ``distance`` bits.

    ``marks``: distinct fp. A list of more than ``block`` entries is dealt into
    chunks, and every pair of chunks is one block. Lists of one entry go no
    further than their count.
    """
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for k, positions in enumerate(KEYS):
        value = F.lit(k).cast("bigint")
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(byte[p])
        keys.append(value)
    entries = marks.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = entries.join(lists, "key")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    dealt = shared.select("key", "fp", own.alias("own"), other.alias("other"), parts.alias("parts"))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    ).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            kept.append(batch)
            size += len(batch)
            if size < 1 << 16:
                continue
            whole = pa.Table.from_batches(kept)
            cols = [whole.column(c).to_numpy() for c in range(3)]
            same = np.ones(size, bool)
            for c in cols:
                same &= c == c[-1]
            cut = size - int(same.sum())
            if cut:
                yield linked(whole.slice(0, cut))
            kept = whole.slice(cut).to_batches()
            size -= cut
        if size:
            yield linked(pa.Table.from_batches(kept))

    def linked(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(c).to_numpy() for c in range(3)]
        change = np.zeros(len(rows), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        a, b = block_links(np.cumsum(change), rows.column(3).to_numpy(), distance)
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links) and class_fp (one fingerprint of the class) of every row.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a
    null id take part; a class in which every id is null has a null
    component. Repeated rows come back as often as they are given. Only the two
    named columns are read; an empty table gives no rows.
    """
    docs = materialise(fingerprints(df, id_col, text_col), "fingerprints")
    marks = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "marks")
    groups = materialise(components(links(marks.select("fp"), distance)), "groups")
    grouped = marks.join(groups, marks.fp == groups.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = grouped.join(smallest, "component").select("fp", "component_id", F.col("component").alias("class_fp"))
    return docs.join(materialise(classes, "classes"), "fp").select("doc_id", "fp", "component_id", "class_fp")
