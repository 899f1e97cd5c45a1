"""Secret scans over every version of every file, by an incremental ledger of blobs.

A version is addressed by the SHA-256 of its text, so copies, renames and
reverted edits are one blob. The ledger says which blobs were scanned by which
version of which rule, and what was found. A scan takes the blobs of the given
versions, drops every (blob, rule version) pair on the ledger, reads only the
texts that are left, and returns new ledger rows; findings are joined back to
all paths and versions that hold the blob.

A rule that changes gets a new version number: only that rule runs again, over
blobs whose other findings stay. Ledger rows are only ever added, by Spark's own
commit of a write, so a scan that is lost half-way has added nothing and its
pairs are still unseen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from observatory.session import materialise

LEDGER = "blob string, scanned array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"
# Rows of 32-byte digests and rule names that a broadcast may carry; above it texts are dealt by blob.
BROADCAST_BLOBS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    Patterns keep to what all regular expression engines read alike. A match that is too
    short is dropped and the search goes on behind it.
    """

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
# A run that is long enough needs no drop: runs of one class end where they end, wherever a match starts.
BASE = (
    Rule("assign", 1, f"""({_NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=12, group=2),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, "[0-9a-f]{16,}"),
)
# The prefixes that issuers put before their tokens.
_PREFIXES = "gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[rs]k_live_|AIza|npm_|hf_"
ADDED = (
    Rule("key_block", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", 1, "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", 1, "[Bb]earer\\x20{1,8}[A-Za-z0-9._~+/=-]{16,}"),
    Rule("login_url", 1, "://[^\\x00-\\x20/:@]{1,64}:[^\\x00-\\x20/:@]{1,128}@"),
    Rule("issued", 1, f"(?:{_PREFIXES})[A-Za-z0-9_-]{{16,}}"),
)
RULES = (*BASE, *ADDED)


def matches(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Spans of a rule in a text: code points, end exclusive."""
    found = re.compile(rule.pattern).finditer(text)
    return [m.span() for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]


def addressed(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns but the text, and ``blob``: the SHA-256 of the text; null is the empty text.

    Columns of the names blob and spans, which the operator gives out itself, are left behind.
    """
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    return versions.select(*[F.col(f"`{c}`") for c in versions.columns if c not in (text_col, "blob", "spans")], digest.alias("blob"))


def unseen(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob and todo (keys of the rules still to run) of every blob that the ledger does not wholly cover."""
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
    wanted = F.array(*[F.lit(r.key) for r in rules]) if rules else F.array().cast("array<string>")
    todo = F.when(F.col("seen").isNull(), wanted).otherwise(F.array_except(wanted, F.col("seen")))
    return blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)


def scan(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows: one per blob of ``versions`` with a pair that is not on ``ledger``, written.

    Digests alone find what is unseen. Copies of a text fall together before they
    are dealt out, and each is searched once.
    """
    todo = materialise(unseen(addressed(versions, text_col), ledger, rules), "unseen-blobs")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    if todo.count() <= BROADCAST_BLOBS:
        texts = texts.join(F.broadcast(todo), "blob").dropDuplicates(["blob"])
    else:
        texts = texts.dropDuplicates(["blob"]).join(todo, "blob")

    by_key = {r.key: r for r in rules}
    schema = pa.schema([
        ("blob", pa.string()), ("scanned", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todos, spans = batch["todo"].to_pylist(), []
            for body, keys in zip(batch["text"], todos, strict=True):
                body = body.as_py()
                spans.append([{"rule": k, "start": s, "end": e} for k in keys for s, e in matches(by_key[k], body)])
            yield pa.RecordBatch.from_arrays([batch["blob"], pa.array(todos, schema.field(1).type), pa.array(spans, schema.field(2).type)], schema=schema)

    return materialise(texts.select("blob", "text", "todo").mapInArrow(search, LEDGER), "ledger")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Every version, without its text, with blob and ``spans``: what the ledger holds of its blob.

    ``spans``: array of (start, rank, end, kind), rank the place of the kind in
    ``rules``, in that order. Versions of blobs without findings have none. Every
    row of ``versions`` comes back, repeated ones too; an empty table gives none.
    """
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    span = F.explode("spans").alias("s")
    rows = ledger.filter(F.size("spans") > 0).select("blob", span).filter(F.col("s.rule").isin([r.key for r in rules]))
    one = F.struct(F.col("s.start"), rank[F.col("s.rule")].alias("rank"), F.col("s.end"), F.substring_index("s.rule", ":", 1).alias("kind"))
    found = materialise(rows.groupBy("blob").agg(F.sort_array(F.collect_set(one)).alias("spans")), "found")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    rows = addressed(versions, text_col)
    return rows.join(found, "blob", "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, rules: Sequence[Rule]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin([r.kind for r in rules]))
