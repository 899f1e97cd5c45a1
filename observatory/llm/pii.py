"""Personal data: spans proposed with high recall, boosted trees that judge them, and redaction.

Strict rules find emails, IP addresses, payment cards and phone numbers; their
spans always stand. Looser generators propose further, overlapping spans. Trees
boosted on the format and the company of proposals score them.

No document is labelled, so each view of a proposal is taught by something that
it does not hold. What the strict rules find is right, also rewritten into
formats that only the loose generators propose; what fails a check (Luhn's sum,
parts up to 255, count of digits) is wrong, and the trees do not see the check.
All other proposals are believed to be right as far as the words beside them
stand beside strict spans rather than beside other proposals; these beliefs are
re-estimated a few times and teach the trees formats. On documents that the trees
have not seen, each kind gets the threshold from which its proposals are
precise; those above it that pass their check are added.

Everything is column expressions over one row: the fitted trees and the odds of
words become one expression too, so scoring neither shuffles nor leaves the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.session import materialise

KINDS = ("email", "ip", "card", "phone")

# What the strict rules match, with possessive repeats and look-behind so that no text takes more than linear time.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]?(?:@|at|AT)[\])}]?\x20?[A-Za-z0-9-]{1,63}+\x20?[\[({]?(?:\.|dot|DOT)[\])}]?\x20?[A-Za-z]{2,24}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?[.,:]\x20?[0-9]{1,3}+){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20._-]{0,2}[0-9]){11,18}+",
    "phone": r"(?<![0-9])(?:\+\x20?)?\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3}[\x20./-]?[0-9]{3,4}(?![0-9])",
}
CONTEXT = 32
WORDS = 3
BUCKETS = 1024
FLOOR = -1.5
BELIEFS = 4
PRECISION = 0.95
LEAST = 0.5

# Strict matches in formats that only the loose generators propose, as (pattern, replacement) in turn.
MAIL = r"^([^@]+)@([A-Za-z0-9-]+)\.([A-Za-z]+)$"
NATIONAL = r"^.*?([0-9]{3})[^0-9]*([0-9]{3})[^0-9]*([0-9]{4})$"
REWRITES = {
    "email": [(MAIL, r) for r in ("$1 [at] $2 dot $3", "$1 at $2 dot $3", "$1 (at) $2 (dot) $3", "$1 (at) $2.$3", "$1 at $2.$3", "$1 @ $2.$3")],
    "ip": [(r"\.", r) for r in (" . ", ". ")],
    "card": [(r"^([0-9]{4})[^0-9]*([0-9]{4})[^0-9]*([0-9]{4})[^0-9]*([0-9]{1,7})$", r) for r in ("$1.$2.$3.$4", "$1_$2_$3_$4", "$1 - $2 - $3 - $4", "$1  $2  $3  $4")]
    + [(r"^([0-9]{4})[^0-9]*([0-9]{6})[^0-9]*([0-9]{5})$", "$1.$2.$3")],
    "phone": [(NATIONAL, r) for r in ("($1) $2-$3", "$1-$2-$3", "$1.$2.$3", "$1 $2 $3", "$1/$2-$3", "$1$2$3")],
}

SPAN = "array<struct<kind:int,start:int,stop:int,value:string>>"
FORMAT = ("kind", "length", "digits", "spaces", "marks", "groups", "opens", "first", "letters_before", "letters_after", "long_group")
FEATURES = (*FORMAT, "company")
BESIDE = tuple(f"word{i}" for i in range(WORDS))
ITEMS = "array<struct<kind:int,value:string,before:string,after:string,state:int>>"
WRONG, RIGHT, OPEN, SEED, MADE = range(5)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum over a string of digits is a multiple of ten."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def passes(kind: int, value: Column) -> Column:
    """What a strict match must fulfil besides its pattern."""
    n = F.length(digits_of(value))
    if KINDS[kind] == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if KINDS[kind] == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits_of(value))).otherwise(False)
    if KINDS[kind] == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: int, needs: str, strict: bool) -> Column:
    """Spans of a pattern in code points, in order; with ``strict`` only those that pass.

    The text between matches gives their positions, so one split and one
    extraction take the place of a search from each position.
    """
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        value, begin = part["value"], acc["at"] + part["gap"]
        stop = begin + F.coalesce(F.length(value), F.lit(0))
        good = value.isNotNull() & (passes(kind, value) if strict else F.lit(True))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), stop.alias("stop"), value.alias("value"))
        return F.struct(stop.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(SPAN))


NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"}
LOOSE_NEEDS = {"email": "@|at|AT", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}


def strict_spans(text: Column) -> Column:
    """The strict rules' spans by kind, then start. A null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[matches(text, STRICT[k], i, NEEDS[k], True) for i, k in enumerate(KINDS)])


def loose_spans(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[matches(text, LOOSE[k], i, LOOSE_NEEDS[k], False) for i, k in enumerate(KINDS)])


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def of_kind(found: Column, kind: int) -> Column:
    return F.filter(found, lambda s: s["kind"] == kind)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def checks(kind: Column, value: Column) -> Column:
    """Whether a value can be of its kind, in any format: check sum, numbers up to 255 with points between, count of digits, no end of a sentence."""
    digits = digits_of(value)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == KINDS.index("email"), ~value.rlike(r"\.\x20[A-Za-z]+$"))
        .when(kind == KINDS.index("ip"), value.rlike(rf"^{part}(?:\x20?\.\x20?{part}){{3}}$"))
        .when(kind == KINDS.index("card"), passes(KINDS.index("card"), value))
        .otherwise(F.length(digits).between(9, 15))
    )


def around(text: Column, span: Column) -> tuple[Column, Column]:
    """The text before and after a span that its features see."""
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
    return before, F.substring(text, span["stop"] + 1, F.lit(CONTEXT))


def described(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """Small integers that describe a value, and the hashed words beside it: the last two before and the first after."""
    count = lambda p: F.least(F.regexp_count(value, F.lit(p)), F.lit(20))
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    word = lambda at, p: F.pmod(F.hash(F.lower(F.regexp_extract(at, p, 1))), F.lit(BUCKETS)).cast("int")
    return F.struct(
        kind.alias("kind"), F.least(F.length(value), F.lit(40)).alias("length"), count("[0-9]").alias("digits"), count(" ").alias("spaces"),
        count("[.,:/_-]").alias("marks"), count("[0-9]+").alias("groups"), count(r"[\[({]").alias("opens"),
        F.least(F.length(F.regexp_extract(value, "[0-9]+", 0)), F.lit(20)).alias("first"),
        yes(before.rlike("[A-Za-z]$")).alias("letters_before"), yes(after.rlike("^[A-Za-z0-9]")).alias("letters_after"),
        yes(value.rlike("[0-9]{6}")).alias("long_group"),
        word(before, r"(\p{L}+)\P{L}*$").alias("word0"), word(before, r"(\p{L}+)\P{L}+\p{L}+\P{L}*$").alias("word1"),
        word(after, r"^\P{L}*(\p{L}+)").alias("word2"),
    )


def features(text: Column, span: Column) -> Column:
    return described(span["kind"], span["value"], *around(text, span))


def candidates(text: Column, strict: Column, loose: Column) -> Column:
    """Descriptions with a state: x and state.

    ``SEED`` are the strict spans. ``RIGHT`` are loose spans over a strict span of
    their kind, and strict spans rewritten into the formats of ``REWRITES`` where
    they stand. ``WRONG`` are loose spans that touch no strict span and fail their
    check. ``MADE`` are wrong too: rewritten ones inside a hex run or with the end
    of a sentence in them, whose words say nothing. ``OPEN`` are loose spans that touch no strict span and pass: what may be
    added. Loose spans over another kind's strict span are left out, as they are
    never added. ``strict`` and ``loose`` are columns, as every span reads them.
    """

    def item(kind: Column, value: Column, before: Column, after: Column, state: Column) -> Column:
        return F.struct(kind.alias("kind"), value.alias("value"), before.alias("before"), after.alias("after"), state.cast("int").alias("state"))

    def judged(span: Column) -> Column:
        good = F.exists(strict, lambda s: (s["kind"] == span["kind"]) & overlaps(s, span))
        free = ~F.exists(strict, lambda s: overlaps(s, span))
        state = F.when(good, RIGHT).when(free & checks(span["kind"], span["value"]), OPEN).when(free, WRONG)
        return item(span["kind"], span["value"], *around(text, span), state)

    def rewritten(kind: int) -> Column:
        whole, k = rf"^(?:{LOOSE[KINDS[kind]]})$", F.lit(kind)

        def forms(span: Column) -> Column:
            values = F.array(*[F.regexp_replace(span["value"], pattern, F.lit(new)) for pattern, new in REWRITES[KINDS[kind]]])
            fitting = F.filter(values, lambda v: (v != span["value"]) & v.rlike(whole))
            before, after = around(text, span)
            right = F.transform(fitting, lambda v: item(k, v, before, after, F.when(checks(k, v), RIGHT)))
            if KINDS[kind] != "email":
                return F.concat(right, F.transform(fitting, lambda v: item(k, v, F.lit("a"), F.lit("f"), F.lit(MADE))))
            ended = lambda v: F.regexp_replace(v, r"(?:\.|\x20?\(?dot\)?\x20?)([A-Za-z]+)$", ". $1")
            return F.concat(right, F.transform(fitting, lambda v: item(k, ended(v), before, after, F.lit(MADE))))

        return F.flatten(F.transform(of_kind(strict, kind), forms))

    seeds = F.transform(strict, lambda s: item(s["kind"], s["value"], *around(text, s), F.lit(SEED)))
    items = F.concat(*[a.cast(ITEMS) for a in (F.transform(loose, judged), seeds, *[rewritten(k) for k in range(len(KINDS))])])
    known = F.filter(items, lambda i: i["state"].isNotNull())
    return F.transform(known, lambda i: F.struct(described(i["kind"], i["value"], i["before"], i["after"]).alias("x"), i["state"].alias("state")))


def company(x: Column, odds: list[float] | None) -> Column:
    """Sum of the logarithmic odds of the words beside a proposal. ``odds`` go by kind, position and bucket."""
    if odds is None:
        return F.lit(0.0)
    table = F.split(F.lit(",".join(f"{v:.3f}" for v in odds)), ",").cast("array<double>")  # folded into one literal
    places = F.array(*[(x["kind"] * WORDS + i) * BUCKETS + x[w] for i, w in enumerate(BESIDE)])
    return F.aggregate(places, F.lit(0.0), lambda total, at: total + F.get(table, at))


def described_with(x: Column, odds: list[float] | None) -> Column:
    """A description with its company, in halves of a unit of odds."""
    return x.withField("company", F.floor(F.greatest(F.least(company(x, odds), F.lit(10.0)), F.lit(-10.0)) * 2).cast("int"))


def word_odds(table: DataFrame, rounds: int = BELIEFS) -> list[float]:
    """Odds of each word beside strict spans against all other proposals, by kind, position and bucket.

    At first no open proposal is believed; each round believes it as far as the
    last odds say. A word that strict spans do not meet counts against a proposal
    with ``FLOOR`` at most, since there may be few of these. A kind without strict
    spans, or without other proposals, has odds of zero.
    """
    odds, beside = None, F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(w).alias("bucket")) for i, w in enumerate(BESIDE)]))
    for _ in range(rounds):
        counted = table.filter(F.col("state").isin(SEED, WRONG, OPEN)).withColumn("b", F.when(F.col("state") == SEED, 1.0).when(F.col("state") == WRONG, 0.0).otherwise(believed(F.struct("kind", *BESIDE), odds)))
        sums = counted.select("kind", "n", "b", beside.alias("w")).groupBy("kind", "w.at", "w.bucket").agg(F.sum(F.col("n") * F.col("b")).alias("good"), F.sum(F.col("n") * (1 - F.col("b"))).alias("bad"))
        rows = sums.collect()  # at most kinds x positions x buckets
        odds = [0.0] * (len(KINDS) * WORDS * BUCKETS)
        for kind in range(len(KINDS)):
            of = [r for r in rows if r.kind == kind]
            good, bad = (sum(r[c] for r in of) / WORDS for c in ("good", "bad"))
            if good and bad:
                for r in of:
                    odds[(kind * WORDS + r["at"]) * BUCKETS + r.bucket] = max(FLOOR, math.log((r.good + 0.5) / (good + 1)) - math.log((r.bad + 0.5) / (bad + 1)))
    return odds


def believed(x: Column, odds: list[float] | None) -> Column:
    return F.lit(0.0) if odds is None else 1 / (1 + F.exp(-company(x, odds)))


@dataclass
class Judge:
    """Boosted trees as nested (feature, threshold, left, right) with leaf values, a threshold per kind, and the odds of words."""

    trees: list
    thresholds: list
    odds: list | None = None

    def admits(self, span: Column, x: Column) -> Column:
        """Whether a proposal passes its check and scores from its kind's threshold up."""
        limit = F.array(*[F.lit(float(t)) for t in self.thresholds])
        return checks(span["kind"], span["value"]) & (bound(x, lambda x: bound(described_with(x, self.odds), self.score)) >= limit[span["kind"]])

    def score(self, x: Column) -> Column:
        """Probability that a proposal is personal data."""

        def branch(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, limit, left, right = node
            return F.when(x[FEATURES[feature]] <= F.lit(float(limit)), branch(left)).otherwise(branch(right))

        margin = sum((F.lit(float(weight)) * branch(root) for weight, root in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node) -> object:
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split = node.split()
    return (split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 12, depth: int = 3) -> Judge | None:
    """Trees over the proposals of all rows, or None if these are all right or all wrong, as without any strict span.

    Proposals are counted by description first. An open one is taught as right
    with its belief and as wrong with the rest of it. The labels of each kind
    weigh the same in all, however many there are. A fifth of the documents, by the hash of their id, only
    calibrates: a kind's threshold is the lowest score, from ``LEAST`` up, from
    which ``PRECISION`` of the weight of its proposals is right; a kind without
    one adds nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = df.filter(text.rlike("[0-9]|@|[aA][tT]")).select(
        (F.pmod(F.xxhash64(id_col), F.lit(5)) == 0).alias("held"), text.alias("text"), strict_spans(text).alias("strict"), loose_spans(text).alias("loose")
    )
    each = read.select("held", F.explode(candidates(F.col("text"), F.col("strict"), F.col("loose"))).alias("c"))
    counts = each.groupBy("held", "c.state", *[F.col(f"c.x.{f}").alias(f) for f in (*FORMAT, *BESIDE)]).agg(F.count("*").cast("double").alias("n"))
    described_ = materialise(counts, "proposals")
    odds = word_odds(described_.filter("not held"))
    x = described_with(F.struct(*FORMAT, *BESIDE), odds)
    belief = F.when(F.col("state") == RIGHT, 1.0).when(F.col("state").isin(WRONG, MADE), 0.0).otherwise(believed(F.struct("kind", *BESIDE), odds))
    soft = described_.filter(F.col("state") != SEED).select("held", "n", x.alias("x"), belief.alias("b")).select(
        "held", "x", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("b")).alias("n")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("b"))).alias("n")))).alias("l")
    )
    few = soft.filter("l.n > 0").groupBy("held", "l.label", *[F.col(f"x.{f}").alias(f) for f in FEATURES]).agg(F.sum("l.n").alias("n"))
    table = materialise(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(few), "labelled")
    totals = table.groupBy("held", "kind", "label").agg(F.sum("n").alias("total")).collect()  # at most 16 rows
    if {r.label for r in totals if not r.held} != {0.0, 1.0}:
        return None
    share = F.lit(None).cast("double")
    for r in totals:
        share = F.when((F.col("held") == r.held) & (F.col("kind") == r.kind) & (F.col("label") == r.label), F.col("n") / r.total).otherwise(share)
    table = table.withColumn("w", share)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1, weightCol="w", maxBins=48).fit(table.filter("not held"))
    trees = list(zip(model.treeWeights, [_tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode()) for t in model.trees], strict=True))
    judge = Judge(trees, [2.0] * len(KINDS), odds)
    score = judge.score(F.struct(*FEATURES))
    held = table.filter("held").groupBy("kind", F.floor(score * 1000).alias("score")).agg(F.sum(F.col("w") * F.col("label")).alias("good"), F.sum("w").alias("w"))
    sums = [(0.0, 0.0)] * len(KINDS)
    for row in sorted(held.collect(), key=lambda r: -r.score):  # at most 1,001 rows a kind
        good, weight = sums[row.kind] = sums[row.kind][0] + row.good, sums[row.kind][1] + row.w
        if row.score >= LEAST * 1000 and good >= PRECISION * weight:
            judge.thresholds[row.kind] = row.score / 1000
    return judge


def spans(text: Column, judge: Judge | None) -> tuple[Column, Column]:
    """Strict spans, and all spans by kind and start: the strict ones and proposals that the judge admits and that touch none of these."""
    strict = strict_spans(text)
    if judge is None:
        return strict, strict

    def more(base: Column) -> Column:
        free = F.filter(loose_spans(text), lambda s: ~F.exists(base, lambda b: overlaps(b, s)))
        added = F.filter(free, lambda s: judge.admits(s, features(F.coalesce(text, F.lit("")), s)))
        return F.array_sort(F.concat(base, added))

    return strict, bound(strict, more)


def written(found: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))))


def find(df: DataFrame, judge: Judge | None, text_col: str = "text") -> DataFrame:
    """``df`` with arrays of spans: base_spans and all_spans (kind by number, start, stop and value, in code points).

    Null and empty texts have none. Spans of different kinds may overlap, and
    two spans of one kind never are the same. Repeated rows, null ids and other
    columns come back as given; an empty table gives no rows.
    """
    base, every = spans(F.col(text_col), judge)
    return df.withColumn("base_spans", base).withColumn("all_spans", every)


def redacted(text: Column, found: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by the kind of its first, as in [EMAIL]."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), kinds[s["kind"]])
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"),
        )

    whole = F.aggregate(
        ordered, start, step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(found) > 0, whole).otherwise(text)
