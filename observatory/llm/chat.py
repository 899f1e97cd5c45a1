"""Chat formatting with linked tool calls.

A message is plain text or a JSON object with content and either tool calls
(id, name, arguments) or the id of the call that it answers. Calls and results
are joined by conversation and identifier; a result that comes before its call
is ordered behind it, along any chain of calls; arguments are validated against schemas; and every message
is written as canonical JSON: keys by name, no spaces.

Everything is DataFrame operations, one row per message throughout: a
conversation of any length is never gathered, and its rows spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.session import Rounds, materialise

# What schema_of_variant says of a value of each schema type.
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID",
}
ID, NAME = "$.id", "$.name"


def valid(name: Column, arguments: Column, schemas: Mapping[str, Mapping]) -> Column:
    """Whether arguments fit the schema of the tool: an object with all required properties, each known one of its type.

    ``schemas``: tool -> {"properties": {name: type}, "required": [names]}. A
    tool without a schema is not valid.
    """
    out = F.lit(False)
    for tool, schema in schemas.items():
        ok = F.schema_of_variant(arguments).startswith("OBJECT")
        for prop, kind in schema.get("properties", {}).items():
            found = F.try_variant_get(arguments, f"$.{prop}", "variant")
            missing = F.lit(prop not in schema.get("required", ()))
            ok = ok & F.when(found.isNull(), missing).otherwise(F.schema_of_variant(found).rlike(f"^(?:{TYPES[kind]})$"))
        out = F.when(name == tool, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def parsed(df: DataFrame, schemas: Mapping[str, Mapping], conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, json, calls (id, valid) and answers (the id of the call that the message answers)."""
    text = F.col(text_col)
    body = F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))
    has = lambda key: F.try_variant_get(body, f"$.{key}", "variant").isNotNull()
    body = F.when(F.schema_of_variant(body).startswith("OBJECT") & (has("tool_calls") | has("tool_call_id")), body)
    df = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text.alias("text"), body.alias("body"))
    content = F.when(F.col("body").isNull(), F.col("text")).otherwise(F.try_variant_get("body", "$.content", "string"))
    df = df.select(
        "conv_id", "turn", "role", content.alias("content"), F.try_variant_get("body", "$.tool_call_id", "string").alias("answers"),
        F.try_variant_get("body", "$.tool_calls", "array<variant>").alias("raw"),
    )

    def call(c: Column) -> Column:
        name, arguments = F.try_variant_get(c, NAME, "string"), F.try_variant_get(c, "$.arguments", "variant")
        return F.struct(
            arguments.alias("arguments"), F.try_variant_get(c, ID, "string").alias("id"), name.alias("name"), valid(name, arguments, schemas).alias("valid")
        )

    df = df.withColumn("calls", F.transform("raw", call)).drop("raw")
    written = F.when(F.size("calls") > 0, F.transform("calls", lambda c: F.struct(c["arguments"], c["id"], c["name"])))
    json = F.to_json(F.struct("content", "role", F.col("answers").alias("tool_call_id"), written.alias("tool_calls")))
    slim = F.coalesce(F.transform("calls", lambda c: F.struct(c["id"].alias("id"), c["valid"].alias("valid"))), F.array().cast("array<struct<id:string,valid:boolean>>"))
    return df.select("conv_id", "turn", "role", json.alias("json"), slim.alias("calls"), "answers")


def chain_positions(messages: DataFrame, first: DataFrame) -> DataFrame | None:
    """Positions (order_turn, order_step) of messages that answer a call and make calls; None if there are none.

    One row per conv_id, turn and answers, with the identifiers ``made``. A
    message is settled in the round after its call's message, so there are as
    many rounds as links in the longest chain, each written. Calls that wait for
    each other have no order: of those on a cycle, the smallest turn of a
    conversation (then identifier) is settled behind its call's own turn, and
    the rounds go on.
    """
    spark, key = messages.sparkSession, ["conv_id", "turn", "answers"]
    rows = messages.filter("answers is not null and size(calls) > 0 and conv_id is not null and turn is not null").select(*key, F.explode("calls.id").alias("id"))
    rows = rows.groupBy(*key).agg(F.collect_set("id").alias("made")).join(first.withColumnRenamed("call_id", "answers"), ["conv_id", "answers"], "left")
    nodes, n = Rounds(spark, "call-chains").add(rows.select(*key, "made", "call_turn"))
    if not n:
        return None
    above = nodes.select("conv_id", F.col("turn").alias("call_turn"), F.explode("made").alias("answers"), F.col("answers").alias("call_answers"))
    links, _ = Rounds(spark, "call-links").add(nodes.join(above, ["conv_id", "call_turn", "answers"]).select(*key, "call_turn", "call_answers"))

    def behind_turn(part: DataFrame) -> DataFrame:
        return part.select(*key, F.greatest("turn", "call_turn").cast("bigint").alias("order_turn"), F.lit(1).alias("order_step"))

    log = Rounds(spark, "call-order")
    log.add(behind_turn(nodes.join(links, key, "left_anti")))
    while True:
        settled = log.read().drop("round")
        of_call = settled.select("conv_id", F.col("turn").alias("call_turn"), F.col("answers").alias("call_answers"), F.struct("order_turn", "order_step").alias("o"))
        waits = links.join(settled.select(*key), key, "left_anti").join(of_call, ["conv_id", "call_turn", "call_answers"], "left")
        ready = waits.groupBy(*key).agg(F.max("o").alias("o"), F.bool_and(F.col("o").isNotNull()).alias("all")).filter("all")
        _, n = log.add(ready.select(*key, *behind(F.col("turn"), F.col("o.order_turn"), F.col("o.order_step"))))
        if n:
            continue
        live, left = Rounds(spark, "call-cycles"), -1
        rest, n = live.add(waits.filter("o is null").select(*key, "call_turn", "call_answers"))
        while n and n != left:  # drops what no waiting message hangs on, so cycles stay
            left = n
            asked = rest.select("conv_id", F.col("call_turn").alias("turn"), F.col("call_answers").alias("answers")).distinct()
            rest, n = live.add(rest.join(asked, key, "left_semi"))
        if not n:
            return nodes.select(*key, "made").join(settled, key)
        log.add(behind_turn(rest.groupBy("conv_id").agg(F.min(F.struct("turn", "answers", "call_turn")).alias("m")).select("conv_id", "m.*")))


def behind(turn: Column, call_turn: Column, call_step: Column) -> tuple[Column, Column]:
    """Position of a result: at its own turn, or a step behind its call's position if that is not before it."""
    late = turn > call_turn
    return F.when(late, turn).otherwise(call_turn).cast("bigint").alias("order_turn"), F.when(late, 1).otherwise(call_step + 1).alias("order_step")


def format_messages(
    df: DataFrame, schemas: Mapping[str, Mapping], conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per message: conv_id, turn, role, order_turn, order_step, n_calls, n_valid, n_answered, linked and json.

    Messages in the order (order_turn, order_step, turn) have every result after
    its call: a result has step 1 at its own turn or, if its call is ordered at
    that turn or later, the step after its call's; all others have step 0 at
    their own turn. Calls on a cycle: see ``chain_positions``. ``linked`` tells of a result whether its call
    exists and is null for other messages; an identifier used twice in a
    conversation means the call of the smallest turn. ``n_answered`` counts the
    different identifiers called in this turn of the conversation that some
    result answers.

    A null text gives a message without content. Text is read as
    an object only if that has tool_calls or tool_call_id; all other text,
    whatever it looks like, is content as it stands. Calls without an identifier link with nothing, as do
    messages with a null conversation or turn. Repeated rows come back as given;
    other columns are not read; an empty table gives no rows.
    """
    messages = materialise(parsed(df, schemas, conv_col, turn_col, role_col, text_col), "messages")
    called = messages.filter("size(calls) > 0").select("conv_id", "turn", F.explode("calls.id").alias("call_id")).filter("call_id is not null")
    first = called.groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"))
    results = messages.filter("answers is not null").select("conv_id", F.col("answers").alias("call_id")).distinct()
    answered = called.distinct().join(results, ["conv_id", "call_id"], "left_semi").groupBy("conv_id", "turn").agg(F.count("*").alias("n_answered"))

    def rows(part: DataFrame, order: tuple[Column, Column], linked: Column, n_answered: Column) -> DataFrame:
        return part.select(
            "conv_id", "turn", "role", order[0].cast("bigint").alias("order_turn"), order[1].cast("int").alias("order_step"),
            F.size("calls").alias("n_calls"), F.size(F.filter("calls", lambda c: c["valid"])).alias("n_valid"),
            n_answered.alias("n_answered"), linked.alias("linked"), "json",
        )

    none, zero = F.lit(None), F.lit(0).cast("bigint")
    plain = messages.filter("answers is null and size(calls) = 0")
    calls = messages.filter("answers is null and size(calls) > 0").join(answered, ["conv_id", "turn"], "left")
    found = messages.filter("answers is not null").withColumnRenamed("answers", "call_id").join(first, ["conv_id", "call_id"], "left").join(
        answered, ["conv_id", "turn"], "left"
    )
    own = (F.greatest("turn", "call_turn"), F.lit(1))
    chain = chain_positions(messages, first)
    if chain is not None:
        placed = chain.select("conv_id", "turn", F.col("answers").alias("call_id"), F.struct("order_turn", "order_step").alias("own"))
        calls_at = chain.select("conv_id", F.explode("made").alias("call_id"), F.col("turn").alias("call_turn"), F.struct("order_turn", "order_step").alias("o"))
        calls_at = calls_at.groupBy("conv_id", "call_id", "call_turn").agg(F.max("o").alias("at"))
        found = found.join(calls_at, ["conv_id", "call_id", "call_turn"], "left").join(placed, ["conv_id", "turn", "call_id"], "left")
        after = behind(F.col("turn"), F.coalesce("at.order_turn", "call_turn"), F.coalesce("at.order_step", F.lit(0)))
        own = tuple(
            F.when((F.size("calls") > 0) & F.col("own").isNotNull(), F.col(f"own.{name}")).when(F.col("call_turn").isNull(), alone).otherwise(x)
            for name, alone, x in (("order_turn", F.col("turn"), after[0]), ("order_step", F.lit(1), after[1]))
        )
    found = found.withColumnRenamed("call_id", "answers")
    out = rows(plain, (F.col("turn"), zero), none.cast("boolean"), zero)
    out = out.union(rows(calls, (F.col("turn"), zero), none.cast("boolean"), F.coalesce("n_answered", zero)))
    return out.union(rows(found, own, F.col("call_turn").isNotNull(), F.coalesce("n_answered", zero)))
