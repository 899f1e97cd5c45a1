"""The registered queries, each beside its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from observatory.llm import blob_ledger, chat, conversation_repair, embedding_dedup, hnsw, language, mixing, packing, pii, quality, ranked_search, simhash, toxicity
from observatory.llm.batches import bound_batches
from observatory.llm.registry import query, table


def mix_sql(docs: str) -> str:
    """op3 over a table expression, as one ordered running sum per source."""
    return f"""
WITH m AS (SELECT doc_id, source, text,
      CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
      substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), '-'), ':', coalesce(md5(text), '-'))), 1, 15) AS hash FROM {docs}),
 t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY source),
 w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 3 AS cap FROM t),
 o AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM w),
 f AS (SELECT *, CAST((SELECT sum(source_size) FROM t) - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lft,
      CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws,
      row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos FROM o),
 p AS (SELECT lft, ws FROM f WHERE CAST(lft AS DOUBLE) * w <= CAST(cap AS DOUBLE) * ws ORDER BY pos LIMIT 1),
 g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(CAST(w * p.lft AS DOUBLE) / CAST(p.ws AS DOUBLE), CAST(cap AS DOUBLE))) AS target FROM f LEFT JOIN p ON true),
 k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
 r AS (SELECT m.*, source_size, target, whole, target - whole * source_size AS rest,
      sum(size) OVER (PARTITION BY m.source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
      sum(size) OVER (PARTITION BY m.source, hash) AS own FROM m JOIN k ON m.source IS NOT DISTINCT FROM k.source),
 c AS (SELECT *, whole + CASE WHEN rest > 0 AND CAST(2 * upto - own AS DOUBLE) <= 2 * rest THEN 1 ELSE 0 END AS copies FROM r)
"""


@query(
    "op3_source_mix",
    mix_sql("documents") + "SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM c",
)
def op3_source_mix(spark, sf):
    out = mixing.mix(table(spark, sf, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op10_packing")
def op10_packing(spark, sf):
    import public_tokenizers

    bound_batches(spark)
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_simhash")
def op8_simhash(spark, sf):
    bound_batches(spark)
    out = simhash.near_duplicates(table(spark, sf, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_language")
def op5_language(spark, sf):
    bound_batches(spark)
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(language.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = language.learn(docs.filter(~held_out).select("doc_id", "text", "lang"))
    out = language.label_texts(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def toxicity_model(spark, sf, docs):
    """Learned from the labels outside the held-out fold."""
    known = table(spark, sf, "labels").filter(toxicity.fold(F.col("doc_id")) != 2)
    return toxicity.learn(docs, known.select("doc_id", "toxic"))


@query("op2_toxicity")
def op2_toxicity(spark, sf):
    bound_batches(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = toxicity.score_texts(docs, toxicity_model(spark, sf, docs))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "matches")


@query("op4_embedding_dedup")
def op4_embedding_dedup(spark, sf):
    out = embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


@query("op7_nearest")
def op7_nearest(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return hnsw.search(hnsw.build_index(vectors), vectors.filter("vec_id % 100 = 0"))


@query("op9_pii")
def op9_pii(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = pii.find(docs, pii.fit(docs))
    counts = [F.size(pii.of_kind(F.col("base_spans"), i)).cast("bigint").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return out.select("doc_id", *counts, F.sha2(pii.written(F.col("base_spans")), 256).alias("base_sha256"), pii.written(F.col("all_spans")).alias("spans"))


@query("op1_quality")
def op1_quality(spark, sf):
    bound_batches(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = quality.score_texts(docs, quality.learn(docs))
    return out.select("doc_id", "posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SCHEMAS = {"count": {"properties": {"chars": "integer", "words": "integer", "deep": "boolean"}, "required": ["chars", "words"]}}

# Assistant turns call a tool on their text, user turns from the second on are its results; some calls break the schema, some results come early.
CALLS = """
 SELECT conv_id, turn, role, text,
   role = 'assistant' AND (conv_id + turn) % 3 <> 0 AS calls, role = 'user' AND turn >= 2 AND conv_id % 2 = 0 AS answers,
   (conv_id + turn) % 5 = 0 AS as_text, (conv_id + turn) % 7 = 0 AS no_words, length(text) AS chars, length(text) - length(replace(text, ' ', '')) + 1 AS words,
   CASE WHEN role = 'user' AND turn >= 2 AND conv_id % 8 = 0 THEN turn - 2 ELSE turn END AS spot
 FROM conversations"""

_ID = "concat('call_', conv_id, '_', {turn})"


@query(
    "op6_chat_format",
    f"""
WITH m AS ({CALLS}),
 a AS (SELECT *, {_ID.format(turn='turn')} AS own, {_ID.format(turn='turn - 1')} AS wanted,
   concat('{{', CASE WHEN as_text THEN concat('"chars":"', chars, '"') ELSE concat('"chars":', chars) END, ',"deep":true', CASE WHEN no_words THEN '' ELSE concat(',"words":', words) END, '}}') AS args FROM m),
 f AS (SELECT conv_id, own, min(spot) AS call_turn FROM a WHERE calls GROUP BY ALL),
 d AS (SELECT c.conv_id, c.spot, count(DISTINCT c.own) AS n_answered FROM a c JOIN a r ON r.answers AND r.conv_id = c.conv_id AND r.wanted = c.own WHERE c.calls GROUP BY ALL)
SELECT a.conv_id, a.spot AS turn, CASE WHEN answers THEN 'tool' ELSE role END AS role,
  CASE WHEN answers THEN greatest(a.spot, coalesce(f.call_turn, a.spot)) ELSE a.spot END AS order_turn, CAST(answers AS INTEGER) AS order_step,
  CAST(calls AS INTEGER) AS n_calls, CAST(calls AND NOT as_text AND NOT no_words AS INTEGER) AS n_valid,
  CASE WHEN calls OR answers THEN coalesce(d.n_answered, 0) ELSE 0 END AS n_answered, CASE WHEN answers THEN f.call_turn IS NOT NULL END AS linked,
  concat('{{', CASE WHEN text IS NOT NULL THEN concat('"content":', to_json(text), ',') ELSE '' END, '"role":', to_json(CASE WHEN answers THEN 'tool' ELSE role END),
    CASE WHEN answers THEN concat(',"tool_call_id":"', wanted, '"') ELSE '' END,
    CASE WHEN calls THEN concat(',"tool_calls":[{{"arguments":', args, ',"id":"', a.own, '","name":"count"}}]') ELSE '' END, '}}') AS json
FROM a LEFT JOIN f ON a.answers AND f.conv_id = a.conv_id AND f.own = a.wanted LEFT JOIN d ON d.conv_id = a.conv_id AND d.spot = a.spot
""",
)
def op6_chat_format(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("conversations")
    m = spark.sql(CALLS)
    own, of = F.concat(F.lit("call_"), "conv_id", F.lit("_"), "turn"), F.concat(F.lit("call_"), "conv_id", F.lit("_"), F.col("turn") - 1)
    words = F.when(~F.col("no_words"), F.col("words"))
    number = F.struct(F.col("chars").alias("chars"), words.alias("words"), F.lit(True).alias("deep"))
    wrong = F.struct(F.col("chars").cast("string").alias("chars"), words.alias("words"), F.lit(True).alias("deep"))
    call = lambda arguments: F.to_json(F.struct(F.array(F.struct(F.lit("count").alias("name"), own.alias("id"), arguments.alias("arguments"))).alias("tool_calls"), "content"))
    m = m.withColumnRenamed("text", "content")
    text = F.when(F.col("calls"), F.when(F.col("as_text"), call(wrong)).otherwise(call(number)))
    text = F.when(F.col("answers"), F.to_json(F.struct("content", of.alias("tool_call_id")))).otherwise(F.coalesce(text, F.col("content")))
    role = F.when(F.col("answers"), "tool").otherwise(F.col("role"))
    return chat.format_messages(m.select("conv_id", F.col("spot").alias("turn"), role.alias("role"), text.alias("text")), SCHEMAS)


def _found_sql(i: int, rule: blob_ledger.Rule) -> str:
    """Matches by their places: what lies between them is what the text splits into."""
    p = rule.pattern.replace("'", "''")
    return f"""SELECT rid, {i} AS rank, '{rule.kind}' AS kind, length(array_to_string(ps[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) AS s, length(ms[i]) AS n FROM (
  SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {rule.group}) AS gs, string_split_regex(t, '{p}') AS ps FROM d)) WHERE length(gs[i]) >= {rule.least}"""


@query(
    "op12_secret_scan",
    f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
 f AS ({" UNION ALL ".join(_found_sql(i, r) for i, r in enumerate(blob_ledger.RULES))}),
 g AS (SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
   string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + n AS BIGINT)), ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
   string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + n AS BIGINT)), ',' ORDER BY s, rank) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)""",
)
def op12_secret_scan(spark, sf):
    bound_batches(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ledger = blob_ledger.scan(docs, blob_ledger.empty_ledger(spark))
    out = blob_ledger.findings(docs, ledger)
    counts = [F.size(blob_ledger.of_kinds(F.col("spans"), [r])).cast("bigint").alias(f"n_{r.kind}") for r in blob_ledger.BASE]
    base = blob_ledger.written(blob_ledger.of_kinds(F.col("spans"), blob_ledger.BASE))
    return out.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), blob_ledger.written(F.col("spans")).alias("spans"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(
    "op13_ranked_search",
    f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
 c AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_all, CAST(sum(len(ts)) AS BIGINT) AS l_all FROM d),
 i AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
 p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000e0 * ln((2e0 * n_all + 2) / (2e0 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_all),
 s AS (SELECT item_id, rid, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all)))) AS BIGINT) AS score
   FROM p JOIN w USING (term) JOIN i USING (term), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
)
def op13_ranked_search(spark, sf):
    bound_batches(spark)
    return ranked_search.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def damaged(conversations):
    """Messages with a number of copies: dropped, emptied, cut, repeated or given to the user by the remainder of their key's checksum."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    rest = F.crc32(key) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(rest == 4, "user").otherwise(role).alias("role"), F.when(rest == 1, "").when(rest == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(rest == 0, 0).when(rest == 3, 2).otherwise(1).alias("copies"),
    )


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


# Costs before a row from those behind it (v), and then with inserts before it.
_STEP = """SELECT conv, pos, c0, least(w1, 3 + c2) AS c1, c2, c3 FROM (SELECT *, least(w0, 3 + c2) AS c0 FROM (SELECT *, least(w2, 3 + w3) AS c2, least(w3, 3 + w2) AS c3 FROM (
  SELECT r.conv, r.pos, CASE WHEN gone THEN 4 + v0 ELSE least(4 + v0, CASE WHEN ini = 's' THEN t + v1 ELSE 99 + v0 END, t + v2 + CASE WHEN ini = 'u' THEN 0 ELSE 3 END) END AS w0,
   CASE WHEN gone THEN 4 + v1 ELSE least(4 + v1, t + v2 + CASE WHEN ini = 'u' THEN 0 ELSE 3 END) END AS w1,
   CASE WHEN gone THEN 4 + v2 ELSE least(4 + v2, t + v3 + CASE WHEN ini = 'a' THEN 0 ELSE 3 END) END AS w2,
   CASE WHEN gone THEN 4 + v3 ELSE least(4 + v3, t + v2 + CASE WHEN ini = 'u' THEN 0 ELSE 3 END) END AS w3
  FROM b JOIN r ON r.conv = b.conv AND r.pos = b.pos - 1)))"""
# One letter a step: the least that keeps to the least cost.
_WALK = """SELECT conv, CASE WHEN letter = 'I' THEN pos ELSE pos + 1 END, CASE letter WHEN 'D' THEN state WHEN 'K' THEN CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE nxt END, audit || letter,
   CASE WHEN letter = 'D' THEN lines ELSE list_append(lines, CASE WHEN letter = 'K' THEN role WHEN nxt = 2 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END) END
  FROM (SELECT *, CASE WHEN pos > n THEN CASE WHEN state IN (1, 2) THEN 'I' END WHEN here = 4 + behind THEN 'D' WHEN here = 3 + other THEN 'I' WHEN ini = CASE nxt WHEN 2 THEN 'u' ELSE 'a' END OR (state = 0 AND ini = 's' AND here = t + back1) THEN 'K' ELSE 'R' END AS letter FROM (
   SELECT f.*, r.role, r.text, r.ini, r.t, c.n, CASE WHEN f.state = 2 THEN 3 ELSE 2 END AS nxt, [x.v0, x.v1, x.v2, x.v3][f.state + 1] AS here, CASE WHEN f.state = 2 THEN x.v3 ELSE x.v2 END AS other, [y.v0, y.v1, y.v2, y.v3][f.state + 1] AS behind, y.v1 AS back1
   FROM f JOIN c ON c.conv = f.conv LEFT JOIN r ON r.conv = f.conv AND r.pos = f.pos LEFT JOIN b x ON x.conv = f.conv AND x.pos = f.pos LEFT JOIN b y ON y.conv = f.conv AND y.pos = f.pos + 1)) WHERE letter IS NOT NULL"""


@query(
    "op11_conversation_repair",
    f"""WITH RECURSIVE q AS (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
 crc AS (SELECT DISTINCT key, 1 AS i, CAST(4294967295 AS BIGINT) AS x FROM q
  UNION ALL SELECT key, i + 1, xor(x >> 8, {_crc_table()}[1 + (xor(x, CAST(ascii(substr(key, i, 1)) AS BIGINT)) & 255)]) FROM crc WHERE i <= length(key)),
 z AS (SELECT q.*, xor(x, 4294967295) % 20 AS h FROM q JOIN crc ON crc.key = q.key AND i = length(q.key) + 1),
 a AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
   CASE h WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z),
 k AS (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '-') AS conv FROM conversations),
 o AS (SELECT a.*, conv, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
   FROM a JOIN k ON a.conv_id IS NOT DISTINCT FROM k.conv_id),
 d AS (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS dup FROM o),
 r AS (SELECT *, blank OR dup AS gone, left(role, 1) AS ini, CASE WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS t, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS prev FROM d),
 c AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
   count(*) FILTER (WHERE NOT gone AND t = 3) AS truncated, count(*) FILTER (WHERE prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv),
 b AS (SELECT conv, n + 1 AS pos, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM c UNION ALL {_STEP}),
 f AS (SELECT conv, CAST(1 AS BIGINT) AS pos, 0 AS state, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM c UNION ALL {_WALK}),
 e AS (SELECT f.* FROM f JOIN c USING (conv) WHERE pos = n + 1 AND state IN (0, 3))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.v0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM k LEFT JOIN c USING (conv) LEFT JOIN b ON b.conv = k.conv AND b.pos = 1 LEFT JOIN e ON e.conv = k.conv""",
)
def op11_conversation_repair(spark, sf):
    bound_batches(spark)
    repaired = conversation_repair.repair(damaged(table(spark, sf, "conversations")), copies_col="copies")
    return conversation_repair.reports(repaired)
