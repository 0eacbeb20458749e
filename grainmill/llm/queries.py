"""The registered queries over the corpus tables: each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm import bpe, chat, decontaminate, license_scan, quality, simhash, substring, toxicity, url_filter, warc
from grainmill.llm._text import settled

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Argument schemas for the calls in conversations.
TOOLS = {"search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]}}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learnable(doc_id: str = "doc_id"):
    """The rows whose labels may be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no labels of their own: a page counts as labelled if a document of the same number is, bad if that is toxic or of low quality."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, labels, RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
    n_items = F.size("items").cast("bigint")
    items = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", decontaminate.n_hit().alias("n_hit"), n_items.alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", F.col("refers_to_key").alias("refers_to"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, width=3, max_bits=3).select("doc_id", "fingerprint", "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
    return found.select(F.col("id").alias("doc_id"), "canonical_sha256", "license_id", F.array_join("notices", ",").alias("notices"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = toxicity.classify(docs.select("doc_id", "text"), labels, learn_from=learnable())
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = chat.messages(_table(spark, sf_dir, "conversations"), TOOLS)
    return m.select("conv_id", "turn", "role", F.array_join(F.transform("rank", lambda x: x.cast("string")), ",").alias("rank"), "n_calls", "n_valid_calls", "n_open_calls", "link", "json")


def op8_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, keep=["doc_id"], decoded="decoded")
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = substring.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_chunks", "n_removed_words", "removed", F.sha2("text", 256).alias("text_sha256"))


def chat_built_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's operator with something to link: every user turn becomes a call, the assistant turn behind it its result. Every third call has an invalid argument, every fifth result an identifier that no call has."""
    m = _table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    number = lambda c: F.concat(F.lit("c"), c.cast("string"))
    limit = F.when(F.col("turn") % 3 == 1, F.lit('"many"')).otherwise(F.col("turn").cast("string"))
    query = F.substring(F.to_json(F.struct(F.col("text").alias("query"))), 2, 1 << 30)
    call = F.concat(F.lit('{"tool_calls": [{"id": "'), number(F.col("turn")), F.lit('", "name": "search", "arguments": {"limit": '), limit, F.lit(", "), query, F.lit("]}"))
    call = F.regexp_replace(call, r"\]\}$", "}]}")
    result = F.to_json(F.struct(F.when(F.col("turn") % 5 == 4, F.lit("lost")).otherwise(number(F.col("turn") - 1)).alias("tool_call_id"), F.col("text").alias("content")))
    built = m.withColumn("text", F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")))
    built = built.withColumn("role", F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")))
    got = chat.messages(built, TOOLS)
    return got.select("conv_id", "turn", "role", F.array_join(F.transform("rank", lambda x: x.cast("string")), ",").alias("rank"), "n_calls", "n_valid_calls", "n_open_calls", "link", "json")


def _licence_variants() -> list[tuple[int, str]]:
    """Known licence texts as files have them: under a title and a copyright line, in upper case, in the other spelling."""
    out = []
    for name, text in license_scan.KNOWN_TEXTS.items():
        title = license_scan.TITLES[name]
        out += [f"{title + chr(10) if title else ''}Copyright (c) 2020 Someone\n\n{text}", text.upper().replace(".", " ."), text.replace("license", "licence") + "\n", text + " Or so."]
    return [(-1 - k, t) for k, t in enumerate(out)]


def license_known_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's operator with whole texts to find: the known licences, varied, among all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(_licence_variants(), "doc_id bigint, text string"))
    found = license_scan.scan(docs)
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
    return found.select(F.col("id").alias("doc_id"), "canonical_sha256", "license_id", F.array_join("notices", ",").alias("notices"))


QUERIES = {f.__name__: f for f in (op1_url_templates, op2_decontaminate, op3_arc_to_warc, op4_simhash, op5_license_scan, op6_toxicity, op7_chat, op8_quality_lines, op9_byte_bpe, op10_gear_chunks, chat_built_calls, license_known_texts)}

WORD2 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_decontaminate": f"""
        WITH bi AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{WORD2}') ws FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(ws), 8) l, ws[p : p + least(len(ws), 8) - 1] w
               FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 8) + 2)) p FROM bi WHERE len(ws) > 0)),
        lens AS (SELECT DISTINCT l FROM bw),
        d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{WORD2}') ws FROM documents),
        dw AS (SELECT doc_id, l, p, ws[p : p + l - 1] w FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) p FROM d, lens WHERE len(ws) >= l)),
        hits AS (SELECT doc_id, l, p, item_id FROM dw JOIN bw USING (l, w)),
        covered AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, unnest(range(p, p + l)) q FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) s FROM hits GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT n_words, coalesce(covered.n, 0)::BIGINT n_hit, coalesce(items.n, 0)::BIGINT n_items, sha256(coalesce(s, '')) items_sha256, coalesce(items.n, 0) >= 2 contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') h, strlen(coalesce(html, ''))::BIGINT b FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY h) k FROM p)
        SELECT page_id, b payload_bytes, sha1(h) payload_digest, CASE WHEN b >= 1000 AND page_id <> k THEN 'revisit' ELSE 'response' END record_type, CASE WHEN b >= 1000 AND page_id <> k THEN k END refers_to FROM m""",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACE_RUN = r"[ \t\n\x0B\f\r]+"
_N_WORDS = f"len(list_filter(string_split_regex(x, '{_SPACE_RUN}'), lambda w: w <> ''))"
_PASSES = " AND ".join([
    f"right(rtrim(x, {_quoted(quality.CLOSERS)}), 1) IN ({', '.join(map(_quoted, quality.SENTENCE_ENDS))})",
    *(f"NOT contains(lower(x), {_quoted(b)})" for bs in quality.BOILERPLATE.values() for b in bs),
    f"NOT regexp_matches(x, {_quoted(quality.BARRED)})",
    f"NOT len(regexp_extract_all(x, '{quality.SYMBOL}')) > 0.1 * {_N_WORDS}",
    f"NOT regexp_matches(lower(x), {_quoted(quality.menu_pattern(quality.MENU_WORDS))})",
])

ORACLES["op8_quality_lines"] = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE_RUN}'), lambda w: w <> '') ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) lines FROM documents),
    win AS (SELECT doc_id, p, ws[p : p + 2] w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) p FROM d)),
    rep AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) c FROM win) WHERE c > 1) GROUP BY 1),
    m AS (SELECT doc_id, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars, len(regexp_extract_all(t, '{quality.SYMBOL}'))::BIGINT n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT n_dup_lines, coalesce(n, 0)::BIGINT n_repeat_words,
        coalesce(list_sum(list_transform(list_filter(list_distinct(lines), lambda x: {_PASSES}), lambda x: {_N_WORDS})), 0)::BIGINT kept_words FROM d LEFT JOIN rep USING (doc_id))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_words >= 0.5 * n_words AS kept FROM m"""


def _canonical(c: str) -> str:
    c = f"lower({c})"
    c = f"regexp_replace({c}, {_quoted(license_scan.COPYRIGHT_LINE)}, '', 'g')"
    for a, b in license_scan.SPELLINGS.items():
        c = f"replace({c}, {_quoted(a)}, {_quoted(b)})"
    return f"trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_TEXTS = [("text", k, t) for k, v in license_scan.KNOWN_TEXTS.items() for t in [v, *([f"{license_scan.TITLES[k]}\n{v}"] if license_scan.TITLES[k] else [])]]
_LINES = [("line", k, f.format(n)) for k, names in license_scan.NAMES.items() for n in names for f in license_scan.FRAMES]

ORACLES["op5_license_scan"] = f"""
    WITH known AS (SELECT unit, sha256({_canonical("t")}) digest, min(license_id) license_id FROM (VALUES {", ".join(f"({_quoted(u)}, {_quoted(k)}, {_quoted(t)})" for u, k, t in _TEXTS + _LINES)}) v(unit, license_id, t) GROUP BY ALL),
    d AS (SELECT doc_id, coalesce(text, '') t, sha256({_canonical("coalesce(text, '')")}) canonical_sha256 FROM documents),
    l AS (SELECT doc_id, sha256({_canonical("x")}) digest FROM (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM d)),
    n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) notices FROM l JOIN known USING (digest) WHERE unit = 'line' GROUP BY 1)
    SELECT doc_id, canonical_sha256, license_id, coalesce(notices, '') notices FROM d LEFT JOIN (SELECT * FROM known WHERE unit = 'text') k ON k.digest = canonical_sha256 LEFT JOIN n USING (doc_id)"""

#: No turn of these tables holds a call or a result, so SQL has plain messages to compare; linking, order and validation are covered by tests.
ORACLES["op7_chat"] = """
    SELECT conv_id, turn, role, turn || ',0,0,' || turn AS rank, 0::BIGINT n_calls, 0::BIGINT n_valid_calls, 0::BIGINT n_open_calls, NULL::VARCHAR link,
        '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json FROM conversations"""

ORACLES["license_known_texts"] = ORACLES["op5_license_scan"].replace("FROM documents)", f"FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f'({i}, {_quoted(t)})' for i, t in _licence_variants())}) v(doc_id, text)))")

ORACLES["chat_built_calls"] = """
    WITH m AS (SELECT conv_id, turn, role, to_json(coalesce(text, ''))::VARCHAR t, text FROM conversations),
    j AS (SELECT m.*, m.role = 'assistant' AND m.turn % 5 <> 4 AND c.turn IS NOT NULL AS linked, m.role = 'user' AND r.turn IS NULL AS open
        FROM m LEFT JOIN m c ON c.conv_id = m.conv_id AND c.turn = m.turn - 1 AND c.role = 'user'
        LEFT JOIN m r ON r.conv_id = m.conv_id AND r.turn = m.turn + 1 AND r.role = 'assistant' AND r.turn % 5 <> 4)
    SELECT conv_id, turn, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'tool' ELSE role END AS role,
        CASE WHEN linked THEN (turn - 1) || ',1,0,' || turn ELSE turn || ',0,0,' || turn END AS rank,
        (role = 'user')::BIGINT n_calls, (role = 'user' AND turn % 3 <> 1)::BIGINT n_valid_calls, open::BIGINT n_open_calls,
        CASE WHEN linked THEN 'linked' WHEN role = 'assistant' THEN 'unmatched' END AS link,
        CASE role
            WHEN 'user' THEN '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"limit":' || CASE WHEN turn % 3 = 1 THEN '"many"' ELSE turn::VARCHAR END || ',"query":' || t || '},"id":"c' || turn || '","name":"search"}]}'
            WHEN 'assistant' THEN '{"content":' || t || ',"role":"tool","tool_call_id":"' || CASE WHEN turn % 5 = 4 THEN 'lost' ELSE 'c' || (turn - 1) END || '"}'
            ELSE '{"content":' || t || ',"role":' || to_json(role)::VARCHAR || '}' END AS json
    FROM j"""
