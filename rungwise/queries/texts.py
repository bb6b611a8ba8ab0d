"""Text functions, step parsing and formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.bridges import order_texts, table, text
from rungwise.functions import text as T
from rungwise.functions.prompts import collapse_messages, fill, split_roles, unfilled
from rungwise.functions.steps import format_generation as print_generation
from rungwise.functions.steps import audit_generation, parse_generation, read_steps, unfiltered
from rungwise.queries.registry import query

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


@query(
    """
SELECT l_orderkey AS id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS step_pos,
  l_linenumber AS n, 'part ' || l_partkey || '|' || l_returnflag AS premises,
  'supplier ' || l_suppkey AS assumptions, 'line ' || l_linestatus AS conclusion
FROM lineitem
"""
)
def parse_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-1, GEN-2, GEN-4, SRT-1, EXP-2: step texts back to their lines."""
    parsed = order_texts(spark, sf_dir).select("id", parse_generation(F.col("text")).alias("g"))
    return parsed.select("id", F.posexplode(unfiltered(F.col("g.steps"))).alias("step_pos", "s")).select(
        "id",
        "step_pos",
        "s.n",
        F.array_join("s.premises", "|").alias("premises"),
        F.array_join("s.assumptions", "|").alias("assumptions"),
        "s.conclusion",
    )


@query(
    """
WITH g AS (
  SELECT l_orderkey AS id, list(l_linenumber ORDER BY l_partkey, l_suppkey, l_linenumber) AS ns, max(l_returnflag) AS final_tag
  FROM lineitem GROUP BY l_orderkey
)
SELECT id, final_tag, ns = list_sort(ns) AS step_order_ok, array_to_string(ns, ',') AS step_numbers,
  array_to_string(list_filter(range(1, list_max(ns) + 1), lambda x: NOT list_contains(ns, x)), ',') AS missing_steps,
  array_to_string(list_filter(range(1, list_max(ns) + 1), lambda x: len(list_filter(ns, lambda y: y = x)) > 1), ',') AS duplicate_steps
FROM g
"""
)
def audit_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-3, TXT-8a: order, gaps and repeats of step numbers."""
    parsed = order_texts(spark, sf_dir).select("id", audit_generation(F.col("text")).alias("g"))
    return parsed.select(
        "id",
        "g.final_tag",
        "g.step_order_ok",
        *[F.array_join(F.col(f"g.{c}").cast("array<string>"), ",").alias(c) for c in ("step_numbers", "missing_steps", "duplicate_steps")],
    )


@query(
    """
WITH s AS (
  SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k
  FROM lineitem
)
SELECT id, 'Reasoning:' || chr(10) || string_agg('Step ' || k || ':' || chr(10) || 'Premise: part ' || l_partkey || ' ' || l_returnflag
  || chr(10) || 'Assumption: supplier ' || l_suppkey || chr(10) || 'Conclusion: line ' || l_linestatus, chr(10) || chr(10) ORDER BY k)
  || chr(10) || 'Final answer: [' || max(l_returnflag) || ']' AS printed
FROM s GROUP BY id
"""
)
def format_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-5, TXT-1a: parsed texts printed in the pair format."""
    body = F.col("text")
    return order_texts(spark, sf_dir).select("id", print_generation(read_steps(body), T.answer_tag(body)).alias("printed"))


_REPLY_SQL = """CASE o_orderpriority
    WHEN '1-URGENT' THEN 'So <answer>' || o_orderstatus || '</answer> and <answer>X</answer>'
    WHEN '2-HIGH' THEN 'So < ANSWER > ' || o_orderstatus || ' </ answer >'
    WHEN '3-MEDIUM' THEN '- Sum ' || o_custkey || chr(10) || ' Final: <answer>' || o_orderstatus || '</answer> '
    WHEN '4-NOT SPECIFIED' THEN 'no tag'
    ELSE '<answer></answer>' END"""


@query(
    f"""
WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS p, o_orderstatus AS s, o_custkey AS c, {_REPLY_SQL} AS reply FROM orders)
SELECT id,
  CASE WHEN p = '4-NOT SPECIFIED' THEN NULL WHEN p = '5-LOW' THEN '' ELSE s END AS answer_tag,
  CASE WHEN p IN ('1-URGENT', '3-MEDIUM') THEN s ELSE '' END AS answer_or_empty,
  CASE WHEN p = '3-MEDIUM' THEN 'Sum ' || c ELSE reply END AS hypothesis
FROM r
"""
)
def answer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-6, TXT-8a, TXT-8b on five forms of a reply."""
    status, form = F.col("o_orderstatus"), F.col("o_orderpriority")
    reply = (
        F.when(form == "1-URGENT", text("So <answer>", status, "</answer> and <answer>X</answer>"))
        .when(form == "2-HIGH", text("So < ANSWER > ", status, " </ answer >"))
        .when(form == "3-MEDIUM", text("- Sum ", F.col("o_custkey"), "\n Final: <answer>", status, "</answer> "))
        .when(form == "4-NOT SPECIFIED", F.lit("no tag"))
        .otherwise(F.lit("<answer></answer>"))
    )
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("id"), reply.alias("reply"))
        .select(
            "id",
            T.answer_tag(F.col("reply")).alias("answer_tag"),
            T.answer_or_empty(F.col("reply")).alias("answer_or_empty"),
            T.hypothesis(F.col("reply")).alias("hypothesis"),
        )
    )


@query(
    f"""
WITH m AS (
  SELECT doc_id, text, regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g') AS marked FROM documents
), a AS (
  SELECT doc_id, text, list_filter(list_transform(string_split_regex(marked, '[\\x01\\n\\r]+'), lambda p: trim(p, ' -•' || chr(9))), lambda p: p <> '') AS atoms
  FROM m
)
SELECT doc_id, CASE WHEN len(atoms) > 0 THEN array_to_string(atoms, '|') ELSE trim(text, {_BLANKS}) END AS atoms,
  greatest(len(atoms), 1) AS n_atoms,
  regexp_replace(trim(text, {_BLANKS}), '\\s+', ' ', 'g') AS squeezed,
  array_to_string(list_transform(list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda s: trim(s, {_BLANKS})), lambda s: s <> ''),
    lambda s: regexp_replace(s, '^[-•]\\s*', '')), '|') AS bullets
FROM a
"""
)
def atomic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-3, TXT-4, TXT-5 on whole documents."""
    body = F.col("text")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text", T.atoms(body).alias("_a"))
        .select(
            "doc_id",
            F.array_join("_a", "|").alias("atoms"),
            F.size("_a").alias("n_atoms"),
            T.squeeze(body).alias("squeezed"),
            F.array_join(T.clean_bullets(body), "|").alias("bullets"),
        )
    )


@query(
    f"""
SELECT conv_id, string_agg(role || chr(10) || trim(text, {_BLANKS}) || chr(10), '' ORDER BY turn) || 'assistant' || chr(10) AS prompt
FROM conversations GROUP BY conv_id
"""
)
def collapse_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-14, TXT-15: chats as flat prompts. A chat is one record of a few turns."""
    turns = F.struct("turn", "role", F.col("text").alias("content"))
    chats = (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turns)).alias("messages"))
    )
    return chats.select("conv_id", collapse_messages(F.col("messages")).alias("prompt"))


@query(
    """
SELECT o_orderkey AS id, 'Order {o_orderkey} of ' || o_custkey AS system, 'Status ' || o_orderstatus || ' {left} ' || o_orderstatus AS user_text,
  'left' AS open_places
FROM (SELECT *, 1 AS one FROM orders)
""".replace("{o_orderkey}", "{key}")
)
def template_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-16: placeholders, open places, system and user part. A filled value is not filled again."""
    template = F.lit("SYSTEM: Order {a} of {b}\nUSER: Status {c} {left} {c}\n")
    filled = fill(template, a=F.lit("{key}"), b=F.col("o_custkey").cast("string"), c=F.col("o_orderstatus"))
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("id"), split_roles(filled).alias("_p"))
        .select(
            "id",
            F.col("_p.system").alias("system"),
            F.col("_p.user").alias("user_text"),
            F.array_join(unfilled(F.col("_p.user")), ",").alias("open_places"),
        )
    )


@query(
    """
SELECT event_id AS id, user_id || '; ' || event_type AS by_prefix,
  '1. ' || user_id || chr(10) || '2. ' || event_type AS by_list,
  user_id || chr(10) || event_type AS bare_list
FROM events
"""
)
def reply_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-17: thinking, code fences, prefixes and numbered lists."""
    user, kind = F.col("user_id"), F.col("event_type")
    fenced = text("<think>1. a</think> Sure ```text explanatory sentences: 1. ", user, "; 2. ", kind, " ``` bye")
    listed = text("<think>x</think>Here:\n1. ", user, "\n2. ", kind)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        T.clean_reply(fenced, "explanatory sentences:", True, True).alias("by_prefix"),
        T.clean_reply(listed, None, True, False).alias("by_list"),
        T.clean_reply(listed, "absent:", True, True).alias("bare_list"),
    )


@query(
    """
SELECT event_id AS id,
  CASE event_type WHEN 'error' THEN NULL ELSE 'user_' || user_id END AS base_id,
  CASE event_type WHEN 'error' THEN NULL ELSE event_id % 5 END AS rep_idx,
  CASE event_type WHEN 'click' THEN 'C' || event_id WHEN 'purchase' THEN 'P' || event_id WHEN 'view' THEN 'V' || event_id ELSE NULL END AS reply,
  CASE event_type WHEN 'click' THEN 'C' || event_id || '|7' WHEN 'purchase' THEN 'P' || event_id WHEN 'view' THEN '' ELSE '' END AS listed
FROM events
"""
)
def completion_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-7, TXT-10, TXT-13: reply envelopes in their three forms, and ones without a string."""
    at, kind = F.col("event_id"), F.col("event_type")
    choice = {
        "click": text('{"response":{"body":{"choices":[{"message":{"content":"C', at, '"}}]}},"x":["C', at, '",7]}'),
        "purchase": text('{"body":{"choices":[{"message":{"content":"P', at, '"}}]},"x":"P', at, '"}'),
        "view": text('{"response":{"body":{"choices":[{"text":"V', at, '"}]}},"x":null}'),
        "signup": text('{"response":{"body":{"choices":[{"message":{"content":5}}]}}}'),
    }
    line = F.lit("{}")
    for name, body in choice.items():
        line = F.when(kind == name, body).otherwise(line)
    custom_id = F.when(kind == "error", text("user_", F.col("user_id"), "_rep1_")).otherwise(
        text("user_", F.col("user_id"), "__rep", at % 5, "__m__rep9__")
    )
    v = F.col("v")
    return (
        table(spark, sf_dir, "events")
        .select(at.alias("id"), F.try_parse_json(line).alias("v"), custom_id.alias("c"))
        .select(
            "id",
            T.custom_id_base(F.col("c")).alias("base_id"),
            T.custom_id_rep(F.col("c")).alias("rep_idx"),
            T.completion_text(v).alias("reply"),
            F.array_join(T.as_list(F.try_variant_get(v, "$.x", "variant")), "|").alias("listed"),
        )
    )


@query(
    """
SELECT event_id AS id, 'IF ' || user_id || ' is here, THEN it is ' || event_type || '|no consequence' AS steps,
  'value ' || value AS assumptions,
  CASE event_type WHEN 'view' THEN 'Therefore, done' ELSE 'no consequence' END AS summary,
  user_id || ' is here.' AS condition, ' it is ' || event_type AS consequence,
  'S 1: First' || chr(10) || 'S 3: ' || event_type || chr(10) AS numbered
FROM events
"""
)
def explanation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-18, TXT-19, TXT-20: parts of a written explanation."""
    kind = F.col("event_type")
    written = text(
        "Step 1: IF ", F.col("user_id"), " is here, THEN it is ", kind, ": yes\nStep 2: no consequence\nAssumption: value ",
        F.col("value"), "\n", F.when(kind == "view", F.lit("Therefore, done")).otherwise(F.lit("Step 3: unended")),
    )
    return (
        table(spark, sf_dir, "events")
        .select(F.col("event_id").alias("id"), kind, T.explanation_parts(written).alias("p"))
        .withColumn("c", T.if_then(F.get("p.steps", F.lit(0))))
        .select(
            "id",
            F.array_join("p.steps", "|").alias("steps"),
            F.array_join("p.assumptions", "|").alias("assumptions"),
            "p.summary",
            "c.condition",
            "c.consequence",
            T.numbered_sentences(text("First.. ", kind, "."), "S ", ": ").alias("numbered"),
        )
    )
