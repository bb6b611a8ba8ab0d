"""Requests, collation, joins and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.bridges import block_of, table, text
from rungwise.functions.prompts import ANSWER_INSTRUCTIONS, build_messages
from rungwise.functions.text import canon, question_key
from rungwise.operators import collate, requests
from rungwise.operators.ordering import rank_in_key
from rungwise.queries.registry import query


@query(
    """
SELECT doc_id, id, length(premise) AS premise_length, canon_question FROM (
  SELECT doc_id, lang AS id, text AS premise, lower(source) AS canon_question,
    row_number() OVER (PARTITION BY lang, text, source ORDER BY doc_id) AS k FROM documents
) WHERE k = 1
"""
)
def dedup_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-2, TXT-2, TXT-12: first document per (language, text, source)."""
    questions = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("id"), F.col("text").alias("premise"), F.col("source").alias("question")
    )
    return requests.dedup_questions(questions, ["doc_id"]).select(
        "doc_id",
        "id",
        F.length("premise").alias("premise_length"),
        canon(text("  ", F.upper("question"), "\n")).alias("canon_question"),
    )


@query(
    """
SELECT count(*) AS n_rows, count(DISTINCT (lang, text, source)) AS n_keys, min(length(sha1(text))) AS digest_length FROM documents
"""
)
def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-12: as many digests as distinct questions."""
    return (
        table(spark, sf_dir, "documents")
        .select(question_key(F.col("lang"), F.col("text"), F.col("source")).alias("k"))
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("n_rows"),
            F.count(F.lit(1)).alias("n_keys"),
            F.min(F.length("k")).cast("bigint").alias("digest_length"),
        )
    )


def _instruction_case_sql(profile: str, family: str) -> str:
    cases = " ".join(
        f"WHEN '{name}' THEN '{wording}'" for name, wording in ANSWER_INSTRUCTIONS[profile].items()
    )
    return f"CASE {family} {cases} ELSE '' END"


_FAMILY_SQL = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'FOLIO' WHEN '2-HIGH' THEN 'esnli' WHEN '3-MEDIUM' THEN 'qasc' "
    "WHEN '4-NOT SPECIFIED' THEN 'ar_lsat' ELSE 'unknown' END"
)


@query(
    f"""
WITH q AS (
  SELECT o_orderkey, {_FAMILY_SQL} || '_' || o_custkey AS id, lower(split_part({_FAMILY_SQL}, '_', 1)) AS family, o_orderstatus FROM orders
), r AS (
  SELECT *, r.rep_idx AS rep_idx FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS rep_idx) r
), d AS (
  SELECT *, row_number() OVER (PARTITION BY id, rep_idx ORDER BY o_orderkey) AS nth, {_instruction_case_sql('local', 'family')} AS instruction FROM r
)
SELECT o_orderkey, id || '__rep' || rep_idx || '__m' || CASE WHEN nth > 1 THEN '__dup' || (nth - 1) ELSE '' END AS custom_id,
  20250815 + rep_idx AS seed, 0.7::DOUBLE AS temperature,
  'Premise:' || chr(10) || 'status ' || o_orderstatus || chr(10) || chr(10) || 'Question:' || chr(10) || 'order ' || o_orderkey
  || CASE WHEN instruction <> '' THEN chr(10) || chr(10) || instruction ELSE '' END || chr(10) AS asked
FROM d
"""
)
def replicate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-1, TXT-9, TXT-11, TXT-14, WIN-2, JON-6: three requests per order with unique ids."""
    priority = F.col("o_orderpriority")
    family = (
        F.when(priority == "1-URGENT", "FOLIO")
        .when(priority == "2-HIGH", "esnli")
        .when(priority == "3-MEDIUM", "qasc")
        .when(priority == "4-NOT SPECIFIED", "ar_lsat")
        .otherwise("unknown")
    )
    questions = table(spark, sf_dir, "orders").select(
        "o_orderkey", text(family, "_", F.col("o_custkey")).alias("id"), "o_orderstatus"
    )
    replicas = requests.replicate(questions, samples=3, temperature=0.7)
    named = requests.unique_custom_ids(replicas, "m", ["o_orderkey"], block_of("o_orderkey"))
    messages = build_messages(
        text("status ", F.col("o_orderstatus")), text("order ", F.col("o_orderkey")), F.col("id"), "local"
    )
    return named.select("o_orderkey", "custom_id", "seed", "temperature", messages[1]["content"].alias("asked"))


@query(
    """
WITH k AS (
  SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS chunk_rank, user_id, event_type FROM events
), r AS (
  SELECT 'U' || (chunk_rank // 4) || '_' || user_id AS id, chunk_rank % 4 AS rep_idx, event_id, event_type FROM k
)
SELECT id, string_agg('E' || event_id, '|' ORDER BY rep_idx) AS generation, string_agg(event_type, '|' ORDER BY rep_idx) AS extracted_answer
FROM r WHERE rep_idx IN (0, 1, 2) AND event_type <> 'error' GROUP BY id
"""
)
def collate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3, AGG-4, FLT-4, WIN-2: replies of replicas 0, 1 and 2; ones without text leave a gap."""
    ranked = rank_in_key(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], block_of("event_id"), "nth")
    rank = F.col("nth") - 1
    replies = ranked.select(
        text("U", F.floor(rank / 4), "_", F.col("user_id")).alias("id"),
        (rank % 4).alias("rep_idx"),
        "event_id",
        F.when(F.col("event_type") != "error", text("E", F.col("event_id"))).alias("text"),
        F.col("event_type").alias("answer"),
    )
    # Each reply comes twice; the second copy must not count.
    twice = replies.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "text", F.when(F.col("copy") == 0, F.col("text")).otherwise(text("again ", F.col("text")))
    )
    records = collate.collate_replicas(collate.first_replies(twice, ["event_id", "copy"]))
    return records.select(
        "id",
        F.array_join("generation", "|").alias("generation"),
        F.array_join("extracted_answer", "|").alias("extracted_answer"),
    )


_CHUNKS_SQL = """
WITH k AS (
  SELECT user_id AS id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS record FROM events
)
SELECT id, record, count(*) AS n, string_agg('E' || event_id, '|' ORDER BY event_id) AS generation,
  string_agg(event_type, '|' ORDER BY event_id) AS extracted_answer
FROM k GROUP BY id, record
"""


def _chunks(spark: SparkSession, sf_dir: str, heavy_rows: int) -> DataFrame:
    replies = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), "event_id", text("E", F.col("event_id")).alias("text"), F.col("event_type").alias("answer")
    )
    # A small block length, so that heavy users have several blocks at any table size.
    block = F.floor(F.col("event_id") / 128)
    return collate.collate_chunks(replies, ["event_id"], block, heavy_rows=heavy_rows).select(
        "id",
        "record",
        F.size("generation").alias("n"),
        F.array_join("generation", "|").alias("generation"),
        F.array_join("extracted_answer", "|").alias("extracted_answer"),
    )


@query(_CHUNKS_SQL)
def collate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3, WIN-3: records of five events per user in event order."""
    return _chunks(spark, sf_dir, 1_000_000)


@query(_CHUNKS_SQL)
def collate_chunks_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a low limit, so that about half of the users count as heavy keys."""
    return _chunks(spark, sf_dir, 66)


@query(
    """
WITH t AS (
  SELECT o_custkey AS id, o_orderstatus AS answer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders
)
SELECT e.event_id, e.user_id AS id, t.answer FROM events e JOIN t ON e.user_id = t.id AND t.k = 1
"""
)
def join_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-1, SRC-3, FLT-3: events with the last order of the customer of that number."""
    truth = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("answer"), "o_orderkey"
    )
    # Customer 0 would count as having no id.
    keyed = collate.keyed_truth(truth.withColumn("id", F.col("id").cast("string")), ["o_orderkey"])
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("id"))
    return collate.join_truth(events, keyed.select("id", "answer")).select(
        "event_id", F.col("id").cast("bigint").alias("id"), "answer"
    )


@query(
    """
SELECT e.event_id, e.user_id AS id FROM events e WHERE e.user_id NOT IN (SELECT doc_id FROM labels)
"""
)
def unmatched_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-1: the rows the join drops."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"))
    truth = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return collate.without_truth(events, truth)


@query(
    """
SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""
)
def skip_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-2, SRC-5: documents without a label."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return collate.skip_processed(docs, done)


@query(
    """
SELECT doc_id, len(string_split_regex(text, '\\s+')) AS prompt_length FROM documents WHERE len(string_split_regex(text, '\\s+')) <= 300
"""
)
def prompt_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1: documents of at most 300 words."""
    words = F.size(F.split("text", r"\s+"))
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("prompt_length"))
    return requests.within_prompt_length(docs, F.col("prompt_length"), 300)


@query(
    """
SELECT event_id, user_id, rep_idx FROM (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rep_idx FROM events
) WHERE rep_idx IN (0, 1, 2)
"""
)
def replica_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3, FLT-4, WIN-2: first three events per user."""
    events = collate.with_id(table(spark, sf_dir, "events"), name="user_id")
    ranked = rank_in_key(events, ["user_id"], ["event_id"], block_of("event_id"), "nth")
    return collate.allowed_reps(ranked.withColumn("rep_idx", F.col("nth") - 1)).select("event_id", "user_id", "rep_idx")


@query(
    """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100
"""
)
def item_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6, LIM-1: the cap counts after the exclusion."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "doc_id", "lang")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return collate.item_cap(collate.skip_processed(docs, done), 100, ["doc_id"]).select("doc_id", "lang")


@query("SELECT event_id, user_id, value FROM events ORDER BY value, event_id LIMIT (SELECT count(*) // 3 FROM events)")
def item_cap_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6, LIM-1: a third of all events, by value; no task takes them all."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return collate.item_cap(events, events.count() // 3, ["value", "event_id"], few=0)
