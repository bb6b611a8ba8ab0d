"""Pair construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.bridges import table, text
from rungwise.functions.prompts import SYSTEM_TEXT, build_messages, collapse_messages
from rungwise.functions.steps import format_answer, format_step
from rungwise.operators.collate import union_sources
from rungwise.operators.pairs import (
    align_rewards,
    best_and_worst,
    dedup_pairs as drop_repeated_pairs,
    merge_longest,
    usable_reward,
    within_thresholds,
)
from rungwise.queries.registry import query

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]
_PROMPT_SQL = (
    "'system' || chr(10) || '" + SYSTEM_TEXT.replace("'", "''") + "' || chr(10) || 'user' || chr(10) || 'Premise:' "
    "|| chr(10) || 'order ' || id || chr(10) || chr(10) || 'Question:' || chr(10) || 'Which line?' || chr(10) "
    "|| chr(10) || 'Answer with exactly one label: yes or no.' || chr(10) || 'assistant' || chr(10)"
)


def _answer_sql(row: str) -> str:
    return (
        f"'Reasoning:' || chr(10) || 'Step 1:' || chr(10) || 'Premise: part ' || {row}.l_partkey || chr(10) || "
        f"'Assumption: supplier ' || {row}.l_suppkey || chr(10) || 'Conclusion: line ' || {row}.l_linenumber "
        f"|| chr(10) || 'Final answer: [' || {row}.l_linenumber || ']'"
    )


_PAIRS_SQL = f"""
WITH g AS (
  SELECT l_orderkey AS id, round(l_discount * 10, 6) AS reward, l_linenumber, l_partkey, l_suppkey
  FROM lineitem WHERE round(l_discount * 10, 6) <> 0
), r AS (
  SELECT *, count(*) OVER (PARTITION BY id) AS n,
    row_number() OVER (PARTITION BY id ORDER BY reward DESC, l_linenumber, l_partkey, l_suppkey) AS hi,
    row_number() OVER (PARTITION BY id ORDER BY reward, l_linenumber, l_partkey, l_suppkey) AS lo
  FROM g
)
SELECT b.id AS id, {_PROMPT_SQL.replace('|| id ||', '|| b.id ||')} AS question,
  {_answer_sql('b')} AS good_answer, {_answer_sql('w')} AS bad_answer,
  b.reward AS reward_good, w.reward AS reward_bad
FROM r b JOIN r w ON b.id = w.id AND b.hi = 1 AND w.lo = 1
WHERE b.n >= 2 AND b.reward > 0.5 AND w.reward < 0.5
"""


@query(_PAIRS_SQL)
def pairs_best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2, AGG-2, TOP-1, FLT-5, TXT-14, TXT-15, GEN-5. Texts are made for the two winners only."""
    generations = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("id"),
            *_ORDER,
            usable_reward(F.round(F.col("l_discount") * 10, 6)).alias("reward"),
        )
        .filter("reward is not null")
    )
    chosen = within_thresholds(best_and_worst(generations, "id", "reward", _ORDER, _ORDER))

    def answer(side: str):
        at = F.col(f"{side}.l_linenumber")
        step = format_step(
            F.lit(1),
            text("part ", F.col(f"{side}.l_partkey")),
            text("supplier ", F.col(f"{side}.l_suppkey")),
            text("line ", at),
        )
        return format_answer(step, at.cast("string"))

    family = text("multilogieval_", F.col("id"))
    messages = build_messages(text("order ", F.col("id")), F.lit("Which line?"), family)
    return chosen.select(
        "id",
        collapse_messages(messages).alias("question"),
        answer("best").alias("good_answer"),
        answer("worst").alias("bad_answer"),
        F.col("best.reward").alias("reward_good"),
        F.col("worst.reward").alias("reward_bad"),
    )


@query(
    """
WITH u AS (
  SELECT l_orderkey AS id, 'q' AS q, round(l_discount * 10, 6) AS reward, l_linenumber, l_partkey, l_suppkey FROM lineitem
), p AS (
  SELECT id, max(reward) AS hi, min(reward) AS lo FROM u WHERE reward <> 0 GROUP BY id HAVING count(*) >= 2
)
SELECT id, 'Order ' || id AS question, 'Best ' || hi AS good_answer, 'Worst  of all' AS bad_answer, 0 AS src FROM p
"""
)
def dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-1, SET-3: pairs and a copy of them that differs in case and blanks only."""
    usable = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("id"), usable_reward(F.round(F.col("l_discount") * 10, 6)).alias("reward"))
        .filter("reward is not null")
        .groupBy("id")
        .agg(F.max("reward").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter("n >= 2")
    )
    pairs = usable.select(
        "id",
        text("Order ", F.col("id")).alias("question"),
        text("Best ", F.col("hi")).alias("good_answer"),
        F.lit("Worst  of all").alias("bad_answer"),
    )
    copy = usable.select(
        "id",
        text(" ORDER\t", F.col("id")).alias("question"),
        text("best \n", F.col("hi"), " ").alias("good_answer"),
        F.lit("worst OF  all").alias("bad_answer"),
    )
    return drop_repeated_pairs(union_sources(pairs, copy), ["src"])


@query(
    """
WITH u AS (
  SELECT doc_id % 97 AS id, text AS premise, source || ' ' || lang AS question, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS src, doc_id
  FROM documents
), p AS (
  SELECT id, premise, row_number() OVER (PARTITION BY id ORDER BY length(premise) DESC, src, doc_id) AS k FROM u
), q AS (
  SELECT id, question, row_number() OVER (PARTITION BY id ORDER BY length(question) DESC, src, doc_id) AS k FROM u
)
SELECT p.id AS id, p.premise AS premise, q.question AS question FROM p JOIN q ON p.id = q.id AND p.k = 1 AND q.k = 1
"""
)
def merge_longest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1, SET-1: longest premise and longest question per id over two sources."""
    docs = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 97).alias("id"),
        F.col("text").alias("premise"),
        text(F.col("source"), " ", F.col("lang")).alias("question"),
        "doc_id",
        "lang",
    )
    sources = union_sources(docs.filter("lang = 'en'"), docs.filter("lang != 'en'"))
    return merge_longest(sources, "id", ["premise", "question"], ["src", "doc_id"])


@query(
    """
WITH l AS (
  SELECT l_orderkey AS id, o_orderpriority, l_discount, l_tax, l_partkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS gen_pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
SELECT id, gen_pos, 'part ' || l_partkey AS generation,
  CASE WHEN o_orderpriority = '1-URGENT' THEN l_tax ELSE l_discount END AS reward
FROM l
"""
)
def align_rewards_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-3, EXP-2: reward lists of the right and, for urgent orders, of the wrong length."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    packed = lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(*_ORDER, "l_discount", "l_tax"))).alias("_l")
    )
    records = packed.join(orders, "id").select(
        "id",
        F.transform(
            "_l", lambda s: F.struct(text("part ", s["l_partkey"]).alias("text"), s["l_tax"].alias("reward"))
        ).alias("generations"),
        F.when(
            F.col("o_orderpriority") == "1-URGENT",
            F.concat(F.transform("_l", lambda s: s["l_discount"]), F.array(F.lit(0.5))),
        )
        .otherwise(F.transform("_l", lambda s: s["l_discount"]))
        .alias("reward_score"),
    )
    return align_rewards(records).select("id", "gen_pos", F.col("generation.text").alias("generation"), "reward")
