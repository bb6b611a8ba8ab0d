"""Soft critics and the classification report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.bridges import STEP_POS_SQL, line_items, table
from rungwise.operators import critics
from rungwise.queries.registry import query


@query(
    f"""
WITH s AS (
  SELECT l_orderkey AS doc_id, {STEP_POS_SQL} AS p, CASE WHEN l_returnflag <> 'N' THEN l_discount * 10 - l_tax * 7 END AS gap FROM lineitem
), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC) AS back FROM s)
SELECT doc_id, round(avg(gap) FILTER (back > 1), 6) + 0.0 AS coherence FROM k GROUP BY doc_id
"""
)
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9: discounts as entailment, taxes as contradiction; lines returned as N have no score."""
    scored = F.col("l_returnflag") != "N"
    scores = line_items(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"),
        "step_pos",
        F.when(scored, F.col("l_discount") * 10).alias("entailment"),
        F.when(scored, F.col("l_tax") * 7).alias("contradiction"),
    )
    return critics.coherence(scores).select("doc_id", (F.round("coherence", 6) + 0.0).alias("coherence"))


@query(
    """
WITH w AS (
  SELECT conv_id, role, unnest(string_split_regex(lower(text), '[^a-zà-ÿ]+')) AS word FROM conversations
), e AS (SELECT DISTINCT conv_id, word FROM w WHERE role = 'assistant' AND word <> ''),
g AS (SELECT DISTINCT conv_id, word FROM w WHERE role <> 'assistant')
SELECT c.conv_id AS doc_id, count(e.word) FILTER (g.word IS NULL) AS drift
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id = e.conv_id
LEFT JOIN g ON e.conv_id = g.conv_id AND e.word = g.word GROUP BY c.conv_id
"""
)
def concept_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, SET-4: words an assistant brings into a chat. A chat is one record of a few turns."""
    words = F.split(F.lower("text"), "[^a-zà-ÿ]+")
    said = F.col("role") == "assistant"
    chats = (
        table(spark, sf_dir, "conversations")
        .select("conv_id", said.alias("said"), F.filter(words, lambda w: w != "").alias("words"))
        .groupBy("conv_id")
        .agg(
            F.flatten(F.collect_list(F.when(F.col("said"), F.col("words")))).alias("explanation"),
            F.flatten(F.collect_list(F.when(~F.col("said"), F.col("words")))).alias("given"),
        )
    )
    drift = critics.concept_drift(F.col("explanation"), F.col("given"))
    return chats.select(F.col("conv_id").alias("doc_id"), drift.alias("drift"))


@query(
    """
SELECT user_id AS doc_id, round((avg(6.0 - value / 20) FILTER (event_type = 'click') + avg(6.0 - value / 20) FILTER (event_type = 'purchase')) / 2, 6) AS uncertainty
FROM events GROUP BY user_id
"""
)
def uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: clicks as assumptions, purchases as summaries."""
    kind = F.when(F.col("event_type") == "click", "assumption").when(F.col("event_type") == "purchase", "summary")
    scores = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), kind.alias("kind"), (F.col("value") / 20).alias("certainty")
    )
    return critics.uncertainty(scores).select("doc_id", F.round("uncertainty", 6).alias("uncertainty"))


_EXAMPLES_SQL = """
WITH x AS (SELECT d.doc_id, d.lang, l.quality = 1 AS gold, d.n_chars > 1500 AS predicted FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).alias("predicted"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("gold"))
    return docs.join(labels, "doc_id")


@query(
    _EXAMPLES_SQL
    + """, c AS (
  SELECT lang, count(*) FILTER (gold AND predicted) AS tp, count(*) FILTER (NOT gold AND predicted) AS fp,
    count(*) FILTER (gold AND NOT predicted) AS fn, count(*) FILTER (NOT gold AND NOT predicted) AS tn FROM x GROUP BY lang
), r AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS q FROM c
)
SELECT lang, tp, fp, fn, tn, round(p, 6) AS precision, round(q, 6) AS recall,
  round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy
FROM r
"""
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: a length rule against the quality labels, per language."""
    report = critics.classification_report(_examples(spark, sf_dir), F.col("gold"), F.col("predicted"), ["lang"])
    ratios = ("precision", "recall", "f1", "accuracy")
    return report.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ratios])


@query(
    _EXAMPLES_SQL
    + "SELECT doc_id, CASE WHEN gold THEN 'false_negative' ELSE 'false_positive' END AS kind FROM x WHERE gold <> predicted"
)
def wrong_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: the misclassified documents."""
    wrong = critics.wrong_examples(_examples(spark, sf_dir), F.col("gold"), F.col("predicted"))
    return wrong.select("doc_id", "kind")
