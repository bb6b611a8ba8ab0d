"""Questions to sampling requests, and replies to parsed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions import text as T
from rungwise.functions.prompts import build_messages
from rungwise.functions.steps import parse_generation
from rungwise.operators import collate, requests
from rungwise.sources.jsonl import LINE_ORDER, field, first_field


def questions(lines: DataFrame, order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """``id, premise, question, answer`` of parsed question lines, with their order columns."""
    return lines.select(
        field("id").alias("id"),
        T.to_text_open(F.try_variant_get("v", "$.premise", "variant")).alias("premise"),
        T.to_text_open(F.try_variant_get("v", "$.question", "variant")).alias("question"),
        field("answer").alias("answer"),
        *order,
    )


def sampling_requests(
    asked: DataFrame,
    order: Sequence[str] = LINE_ORDER,
    profile: str = "local",
    prompt_length: Column | None = None,
    **sampling: float,
) -> DataFrame:
    """Distinct questions with messages, within the prompt length, one row per replica.

    ``prompt_length`` may use the ``messages`` column; by default it counts words.
    """
    unique = requests.dedup_questions(asked, order).withColumn(
        "messages", build_messages(F.col("premise"), F.col("question"), F.col("id"), profile)
    )
    words = F.size(F.split(F.array_join(F.transform("messages", lambda m: m["content"]), " "), r"\s+"))
    fitting = requests.within_prompt_length(unique, words if prompt_length is None else prompt_length)
    return requests.replicate(fitting, **sampling)


def remote_replies(lines: DataFrame, truth: DataFrame, order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """Rollout records from completion envelopes ``v`` and the reference table ``truth``."""
    reply = T.completion_text(F.col("v"))
    custom_id = field("custom_id")
    replies = lines.select(
        T.custom_id_base(custom_id).alias("id"),
        T.custom_id_rep(custom_id).alias("rep_idx"),
        reply.alias("text"),
        T.answer_or_empty(reply).alias("answer"),
        *order,
    ).filter("id is not null")
    records = collate.collate_replicas(collate.first_replies(collate.allowed_reps(replies), order))
    return collate.join_truth(records, truth)


def parsed_rollouts(lines: DataFrame) -> DataFrame:
    """Records with their generations as structures (GEN-4).

    A line may hold one record or an array of them, under ``generation`` or ``generations``.
    """
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    one = lines.withColumn(
        "v",
        F.explode(
            F.when(is_list, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array(F.col("v")))
        ),
    )
    texts = T.as_list(first_field(("generation", "generations")))
    return one.select(
        field("id").alias("id"),
        field("premise", "variant").alias("premise"),
        field("question", "variant").alias("question"),
        field("answer").alias("answer"),
        F.try_variant_get("v", "$.extracted_answer", "array<string>").alias("extracted_answer"),
        F.transform(texts, lambda t: parse_generation(t)).alias("generations"),
        *[c for c in lines.columns if c in LINE_ORDER],
    )
