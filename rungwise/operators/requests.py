"""From questions to sampling requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.text import question_key
from rungwise.operators.ordering import HEAVY_ROWS, first_per_key, rank_in_key

# The sampling settings of the two sources.
LOCAL_SAMPLING = {"samples": 5, "temperature": 1.3, "top_p": 0.95, "max_tokens": 3072}
REMOTE_SAMPLING = {"samples": 3, "temperature": 0.0, "top_p": 0.95, "max_tokens": 4096}
BASE_SEED = 20250815
MAX_PROMPT_LENGTH = 3072


def dedup_questions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First question per (id, premise, question) (SET-2)."""
    keyed = df.withColumn("_key", question_key(F.col("id"), F.col("premise"), F.col("question")))
    return first_per_key(keyed, ["_key"], order).drop("_key")


def replicate(
    df: DataFrame,
    samples: int = LOCAL_SAMPLING["samples"],
    temperature: float = LOCAL_SAMPLING["temperature"],
    top_p: float = LOCAL_SAMPLING["top_p"],
    max_tokens: int = LOCAL_SAMPLING["max_tokens"],
    base_seed: int = BASE_SEED,
) -> DataFrame:
    """``samples`` rows per question, each with its own seed (EXP-1)."""
    return (
        df.withColumn("rep_idx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("seed", F.lit(base_seed).cast("bigint") + F.col("rep_idx"))
        .withColumn("temperature", F.lit(float(temperature)))
        .withColumn("top_p", F.lit(float(top_p)))
        .withColumn("max_tokens", F.lit(max_tokens))
    )


def unique_custom_ids(
    df: DataFrame,
    model: str,
    order: Sequence[str],
    block: Column,
    name: str = "custom_id",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Request id per row; a repeated one gets ``__dup1``, ``__dup2``, .. in order (TXT-11)."""
    base = F.concat(
        F.col("id").cast("string"), F.lit("__rep"), F.col("rep_idx").cast("string"), F.lit(f"__{model}")
    )
    ranked = rank_in_key(
        df.withColumn("_base", base), ["_base"], order, block, "_nth", heavy_rows
    )
    suffix = F.when(F.col("_nth") > 1, F.concat(F.lit("__dup"), (F.col("_nth") - 1).cast("string")))
    return ranked.withColumn(
        name, F.concat("_base", F.coalesce(suffix, F.lit("")))
    ).drop("_base", "_nth")


def request_lines(df: DataFrame, model: str, url: str = "/v1/chat/completions") -> DataFrame:
    """One JSON request line per row of ``custom_id``, ``messages``, ``max_tokens``, ``temperature`` (SNK-5)."""
    body = F.struct(
        F.lit(model).alias("model"),
        "messages",
        F.col("max_tokens").alias("max_completion_tokens"),
        "temperature",
    )
    request = F.struct(
        "custom_id", F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")
    )
    return df.select(F.lit(model).alias("model"), F.to_json(request).alias("value"))


def within_prompt_length(
    df: DataFrame, length: Column, limit: int = MAX_PROMPT_LENGTH
) -> DataFrame:
    """Rows whose prompt is short enough; an unknown length counts as too long (FLT-1).

    Put it before a model call: Spark does not move a filter below a Python stage.
    """
    return df.filter(F.coalesce(length <= limit, F.lit(False)))
