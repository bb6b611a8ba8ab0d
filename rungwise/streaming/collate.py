"""Collation of replies that arrive in any order (STR-1)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD = "id string, generation array<string>, extracted_answer array<string>"


def _records(id_: str, groups: list[list[tuple]]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "id": [id_] * len(groups),
            "generation": [[text for text, _ in g] for g in groups],
            "extracted_answer": [[answer for _, answer in g] for g in groups],
        }
    )


def stream_collate(
    replies: DataFrame, samples: int = 5, flush_after_ms: int | None = None, salts: int = 1
) -> DataFrame:
    """A record as soon as ``samples`` replies of an id are there, from a stream of ``id, text, answer``.

    State per key stays below ``samples`` rows, and a full record clears it, so an id that comes
    again starts afresh. What is left at the end of input goes out by a timer (``flush_after_ms``)
    or is read from the checkpoint of the stopped query (``left_over``). Replies of one id have no order among them, so an id that
    dominates the stream may be spread over ``salts`` keys; each then fills its own records.
    """

    def collate(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield _records(key[0], [held])
            return
        for batch in batches:
            full = []
            for pair in zip(batch["text"], batch["answer"]):
                held.append(pair)
                if len(held) == samples:
                    full.append(held)
                    held = []
            if full:
                yield _records(key[0], full)
        if held:
            state.update((json.dumps(held),))
            if flush_after_ms is not None:
                state.setTimeoutDuration(flush_after_ms)
        elif state.exists:
            state.remove()

    timeout = (
        GroupStateTimeout.NoTimeout if flush_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )
    salt = F.pmod(F.xxhash64("text", "answer"), F.lit(salts)).cast("int")
    return (
        replies.select(F.col("id").cast("string").alias("id"), "text", "answer")
        .withColumn("_salt", salt)
        .groupBy("id", "_salt")
        .applyInPandasWithState(collate, RECORD, "held string", "append", timeout)
    )


def left_over(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Replies ``id, text, answer`` that a stopped collation still holds in its state.

    The state is read as a table, from the last batch that the checkpoint committed, and stays as it
    is: a query started again on the same checkpoint goes on filling those records. So hand leftovers
    on when no more input comes.
    """
    state = spark.read.format("statestore").load(checkpoint)
    # A reply is stored as the pair of its text and its answer.
    pairs = F.from_json(F.col("value.groupState.held"), "array<array<string>>")
    return state.select(F.col("key.id").alias("id"), F.explode(pairs).alias("_p")).select(
        "id", F.get("_p", F.lit(0)).alias("text"), F.get("_p", F.lit(1)).alias("answer")
    )


def collate_left_over(spark: SparkSession, checkpoint: str, samples: int = 5) -> DataFrame:
    """Records of the replies that a stopped collation still holds; the last of an id may be short.

    The salted keys of an id are put together here: each holds less than a record, so an id has at
    most ``salts * (samples - 1)`` replies. Together with the streamed records they are what the batch
    form makes, up to the order among replies of an id, which a stream does not have.
    """
    held = F.array_sort(F.collect_list(F.struct("text", "answer")))
    starts = F.sequence(F.lit(1), F.size("_r"), F.lit(samples))
    return (
        left_over(spark, checkpoint)
        .groupBy("id")
        .agg(held.alias("_r"))
        .select("id", F.explode(F.transform(starts, lambda at: F.slice("_r", at, samples))).alias("_r"))
        .select(
            "id",
            F.transform("_r", lambda r: r["text"]).alias("generation"),
            F.transform("_r", lambda r: r["answer"]).alias("extracted_answer"),
        )
    )
