"""Gathering replies per question, and the joins around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwise.operators.ordering import HEAVY_ROWS, first_per_key, order_key_at, rank_in_key
from rungwise.session import materialize

# Samples per record of the two sources.
LOCAL_SAMPLES = 5
ALLOWED_REPS = (0, 1, 2)
#: Rows that one task may take for a cap.
FEW_ROWS = 10_000


def with_id(df: DataFrame, falsy: bool = False, name: str = "id") -> DataFrame:
    """Rows that have an id; ``falsy`` also drops the empty text and zero (FLT-3)."""
    present = F.col(name).isNotNull()
    if falsy:
        empty = "" if isinstance(df.schema[name].dataType, T.StringType) else 0
        present = present & (F.col(name) != F.lit(empty))
    return df.filter(present)


def allowed_reps(df: DataFrame, reps: Sequence[int] = ALLOWED_REPS) -> DataFrame:
    """Rows of the sampled replicas (FLT-4)."""
    return df.filter(F.col("rep_idx").isin(*reps))


def keyed_truth(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Reference rows by id; the last row of a repeated id wins (SRC-3)."""
    return first_per_key(with_id(df, falsy=True), ["id"], order, last=True)


def first_replies(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First reply with text per (id, replica) (AGG-4)."""
    return first_per_key(df.filter(F.col("text").isNotNull()), ["id", "rep_idx"], order)


def collate_replicas(df: DataFrame, reps: Sequence[int] = ALLOWED_REPS) -> DataFrame:
    """One record per id with the replies of its replicas in replica order (AGG-3).

    Input has one row per (id, replica), so a list is no longer than ``reps``.
    """
    listed = F.array_sort(F.collect_list(F.struct("rep_idx", "text", "answer")))
    return (
        allowed_reps(df, reps)
        .groupBy("id")
        .agg(listed.alias("_r"))
        .select(
            "id",
            F.transform("_r", lambda r: r["text"]).alias("generation"),
            F.transform("_r", lambda r: r["answer"]).alias("extracted_answer"),
        )
    )


def collate_chunks(
    df: DataFrame,
    order: Sequence[str],
    block: Column,
    samples: int = LOCAL_SAMPLES,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Records of ``samples`` replies per id in arrival order; the last may be short (AGG-3, WIN-3).

    Rows are grouped by (id, record), so neither the shuffle key nor a list grows with an id.
    """
    ranked = rank_in_key(df, ["id"], order, block, "_nth", heavy_rows)
    listed = F.array_sort(F.collect_list(F.struct("_nth", "text", "answer")))
    return (
        ranked.withColumn("record", F.floor((F.col("_nth") - 1) / samples))
        .groupBy("id", "record")
        .agg(listed.alias("_r"))
        .select(
            "id",
            "record",
            F.transform("_r", lambda r: r["text"]).alias("generation"),
            F.transform("_r", lambda r: r["answer"]).alias("extracted_answer"),
        )
    )


def join_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Records with the reference fields of their id; records without one are dropped (JON-1).

    ``truth`` has one row per id, so the join cannot multiply rows and adaptive execution may
    split a heavy id.
    """
    return df.join(truth, "id", "inner")


def without_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Records ``join_truth`` drops."""
    return df.join(truth.select("id"), "id", "left_anti")


def skip_processed(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose id, as text, is not among ``done``; rows without an id stay (JON-2)."""
    ids = done.select(F.col("id").cast("string").alias("_done")).filter("_done is not null").distinct()
    return df.join(ids, F.col("id").cast("string") == F.col("_done"), "left_anti")


def item_cap(df: DataFrame, k: int, order: Sequence[str], few: int = FEW_ROWS) -> DataFrame:
    """The first ``k`` rows in order, nulls first; ``order`` must be unique (FLT-6, LIM-1).

    A few rows are taken by a sort with a limit. That brings all ``k`` rows into one task, so a large
    cap instead finds the order columns of the last row that stays, from counts of ranges, and filters
    by them: rows stay where they are, and come in no order.
    """
    if k <= few:
        return df.orderBy(*order).limit(k)
    key = F.struct(*[F.col(c) for c in order])
    last = materialize(order_key_at(df, order, k - 1).select(F.struct(*order).alias("_last")), "cap")
    if last.isEmpty():
        return df
    # One row.
    return df.join(F.broadcast(last), key <= F.col("_last")).drop("_last")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, each with its rank as ``src`` (SET-1)."""
    ranked = [s.withColumn("src", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
