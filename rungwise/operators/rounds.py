"""Refinement in bounded rounds (ITR-1, ITR-3)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.session import materialize

RoundHook = Callable[[DataFrame, int], DataFrame]

# Rounds per step in batch use and in direct use.
BATCH_ROUNDS = 5
DIRECT_ROUNDS = 11


@dataclass(frozen=True)
class Refined:
    """``steps``: final state per step. ``history``: one row per step and round it took part in."""

    steps: DataFrame
    history: DataFrame


def refine_rounds(
    steps: DataFrame, critique: RoundHook, rewrite: RoundHook, rounds: int = BATCH_ROUNDS
) -> Refined:
    """Criticise and rewrite the ``assumption`` of each step until it holds or rounds run out.

    ``critique(rows, round)`` adds ``syntactic_ok`` and ``semantic_ok``; null in either marks the
    step as failed with an error. ``rewrite(rows, round)`` replaces ``assumption``. A step that
    holds leaves the loop, one that could not be read tries again unchanged, others go on with
    their new assumption, which also the last round still makes.

    Only pending rows take part in a round, and each critique and rewrite is stored once, so a model
    behind a hook is called once per row and round, however often the result is read.
    """
    pending = steps
    rounds_seen: list[DataFrame] = []
    finished: list[DataFrame] = []
    holds = F.col("syntactic_ok") & F.col("semantic_ok")
    failed = F.col("syntactic_ok").isNull() | F.col("semantic_ok").isNull()
    for number in range(rounds):
        judged = materialize(
            critique(pending, number).withColumn("round", F.lit(number)), f"round{number}"
        )
        rounds_seen.append(judged)
        finished.append(judged.filter(F.coalesce(holds | failed, failed)))
        unread = judged.filter(~failed & ~F.col("syntactic_ok"))
        weak = judged.filter(~failed & F.col("syntactic_ok") & ~F.col("semantic_ok"))
        if judged.filter(~failed & ~holds).isEmpty():
            break
        rewritten = materialize(rewrite(weak, number).select(*judged.columns), f"rewrite{number}")
        if number == rounds - 1:
            finished.extend([unread, rewritten])
        else:
            pending = unread.unionByName(rewritten).select(*steps.columns)
    out = _union(finished)
    return Refined(
        steps=out.withColumn("logic_validity", F.when(F.col("semantic_ok"), 1.0).otherwise(0.0))
        .withColumn("syntactic_validity", F.when(F.col("syntactic_ok"), 1.0).otherwise(0.0))
        .withColumn("error", F.when(failed, F.lit("critique failed"))),
        history=_union(rounds_seen),
    )


def refine_soft_rounds(
    steps: DataFrame, critique: RoundHook, rewrite: RoundHook, rounds: int = BATCH_ROUNDS
) -> Refined:
    """The same loop with soft critics: no step ends early, every round feeds the next (ITR-3)."""
    current = steps
    seen: list[DataFrame] = []
    for number in range(rounds):
        judged = materialize(
            critique(current, number).withColumn("round", F.lit(number)), f"soft{number}"
        )
        seen.append(judged)
        rewritten = materialize(rewrite(judged, number).select(*judged.columns), f"soft-rewrite{number}")
        current = rewritten.select(*steps.columns)
    return Refined(steps=rewritten, history=_union(seen))


def apply_refinement(generations: DataFrame, refined: DataFrame) -> DataFrame:
    """Flat steps with refined assumptions and validities in place of the old ones.

    Old rewards no longer describe the steps, so they are dropped and have to be computed again.
    """
    new = refined.select(
        "id", "gen_pos", "step_pos", F.col("assumption").alias("_new"), "logic_validity", "syntactic_validity"
    )
    stale = [c for c in ("reward_score", "reward", "per_step_validity", "logic_validity", "syntactic_validity") if c in generations.columns]
    return (
        generations.drop(*stale)
        .join(new, ["id", "gen_pos", "step_pos"], "left")
        .withColumn("assumption", F.coalesce("_new", "assumption"))
        .drop("_new")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
