"""Refined assumptions for parsed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.functions.text import let
from rungwise.operators.rounds import BATCH_ROUNDS, Refined, RoundHook, refine_rounds
from rungwise.plans.labelling import STEP_KEYS, explanation_of, explode_generations, explode_steps


def steps_to_refine(records: DataFrame) -> DataFrame:
    """One row per step of ``records(id, answer, generations)``: what a critic and a rewriter read."""
    steps = explode_steps(explode_generations(records))
    none = F.lit(None).cast("array<string>")
    return steps.select(
        *STEP_KEYS,
        "hypothesis",
        explanation_of(F.col("premises"), none).alias("explanation"),
        explanation_of(none, F.col("assumptions")).alias("assumption"),
    )


def refine_records(
    records: DataFrame, critique: RoundHook, rewrite: RoundHook, rounds: int = BATCH_ROUNDS
) -> tuple[DataFrame, DataFrame, Refined]:
    """Records with refined steps, error records, and the rounds themselves.

    A record with a step its critic failed on becomes an error record. Old rewards are dropped:
    they do not describe the new steps. ``id`` is unique per record.
    """
    refined = refine_rounds(steps_to_refine(records), critique, rewrite, rounds)
    # The steps of one record, which arrived in one row.
    per_record = refined.steps.groupBy("id").agg(
        F.max("error").alias("_error"),
        F.array_sort(
            F.collect_list(F.struct("gen_pos", "step_pos", "assumption", "logic_validity", "syntactic_validity"))
        ).alias("_refined"),
    )
    joined = records.join(per_record, "id", "left")

    def step(s, at):
        return let(
            F.get("_refined", at),
            lambda r: F.struct(
                s["n"].alias("n"),
                s["premises"].alias("premises"),
                F.array(r["assumption"]).alias("assumptions"),
                s["conclusion"].alias("conclusion"),
                r["logic_validity"].alias("logic_validity"),
                r["syntactic_validity"].alias("syntactic_validity"),
            ),
        )

    def steps_before(i):
        """Each step was refined, so a step lies in ``_refined`` behind those of the generations before it."""
        size = lambda g: F.coalesce(F.greatest(F.size(g["steps"]), F.lit(0)), F.lit(0))
        return F.aggregate(F.slice("generations", 1, i), F.lit(0), lambda n, g: n + size(g))

    updated = F.transform(
        "generations",
        lambda g, i: F.struct(
            g["final_tag"].alias("final_tag"),
            let(steps_before(i), lambda n: F.transform(g["steps"], lambda s, j: step(s, n + j))).alias("steps"),
        ),
    )
    stale = [c for c in ("reward_score", "per_step_validity") if c in records.columns]
    good = (
        joined.filter("_error is null").withColumn("generations", updated).drop("_error", "_refined", *stale)
    )
    bad = joined.filter("_error is not null").select("id", F.col("_error").alias("error"))
    return good, bad, refined
