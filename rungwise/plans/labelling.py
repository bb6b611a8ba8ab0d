"""Rewards for parsed records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions import text as T
from rungwise.operators import rewards
from rungwise.session import materialize

STEP_KEYS = list(rewards.STEP_KEYS)


def explode_generations(records: DataFrame) -> DataFrame:
    """One row per generation: ``id, gold, gen_pos, final_tag, steps`` (EXP-2)."""
    return records.select(
        "id", F.col("answer").alias("gold"), F.posexplode("generations").alias("gen_pos", "_g")
    ).select("id", "gold", "gen_pos", "_g.final_tag", "_g.steps")


def explode_steps(generations: DataFrame) -> DataFrame:
    """One row per step with its hypothesis (EXP-2, TXT-6)."""
    fields = generations.schema["steps"].dataType.elementType.names
    stored = F.col("_s.logic_validity") if "logic_validity" in fields else F.lit(None)
    return generations.select(
        "id", "gen_pos", F.posexplode("steps").alias("step_pos", "_s")
    ).select(
        "id",
        "gen_pos",
        "step_pos",
        "_s.premises",
        "_s.assumptions",
        T.hypothesis(F.col("_s.conclusion")).alias("hypothesis"),
        stored.cast("double").alias("stored_validity"),
    )


def explanation_of(premises: Column, assumptions: Column) -> Column:
    """What a critic is given next to the hypothesis: the premises, then the assumptions."""
    none = F.array().cast("array<string>")
    words = F.concat(F.coalesce(premises, none), F.coalesce(assumptions, none))
    return T.strip(F.array_join(words, " "))


def label(
    records: DataFrame,
    embed: Callable[[Column], Column],
    attempts: DataFrame,
    confidence: DataFrame | None = None,
) -> DataFrame:
    """Reward and metrics per generation of ``records(id, premises, answer, generations)``.

    ``id`` is unique per record and ``premises`` is an array of texts. ``embed`` gives unit vectors,
    ``attempts`` holds the verdicts of a critic per step and attempt, ``confidence`` the fallback for
    steps no attempt could read. Each distinct text is embedded once, and its vector stored.
    """
    generations = explode_generations(records)
    steps = materialize(
        rewards.carry_conclusion(explode_steps(generations)).select(
            *STEP_KEYS, "premises", "previous_conclusion", "stored_validity"
        ),
        "label-steps",
    )
    base = records.select(
        "id", F.posexplode(T.atoms_of_list(F.col("premises"))).alias("pos", "_t")
    ).select("id", "pos", T.squeeze(F.col("_t")).alias("text"))
    used = (
        steps.select(*STEP_KEYS, F.posexplode("premises").alias("pos", "_t"))
        .filter(T.strip(F.col("_t")) != "")
        .select(*STEP_KEYS, "pos", T.squeeze(F.col("_t")).alias("text"))
    )
    carried = steps.filter("previous_conclusion is not null").select(
        *STEP_KEYS, T.squeeze(F.col("previous_conclusion")).alias("text")
    )
    texts = base.select("text").union(used.select("text")).union(carried.select("text")).distinct()
    vectors = materialize(texts.select("text", embed(F.col("text")).alias("embedding")), "label-vectors")
    used, base, carried = (rows.join(vectors, "text").drop("text") for rows in (used, base, carried))
    grounded = rewards.premise_grounding(
        steps.select(*STEP_KEYS, "stored_validity"), used, base, carried
    )
    judged = grounded.join(rewards.verdict_over_attempts(attempts), STEP_KEYS, "left")
    if confidence is None:
        judged = judged.withColumn("confidence", F.lit(None).cast("double"))
    else:
        judged = judged.join(confidence.select(*STEP_KEYS, "confidence"), STEP_KEYS, "left")
    metrics = judged.withColumn(
        "_m",
        rewards.logic_metrics(
            F.col("proved"), F.col("well_formed"), F.col("confidence"), F.col("stored_validity")
        ),
    ).select(*STEP_KEYS, "premise_validity", "_m.logic_validity", "_m.syntactic_ok", "_m.semantic_ok")
    return rewards.generation_rewards(generations.drop("steps"), metrics)


def label_records(
    records: DataFrame,
    embed: Callable[[Column], Column],
    attempts: DataFrame,
    confidence: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Records with ``reward_score`` and ``per_step_validity``, and error records ``(id, error)``.

    The lists follow the order of ``generations``; a record without generations has empty ones.
    ``failures(id, error)`` names records whose hooks failed, in any number of rows; they become
    error records with the least message. Earlier rewards are replaced.
    """
    kept = records.drop("reward_score", "per_step_validity")
    if failures is None:
        bad = kept.select("id", F.lit(None).cast("string").alias("error")).filter(F.lit(False))
    else:
        failed = failures.groupBy("id").agg(F.min("error").alias("error"))
        bad = materialize(kept.select("id").join(failed, "id"), "label-errors")
        kept = kept.join(bad.select("id"), "id", "left_anti")
    labelled = label(kept, embed, attempts, confidence)
    rewarded = rewards.record_rewards(labelled)
    types = dict(rewarded.dtypes)
    good = kept.join(rewarded, "id", "left")
    for column in ("reward_score", "per_step_validity"):
        good = good.withColumn(column, F.coalesce(column, F.array().cast(types[column])))
    return good, bad
