"""Preference pairs from rewarded records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.functions.prompts import build_messages, collapse_messages
from rungwise.functions.steps import format_generation
from rungwise.functions.text import let
from rungwise.operators.pairs import usable_reward, within_thresholds


def preference_pairs(
    records: DataFrame,
    order: str,
    good: float = 0.5,
    bad: float = 0.5,
    skip_zero: bool = True,
    profile: str = "pairs",
) -> DataFrame:
    """``id, question, good_answer, bad_answer, reward`` from nested records.

    ``records(id, premise, question, generations, reward_score)`` with ``order``, a number that is
    unique per record. Without a reward list of the right length a generation's own ``reward``
    counts. A record chooses its own best and worst first and prints only those two, so
    one narrow shuffle carries two texts per record and a grouped maximum combines them on the way.
    """
    count = F.size("generations")
    names = records.schema["generations"].dataType.elementType.names

    def own(g):
        return g["reward"].cast("string") if "reward" in names else F.lit(None).cast("string")

    given = F.transform("reward_score", lambda r: r.cast("string"))
    listed = F.when(F.size("reward_score") == count, given).otherwise(F.transform("generations", own))

    def usable_of(rewards):
        placed = F.transform(
            rewards, lambda r, i: F.struct(usable_reward(r, skip_zero).alias("reward"), i.alias("i"))
        )
        return F.filter(placed, lambda p: p["reward"].isNotNull())

    def side(usable, first: bool):
        place = F.transform(
            usable, lambda p: F.struct(p["reward"].alias("reward"), (-p["i"] if first else p["i"]).alias("k"))
        )
        chosen = F.array_max(place) if first else F.array_min(place)
        return let(
            chosen,
            lambda c: F.when(
                c.isNotNull(),
                let(
                    F.get("generations", F.abs(c["k"])),
                    lambda g: F.struct(
                        c["reward"].alias("reward"), format_generation(g["steps"], g["final_tag"]).alias("text")
                    ),
                ),
            ),
        )

    def choose(usable):
        return F.struct(
            F.size(usable).alias("n"), side(usable, True).alias("best"), side(usable, False).alias("worst")
        )

    local = records.filter("id is not null").select(
        "id", "premise", "question", F.col(order).alias("_at"), let(usable_of(listed), choose).alias("_c")
    )
    best_at = F.when(F.col("_c.best").isNotNull(), F.struct(F.col("_c.best.reward"), -F.col("_at")))
    worst_at = F.when(F.col("_c.worst").isNotNull(), F.struct(F.col("_c.worst.reward"), F.col("_at")))
    merged = local.groupBy("id").agg(
        F.sum("_c.n").alias("n_usable"),
        F.max_by("_c.best", best_at).alias("best"),
        F.min_by("_c.worst", worst_at).alias("worst"),
        *[
            F.coalesce(F.max_by(t, F.struct(F.length(t), -F.col("_at"))), F.lit("")).alias(t)
            for t in ("premise", "question")
        ],
    )
    messages = build_messages(F.col("premise"), F.col("question"), F.col("id"), profile)
    return within_thresholds(merged, good, bad).select(
        "id",
        collapse_messages(messages).alias("question"),
        F.col("best.text").alias("good_answer"),
        F.col("worst.text").alias("bad_answer"),
        F.array("best.reward", "worst.reward").alias("reward"),
    )
