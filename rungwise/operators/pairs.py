"""One best-versus-worst pair per question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.text import canon
from rungwise.operators.ordering import first_per_key


def usable_reward(reward: Column, skip_zero: bool = True) -> Column:
    """Reward as a double, null if it is no number, NaN, or exactly zero (FLT-2)."""
    value = reward.try_cast("double")
    bad = value.isNull() | F.isnan(value)
    if skip_zero:
        bad = bad | (value == 0.0)
    return F.when(~bad, value)


def align_rewards(
    df: DataFrame, generations: str = "generations", rewards: str = "reward_score", own: str = "reward"
) -> DataFrame:
    """One row per generation with its reward (JON-3, EXP-2).

    The reward list counts only if it is as long as the generation list; otherwise each
    generation's own ``own`` field does. Without such a field the reward is null.
    """
    element = df.schema[generations].dataType.elementType
    has_own = own in getattr(element, "names", [])
    single = (lambda g: g[own].try_cast("double")) if has_own else (lambda g: F.lit(None).cast("double"))
    listed = F.transform(F.col(rewards), lambda r: r.try_cast("double"))
    aligned = F.when(F.size(rewards) == F.size(generations), listed).otherwise(
        F.transform(F.col(generations), single)
    )
    zipped = F.zip_with(
        F.col(generations), aligned, lambda g, r: F.struct(g.alias("generation"), r.alias("reward"))
    )
    rest = [c for c in df.columns if c not in (generations, rewards)]
    return df.select(*rest, F.posexplode(zipped).alias("gen_pos", "_g")).select(
        *rest, "gen_pos", "_g.generation", "_g.reward"
    )


def merge_longest(
    df: DataFrame, key: str, texts: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Longest value of each text per key, each chosen on its own, first in order on a tie (AGG-1)."""
    earlier = [-F.col(c) for c in order]
    return df.groupBy(key).agg(
        *[
            F.coalesce(
                F.max_by(F.col(t), F.struct(F.length(t), *earlier)), F.lit("")
            ).alias(t)
            for t in texts
        ]
    )


def best_and_worst(
    df: DataFrame, key: str, reward: str, order: Sequence[str], payload: Sequence[str]
) -> DataFrame:
    """Highest and lowest reward per key with their rows, first in order on a tie (AGG-2, TOP-1).

    One aggregate, combined before its shuffle: a task sends two rows per key however many it read.
    ``order`` holds numbers that are unique in the key.
    """
    row = F.struct(F.col(reward).alias("reward"), *[F.col(c) for c in payload])
    earlier = [-F.col(c) for c in order]
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_usable"),
        F.max_by(row, F.struct(F.col(reward), *earlier)).alias("best"),
        F.min_by(row, F.struct(F.col(reward), *[F.col(c) for c in order])).alias("worst"),
    )


def within_thresholds(df: DataFrame, good: float = 0.5, bad: float = 0.5) -> DataFrame:
    """Keys with two usable rows, a best above ``good`` and a worst below ``bad``, both strict (FLT-5)."""
    return df.filter(
        (F.col("n_usable") >= 2) & (F.col("best.reward") > good) & (F.col("worst.reward") < bad)
    )


def dedup_pairs(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First pair among those equal up to case and white space (SET-3)."""
    keyed = df.withColumn(
        "_key",
        F.sha2(
            F.to_json(
                F.struct(
                    "id",
                    canon(F.col("question")).alias("q"),
                    canon(F.col("good_answer")).alias("g"),
                    canon(F.col("bad_answer")).alias("b"),
                )
            ),
            256,
        ),
    )
    # Dealt before they are sorted by key: a task of narrow rows can make far more wide pairs than it read.
    return first_per_key(keyed.repartition("_key"), ["_key"], order).drop("_key")
