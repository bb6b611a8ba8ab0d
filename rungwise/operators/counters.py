"""Run counters that cost no extra pass (AGG-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and an observation of ``n_rows`` and of the rows that meet each condition.

    The observation fills while an action on the returned frame runs, for example its write.
    """
    observation = Observation(name)
    counts = [F.count_if(c).alias(k) for k, c in conditions.items()]
    return df.observe(observation, F.count(F.lit(1)).alias("n_rows"), *counts), observation
