"""Scores of the soft critics and the classification report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coherence(scores: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Mean entailment less mean contradiction over all steps but the last (AGG-9).

    The last step is taken back out of the sums, so one combined aggregate is enough. Values that
    are not finite are counted beside the sum, so one in the last step leaves no trace. Steps
    without a score do not count; a document with no step left has a null score.
    """
    scored = F.col("entailment").isNotNull() & F.col("contradiction").isNotNull()
    gap = F.when(scored, F.col("entailment") - F.col("contradiction"))
    kinds = {
        "_nan": lambda g: F.isnan(g),
        "_up": lambda g: g == float("inf"),
        "_down": lambda g: g == float("-inf"),
    }
    finite = lambda g: ~F.isnan(g) & (F.abs(g) < float("inf"))
    last = F.col("_last.gap")
    left = lambda c, held: F.col(c) - F.coalesce(held.cast("int"), F.lit(0))
    return (
        scores.groupBy(*keys)
        .agg(
            F.coalesce(F.sum(F.when(finite(gap), gap)), F.lit(0.0)).alias("_sum"),
            F.count(gap).alias("_n"),
            *[F.coalesce(F.count_if(test(gap)), F.lit(0)).alias(name) for name, test in kinds.items()],
            F.max_by(F.struct(gap.alias("gap")), F.col("step_pos")).alias("_last"),
        )
        .withColumns({"_n": left("_n", last.isNotNull()), **{name: left(name, test(last)) for name, test in kinds.items()}})
        .withColumn("_sum", F.col("_sum") - F.when(finite(last), last).otherwise(F.lit(0.0)))
        .select(
            *keys,
            F.when(F.col("_n") <= 0, None)
            .when((F.col("_nan") > 0) | ((F.col("_up") > 0) & (F.col("_down") > 0)), float("nan"))
            .when(F.col("_up") > 0, float("inf"))
            .when(F.col("_down") > 0, float("-inf"))
            .otherwise(F.col("_sum") / F.col("_n"))
            .alias("coherence"),
        )
    )


def concept_drift(explanation: Column, given: Column) -> Column:
    """Number of concepts an explanation brings in that were not given (AGG-10)."""
    return F.size(F.array_except(F.array_distinct(explanation), given))


def uncertainty(
    scores: DataFrame, keys: Sequence[str] = ("doc_id",), kind: str = "kind", top: float = 6.0
) -> DataFrame:
    """Half the mean doubt over the assumptions plus half the doubt of the summary (AGG-11)."""
    doubt = F.lit(top) - F.col("certainty")
    return scores.groupBy(*keys).agg(
        (
            (F.avg(F.when(F.col(kind) == "assumption", doubt)) + F.avg(F.when(F.col(kind) == "summary", doubt)))
            / 2
        ).alias("uncertainty")
    )


def classification_report(
    df: DataFrame, gold: Column, predicted: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and their ratios, 0.0 where a ratio is undefined (AGG-12)."""
    counts = df.groupBy(*by).agg(
        F.count_if(gold & predicted).alias("tp"),
        F.count_if(~gold & predicted).alias("fp"),
        F.count_if(gold & ~predicted).alias("fn"),
        F.count_if(~gold & ~predicted).alias("tn"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn(
            "f1",
            ratio(
                F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
        .withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn))
    )


def wrong_examples(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Misclassified rows with their kind: a table, because their number has no bound (AGG-12)."""
    return df.filter(gold != predicted).withColumn(
        "kind", F.when(gold, F.lit("false_negative")).otherwise(F.lit("false_positive"))
    )
