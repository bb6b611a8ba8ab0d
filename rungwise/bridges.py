"""The given tables seen as the toolkit's own tables.

None of them holds step-formatted text, so fields are put together by formula; the SQL of each
query states the same formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIONS_PER_BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_of(position: str) -> Column:
    """Run of a whole-number position, for cutting heavy keys."""
    return F.floor(F.col(position) / POSITIONS_PER_BLOCK)


def text(*parts: str | Column) -> Column:
    """Concatenation of literal strings and columns."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a step position that is unique in its order."""
    return table(spark, sf_dir, "lineitem").withColumn(
        "step_pos",
        ((F.col("l_linenumber").cast("bigint") * 100_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 100
        + F.col("l_quantity").cast("int"),
    )


STEP_POS_SQL = "(((l_linenumber::BIGINT * 100000000 + l_partkey) * 100000 + l_suppkey) * 100 + l_quantity::INT)"


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reasoning text per order: its lines as steps in (part, supplier) order, numbered by line."""
    step = text(
        "Step ", F.col("l_linenumber"), ":\nPremises:\n- part ", F.col("l_partkey"), "\n- ", F.col("l_returnflag"),
        "\nAssumptions:\n- supplier ", F.col("l_suppkey"), "\nConclusion:\n- line ", F.col("l_linestatus"), "\n",
    )
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", step.alias("s")))).alias("_s"),
            F.max("l_returnflag").alias("_flag"),
        )
        .select(
            "id",
            text(
                F.array_join(F.transform("_s", lambda s: s["s"]), ""), "Final:\n<answer>", F.col("_flag"), "</answer>"
            ).alias("text"),
        )
    )
