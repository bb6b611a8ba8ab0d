"""Results of models and provers that outlive a run.

A result is stored under the digest of the model's settings and the input it was made for. A later
run, or a run started again after a loss, asks the model only for inputs that the store lacks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.session import materialize
from rungwise.sources.jsonl import path_exists


def result_key(settings: str, inputs: Sequence[str]) -> Column:
    """Digest of the settings and the named input columns; nulls count as values."""
    named = F.struct(F.lit(settings).alias("settings"), *[F.col(c).alias(f"input_{i}") for i, c in enumerate(inputs)])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def stored_results(df: DataFrame, store: str, schema: str) -> DataFrame:
    """(result_key, run, columns of ``schema``) of a store; empty if there is none yet."""
    spark = df.sparkSession
    columns = f"result_key string, run string, {schema}"
    if not path_exists(spark, store):
        return spark.createDataFrame([], columns)
    # Two runs at a time may both have made a result.
    return spark.read.schema(columns).parquet(store).dropDuplicates(["result_key"])


def with_results(
    df: DataFrame,
    hook: Callable[[DataFrame], DataFrame],
    schema: str,
    inputs: Sequence[str],
    store: str,
    settings: str,
    run: str = "",
) -> DataFrame:
    """``df`` with the columns of ``schema``, ``run`` (the run that made them) and ``error``.

    ``hook`` adds the columns of ``schema``, and ``error`` if it has any, to rows of the input columns;
    it sees each distinct input that the store lacks once. What it makes is written before anything
    reads it, good results to the store and errors beside it, so neither output runs it again. Errors
    are not kept: the next run tries those inputs anew.
    """
    keyed = df.withColumn("result_key", result_key(settings, inputs))
    known = stored_results(df, store, schema)
    wanted = keyed.select("result_key", *inputs).dropDuplicates(["result_key"])
    made = hook(wanted.join(known.select("result_key"), "result_key", "left_anti"))
    if "error" not in made.columns:
        made = made.withColumn("error", F.lit(None).cast("string"))
    names = [f.name for f in known.schema.fields[2:]]
    made = materialize(made.select("result_key", F.lit(run).alias("run"), *names, "error"), "hook-results")
    made.filter("error is null").drop("error").write.mode("append").parquet(store)
    good = stored_results(df, store, schema).withColumn("error", F.lit(None).cast("string"))
    every = good.unionByName(made.filter("error is not null"))
    return keyed.join(every, "result_key", "left").select(*df.columns, *names, "run", "error")
