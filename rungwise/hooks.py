"""Places where a caller's model, prover or tokenizer joins the plan.

A hook gets whole Arrow batches and runs once per batch inside tasks. Failures stay with the row:
the output is null and ``error`` says why, and the job goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BatchFunction = Callable[[pd.DataFrame], pd.DataFrame]
SeriesFunction = Callable[[pd.Series], pd.Series]

COMPLETION = "completion string"
CRITIQUE = (
    "semantic_ok boolean, syntactic_ok boolean, error_code string, solving_time double, "
    "proof_tactics array<string>, code string, logical_information string"
)


def _fields(schema: str) -> list[T.StructField]:
    return T._parse_datatype_string(schema).fields


def apply_hook(
    df: DataFrame,
    load: Callable[[], BatchFunction],
    schema: str,
    partitions: int | None = None,
    give_up_after: int | None = None,
) -> DataFrame:
    """Add the columns of ``schema`` and ``error`` to ``df`` (UDF-1, UDF-2).

    ``load`` runs once per task and returns the batch function, so a model is loaded per task and
    not per batch. A failing batch is halved until its bad rows stand alone, so only they carry an error.
    ``partitions`` spreads the rows evenly before the hook. With ``give_up_after``, a task that sees so
    many rows fail and none succeed fails itself: then the model is down, not the rows bad. Whether it
    does depends on how rows fall into tasks, so it is off unless asked for.
    """
    added = _fields(schema)
    names = [f.name for f in added]
    out = T.StructType([*df.schema.fields, *added, T.StructField("error", T.StringType())])

    def run(function: BatchFunction, batch: pd.DataFrame) -> pd.DataFrame:
        result = function(batch)
        result.index = batch.index
        return batch.assign(**{n: result[n] for n in names}, error=None)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function = load()
        good = bad = 0

        def in_parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal good, bad
            try:
                result = run(function, batch)
            except Exception as failure:  # one bad row fails its batch; halves narrow it down
                if len(batch) > 1:
                    middle = len(batch) // 2
                    yield from in_parts(batch.iloc[:middle])
                    yield from in_parts(batch.iloc[middle:])
                    return
                bad += 1
                if give_up_after and not good and bad >= give_up_after:
                    raise RuntimeError(f"the hook failed for all of {bad} rows") from failure
                yield batch.assign(**{n: None for n in names}, error=f"{type(failure).__name__}: {failure}")
            else:
                good += len(batch)
                yield result

        for batch in batches:
            if not batch.empty:
                yield from in_parts(batch)

    source = df.repartition(partitions) if partitions else df
    return source.mapInPandas(task, out)


def complete(df: DataFrame, load: Callable[[], BatchFunction], partitions: int | None = None) -> DataFrame:
    """Model replies for ``messages`` (UDF-1)."""
    return apply_hook(df, load, COMPLETION, partitions)


def critique(df: DataFrame, load: Callable[[], BatchFunction], partitions: int | None = None) -> DataFrame:
    """Prover verdicts for steps (UDF-2)."""
    return apply_hook(df, load, CRITIQUE, partitions)


def _series_hook(load: Callable[[], SeriesFunction], return_type: str) -> Callable[[Column], Column]:
    def batches(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        function = load()
        for series in values:
            yield function(series)

    # pandas_udf reads the iterator form from the annotations, which must be real types here.
    batches.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, return_type)


def embed(load: Callable[[], SeriesFunction]) -> Callable[[Column], Column]:
    """Unit-length vectors of texts (UDF-3)."""
    return _series_hook(load, "array<float>")


def logprobs(load: Callable[[], SeriesFunction]) -> Callable[[Column], Column]:
    """Token log-probabilities of texts (UDF-4)."""
    return _series_hook(load, "array<double>")


def certainty(load: Callable[[], SeriesFunction]) -> Callable[[Column], Column]:
    """Certainty of sentences, 1 to 6 (UDF-4)."""
    return _series_hook(load, "double")


def tag(load: Callable[[], SeriesFunction]) -> Callable[[Column], Column]:
    """Nouns and adjectives of texts (UDF-4)."""
    return _series_hook(load, "array<string>")


def token_count(load: Callable[[], SeriesFunction]) -> Callable[[Column], Column]:
    """Token counts of texts (UDF-4)."""
    return _series_hook(load, "int")


def nli(df: DataFrame, load: Callable[[], BatchFunction], partitions: int | None = None) -> DataFrame:
    """Entailment, neutral and contradiction per row (UDF-4)."""
    return apply_hook(df, load, "entailment double, neutral double, contradiction double", partitions)


def split_errors(df: DataFrame, keep: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the error records of the others (SNK-4)."""
    good = df.filter("error is null").drop("error")
    bad = df.filter("error is not null").select(*keep, "error")
    return good, bad
