"""Mixing sources to target weights by Poisson replication.

Each source has a target share; its mean repetition rate is the target amount over the amount it
has. Every document draws its number of copies from a Poisson distribution of that mean, by
inverting the distribution at a number in [0, 1) that a seeded hash of the document gives. So the
draw needs no state, is the same in every run and on every cluster, and rates below and above one
are treated alike. Copies are exploded and spread over all partitions by a hash of document and
copy, and sorted by it inside them, which is the global shuffle.

The amounts are one grouped sum; the rates join back by source, where adaptive execution splits a
hot source. The distribution is tabled once per source, not per document.

Defined results: a null source is a source of its own. A document with 0 copies is left out, as the
method asks. Repeated rows draw alike, null ids and texts included. A source whose amount is 0 keeps
the rate ``epochs``. Other columns are carried unread, whatever their names. An empty table gives
no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.session import materialize

SEED = 20240229
ALPHA = 0.5
_DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: 52 bits, which a double holds exactly."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint") / F.lit(float(1 << (4 * _DIGITS)))


def poisson_table(rate: float) -> tuple[int, list[float]]:
    """The first count that can occur and the distribution function from it on, until it is 1."""
    spread = 12 * math.sqrt(rate) + 40
    first = max(0, math.floor(rate - spread))
    counts = range(first, math.ceil(rate + spread) + 1)
    if rate <= 0:
        return 0, [1.0]
    mass = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in counts]
    total = np.cumsum(mass)
    return first, total[: int(np.searchsorted(total, 1 - 2.0**-53)) + 1].tolist()


def _tables(rate: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([poisson_table(r) for r in rate], columns=["first", "steps"])


def rates(docs: DataFrame, source_col: str, amount: Column, weights: dict[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """(source, rate): mean copies per document of each source.

    Without ``weights`` the target share of a source is its amount to the power ``alpha``. Sources
    that ``weights`` leaves out get no copies.
    """
    amounts = materialize(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(amount).cast("double").alias("amount")), "mix-amounts")
    share = F.pow("amount", F.lit(alpha))
    if weights is not None:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    shared = amounts.withColumn("share", F.when(F.col("amount") > 0, share).otherwise(0.0))
    total = shared.agg(F.sum("amount").alias("all"), F.sum("share").alias("shares"))
    rate = F.when(F.col("amount") > 0, F.col("share") / F.col("shares") * F.col("all") * epochs / F.col("amount")).otherwise(F.lit(float(epochs)))
    # One row of totals.
    return shared.join(F.broadcast(total)).select("source", rate.alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = ALPHA,
    epochs: float = 1.0,
    amount: Column | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(row, copy, n_copies) in shuffled order: ``row`` holds the document, ``copy`` counts from 1.

    ``amount`` measures a document (default: 1, so shares are shares of documents).
    """
    amount = F.lit(1) if amount is None else amount
    tabled = F.pandas_udf(_tables, "first bigint, steps array<double>")
    tables = rates(docs, source_col, amount, weights, alpha, epochs).select("source", tabled("rate").alias("t"))
    text_digest = F.md5(F.coalesce(docs[text_col], F.lit("")))
    key = (F.coalesce(docs[id_col].cast("string"), F.lit("")), text_digest)
    drawn = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[source_col].alias("s"),
        uniform(F.lit(str(seed)), *key).alias("u"),
        F.xxhash64(F.lit(seed), *key).alias("place"),
    )
    counted = drawn.join(tables, F.col("s").eqNullSafe(F.col("source"))).select(
        "row",
        "place",
        (F.col("t.first") + F.size(F.filter("t.steps", lambda step: step <= F.col("u")))).cast("bigint").alias("n_copies"),
    )
    copies = (
        counted.filter("n_copies > 0")
        .select("row", "n_copies", "place", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))).alias("copy"))
        .withColumn("place", F.xxhash64("place", "copy"))
    )
    return copies.repartition("place").sortWithinPartitions("place").select("row", "copy", "n_copies")


MIX_SQL = f"""
WITH d AS (
    SELECT doc_id, source, text,
           ('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, {_DIGITS}))::BIGINT
               / {1 << (4 * _DIGITS)}.0::DOUBLE AS u
    FROM documents
), a AS (
    SELECT source, count(*)::DOUBLE AS amount FROM documents GROUP BY source
), r AS (
    SELECT source, sqrt(amount) / (SELECT sum(sqrt(amount)) FROM a) * (SELECT sum(amount) FROM a) / amount AS rate FROM a
), p AS (
    SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
    FROM r, range(0, 100) AS g(k)
), t AS (
    SELECT source, list(cdf ORDER BY k) AS steps FROM p WHERE cdf < 1 - 1.2e-16 GROUP BY source
), c AS (
    SELECT d.doc_id, d.source, d.text, len(list_filter(t.steps, lambda s: s <= d.u)) AS n_copies
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, text, unnest(range(1, n_copies + 1)) AS copy, n_copies::BIGINT AS n_copies FROM c WHERE n_copies > 0
"""
