"""Labelling that picks up where it stopped (STR-2)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rungwise.operators.collate import skip_processed
from rungwise.sources.jsonl import path_exists

#: Buckets that finished ids are dealt to; fixed for the life of an output.
BUCKETS = 64
_OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def unprocessed(stream: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of a stream whose id is not finished yet."""
    return skip_processed(stream, done)


def append_new(
    stream: DataFrame, done: DataFrame, path: str, checkpoint: str, fmt: str = "json", one_per_id: bool = True
) -> StreamingQuery:
    """Append the rows whose id is not finished to ``path`` and stop when the input is read.

    The checkpoint remembers which files were read, so a restart continues and writes no row twice.
    With ``one_per_id`` it also remembers every id written, a state that grows with the ids, and
    one row of each id (and one of those without) is written. Without it every row is written,
    rows with a null or repeated id too, and no state is kept.
    """
    new = unprocessed(stream, done)
    return (
        (new.dropDuplicates(["id"]) if one_per_id else new)
        .writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _output_table(spark: SparkSession, schema: T.StructType, path: str, buckets: int) -> str:
    """Name of the table over ``path``, dealt into buckets by key, with the batches found there."""
    name = f"once_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, _key STRING, _batch BIGINT) USING parquet "
        f"PARTITIONED BY (_batch) CLUSTERED BY (_key) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    if path_exists(spark, path):
        spark.catalog.recoverPartitions(name)
    return name


def new_rows(rows: DataFrame, batch: int, output: DataFrame, buckets: int) -> DataFrame:
    """One row of each id that no batch before ``batch`` holds, with its ``_key``; null counts as an id.

    Only ``rows`` are shuffled, the rows of an id that comes often after they became one in their task.
    They meet the finished ids of their bucket where those lie.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    earlier = output.filter(F.col("_batch") < batch).select("_key")
    first = rows.withColumn("_key", key).dropDuplicates(["_key"]).repartition(buckets, "_key")
    return first.join(earlier, "_key", "left_anti").select(*rows.columns, "_key")


def write_once(rows: DataFrame, batch: int, path: str, buckets: int = BUCKETS) -> None:
    """Write the rows of one batch whose id no earlier batch wrote, one row of each id.

    A batch is a partition of its own and is written whole: one that was lost between its write and its
    commit comes again under its number, looks at the batches before it only, and replaces itself.
    The output itself tells what is finished, so no state grows beside it.
    """
    spark = rows.sparkSession
    name = _output_table(spark, rows.schema, path, buckets)
    new = new_rows(rows, batch, spark.table(name), buckets)
    written = new.withColumn("_batch", F.lit(batch).cast("bigint"))
    # Only the batch's own partition is replaced; a stream's batches run in a session of their own.
    mode = spark.conf.get(_OVERWRITE_MODE)
    spark.conf.set(_OVERWRITE_MODE, "dynamic")
    try:
        written.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(_OVERWRITE_MODE, mode)


def append_once(
    stream: DataFrame, done: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Like ``append_new`` with one row of each id, but without state; stops when the input is read.

    ``buckets`` stays the same for the life of an output, which ``read_once`` reads.
    """
    return (
        unprocessed(stream, done)
        .writeStream.foreachBatch(lambda rows, batch: write_once(rows, batch, path, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that ``append_once`` wrote, with the columns of ``schema``."""
    return spark.read.schema(schema).parquet(path).drop("_batch")
