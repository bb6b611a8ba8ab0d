"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_stored: ContextVar[list[str] | None] = ContextVar("rungwise_stored", default=None)


def build_session(app_name: str = "rungwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Parsing and scoring texts is bound by processor time, not bytes: keep small shuffles spread.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Noting the Python line of each column takes most of the time of building long expressions.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master with the setting absent, as in
    tests. On a cluster the setting is required, because executors must all see the folder.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="rungwise-checkpoint-")
    spark.conf.set(_CHECKPOINT_KEY, root)
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and gives the next plan real table sizes and
    column pruning. The folder is shared and durable; its owner decides how long tables stay, by
    ``releasing`` or otherwise.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/rungwise/{label}-{uuid.uuid4().hex}"
    held = _stored.get()
    if held is not None:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``materialize`` stores within, once their results are written.

    Tables that a result still reads must not go before it is written, so write it inside. Each block
    removes its own tables only, also after an error; other threads are not affected.
    """
    token = _stored.set([])
    try:
        yield
    finally:
        paths = _stored.get()
        _stored.reset(token)
        for path in paths:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
