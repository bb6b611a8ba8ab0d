"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (line, n): the 128-bit digest of a line's key and the number of documents that
hold it, in hash buckets and sorted inside each. Documents come in batches. A new batch counts its
lines, is merge-joined against every run to leave out the lines that a run already knows to be
repeated often enough, and adds what remains as a run of its own at the lowest level. When a level
has ``FAN`` runs they are merged into one run of the next level, so there are few runs at any time
and each line is rewritten a number of times that grows with the logarithm of the batches.

At the end the lines counted often enough are taken out of their documents. Only digests are
exploded, joined and grouped. Lines that very many documents hold are told from the rest by a list
of bounded length, which is broadcast; the others go through a merge join, in which no line has more
than a small share of the rows. What a document loses is one set of digests, which its text is then
filtered by, in order.

Defined results: a text is split at line feeds; a null or empty text is one empty line. A line's key
is the line without ASCII white space at its ends, A-Z in lower case; lines with a key shorter than
``least_chars`` always stay. Each row is a document: rows that repeat an id, or id and text, count
once each. A null id is an id. Only the id and text columns are read, so other columns cannot clash.
An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.session import checkpoint_root, materialize

THRESHOLD = 10
BATCHES = 4
FAN = 2
#: Lines in more documents than this are candidates for the list of hot lines, the longest of which is broadcast.
HOT_ROWS = 10_000
MAX_HOT_LINES = 10_000


def line_key(line: bytes) -> bytes:
    """The form under which two lines count as the same."""
    return line.strip().lower()


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (least_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least_chars)


def document_lines(docs: DataFrame, batches: int, least_chars: int = 1) -> DataFrame:
    """(doc_id, text_key, line, batch): the distinct lines of each document row, stored by batch."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, lines = [], []
            for i, text in enumerate(part.column("text")):
                keys = {key for key in map(line_key, _lines(text.as_py())) if _long_enough(key, least_chars)}
                rows += [i] * len(keys)
                lines += map(_digest, keys)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(at), part.column("text_key").take(at), pa.array(lines, pa.binary())],
                names=["doc_id", "text_key", "line"],
            )

    exploded = docs.mapInArrow(make, f"doc_id {id_type}, text_key bigint, line binary")
    spark = docs.sparkSession
    path = f"{checkpoint_root(spark)}/rungwise/lines-{uuid.uuid4().hex}"
    exploded.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(batches)).cast("int")).write.partitionBy(
        "batch"
    ).parquet(path)
    return spark.read.schema(f"doc_id {id_type}, text_key bigint, line binary, batch int").parquet(path)


class LineRuns:
    """Counts of lines over batches, as levelled sorted runs."""

    def __init__(self, spark: SparkSession, threshold: int = THRESHOLD, fan: int = FAN) -> None:
        self.spark, self.threshold, self.fan = spark, threshold, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _store(self, counted: DataFrame, level: int) -> DataFrame:
        """A run: one sorted file per bucket, which joins and merges read without a shuffle."""
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        path = f"{checkpoint_root(self.spark)}/rungwise/{name}"
        counted.repartition(self.buckets, "line").write.format("parquet").bucketBy(self.buckets, "line").sortBy("line").option(
            "path", path
        ).saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        """All runs, lowest level first."""
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Counts the rows of a batch by ``line`` and adds them, less the lines known to be repeated enough."""
        counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            settled = run.filter(F.col("n") >= self.threshold).select("line")
            counted = counted.join(settled.hint("merge"), "line", "left_anti")
        self._place(self._store(counted, 0), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            merged = self._store(_summed(self.levels[level]), level + 1)
            self.levels[level] = []
            self._place(merged, level + 1)

    def repeated(self) -> DataFrame:
        """(line, n) of the lines in at least ``threshold`` documents. ``n`` may stop counting above it."""
        if not self.runs():
            return self.spark.createDataFrame([], "line binary, n bigint")
        return _summed(self.runs()).filter(F.col("n") >= self.threshold)


def _summed(runs: list[DataFrame]) -> DataFrame:
    """The runs merged two at a time: a merge join of both, in which counts of the same line add up.

    (A union of bucketed tables that is then grouped gives wrong sums on Spark 4.1: the plan takes the
    union to be co-partitioned, but the columnar union is not.)
    """
    merged = runs[0]
    for run in runs[1:]:
        more = run.withColumnRenamed("n", "more")
        merged = merged.join(more.hint("merge"), "line", "full").select(
            "line", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n")
        )
    return merged


def repeated_lines_of(lines: DataFrame, repeated: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, text_key, lines): the repeated lines of each document that has any."""
    repeated = materialize(repeated, "lines-repeated")
    # Of limited length, so it is safe to broadcast. What it leaves out has a small share of all rows.
    hot = materialize(
        repeated.filter(F.col("n") > hot_rows).orderBy(F.col("n").desc(), "line").limit(MAX_HOT_LINES).select("line"), "lines-hot"
    )
    rows = lines.select("doc_id", "text_key", "line")
    cold = repeated.select("line").join(F.broadcast(hot), "line", "left_anti")
    found = rows.join(F.broadcast(hot), "line", "left_semi").unionByName(
        rows.join(F.broadcast(hot), "line", "left_anti").join(cold.hint("merge"), "line", "left_semi").select("doc_id", "text_key", "line")
    )
    return found.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines"))


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    least_chars: int = 1,
    batches: int = BATCHES,
    fan: int = FAN,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per document row: doc_id, n_lines, n_dropped, kept.

    Lines whose key stands in at least ``threshold`` documents are gone from ``kept`` everywhere.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    lines = document_lines(docs, batches, least_chars)
    index = LineRuns(docs.sparkSession, threshold, fan)
    for batch in range(batches):
        index.add(lines.filter(F.col("batch") == batch))
    lost = repeated_lines_of(lines, index.repeated(), hot_rows).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    same = docs["doc_id"].eqNullSafe(lost["_id"]) & (docs["text_key"] == lost["_key"])
    joined = docs.join(lost.hint("merge"), same, "left").select("doc_id", "text", "lines")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            before, dropped, kept = [], [], []
            for text, gone in zip(part.column("text"), part.column("lines")):
                split = _lines(text.as_py())
                gone = set(gone.as_py() or ())
                stay = split
                if gone:
                    stay = [line for line in split if not _long_enough(key := line_key(line), least_chars) or _digest(key) not in gone]
                before.append(len(split))
                dropped.append(len(split) - len(stay))
                kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(before, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept"],
            )

    return joined.mapInArrow(make, f"doc_id {id_type}, n_lines bigint, n_dropped bigint, kept string")


def line_digests(kept: DataFrame) -> DataFrame:
    """Of ``drop_repeated_lines``: the digest in place of the text."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


LINE_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
    SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d
), k AS (
    SELECT r, i, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l
), often AS (
    SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= {THRESHOLD}
), stay AS (
    SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept
    FROM k WHERE key NOT IN (SELECT key FROM often) GROUP BY r
)
SELECT doc_id,
       len(ls) AS n_lines,
       len(ls) - coalesce(n, 0) AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN stay USING (r)
"""
