"""Shards, offsets and merged records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.bridges import table, text
from rungwise.functions import text as T
from rungwise.operators.ordering import with_index
from rungwise.operators.requests import request_lines
from rungwise.queries.registry import query
from rungwise.session import checkpoint_root
from rungwise.sources import jsonl


@query(
    """
WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, idx, CAST(floor(idx / ceil(n / 7.0)) AS BIGINT) + 1 AS shard FROM i
"""
)
def shard_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2: documents cut into seven even runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return jsonl.with_shards(docs, 7, ["doc_id"]).select("doc_id", "idx", "shard")


@query("SELECT event_id, event_id AS idx FROM events WHERE event_id >= 500")
def resume_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4: events from the 500th on. Event ids are 0, 1, 2, .. in order."""
    events = table(spark, sf_dir, "events").select("event_id")
    return with_index(events, ["event_id"]).filter("idx >= 500")


_LINES_SQL = """
WITH l AS (SELECT event_id, event_type, event_type IN ('error', 'view') AS bad FROM events)
"""


def _record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shard lines: errors as error records, views as broken lines."""
    kind = F.col("event_type")
    line = (
        F.when(kind == "error", F.to_json(F.struct(F.col("event_id").alias("id"), kind.alias("error"))))
        .when(kind == "view", text('{"id": ', F.col("event_id"), ", "))
        .otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), kind.alias("answer"), F.lit("error").alias("note"))))
    )
    return table(spark, sf_dir, "events").select(line.alias("value")).withColumn(
        "v", jsonl.strict_json(F.col("value"))
    )


@query(_LINES_SQL + "SELECT event_id AS id, event_type AS answer FROM l WHERE NOT bad")
def merge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, SNK-4: records that parse and carry no error."""
    good = jsonl.merged_records(_record_lines(spark, sf_dir))
    return good.select(jsonl.field("id", "bigint").alias("id"), jsonl.field("answer").alias("answer"))


@query(
    _LINES_SQL + "SELECT count(*) AS n_in, count(*) FILTER (NOT bad) AS n_out, count(*) FILTER (bad) AS n_errors FROM l"
)
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: lines read, written and left out."""
    return jsonl.merge_counts(_record_lines(spark, sf_dir))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_root(spark)}/rungwise/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """The folder that ``lines`` were written to as text."""
    path = _folder(spark, name)
    lines.select("value").write.text(path)
    return path


@query("SELECT doc_id, text, lang, source FROM documents")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, SRC-1: documents written as JSON lines, nulls too, and read back."""
    path = _folder(spark, "round-trip")
    jsonl.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    read = jsonl.good_records(jsonl.read_jsonl(spark, path))
    return read.select(jsonl.field("doc_id", "bigint").alias("doc_id"), *[jsonl.field(c).alias(c) for c in ("text", "lang", "source")])


@query(
    """
SELECT event_id AS id, event_type AS answer, CASE event_id % 4 WHEN 3 THEN 'NaN, Infinity' END AS note, NULL::DOUBLE AS score FROM events
"""
)
def read_lines_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1: lines with number words and repeated keys are records; the words read as null."""
    at, kind = F.col("event_id"), F.col("event_type")
    line = (
        F.when(at % 4 == 0, text('{"id":', at, ',"answer":"', kind, '","score":NaN}'))
        .when(at % 4 == 1, text('{"id":', at, ',"answer":"', kind, '","score":-Infinity,"all":[Infinity,1,-2]}'))
        .when(at % 4 == 2, text('{"id":0,"answer":"first","id":', at, ',"answer":"', kind, '"}'))
        .otherwise(text('{"id":', at, ',"answer":"', kind, '","note":"NaN, Infinity"}'))
    )
    path = _written(spark, table(spark, sf_dir, "events").select(line.alias("value")), "lenient")
    read = jsonl.good_records(jsonl.read_jsonl(spark, path))
    names = {"id": "bigint", "answer": "string", "note": "string", "score": "double"}
    return read.select(*[jsonl.field(name, type_).alias(name) for name, type_ in names.items()])


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'P'")
def read_comma_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: records on lines that end in commas; broken ones are left out."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    line = F.when(status == "P", text('{"id":', key, ", ")).otherwise(text('{"id":', key, ',"status":"', status, '"},'))
    path = _written(spark, table(spark, sf_dir, "orders").select(line.alias("value")), "comma-lines")
    read = jsonl.read_json_or_jsonl(spark, path)
    return read.select(jsonl.field("id", "bigint").alias("id"), jsonl.field("status").alias("status"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events")
def read_skip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5a: a skip list of records with an id and of bare ids."""
    user = F.col("user_id")
    line = F.when(F.col("event_id") % 2 == 0, text('{"id":"', user, '"}')).otherwise(user.cast("string"))
    return jsonl.excluded_ids(spark, _written(spark, table(spark, sf_dir, "events").select(line.alias("value")), "skip"))


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id FROM customer")
def read_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5b: the ids in all JSON line files of a folder. Spark names such files ``.json``."""
    path = _folder(spark, "processed")
    jsonl.write_jsonl(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id")), path)
    return jsonl.read_jsonl(spark, path, glob="*.json").select(jsonl.field("id").alias("id")).distinct()


@query(
    """
SELECT o_orderkey AS id, 'a ' || o_custkey || ' b ' || o_orderstatus AS strict,
  'a ' || o_custkey || chr(10) || 'b ' || o_orderstatus AS lenient
FROM orders
"""
)
def nested_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-1a, TXT-1b: seven lists deep, and a long chain of objects and lists."""
    a, b = text("a ", F.col("o_custkey")), text(F.col("o_orderstatus"))
    deep = F.try_parse_json(text('[[[[[[["', a, '"]],"b"]]],["', b, '"]]]'))
    mixed = F.try_parse_json(text('[[[[[[[{"text":["', a, '\\nb",null,{"content":[{"text":{"value":[{"content":[[{"value":"', b, '"}]]}]}}]}]}]]]]]]]'))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), T.to_text(deep).alias("strict"), T.to_text_open(mixed).alias("lenient")
    )


@query(
    """
SELECT 'm' AS model, '{"custom_id":"' || event_id || '__rep0__m","method":"POST","url":"/v1/chat/completions","body":{"model":"m","messages":'
  || '[{"role":"user","content":"' || event_type || '"}],"max_completion_tokens":16,"temperature":0.5}}' AS value
FROM events
"""
)
def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5: request lines written below their model and read back."""
    asked = table(spark, sf_dir, "events").select(
        text(F.col("event_id"), "__rep0__m").alias("custom_id"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"))).alias("messages"),
        F.lit(16).alias("max_tokens"),
        F.lit(0.5).alias("temperature"),
    )
    path = _folder(spark, "requests")
    request_lines(asked, "m").write.partitionBy("model").text(path)
    return spark.read.text(path).select("model", "value")


@query(
    """
WITH i AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS idx, count(*) OVER () AS n FROM events)
SELECT CAST(CAST(floor(idx / ceil(n / 3.0)) AS BIGINT) + 1 AS INT) AS shard, event_id AS id, event_type AS answer FROM i
"""
)
def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, SNK-3: lines written as three shards; the records of all shard files read back."""
    lines = table(spark, sf_dir, "events").select(
        "event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("answer"))).alias("value")
    )
    path = _folder(spark, "shards")
    jsonl.write_shards(jsonl.with_shards(lines, 3, ["event_id"]), path)
    read = jsonl.merged_records(jsonl.read_jsonl(spark, path))
    shard = F.regexp_extract("file", "/shard=([0-9]+)/", 1).cast("int")
    return read.select(shard.alias("shard"), jsonl.field("id", "bigint").alias("id"), jsonl.field("answer").alias("answer"))


@query(
    """
SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, 'a "[{' || l_returnflag || '}, ' || chr(92) || l_linestatus || '" ]' AS note
FROM lineitem
"""
)
def read_split_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: pretty-printed arrays of many elements, cut where their splits lie; strings hold brackets and quotes."""
    note = text('a \\"[{', F.col("l_returnflag"), "}, ", "\\\\", F.col("l_linestatus"), '\\" ]')
    element = text(
        '  {\n    "id": ', F.col("l_orderkey"), ',\n    "n": [', F.col("l_linenumber"), ",\n      ", F.col("l_partkey"), '\n    ],\n    "note": "', note, '"\n  }'
    )
    # A document holds the lines of 15,000 orders, whatever the table's size.
    items = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 15_000).alias("document"), F.col("l_orderkey").alias("k"), element.alias("value")
    )
    named = items.select("document").distinct()
    frame = (
        items.select("document", F.lit(1).alias("part"), F.concat(F.lit(",\n"), "value").alias("value"))
        .unionByName(named.select("document", F.lit(0).alias("part"), F.lit('[\n  {"head": [[], {}, ",]"]}').alias("value")))
        .unionByName(named.select("document", F.lit(2).alias("part"), F.lit("\n]\n").alias("value")))
    )
    path = _folder(spark, "split-document")
    frame.repartition("document").sortWithinPartitions("document", "part").select("document", "value").write.partitionBy("document").option("lineSep", "\n").text(path)
    read = jsonl.read_json_or_jsonl(spark, f"{path}/*", "document").filter(jsonl.field("id", "bigint").isNotNull())
    return read.select(
        jsonl.field("id", "bigint").alias("id"),
        F.try_variant_get("v", "$.n[0]", "int").alias("n"),
        F.try_variant_get("v", "$.n[1]", "bigint").alias("part"),
        jsonl.field("note").alias("note"),
    )


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several files, an event each, in the order of the events, with blank lines between."""
    events = table(spark, sf_dir, "events").repartitionByRange(5, "event_id").sortWithinPartitions("event_id")
    line = F.concat(F.when(F.col("event_id") % 3 == 0, F.lit(" \n")).otherwise(F.lit("")), text('{"id":', F.col("event_id"), "}"))
    return jsonl.read_jsonl(spark, _written(spark, events.select(line.alias("value")), "event-lines"))


@query("SELECT event_id AS id, event_id AS idx FROM events WHERE event_id >= 500")
def resume_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4, SRT-2: lines of several files from the 500th on, numbered by the counts of their splits."""
    rest = jsonl.skip_lines(_event_lines(spark, sf_dir), 500)
    return rest.select(jsonl.field("id", "bigint").alias("id"), "idx")


@query(
    """
WITH n AS (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS idx, count(*) OVER () AS n FROM events)
SELECT id, idx, CAST(floor(idx / ceil(n / 7.0)) AS BIGINT) + 1 AS shard FROM n
"""
)
def shard_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, SRT-2: lines of several files in seven even runs."""
    sharded = jsonl.with_shards(_event_lines(spark, sf_dir), 7, jsonl.LINE_ORDER)
    return sharded.select(jsonl.field("id", "bigint").alias("id"), "idx", "shard")
