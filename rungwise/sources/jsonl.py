"""JSONL files in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.functions.text import strip
from rungwise.operators.ordering import first_per_key, index_in_splits, with_index
from rungwise.session import materialize
from rungwise.sources.documents import document_elements, of_files


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches ``path`` on its own file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path)
    return found is not None and len(found) > 0


# Number words that writers of the format use although JSON has none for them.
_NUMBER_WORD = r'(?s)\G((?:[^"NI-]++|-(?!Infinity)|"(?:[^"\\]++|\\.)*+")*+)(?:NaN|-?Infinity)'


def plain_numbers(c: Column) -> Column:
    """JSON text with null for the bare words NaN and Infinity; words inside strings stay."""
    return F.when(c.rlike("NaN|Infinity"), F.regexp_replace(c, _NUMBER_WORD, "$1null")).otherwise(c)


def strict_json(c: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else null.

    The number words NaN and Infinity read as null. Of repeated keys the last wins where the
    session has ``spark.sql.variant.allowDuplicateKeys``, which the readers here set.

    The built-in parser stops after the first value and does not look at what follows. Inside
    brackets, and inside braces, whatever follows is an error; a text that closes one of the two
    by itself does not fit the other.
    """
    c = plain_numbers(c)
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    only = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(keyed.isNotNull() & only, F.try_variant_get(listed, "$[0]", "variant"))


def read_lines(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """Non-blank lines as ``value`` with their origin (SRT-2).

    ``src`` is the rank of the path, ``file`` and ``block`` name the split a line came from and
    ``at`` grows along it. Together they give the order of the input; ``at`` alone does not,
    because splits are not read in file order. A missing path gives no rows.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    frames = []
    for rank, path in enumerate(paths):
        if not path_exists(spark, path):
            continue
        reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
        frames.append(
            reader.text(path).select(
                "value",
                F.lit(rank).alias("src"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("at"),
            )
        )
    if not frames:
        return spark.createDataFrame([], "value string, src int, file string, block bigint, at bigint")
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out.withColumn("value", strip(F.col("value"))).filter(F.col("value") != "")


LINE_ORDER = ("src", "file", "block", "at")


def read_jsonl(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """Parsed lines as the variant ``v``; null where a line is no JSON (SRC-1)."""
    return read_lines(spark, *paths, glob=glob).withColumn("v", strict_json(F.col("value")))


def good_records(lines: DataFrame) -> DataFrame:
    """Lines that parsed."""
    return lines.filter(F.col("v").isNotNull())


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that did not parse, for a side output."""
    return lines.filter(F.col("v").isNull()).drop("v")


def read_json_or_jsonl(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """Records of a JSON array, of one JSON object, or of lines that may end in commas (SRC-2).

    ``layout`` is ``"document"`` or ``"lines"``. By default a file that is one array or one object
    as a whole is a document, whatever its size: arrays are cut into elements split by split, and only
    an element has to fit a row. An array with one element on each line is the same read by lines.
    Scalars become ``{"value": x}``; fragments that do not parse are left out. Files of which nothing
    is known are read by lines too, so a document whose line does not fit a row needs its ``layout``.
    """
    as_lines = read_lines(spark, path)
    loose = as_lines.withColumn("v", strict_json(strip(F.regexp_replace("value", r"[,\s]+\z", ""))))
    only_lines = _records(loose.filter(F.col("v").isNotNull()))
    if layout == "lines" or not path_exists(spark, path):
        return only_lines
    text = strip(F.col("text"))
    elements = document_elements(spark, path).select("file", "number", (text == "").alias("blank"), strict_json(text).alias("v"))
    elements = materialize(elements, "document-elements")
    counted = elements.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("blank").alias("n_blank"), F.count_if(F.col("v").isNull() & ~F.col("blank")).alias("n_bad")
    )
    # One row per document. A blank element is an empty array, or an error.
    sound = counted.filter((F.col("n_bad") == 0) & ((F.col("n_blank") == 0) | (F.col("n") == 1))).select("file")
    sound = materialize(sound, "documents")
    from_documents = of_files(
        elements.filter(F.col("v").isNotNull()).select(
            F.lit(0).alias("src"), "file", F.lit(0).cast("bigint").alias("block"), F.col("number").alias("at"), "v"
        ),
        sound,
        "left_semi",
    )
    if layout == "document":
        return _records(from_documents)
    at = F.struct("block", "at")
    by_line = (
        of_files(loose, sound, "left_semi")
        .groupBy("file")
        .agg(F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"), F.count_if(F.col("v").isNull()).alias("n_open"))
        .filter("first = '[' and last = ']' and n_open = 2")
        .select("file")
    )
    documents = materialize(sound.join(by_line, "file", "left_anti"), "documents")
    from_documents = of_files(from_documents, documents, "left_semi")
    rest = of_files(loose.filter(F.col("v").isNotNull()), documents, "left_anti")
    return _records(from_documents.unionByName(rest.select(*LINE_ORDER, "v")))


def _records(df: DataFrame) -> DataFrame:
    wrapped = F.parse_json(F.concat(F.lit('{"value":'), F.to_json("v"), F.lit("}")))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    return df.withColumn("v", F.when(is_object, F.col("v")).otherwise(wrapped)).select(*LINE_ORDER, "v")


def field(name: str, type_: str = "string", v: str = "v") -> Column:
    """Field of a parsed record, null if absent or of another type."""
    return F.try_variant_get(v, f"$.{name}", type_)


def first_field(names: Sequence[str], v: str = "v") -> Column:
    """First of several names under which a record may hold a field, as a variant."""
    options = []
    for name in names:
        value = F.try_variant_get(v, f"$.{name}", "variant")
        text = F.to_json(value)
        options.append(F.when(~text.isin("null", '""', "[]", "{}", "0", "false"), value))
    return F.coalesce(*options)


def last_record_by_id(lines: DataFrame) -> DataFrame:
    """``id`` and ``v`` of keyed records; the last line of a repeated id wins (SRC-3)."""
    keyed = lines.withColumn("id", field("id")).filter("id is not null and id != ''")
    return first_per_key(keyed.select("id", "v", *LINE_ORDER), ["id"], LINE_ORDER, last=True).select("id", "v")


def excluded_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a skip list whose lines are records with an id, or ids as such (SRC-5a)."""
    lines = read_jsonl(spark, path)
    is_record = F.coalesce(F.schema_of_variant("v").rlike(r"^OBJECT<(.*, )?id:"), F.lit(False))
    return (
        lines.select(F.when(is_record, field("id")).otherwise(F.col("value")).alias("id"))
        .filter("id is not null")
        .distinct()
    )


def processed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids found in one file or in all JSONL files of a folder (SRC-5b)."""
    glob = None if path.endswith(".jsonl") else "*.jsonl"
    return read_jsonl(spark, path, glob=glob).select(field("id").alias("id")).filter("id is not null").distinct()


def skip_lines(lines: DataFrame, k: int) -> DataFrame:
    """Lines from the ``k``-th on, counted from 0 (SRC-4). Reports an offset past the end."""
    indexed = index_lines(lines)
    if k and indexed.filter(F.col("idx") >= k).isEmpty():
        raise ValueError(f"offset {k} is not below the number of rows")
    return indexed.filter(F.col("idx") >= k)


def index_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with their dense position ``idx`` in input order.

    Rows straight from files stay where they are: only the counts of the splits are summed up. Others are
    sorted by ranges.
    """
    placed = index_in_splits(lines, ("src", "file", "block"), "at")
    return with_index(lines, LINE_ORDER) if placed is None else placed


def shard_of(idx: Column, total: Column, shards: int) -> Column:
    """1-based shard of a 0-based position when ``total`` rows are cut into even runs (SNK-2)."""
    return F.floor(idx / F.ceil(total / shards)) + 1


def with_shards(df: DataFrame, shards: int, order: Sequence[str]) -> DataFrame:
    """``df`` with ``idx`` and the ``shard`` each row belongs to (SNK-2)."""
    indexed = index_lines(df) if tuple(order) == LINE_ORDER else with_index(df, order)
    total = indexed.agg(F.count(F.lit(1)).alias("_total"))
    # One row.
    return indexed.join(F.broadcast(total)).withColumn(
        "shard", shard_of(F.col("idx"), F.col("_total"), shards)
    ).drop("_total")


def write_shards(df: DataFrame, path: str, value: str = "value") -> None:
    """Lines of ``with_shards`` below ``path``, one folder per shard, in order.

    Rows are cut by ranges of position, so a large shard is written by several tasks; the names of
    its files follow their order.
    """
    df.repartitionByRange("shard", "idx").sortWithinPartitions("shard", "idx").select("shard", value).write.partitionBy(
        "shard"
    ).text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row; nulls are written (SNK-1)."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_outcomes(df: DataFrame, path: str, keep: Sequence[str] = ("id",)) -> None:
    """Rows of a hook as lines below ``path``: whole records in ``outcome=good``, the others in ``outcome=error``.

    One pass writes both, so the hook runs once (SNK-1, SNK-4). A good record has no ``error`` field, an
    error record has ``keep`` and ``error``; nulls are written. Either folder is absent if it has no row.
    """
    plain = [c for c in df.columns if c != "error"]

    def line(names: Sequence[str]) -> Column:
        return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})

    good = F.col("error").isNull()
    df.select(
        F.when(good, "good").otherwise("error").alias("outcome"),
        F.when(good, line(plain)).otherwise(line([*keep, "error"])).alias("value"),
    ).write.partitionBy("outcome").text(path)


def read_outcome(spark: SparkSession, path: str, outcome: str, schema: str) -> DataFrame:
    """Records of one outcome (``good`` or ``error``) of ``write_outcomes``; none if its folder is absent."""
    folder = f"{path}/outcome={outcome}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(folder)


def merged_records(lines: DataFrame) -> DataFrame:
    """Good records of shard files: parsed, and no error record (SNK-3)."""
    return good_records(lines).filter(~is_error_record())


def is_error_record(v: str = "v") -> Column:
    """Whether a record is an object with an ``error`` key (SNK-3)."""
    return F.coalesce(F.schema_of_variant(v).rlike(r"^OBJECT<(.*, )?error:"), F.lit(False))


def merge_counts(lines: DataFrame) -> DataFrame:
    """Lines read, written and left out, in one aggregate (AGG-13)."""
    bad = F.col("v").isNull() | is_error_record()
    return lines.agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(~bad).alias("n_out"), F.count_if(bad).alias("n_errors")
    )
