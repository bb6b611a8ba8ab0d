"""Exact deduplication by deterministic block naming (native).

Texts are cut into blocks of a fixed number of code points. The distinct blocks are sorted and get
integer names; then adjacent names are paired, the distinct pairs are sorted and named, and so on
until one name per text is left. Two texts of the same number of levels have the same last name
exactly when they are equal: names stand for contents, not for hashes of them.

A text that alone has its length and first characters is already identified and takes no part in
the naming; the texts that share both are named whole.

Defined results: a null text counts as empty; all empty texts are one group. Rows with the same id
and the same text are one document listed several times: they count in ``group_size`` and share
``kept``. A null id is smaller than any other; a group with null ids only keeps the null. Only the
id and text columns are read, so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.session import materialize

BLOCK_CHARS = 4096
HEAD_CHARS = 64
RANGE_CHARS = 8
_NO_PARTNER = -1


def integer_names(rows: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """The distinct values of ``columns`` with an integer ``name`` that follows their sort order.

    Copies are combined before the shuffle. Range partitions keep every task at its share, and the
    names are stored before anything uses them, so a repeated task cannot rename. Texts are sorted by
    their first characters, their hash and then as a whole: the driver samples what ranges are cut by,
    so that is kept short.
    """
    kinds = dict(rows.dtypes)
    short = [k for c in columns for k in ([F.substring(c, 1, RANGE_CHARS), F.xxhash64(c)] if kinds[c] == "string" else [F.col(c)])]
    return materialize(
        rows.select(*columns)
        .distinct()
        .repartitionByRange(*short)
        .sortWithinPartitions(*short, *columns)
        .withColumn("name", F.monotonically_increasing_id()),
        label,
    )


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumns({"chars": F.char_length("text"), "head": F.substring("text", 1, HEAD_CHARS)})


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]):
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row: doc_id, text_sha256, chars, level, name.

    (``level``, ``name``) identifies the text; both are null where the text is alone. The digest
    only finds rows again (with the id); it does not decide equality.
    """
    located = _located(docs, id_col, text_col)
    keys = materialize(
        located.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "chars", "head"), "dedup-keys"
    )
    shared = materialize(
        keys.groupBy("chars", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and chars > 0").select("chars", "head"),
        "dedup-shared",
    )
    # The joins below are merge joins at every size: neither side has a bound that allows a broadcast.
    blocks = materialize(
        located.join(shared.hint("merge"), ["chars", "head"])
        .select(
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.ceil(F.col("chars") / block_chars).alias("blocks"),
            F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))).alias("pos", "block"),
        ),
        "dedup-blocks",
    )
    names = integer_names(blocks, ["block"], "dedup-names")
    rows = materialize(
        blocks.join(names.hint("merge"), "block").select("doc_id", "text_sha256", "blocks", "pos", "name"), "dedup-level"
    )
    level, done = 0, []
    while True:
        done.append(
            rows.filter("blocks = 1").select("doc_id", "text_sha256", F.lit(level).alias("level"), "name")
        )
        rest = rows.filter("blocks > 1")
        if rest.isEmpty():
            break
        pairs = materialize(
            rest.groupBy("doc_id", "text_sha256", "blocks", F.shiftright("pos", 1).alias("at"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(_NO_PARTNER)).alias("second"),
            )
            .select("doc_id", "text_sha256", F.ceil(F.col("blocks") / 2).alias("blocks"), F.col("at").alias("pos"), "first", "second"),
            "dedup-pairs",
        )
        names = integer_names(pairs, ["first", "second"], "dedup-names")
        rows = pairs.join(names, ["first", "second"]).select("doc_id", "text_sha256", "blocks", "pos", "name")
        level += 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = found.distinct()
    empty = F.col("chars") == 0
    return (
        keys.alias("k")
        .join(found.alias("f").hint("merge"), _same(keys, found, ["doc_id", "text_sha256"]), "left")
        .select(
            "k.doc_id",
            "k.text_sha256",
            "k.chars",
            F.when(empty, _NO_PARTNER).otherwise(F.col("f.level")).alias("level"),
            F.when(empty, _NO_PARTNER).otherwise(F.col("f.name")).alias("name"),
        )
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    named = materialize(identities(docs, id_col, text_col, block_chars), "dedup-identities")
    groups = materialize(
        named.filter("name is not null")
        .groupBy("level", "name")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "dedup-groups",
    )
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return named.join(groups.hint("merge"), ["level", "name"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row left of each group of equal texts, all columns as they came."""
    kept = materialize(exact_groups(docs, id_col, text_col).filter("kept").select("doc_id", "text_sha256"), "dedup-kept")
    once = kept.distinct()
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_sha"),
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
    )
    left = rows.join(
        once.hint("merge"), rows["_id"].eqNullSafe(once["doc_id"]) & (rows["_sha"] == once["text_sha256"]), "left_semi"
    )
    repeated = kept.groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if not repeated.isEmpty():
        # Rows that repeat id and text: any one of them stays, the others differ at most in extra columns.
        left = left.groupBy("_id", "_sha").agg(F.any_value("_row").alias("_row"))
    return left.select("_row.*")


EXACT_GROUPS_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
