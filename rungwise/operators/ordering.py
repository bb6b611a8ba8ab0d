"""Ordered work per key that does not put one heavy key into one task.

Ranks and carries are windows over a key. A window runs a whole key in one task, so a key that
holds a third of the rows would stop the job. ``tag_blocks`` finds such keys with a thin count
and cuts only them into blocks along their order; a block is then the unit of the window, and
one number per block links the blocks. Keys of ordinary size form one block and pay for nothing
but the count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.session import materialize

HEAVY_ROWS = 1_000_000
MAX_HEAVY_KEYS = 100_000


def heavy_keys(df: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Keys with more than ``heavy_rows`` rows, at most ``MAX_HEAVY_KEYS`` of the largest.

    The limit makes the result safe to broadcast at any input size. A key it leaves out is
    smaller than 1/MAX_HEAVY_KEYS of the input, which one task can hold.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > heavy_rows)
        .orderBy(F.col("_rows").desc(), *keys)
        .limit(MAX_HEAVY_KEYS)
        .select(*[F.col(k).alias(f"_heavy_{k}") for k in keys])
    )


def tag_heavy(df: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Add the boolean ``_heavy``: whether the row's key is a heavy one. A null key is a key."""
    return mark_heavy(df, keys, heavy_keys(df, keys, heavy_rows))


def mark_heavy(df: DataFrame, keys: Sequence[str], heavy: DataFrame) -> DataFrame:
    """Add ``_heavy`` from a list that ``heavy_keys`` made."""
    heavy = heavy.withColumn("_heavy", F.lit(True))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_heavy_{k}"))
    return (
        df.join(F.broadcast(heavy), condition, "left")
        .withColumn("_heavy", F.coalesce("_heavy", F.lit(False)))
        .drop(*[f"_heavy_{k}" for k in keys])
    )


def tag_blocks(
    df: DataFrame, keys: Sequence[str], block: Column, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Add ``_heavy`` and ``_blk``: ``block`` for rows of heavy keys, 0 for all others.

    ``block`` must not fall along the order the caller will use inside the key.
    """
    return tag_heavy(df, keys, heavy_rows).withColumn(
        "_blk", F.when(F.col("_heavy"), block).otherwise(F.lit(0)).cast("bigint")
    )


def block_keys(keys: Sequence[str]) -> list[str]:
    """What the rows of one block share. The flag lets Spark filter heavy rows below a window."""
    return [*keys, "_blk", "_heavy"]


def _earlier_blocks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)


def rank_in_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    name: str = "rank",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """1-based position of each row in its key (WIN-2). ``order`` must be unique in the key."""
    tagged = tag_blocks(df, keys, block, heavy_rows)
    parts = block_keys(keys)
    # One row per block of a heavy key.
    offsets = (
        tagged.filter("_heavy")
        .groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(_earlier_blocks(keys)))
        .drop("_n")
    )
    inside = Window.partitionBy(*parts).orderBy(*order)
    return (
        tagged.withColumn(name, F.row_number().over(inside).cast("bigint"))
        .join(offsets, parts, "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, name)
    )


def carry_last(
    tagged: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Last non-null ``value`` of the rows before each row of a key, on rows of ``tag_blocks``."""
    parts = block_keys(keys)
    placed = F.when(F.col(value).isNotNull(), F.struct(*order))
    carried = (
        tagged.filter("_heavy")
        .groupBy(*parts)
        .agg(F.max_by(value, placed).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(_earlier_blocks(keys)))
        .drop("_last")
    )
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.withColumn(name, F.last(value, ignorenulls=True).over(inside))
        .join(carried, parts, "left")
        .withColumn(name, F.coalesce(name, "_carried"))
        .drop("_blk", "_heavy", "_carried")
    )


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False
) -> DataFrame:
    """The first (or last) whole row of each key.

    A grouped minimum is combined before the shuffle, so a key with very many rows sends one row
    per task; a ranking window would send them all to one.
    """
    payload = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    pick = F.max_by if last else F.min_by
    picked = df.groupBy(*keys).agg(pick(payload, F.struct(*order)).alias("_row"))
    return picked.select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]
    )


def with_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """0-based dense position of each row in the order of ``order``, which must be unique.

    Rows are range partitioned, so no partition grows with anything but its share, and the
    positions inside partitions are stored before they are used.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    stored = materialize(placed, "index")
    # One row per partition, so neither the window nor the broadcast grows with the rows.
    every_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(every_part), F.lit(0)).alias("_start"))
    )
    return (
        stored.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_part", "_at", "_start")
    )


MAX_SPLITS = 500_000


def index_in_splits(df: DataFrame, split: Sequence[str], along: str, name: str = "idx") -> DataFrame | None:
    """0-based dense position of each row, by ``split`` and then as rows lie in a split.

    For rows as a scan gives them: the rows of one split are together in one task, in the order of
    ``along``. They are counted per split; the counts, one small row a split, are summed up in order
    and joined back, so no row moves. Gives None where the rows do not lie like that, or where there
    are more than ``MAX_SPLITS`` splits, whose counts would be too many to broadcast.
    """
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    counted = numbered.groupBy(*split).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_id").alias("_first"),
        F.max("_id").alias("_last"),
        F.min_by(along, "_id").alias("_low"),
        F.max_by(along, "_id").alias("_high"),
        F.min(along).alias("_least"),
        F.max(along).alias("_most"),
    )
    counted = materialize(counted, "split-counts")
    astray = counted.filter("_last - _first + 1 <> _n or _low <> _least or _high <> _most")
    if not astray.isEmpty() or counted.limit(MAX_SPLITS + 1).count() > MAX_SPLITS:
        return None
    # One row per split.
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        *[F.col(c).alias(f"_split_{c}") for c in split],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.lit(True)
    for c in split:
        same = same & F.col(c).eqNullSafe(F.col(f"_split_{c}"))
    # Of limited length.
    return numbered.join(F.broadcast(starts), same).withColumn(name, F.col("_id") + F.col("_shift")).select(*df.columns, name)


def order_key_at(df: DataFrame, order: Sequence[str], position: int) -> DataFrame:
    """The ``order`` columns of the row at a 0-based position, as one row; none if there is no such row.

    Only the order columns are sorted, by ranges, and numbered by counts of the ranges.
    """
    return with_index(df.select(*order), order, "_at").filter(F.col("_at") == position).select(*order)
