"""Conflict-constrained best-fit packing of documents into fixed-size sequences.

Documents longer than a sequence are cut into full chunks, each a bin of its own, and a tail. Tails
are taken from the longest to the shortest. Open bins are kept in order of what is left in them; the
search starts at the tightest bin that is large enough and goes on to its successors until one is
compatible. A bin is compatible when it holds neither the item's source nor its duplicate cluster,
which bitmaps of the bin tell. Without such a bin a new one is opened.

Best fit is sequential, so rows are dealt by a hash into shards of about ``per_shard`` rows, and
each shard is packed on its own with bounded memory. A hot source or cluster is dealt evenly over
all shards, and so are rows that repeat each other: equal items are counted before the shuffle and
dealt by their number. The only loss is one part-filled set of bins per shard. Only ids and lengths move, not
texts; a bin's text is put together from ``doc_id``, ``start`` and ``length``.

Defined results: every document gives at least one row; a null or empty text is an item of length 0
without a cluster. A null source or cluster conflicts with nothing. Repeated rows are items like
others. Ties in length go to the smaller id, nulls first. Only the named columns are read. An empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.llm.near_dedup import near_components
from rungwise.session import materialize

CAPACITY = 8192
PER_SHARD = 2048
_BIN_BITS = 32


def _bits(values: Sequence) -> list[int]:
    """One bit for each value that occurs at least twice; 0 for the others and for null."""
    count = Counter(v for v in values if v is not None)
    bit = {v: 1 << i for i, v in enumerate(v for v, n in count.items() if n > 1)}
    return [bit.get(v, 0) for v in values]


def best_fit(lengths: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item, items in the given order, and what is left in each bin."""
    source_bits, cluster_bits = _bits(sources), _bits(clusters)
    held_sources: list[int] = []
    held_clusters: list[int] = []
    left: list[int] = []
    open_bins: list[tuple[int, int]] = []
    chosen = []
    for length, source, cluster in zip(lengths, source_bits, cluster_bits):
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (held_sources[b] & source or held_clusters[b] & cluster):
                break
            at += 1
        if at < len(open_bins):
            b = open_bins.pop(at)[1]
        else:
            b = len(left)
            left.append(capacity)
            held_sources.append(0)
            held_clusters.append(0)
        left[b] -= length
        held_sources[b] |= source
        held_clusters[b] |= cluster
        insort(open_bins, (left[b], b))
        chosen.append(b)
    return chosen, left


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    per_shard: int = PER_SHARD,
    id_col: str = "doc_id",
    length: Column | None = None,
    source: Column | None = None,
    cluster: Column | None = None,
) -> DataFrame:
    """One row per chunk: bin_id, position, doc_id, chunk, start, length, bin_left.

    ``length`` is any whole-number column (default: code points of ``text``), ``cluster`` defaults
    to the digest of the text, so exact copies never meet.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    length = F.char_length(text) if length is None else length
    source = F.col("source") if source is None else source
    cluster = F.when(F.char_length(text) > 0, F.md5(text)) if cluster is None else cluster
    items = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(length, F.lit(0)).cast("bigint").alias("length"),
        source.cast("string").alias("source"),
        cluster.cast("string").alias("cluster"),
    )
    shards = max(1, -(-docs.count() // per_shard))
    id_type = items.schema["doc_id"].dataType.simpleString()

    def pack_shard(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        lengths = table.column("length").to_pylist()
        # An exact multiple of the capacity has no tail; an empty document is all tail.
        full = [n // capacity for n in lengths]
        tails = [i for i, n in enumerate(lengths) if n % capacity or not n]
        tails.sort(key=lambda i: -(lengths[i] % capacity))
        sources, clusters = table.column("source").to_pylist(), table.column("cluster").to_pylist()
        chosen, left = best_fit(
            [lengths[i] % capacity for i in tails], [sources[i] for i in tails], [clusters[i] for i in tails], capacity
        )
        first = int(key[0].as_py()) << _BIN_BITS
        filled: Counter = Counter()
        out = {name: [] for name in ("row", "bin_id", "position", "chunk", "start", "length", "bin_left")}

        def put(*values: int) -> None:
            for held, value in zip(out.values(), values):
                held.append(value)

        for i, b in zip(tails, chosen):
            put(i, first + b, filled[b], full[i], full[i] * capacity, lengths[i] % capacity, left[b])
            filled[b] += 1
        b = len(left)
        for i, n in enumerate(full):
            for chunk in range(n):
                put(i, first + b, 0, chunk, chunk * capacity, capacity, 0)
                b += 1
        ids = table.column("doc_id").take(pa.array(out.pop("row"), pa.int64()))
        return pa.table({"doc_id": ids, **{name: pa.array(v, pa.int64()) for name, v in out.items()}})

    # Equal items differ by their number alone, which any order of the rows gives alike.
    numbered = items.groupBy(*items.columns).agg(F.count(F.lit(1)).alias("n")).select(
        *items.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy")
    )
    return (
        numbered.select(*items.columns, F.pmod(F.xxhash64(*items.columns, "copy"), F.lit(shards)).alias("shard"))
        .groupBy("shard")
        .applyInArrow(
            pack_shard,
            f"doc_id {id_type}, bin_id bigint, position bigint, chunk bigint, start bigint, length bigint, bin_left bigint",
        )
    )


def with_near_clusters(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, source, length and cluster of each document; near copies have one cluster.

    Texts without words have no shingles to compare; they are told apart by their digest.
    """
    named = near_components(docs, width=width, percent=percent)
    named = named.filter("component_key is not null").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.hex("component_key").alias("_near")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    items = docs.select(
        "doc_id",
        "source",
        F.char_length(text).alias("length"),
        F.when(F.char_length(text) > 0, F.md5(text)).alias("digest"),
        F.xxhash64("text").alias("text_key"),
    )
    same = items["doc_id"].eqNullSafe(named["_id"]) & (items["text_key"] == named["_key"])
    joined = items.join(named.hint("merge"), same, "left")
    return materialize(joined.select("doc_id", "source", "length", F.coalesce("_near", "digest").alias("cluster")), "packing-items")


def pack_apart(docs: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """``pack`` with near copies (five words, 80 %) as duplicate clusters, which never meet in a bin."""
    return pack(with_near_clusters(docs), capacity, per_shard, length=F.col("length"), cluster=F.col("cluster"))
