"""Periodic runs of words by maximal-pair enumeration.

A run is a stretch of words with a period that no neighbouring word extends. With start s, length n
and smallest period q, the suffixes at s and s + q share exactly n - q words and have different words
before them: they are a maximal pair of distance q. So the maximal pairs whose common part is at
least (exponent - 1) times their distance are the runs, and nothing has to be extended.

1. The suffixes of the documents of a batch are ranked by prefix doubling; a document's words have
   numbers of their own, so suffixes of two documents share nothing. Comparing ranks of all doublings
   gives the common part of neighbours.
2. The tree of common-prefix intervals is walked bottom-up with a stack. An interval holds its
   suffixes in text order, each with the class of the word on its left. Where two children meet, each
   suffix of the smaller looks in the larger one for a partner of another left class within the
   distance the interval's length allows. Suffixes that near stand whole periods apart, so only the
   outermost one before it and the one after it can be of another class: two searches each.
3. A stretch that is a maximal pair at several multiples of its period is named by the least one.

Work and memory are bounded by a document's own length (n log n); a document is one row in any case.
Intervals shorter than any run, or whose suffixes all stand too far apart, are passed over.

Defined results: words are maximal sequences of characters other than ASCII white space. A null or
empty text, or one of white space, has no words and no runs, and collapses to an empty text. Rows that
repeat are treated alike, each by itself. A null id is kept. Only the id and text columns are read,
so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.text import let

EXPONENT = 4
LEAST_LENGTH = 6
#: Words whose suffixes are ranked together; a longer document is ranked alone.
TOGETHER = 250_000
WORD = r"[^\x20\x09-\x0D]+"


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and their ranks by the first 1, 2, 4, .. words.

    Ranks of one doubling are equal exactly where that many words are. They have one place more,
    for the end.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    slots, keys = np.arange(n), codes[order]
    rank = np.full(n + 1, -1, np.int64)
    levels: list[np.ndarray] = []
    width = 1
    while True:
        new = np.empty(len(slots), bool)
        new[:1], new[1:] = True, keys[1:] != keys[:-1]
        rank = rank.copy()
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank)
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order, levels
        at = order[slots]
        keys = rank[at] * (n + 1) + rank[np.minimum(at + width, n)] + 1
        placed = np.argsort(keys, kind="stable")
        order[slots], keys = at[placed], keys[placed]
        width *= 2


def common_words(left: np.ndarray, right: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words the suffixes of each pair share."""
    shared = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared += (levels[k][left + shared] == levels[k][right + shared]).astype(np.int64) << k
    return shared


def _meet(shared: int, one: list[int], two: list[int], before: list[int], reach: int, pairs: list[tuple[int, int, int]]) -> list[int]:
    """Adds the maximal pairs (start, distance, shared) between two children; gives their union in order."""
    if len(one) < len(two):
        one, two = two, one
    last = len(one)
    for p in two:
        k = bisect_left(one, p - reach)
        if k < last:
            s = one[k]
            if s < p:
                if before[s] != before[p]:
                    pairs.append((s, p - s, shared))
                k = bisect_right(one, p, k)
            if k < last and one[k] - p <= reach and before[one[k]] != before[p]:
                pairs.append((p, one[k] - p, shared))
    if len(two) * 8 > last:
        return sorted(one + two)
    for p in two:
        one.insert(bisect_left(one, p), p)
    return one


def maximal_pairs(order: list[int], shared: list[int], before: list[int], ratio: int) -> list[tuple[int, int, int]]:
    """(start, distance, shared) of the maximal pairs no further apart than ``shared / ratio``.

    ``shared[i]`` belongs to ``order[i]`` and ``order[i + 1]``.
    """
    pairs: list[tuple[int, int, int]] = []
    depths: list[int] = []
    held: list[list[int]] = []
    for i, p in enumerate(order):
        depth = shared[i] if i < len(shared) else 0
        node = [p]
        while depths and depths[-1] > depth:
            closing = depths.pop()
            node = _meet(closing, held.pop(), node, before, closing // ratio, pairs)
        if depths and depths[-1] == depth and depth:
            held[-1] = _meet(depth, held[-1], node, before, depth // ratio, pairs)
        else:
            depths.append(depth)
            held.append(node)
    return pairs


def runs_of(documents: list[list], exponent: int = EXPONENT, least_length: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs in each list of words, by start and period."""
    if exponent < 3:
        raise ValueError("runs of an exponent below 3 are not told apart by their nearest partners")
    sizes = [len(words) for words in documents]
    found: list[dict[tuple[int, int], int]] = [{} for _ in documents]
    starts = np.cumsum([0, *sizes])
    codes = np.empty(starts[-1], np.int64)
    base = 0
    for words, at in zip(documents, starts):
        known: dict = {}
        codes[at : at + len(words)] = [known.setdefault(w, base + len(known)) for w in words]
        base += len(known)
    # The shortest common part of any run, over all distances.
    least = min(max((exponent - 1) * d, least_length - d) for d in range(1, max(2, least_length)))
    if len(codes) <= least:
        return [[] for _ in documents]
    order, levels = suffix_order(codes)
    left, right = order[:-1], order[1:]
    deep = min(len(levels) - 1, max(0, least.bit_length() - 1))
    near = np.flatnonzero(levels[deep][left] == levels[deep][right])
    shared = np.zeros(len(order), np.int64)
    shared[near] = common_words(left[near], right[near], levels)
    # Stretches of suffixes that share enough with their neighbours.
    linked = np.append(shared[:-1] >= least, False)
    first = np.flatnonzero(linked & ~np.append(False, linked[:-1]))
    after = np.flatnonzero(~linked & np.append(False, linked[:-1])) + 1
    if not len(first):
        return [[] for _ in documents]
    lengths = after - first
    group = np.repeat(np.arange(len(first)), lengths)
    members = np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first, lengths)
    sorted_keys = np.sort(group * (len(codes) + 1) + order[members])
    gaps = np.append(np.diff(sorted_keys), len(codes))
    cut = np.cumsum(lengths) - 1
    gaps[cut] = len(codes)
    heads = np.append(0, cut[:-1] + 1)
    nearest = np.minimum.reduceat(gaps, heads)
    longest = np.maximum.reduceat(np.where(linked[members], shared[members], 0), heads)
    before = np.empty(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[starts[:-1][np.array(sizes) > 0]] = -1
    before = before.tolist()
    for x in np.flatnonzero((exponent - 1) * nearest <= longest):
        span = slice(first[x], after[x])
        for s, d, common in maximal_pairs(order[span].tolist(), shared[first[x] : after[x] - 1].tolist(), before, exponent - 1):
            if d + common >= least_length:
                doc = int(np.searchsorted(starts, s, side="right")) - 1
                key = (s - int(starts[doc]), d + common)
                found[doc][key] = min(d, found[doc].get(key, d))
    return [sorted((s, n, q) for (s, n), q in runs.items()) for runs in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay when each run keeps its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    drop = bytearray(len(words))
    for start, length, period in runs:
        drop[start + period : start + length] = b"\1" * (length - period)
    return b" ".join([w for w, gone in zip(words, drop) if not gone])


RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least_length: int = LEAST_LENGTH
) -> DataFrame:
    """One row per document row: doc_id, n_words, runs, collapsed.

    ``runs`` holds (start, length, period) of every run of at least ``exponent`` periods and
    ``least_length`` words. ``collapsed`` is the text with one period of each run left.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def portions(texts: pa.Array) -> Iterator[list[list[bytes]]]:
        held, size = [], 0
        for text in texts:
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            if held and size + len(words) > TOGETHER:
                yield held
                held, size = [], 0
            held.append(words)
            size += len(words)
        yield held

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "length", "period")
        for batch in batches:
            at = 0
            for documents in portions(batch.column("text")):
                runs = runs_of(documents, exponent, least_length)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(documents)),
                        pa.array([len(words) for words in documents], pa.int64()),
                        pa.array([[dict(zip(names, r)) for r in found] for found in runs], _ARROW_RUNS),
                        pa.array([collapse(w, r).decode("utf-8", "surrogatepass") for w, r in zip(documents, runs)], pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                at += len(documents)

    return docs.mapInArrow(make, f"doc_id {id_type}, n_words bigint, runs {RUNS_TYPE}, collapsed string")


def plant_runs(text: Column, doc_id: Column) -> Column:
    """The text with a run planted where the id's checksum ends in 0; other texts stay as they are."""
    h = F.crc32(doc_id.cast("string"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words).cast("bigint"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(
            F.struct(words.alias("w"), a.alias("a"), p.alias("p")),
            lambda s: F.array_join(
                F.transform(
                    s["w"],
                    lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int"))),
                ),
                " ",
            ),
        )

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(WORD), let(words, repeated)).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """Of ``find_runs``: doc_id, n_runs, the most repeated run, and digests of all runs and of what is left."""

    def more_repeated(x: Column, y: Column) -> Column:
        ahead = y["length"] * x["period"] - x["length"] * y["period"]
        order = F.array(ahead, x["start"] - y["start"], x["period"] - y["period"])
        return F.signum(F.coalesce(F.get(F.filter(order, lambda d: d != 0), F.lit(0)), F.lit(0))).cast("int")

    best = F.get(F.array_sort("runs", more_repeated), F.lit(0))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
