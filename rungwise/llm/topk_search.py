"""Exact top-k search by inner product without random access.

Vectors are cut into blocks. In a block each component has a list of its values in order. A query
reads the lists from the end that its component favours. A candidate seen in a list has its exact
contribution; for the others the value last read bounds the contribution from above and the far end
of the list from below. Reading goes on by levels, at each first in the half of the lists that can
move the query's bounds most, then in the others, and adds to the bounds what the newly read entries
change. It stops when all but a few candidates have upper bounds below the k-th lower bound, and the
few get their final scores; at the last level both bounds are the score. The k-th score found so far
goes on to the next block, so most blocks are left early. Many queries read together: the change of
a level is two matrix products.

Each pair of a group of queries and a group of candidates is one task's work, block after block, and k
rows per query and group go on to the final ranking, which Spark cuts to k per task before its shuffle.
So no task holds more than two groups, and no side is broadcast. A vector is copied once for each group
of the other side, in the narrowest whole numbers that hold all. The queries are a stated set, met with
all candidates.

Defined results: components become floor(scale * x), products are integers. Vectors that are null
or hold null or non-finite components take no part; vectors of different lengths never meet; empty
vectors score 0 with each other. Rows with the query's own id are no candidates. Rows that repeat an
id are candidates of their own, equal ones too; of repeated queries the smallest vector is searched. A
null id is no query; as a candidate it takes part and comes first in ties. An empty table gives no
rows. Scores must fit 64 bits. Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.session import materialize

SCALE = 256
BLOCK = 512
#: Vectors of one side in a task: groups of queries and groups of candidates.
GROUP = 8192
#: Shares of a list that are read one after the other.
LEVELS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1.0)
FEW = 4
NONE = -(2**63) + 1


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): usable vectors as whole numbers."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), F.when(usable, F.transform(x, lambda c: F.floor(c * scale).cast("bigint"))).alias("v"))
        .filter("v is not null")
    )


def _number_type(queries: np.ndarray, block: np.ndarray):
    """The fastest type in which every partial sum, and every change of one, is an exact whole number."""
    most = 2 * float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(1, block.shape[1])
    if most < 2**24:
        return np.float32
    return np.float64 if most < 2**53 else object


def _best_first(queries: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Query by list: whether the list is in the half that can move the query's bounds most."""
    reach = np.abs(queries.astype(float)) * (lists[-1] - lists[0]).astype(float)
    return reach >= np.median(reach, axis=1, keepdims=True) if reach.shape[1] else reach > 0


def search_block(
    query_ids: np.ndarray,
    queries: np.ndarray,
    ids: np.ndarray,
    block: np.ndarray,
    k: int,
    found: np.ndarray | None = None,
    levels: tuple[float, ...] = LEVELS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` of a block for each query: places of query and candidate, scores; and the entries each query read.

    ``found`` has the k-th score that each query has from earlier blocks, or ``NONE``; candidates below
    it may be left out.
    """
    kind = _number_type(queries, block)
    n = len(ids)
    order = np.argsort(block, axis=0, kind="stable")
    places = np.empty(block.shape, np.int64)
    np.put_along_axis(places, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(block, order, axis=0).astype(kind)
    # A query's positive components read lists from the top, the negative ones from the bottom.
    signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)
    first = _best_first(queries, lists)
    parts = [np.hstack([part, part]) for part in (first, ~first)]
    block = block.astype(kind)
    floor = NONE if kind is object else -np.inf
    known = np.full(len(query_ids), floor, kind)
    if found is not None:
        known[found != NONE] = found[found != NONE].astype(kind)
    hidden = query_ids[:, None] == ids[None, :]
    others = n - hidden.sum(axis=1)

    def views(read: int) -> tuple[np.ndarray, np.ndarray]:
        """Values that bound the scores from below and from above after ``read`` entries of each list."""
        top, bottom = places >= n - read, places < read
        below = np.hstack([np.where(top, block, lists[0]), np.where(bottom, block, lists[-1])])
        above = np.hstack(
            [np.where(top, block, lists[n - read] if read else lists[-1]), np.where(bottom, block, lists[read - 1] if read else lists[0])]
        )
        return below.T, above.T

    now, at = views(0), 0
    # Nothing is read yet, so all candidates have the same bounds.
    lower, upper = (np.repeat(signed @ bound[:, :1], n, axis=1) for bound in now)
    reads = np.zeros(len(query_ids), np.int64)
    waiting = np.arange(len(query_ids))
    out_q, out_c, out_s = [], [], []
    for level in levels:
        read = min(n, max(1, int(np.ceil(n * level))))
        if read == at and read < n:
            continue
        then = views(read)
        below, above = (b - a for a, b in zip(now, then))
        for last, part in enumerate(parts):
            weights = signed[waiting] * part[waiting]
            lower += weights @ below
            upper += weights @ above
            reads[waiting] += (read - at) * (part[waiting].sum(axis=1) // 2)
            whole = read == n and last
            bar = known[waiting]
            # Where k scores are known, the lower bounds of a part read hardly ever raise the bar.
            new = np.flatnonzero(bar == floor)
            if len(new):
                bar[new] = _kth(np.where(hidden[new], floor, lower[new]), k)
            able = (upper >= bar[:, None]) & ~hidden
            n_able = able.sum(axis=1)
            done = (n_able <= FEW * k) | bool(whole) | (others <= k)
            for row in np.flatnonzero(done & (n_able > 0)):
                q = waiting[row]
                rows = np.flatnonzero(able[row])
                scores = lower[row, rows] if whole else block[rows] @ queries[q].astype(kind)
                scores = np.asarray([int(s) for s in scores], np.int64)
                best = np.lexsort((rows, -scores))[:k]
                out_q.append(np.full(len(best), q))
                out_c.append(rows[best])
                out_s.append(scores[best])
            if done.any():
                stay = np.flatnonzero(~done)
                lower, upper, waiting, hidden, others = lower[stay], upper[stay], waiting[stay], hidden[stay], others[stay]
            if not len(waiting):
                break
        if not len(waiting):
            break
        now, at = then, read
    empty = [np.empty(0, np.int64)]
    return np.concatenate(out_q or empty), np.concatenate(out_c or empty), np.concatenate(out_s or empty), reads


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest of each row, or the least if there are fewer."""
    at = scores.shape[1] - min(k, scores.shape[1])
    if scores.dtype == object:
        return np.sort(scores, axis=1)[:, at]
    return np.partition(scores, at, axis=1)[:, at]


def search_group(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block: int = BLOCK
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best ``k`` of a group of candidates, block by block: places of query and candidate, scores; and the entries read.

    ``ids`` ascend, so of equal scores the earlier block's candidate wins.
    """
    best_score = np.full((len(query_ids), k), NONE, np.int64)
    best_place = np.full((len(query_ids), k), -1, np.int64)
    entries = 0
    for start in range(0, len(query_ids), block):
        asked = slice(start, start + block)
        for at in range(0, len(ids), block):
            held = slice(at, at + block)
            q, c, s, reads = search_block(query_ids[asked], queries[asked], ids[held], vectors[held], k, best_score[asked, k - 1])
            entries += int(reads.sum())
            if not len(q):
                continue
            # The rows of a query lie together, best first.
            order = np.argsort(q, kind="stable")
            q, c, s = q[order], c[order], s[order]
            asking, begins = np.unique(q, return_index=True)
            rank = np.arange(len(q)) - np.repeat(begins, np.diff([*begins, len(q)]))
            score, place = np.full((len(asking), 2 * k), NONE, np.int64), np.full((len(asking), 2 * k), -1, np.int64)
            score[:, :k], place[:, :k] = best_score[start + asking], best_place[start + asking]
            row = np.searchsorted(asking, q)
            score[row, k + rank], place[row, k + rank] = s, at + c
            chosen = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best_score[start + asking] = np.take_along_axis(score, chosen, axis=1)
            best_place[start + asking] = np.take_along_axis(place, chosen, axis=1)
    q, rank = np.nonzero(best_place >= 0)
    return q, best_place[q, rank], best_score[q, rank], entries


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` of each row that ``is_query`` marks.

    ``is_query`` is a condition on the column ``id``.
    """
    whole = materialize(whole_vectors(vectors, id_col, vector_col, scale), "topk-vectors")
    queries = whole.filter(is_query & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    queries = materialize(queries, "topk-queries")
    rows, least, most = whole.agg(F.count(F.lit(1)), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    reach = max(abs(least or 0), abs(most or 0))
    kind = "smallint" if reach < 2**15 else "int" if reach < 2**31 else "bigint"
    candidate_groups, query_groups = max(1, -(-rows // group)), max(1, -(-queries.count() // group))
    # Equal rows are dealt apart by their number, so that a row repeated often does not fill a group.
    numbered = whole.withColumn("r", F.monotonically_increasing_id())

    def dealt(df: DataFrame, key: Column, own: str, n: int, other: str, m: int) -> DataFrame:
        others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
        return df.select(
            "id", F.col("v").cast(f"array<{kind}>").alias("v"), F.size("v").alias("d"), F.pmod(key, F.lit(n)).alias(own), others.alias(other)
        ).groupBy("d", "q", "c")

    left = dealt(queries, F.xxhash64("id", "v"), "q", query_groups, "c", candidate_groups)
    right = dealt(numbered, F.xxhash64("r"), "c", candidate_groups, "q", query_groups)

    def best(key, asked, held):
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        # Nulls first, so that a candidate's place decides ties.
        held = held.take(pc.sort_indices(held, [("id", "ascending")], null_placement="at_start"))
        size = key[0].as_py()
        matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).astype(np.int64).reshape(t.num_rows, size)
        ids, asking = held.column("id"), np.asarray(asked.column("id"))
        plain = np.asarray(ids.fill_null(-(2**63)))
        q, c, s, _ = search_group(asking, matrix(asked), plain, matrix(held), k, block)
        return pa.table([pa.array(asking[q], pa.int64()), ids.take(pa.array(c, pa.int64())), pa.array(s, pa.int64())], schema=schema)

    found = left.cogroup(right).applyInArrow(best, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_first())
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def search_sql(k: int = 5, every: int = 50) -> str:
    """DuckDB SQL for the same search by scoring every pair."""
    return f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
    SELECT vec_id, min(v) AS v FROM v WHERE vec_id % {every} = 0 GROUP BY vec_id
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM q JOIN v ON v.vec_id IS DISTINCT FROM q.vec_id AND len(v.v) = len(q.v)
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
