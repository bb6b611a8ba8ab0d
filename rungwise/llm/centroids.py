"""Centroid clustering with bounds by the norm of the total displacement (ns-bounds).

Lloyd's rounds on whole numbers, so that every distance, tie and centroid is exact. Each vector
carries the squared distance to its own centroid and to the second nearest one, each with the round
in which it was evaluated. All centroids of all rounds are kept. In a later round the first is
loosened upwards by the way its centroid has gone since that round, start to end, and the second
downwards by the longest such way of the other centroids: not by the sum of the ways of the single
rounds, which is never shorter. Where the loosened own distance is surely below the loosened other one
the vector stays, unseen. Else the own distance is evaluated anew, and if that does not settle it, all
distances are, exactly. Roots are compared with a slack far above their rounding.

A round is one pass over the stored vectors with their bounds, and one grouped sum. Only the
centroids, ``k`` vectors a round, reach the driver or all tasks. No shuffle moves a vector.

Defined results: components become floor(scale * x), x as double, held to 64 bits. Only vectors of
``dims`` components, none null or non-finite, take part and are returned. The ``k`` rows with the
smallest digests of their ids are the first centroids (fewer, if there are fewer rows; rows that
repeat an id in the order of their vectors). A null id takes part; its digest is that of the seed
alone. Equal vectors are clustered each by itself. Distances, and sums of them, above 64 bits are
given as the largest long. Only the id and vector columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.session import materialize

CLUSTERS = 40
ROUNDS = 5
SCALE = 256
DIMS = 64
SEED = "2:"
_MOST = 2**63 - 1
_SLACK = 1e-9
_STATE = "v array<bigint>, cluster int, near bigint, near_round int, far bigint, far_round int, scans int"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, dims: int) -> DataFrame:
    """(vec_id, v): the usable vectors as whole numbers."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    usable = (F.size(vector_col) == dims) & finite
    return vectors.select(
        F.col(id_col).alias("vec_id"), F.when(usable, F.transform(x, lambda c: F.floor(c * scale).cast("bigint"))).alias("v")
    ).filter("v is not null")


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each point to each centroid, in whole numbers."""
    most = max(abs(int(x)) for a in (points, centroids) for x in (a.min(initial=0), a.max(initial=0)))
    # All terms are whole numbers below 2 ** 53.
    if 4 * most * most * max(1, points.shape[1]) < 2**53:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    apart = points.astype(object)[:, None, :] - centroids.astype(object)[None, :, :]
    return (apart * apart).sum(axis=2)


def _own_distance(points: np.ndarray, own: np.ndarray) -> np.ndarray:
    most = max(abs(int(x)) for a in (points, own) for x in (a.min(initial=0), a.max(initial=0)))
    kind = np.int64 if 4 * most * most * max(1, points.shape[1]) < 2**62 else object
    apart = points.astype(kind) - own.astype(kind)
    return (apart * apart).sum(axis=1)


def _held(x: np.ndarray) -> np.ndarray:
    """Whole numbers as longs, the largest one where they do not fit."""
    return x if x.dtype == np.int64 else np.array([min(int(i), _MOST) for i in x], np.int64)


def _two_nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number in ties), its distance, and the least of the others."""
    at = np.arange(len(distances))
    nearest = np.argmin(distances, axis=1)
    near = distances[at, nearest].copy()
    if distances.shape[1] == 1:
        return nearest, near, np.full(len(at), _MOST, np.int64)
    others = distances.copy()
    others[at, nearest] = distances.max(initial=0) + 1 if distances.dtype == object else _MOST
    return nearest, near, others.min(axis=1)


def assign(points: np.ndarray, state: dict[str, np.ndarray] | None, history: list[np.ndarray], last: bool) -> dict[str, np.ndarray]:
    """The state of each point under the newest centroids; all own distances are exact if ``last``."""
    now, newest = len(history) - 1, history[-1]
    n = len(points)
    if state is None:
        cluster, near, far = _two_nearest(squared_distances(points, newest))
        rounds = np.full(n, now, np.int32)
        return {
            "cluster": cluster.astype(np.int32), "near": _held(near), "near_round": rounds, "far": _held(far), "far_round": rounds.copy(),
            "scans": np.ones(n, np.int32),
        }
    state = {name: values.copy() for name, values in state.items()}
    cluster = state["cluster"]
    # [round, centroid]: how far each centroid has gone from where it was in that round.
    gone = np.array([np.sqrt(((newest.astype(np.float64) - then.astype(np.float64)) ** 2).sum(axis=1)) for then in history])
    away = gone[state["far_round"]]
    away[np.arange(n), cluster] = 0
    loss = away.max(axis=1)
    second = np.sqrt(state["far"].astype(np.float64))
    single = len(newest) == 1

    def stays(own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        slack = _SLACK * (own + second[rows] + loss[rows])
        return single | (own + slack < second[rows] - loss[rows])

    rows = np.arange(n)
    own = np.where(state["near"] == _MOST, np.inf, np.sqrt(state["near"].astype(np.float64)) + gone[state["near_round"], cluster])
    unsettled = np.flatnonzero(~stays(own, rows))
    again = rows if last else unsettled
    state["near"][again] = _held(_own_distance(points[again], newest[cluster[again]]))
    state["near_round"][again] = now
    own = np.where(state["near"][unsettled] == _MOST, np.inf, np.sqrt(state["near"][unsettled].astype(np.float64)))
    failed = unsettled[~stays(own, unsettled)]
    if len(failed):
        nearest, near, far = _two_nearest(squared_distances(points[failed], newest))
        state["cluster"][failed] = nearest
        state["near"][failed], state["far"][failed] = _held(near), _held(far)
        state["near_round"][failed] = state["far_round"][failed] = now
        state["scans"][failed] += 1
    return state


def _pass(stored: DataFrame, history: list[np.ndarray], dims: int, last: bool) -> DataFrame:
    """One round over the stored vectors, with their bounds if they have any."""
    id_type = stored.schema["vec_id"].dataType.simpleString()
    bounded = "cluster" in stored.columns
    names = ["cluster", "near", "near_round", "far", "far_round", "scans"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, dims)
                state = {name: np.asarray(batch.column(name)) for name in names} if bounded else None
                new = assign(points, state, history, last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), *[pa.array(new[name]) for name in names]], names=["vec_id", "v", *names]
                )

    return stored.mapInArrow(make, f"vec_id {id_type}, {_STATE}")


def _sum_type(stored: DataFrame) -> str:
    """The type in which no sum of components can overflow."""
    found = stored.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_max("v")).alias("most"), F.min(F.array_min("v")).alias("least")
    ).first()
    most = max(abs(found["most"] or 0), abs(found["least"] or 0))
    return "bigint" if most * found["n"] < 2**62 else "decimal(19,0)"


def _moved(stored: DataFrame, centroids: np.ndarray, dims: int, kind: str) -> np.ndarray:
    """Centroids at the floor of their vectors' means; a centroid without vectors stays."""
    sums = [F.sum(F.get("v", F.lit(i)).cast(kind)).alias(f"s{i}") for i in range(dims)]
    moved = centroids.copy()
    # At most one row per centroid.
    for row in stored.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).take(len(centroids)):
        moved[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
    return moved


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    dims: int = DIMS,
    seed: str = SEED,
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans.

    ``scans`` counts the rounds in which all distances of the vector were evaluated, at most
    ``rounds`` + 1.
    """
    spark = vectors.sparkSession
    stored = materialize(whole_vectors(vectors, id_col, vector_col, scale, dims), "centroids-vectors")
    named = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = stored.select(named.alias("h"), "v").orderBy("h", "v").take(k)
    history = [np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)]
    kind = _sum_type(stored)
    for at in range(rounds + 1 if first else 0):
        stored = materialize(_pass(stored, history, dims, at == rounds), "centroids-round")
        if at < rounds:
            history.append(_moved(stored, history[-1], dims, kind))
    if not first:
        stored = stored.selectExpr("vec_id", "v", "0 as cluster", "0L as near", "0 as scans")
    final = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(history[-1].tolist())]
    digests = spark.createDataFrame(final, "cluster int, centroid_sha256 string")
    whole = lambda c: F.least(c, F.lit(_MOST).cast("decimal(38,0)")).cast("bigint")
    inertia = stored.groupBy("cluster").agg(F.sum(F.col("near").cast("decimal(19,0)")).cast("decimal(38,0)").alias("s"))
    # One row per centroid, as are the digests; one row in all.
    inertia = materialize(inertia, "centroids-inertia")
    total = inertia.agg(F.sum("s").alias("t"))
    by_cluster = inertia.join(F.broadcast(digests), "cluster").join(F.broadcast(total))
    return stored.join(F.broadcast(by_cluster), "cluster").select(
        "vec_id",
        "cluster",
        F.col("near").alias("distance"),
        whole(F.col("s")).alias("cluster_inertia"),
        whole(F.col("t")).alias("inertia"),
        "centroid_sha256",
        "scans",
    )


def cluster_sql(k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = SEED) -> str:
    """DuckDB SQL for the same clusters by evaluating every distance in every round."""
    steps = [
        f"""
WITH x AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
    FROM (SELECT sha256('{seed}' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM x ORDER BY h, v LIMIT {k})
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
    SELECT r, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v, min(struct_pack(
        d := list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c.c)) AS m
    FROM x, c{i} c GROUP BY r
)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} AS MATERIALIZED (
    SELECT m.c AS c, j, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM (SELECT m, unnest(v) AS e, unnest(range(len(v))) AS j FROM a{i}) GROUP BY 1, 2
), c{i + 1} AS MATERIALIZED (
    SELECT c, coalesce(any_value(w), any_value(v)) AS v
    FROM c{i} LEFT JOIN (
        SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS w FROM s{i} GROUP BY c
    ) USING (c) GROUP BY c
)"""
            )
    return (
        ", ".join(steps)
        + f"""
SELECT vec_id, m.c::INT AS cluster, m.d AS distance,
       (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} f ON f.c = m.c
"""
    )
