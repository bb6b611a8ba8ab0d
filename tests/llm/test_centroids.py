"""Centroid clustering against Lloyd's rounds with every distance."""

import hashlib
import math
import random

import numpy as np
import pytest

from rungwise.llm.centroids import assign, cluster_vectors

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def brute(rows, k, rounds, dims):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in e]))
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted((name(i), v) for i, v in kept)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for at in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
        if at < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), (_, m) in zip(kept, near) if m == j]
                if own:
                    cents[j] = [sum(x) // len(own) for x in zip(*own)]
    total = sum(d for d, _ in near) if kept else 0
    out = []
    for (i, _), (d, j) in zip(kept, near if kept else []):
        sha = hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()
        out.append((i, j, d, sum(x for x, m in near if m == j), total, sha))
    return sorted(out, key=repr)


def made(n=400, dims=6, seed=2, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * (dims - 1)), (n + 2, [math.nan] + [0.0] * (dims - 1)), (n + 3, [None] + [0.0] * (dims - 1))]
    rows += [(n + 4, [math.inf] * dims), (n + 5, []), (None, [0.1] * dims), (None, [0.1] * dims), rows[0], rows[0], (7, [0.5] * dims)]
    return rows


def got(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in cluster_vectors(docs, **options).drop("scans").collect()), key=repr)


@pytest.mark.parametrize("k,rounds,spread", [(8, 5, 0.3), (40, 3, 0.02), (1, 2, 0.3), (5, 0, 0.3)])
def test_equals_brute_force(spark, k, rounds, spread):
    rows = made(spread=spread)
    assert got(spark, rows, k=k, rounds=rounds, dims=6) == brute(rows, k, rounds, 6)


def test_ties_and_repeats(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    assert got(spark, rows, k=6, rounds=3, dims=2) == brute(rows, 6, 3, 2)


def test_fewer_rows_than_centroids_and_very_large_numbers(spark):
    rows = [(1, [3e9, -3e9]), (2, [3e9, -2.5e9]), (3, [1.0, 2.0])]
    out = got(spark, rows, k=5, rounds=2, dims=2)
    assert [r[:2] for r in out] == [r[:2] for r in brute(rows, 5, 2, 2)]
    assert got(spark, [(1, [3e38, 0.0]), (2, [0.0, 0.0])], k=1, rounds=1, dims=2)[0][2] == 2**63 - 1


def test_empty_table_and_no_usable_row(spark):
    assert got(spark, [], k=3, dims=6) == []
    assert got(spark, [(1, None), (2, [1.0])], k=3, dims=6) == []


def test_bounds_spare_most_scans(spark):
    rows = made(n=1500, spread=0.02)[:1500]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    scans = [r["scans"] for r in cluster_vectors(docs, k=12, rounds=5, dims=6).collect()]
    assert sum(scans) < 0.6 * 6 * len(scans)


def test_total_displacement_is_tighter_than_the_sum_of_rounds():
    # The other centroid goes away and comes back: its total way is 0, so nothing is evaluated.
    history = [np.array([[0, 0], [10, 0]]), np.array([[0, 0], [14, 0]]), np.array([[0, 0], [10, 0]])]
    point = np.array([[4, 0]])
    state = assign(point, None, history[:1], False)
    state = assign(point, state, history[:2], False)
    assert state["scans"].tolist() == [2]
    state["far"][:], state["far_round"][:] = 36, 0
    assert assign(point, state, history, False)["scans"].tolist() == [2]
