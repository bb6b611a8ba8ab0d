"""Top-k search against scoring every pair."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rungwise.llm.queries import op3_exact_top_k
from rungwise.llm.topk_search import search, search_block, search_group, search_sql

SF = "/root/testdata/sf0.01"


def brute(rows, every, k):
    usable = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in usable:
        if i is not None and i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        found = [(-sum(a * b for a, b in zip(v, w)), i is not None, i or 0, i) for i, w in usable if i != q and len(w) == len(v)]
        out += [(q, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def made(kind):
    rng = random.Random(kind)
    near = lambda c: [x + rng.gauss(0, 0.05) for x in c]
    if kind == "clusters":
        centres = [[rng.gauss(0, 0.2) for _ in range(8)] for _ in range(4)]
        return [(i, near(rng.choice(centres))) for i in range(300)]
    if kind == "ties":
        return [(i, [rng.choice([0.0, 0.25, -0.25]) for _ in range(3)]) for i in range(200)]
    if kind == "large":
        return [(i, [rng.uniform(-1e6, 1e6) for _ in range(5)]) for i in range(60)]
    return [(0, []), (4, []), (8, [1.0]), (12, None), (16, [float("nan"), 1.0]), (20, [None, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (24, [1.0, -1.0]), (24, [1.0, -1.0]), (24, [1.0, 0.0]), (None, [0.5, 0.5]), (3, [float("inf"), 0.0])]


@pytest.mark.parametrize("kind", ["clusters", "ties", "large", "odd"])
@pytest.mark.parametrize("block, group", [(512, 8192), (16, 64)])
def test_search_equals_brute_force(spark, kind, block, group):
    rows = made(kind)
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, id string")
    got = search(vectors, F.col("id") % 4 == 0, block=block, group=group)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 4, 5)


def test_search_stops_before_the_ends():
    rng = np.random.default_rng(1)
    block = np.vstack([rng.integers(200, 256, (6, 4)), rng.integers(-40, 40, (400, 4))])
    q, c, s, reads = search_block(np.array([-1]), np.full((1, 4), 256), np.arange(406), block, 5)
    want = sorted(range(406), key=lambda i: (-int(block[i].sum()), i))[:5]
    assert q.tolist() == [0] * 5 and c.tolist() == want and s.tolist() == [int(block[i].sum()) * 256 for i in want]
    assert 0 < reads[0] <= 4 * 406 / 8


def test_scores_found_before_shorten_the_reading():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 40, (12, 32))
    vectors = np.floor(centres[rng.integers(0, 12, 4000)] + rng.normal(0, 8, (4000, 32))).astype(np.int64)
    ids, asked = np.arange(4000), np.arange(0, 4000, 50)
    q, c, s, entries = search_group(asked, vectors[asked], ids, vectors, 5, block=250)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -(2**40)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert c.reshape(-1, 5).tolist() == order.tolist() and q.tolist() == np.repeat(np.arange(80), 5).tolist()
    assert s.reshape(-1, 5).tolist() == np.take_along_axis(scores, order, axis=1).tolist()
    alone = sum(int(search_block(asked, vectors[asked], ids[i : i + 250], vectors[i : i + 250], 5)[3].sum()) for i in range(0, 4000, 250))
    assert entries < alone < 80 * 4000 * 32


def test_empty_table(spark):
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 2 == 0).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = duck.sql(search_sql())
    assert sorted(map(tuple, op3_exact_top_k(spark, SF).select(*want.columns).collect())) == sorted(want.fetchall())
