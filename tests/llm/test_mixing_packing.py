"""Poisson draws, shares and best-fit bins against plain versions."""

import math
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rungwise.llm.exact_dedup import EXACT_GROUPS_SQL
from rungwise.llm.mixing import MIX_SQL, mix_sources, poisson_table
from rungwise.llm.packing import best_fit, pack
from rungwise.llm.queries import op1_best_fit_packing, op5_exact_dedup, op6_poisson_mixing

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, copy string, row int, length string"


@pytest.mark.parametrize("rate", [0.01, 0.7, 1.0, 3.5, 40.0, 900.0, 20000.0])
def test_poisson_table(rate):
    first, steps = poisson_table(rate)
    mean, before = 0.0, 0.0
    for k, step in enumerate(steps, first):
        mean += k * (step - before)
        before = step
    assert math.isclose(mean, rate, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(steps[-1], 1, abs_tol=1e-9)


def docs(spark):
    rows = [(i, f"text {i % 700} " * (i % 9), "hot" if i % 3 else f"s{i % 5}", "c", 1, "z") for i in range(3000)]
    rows += [(None, None, None, None, None, None)] * 3 + [(5000, "", None, "x", 1, "z"), (5001, "w" * 50_000, "hot", "x", 1, "z"), (1, "text 1 ", "hot", "c", 1, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_mix_meets_weights(spark):
    mixed = mix_sources(docs(spark), weights={"hot": 1, "s0": 1, "s3": 2}, epochs=3.0)
    got = {r.source: r.n for r in mixed.groupBy("row.source").agg(F.count("*").alias("n")).collect()}
    total = sum(got.values())
    assert set(got) == {"hot", "s0", "s3"} and abs(total - 9000) < 600
    assert abs(got["s3"] / total - 0.5) < 0.05
    same = mix_sources(docs(spark).repartition(2), weights={"hot": 1, "s0": 1, "s3": 2}, epochs=3.0)
    flat = lambda m: sorted(map(repr, m.select("row.doc_id", "copy", "n_copies").collect()))
    assert flat(mixed) == flat(same)


def test_mix_empty(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("query, sql", [(op6_poisson_mixing, MIX_SQL), (op5_exact_dedup, EXACT_GROUPS_SQL)])
def test_equals_sql(spark, query, sql):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.sql(sql)
    got = query(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def plain_fit(items, capacity):
    """Best fit by looking at every bin."""
    bins, chosen = [], []
    for n, s, c in items:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        if fits:
            i = min(fits)[1]
        else:
            bins.append([capacity, set(), set()])
            i = len(bins) - 1
        bins[i][0] -= n
        bins[i][1].add(s)
        bins[i][2].add(c)
        chosen.append(i)
    return chosen, [b[0] for b in bins]


def test_best_fit_equals_plain():
    items = sorted(((i * 37 % 101, f"s{i % 3}" if i % 4 else None, f"c{i % 11}" if i % 5 else None) for i in range(400)), key=lambda x: -x[0])
    n, s, c = zip(*items)
    assert best_fit(n, s, c, 120) == plain_fit(items, 120)


def test_packing_is_whole_and_compatible(spark):
    source = docs(spark)
    got = pack(source, capacity=256, per_shard=500).collect()
    lengths, bins = Counter(), defaultdict(list)
    for r in got:
        lengths[r.doc_id] += r.length
        bins[r.bin_id].append(r)
    rows = source.collect()
    want = Counter()
    for r in rows:
        want[r.doc_id] += len(r.text or "")
    assert lengths == want and {r.doc_id for r in got} == {r.doc_id for r in rows}
    by_id = {r.doc_id: r for r in rows}
    for members in bins.values():
        assert sum(r.length for r in members) + members[0].bin_left == 256
        assert sorted(r.position for r in members) == list(range(len(members)))
        sources = [by_id[r.doc_id].source for r in members if by_id[r.doc_id].source is not None]
        texts = [by_id[r.doc_id].text for r in members if by_id[r.doc_id].text]
        assert len(sources) == len(set(sources)) and len(texts) == len(set(texts))
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_are_spread_over_shards(spark):
    rows = [(7, "same text", "hot", "c", 1, "z")] * 900 + [(100 + i, f"other {i}", "s", "c", 1, "z") for i in range(300)]
    source = spark.createDataFrame(rows, SCHEMA)
    got = pack(source, capacity=64, per_shard=100).collect()
    shards = Counter(r.bin_id >> 32 for r in got if r.doc_id == 7)
    assert len(got) == 1200 and shards.total() == 900
    assert len(shards) == 12 and max(shards.values()) < 200
    same = pack(source.repartition(7), capacity=64, per_shard=100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, same))


def test_near_copies_never_share_a_bin(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} tail{i}", f"s{i}", "c", 1, "z") for i in range(6)]
    # Ids that are null or repeat do not hide a near copy, nor make one of other texts.
    rows += [(None, f"{words} null{i}", f"n{i}", "c", 1, "z") for i in range(2)]
    rows += [(0, "something else", "t", "c", 1, "z"), (50, " ", "u", "c", 1, "z"), (51, None, "v", "c", 1, "z"), (52, "", "w", "c", 1, "z")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(r.length for r in got) == sum(len(r[1] or "") for r in rows)
    near = [r.bin_id for r in got if r.length > 100]
    assert len(near) == len(set(near)) == 8
    assert len({r.bin_id for r in got}) == 8
