"""Near-duplicate components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import Row

from rungwise.llm.near_dedup import drop_near_copies, least_matches, near_components, signature

SCHEMA = "doc_id long, text string, component_id string, n_shingles int"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width=4, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        ids = least.setdefault(root(i), [])
        if d is not None:
            ids.append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = least[root(i)]
        c = d if not sets[i] else (min(ids) if ids else None)
        out.append((d, len(sets[i]), c, d == c))
    return out


def made(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words) if n % 3 else "\t".join(words).upper()))
            n += 1
    # A chain: each text shares most of its words with the next one only.
    chain = [f"c{i}" for i in range(400)]
    for k in range(10):
        rows.append((n, " ".join(chain[k * 10 : k * 10 + 150])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "one two three")]
    rows += [rows[0], rows[0], (None, rows[3][1]), (None, "only null"), (None, "only null"), (n + 6, "é É"), (n + 7, "É É")]
    rng.shuffle(rows)
    return rows


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block", [512, 4])
def test_components_equal_brute_force(spark, block):
    rows = made()
    docs = spark.createDataFrame([Row(*r, "x", 7) for r in rows], SCHEMA).repartition(5)
    got = near_components(docs, width=4, block=block).select("doc_id", "n_shingles", "component_id", "kept")
    assert key([tuple(r) for r in got.collect()]) == key(brute(rows))


def test_drop_keeps_one_of_each(spark):
    rows = made(8)
    docs = spark.createDataFrame([Row(*r, "x", 7) for r in rows], SCHEMA)
    left = drop_near_copies(docs, width=4)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    want = {(d, c) for d, n, c, kept in brute(rows) if kept and d is not None}
    assert {i for i in ids if i is not None} == {d for d, _ in want}
    assert len([i for i in ids if i is not None]) == len(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_components(docs).count() == 0
    assert drop_near_copies(docs).count() == 0


def test_least_matches_keep_similar_pairs():
    needed = least_matches(0.8, 128)
    assert needed == sorted(needed) and needed[-1] < 0.8 * 128


def test_one_stays_where_near_texts_share_the_least_id(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, f"{words} a", "c", 0), (1, f"{words} b", "c", 0), (2, f"{words} d", "c", 0), (1, "another text", "c", 0), (None, "only here", "c", 0)]
    left = drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.text.startswith(words) for r in left) == 1
    assert sorted(r.text for r in left if not r.text.startswith(words)) == ["another text", "only here"]


@pytest.mark.parametrize("size", [4, 9, 45, 450, 1800])
def test_signatures_agree_with_the_chance_of_the_similarity(size):
    rng = np.random.default_rng(size)
    common, trials = (size * 8) // 9, 1500
    shares, missed = [], 0
    for _ in range(trials):
        u = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * size - common, dtype=np.uint64)
        one, two = signature(np.sort(u[:size])), signature(np.sort(np.concatenate([u[:common], u[size:]])))
        shares.append((one == two).mean())
        missed += not (one.reshape(32, 4) == two.reshape(32, 4)).all(axis=1).any()
    similarity = common / (2 * size - common)
    assert abs(np.mean(shares) - similarity) < 0.01
    assert np.std(shares) < 1.1 * (similarity * (1 - similarity) / 128) ** 0.5
    # The chance that no band agrees, for independent places, and far above what may be seen.
    assert missed <= 20 * trials * (1 - similarity**4) ** 32 + 1


def test_signature_does_not_depend_on_how_many_rounds_are_drawn_at_once():
    # Sets on both sides of the size from which one round is enough.
    rng = np.random.default_rng(3)
    big = np.sort(rng.integers(0, 1 << 63, 1100, dtype=np.uint64) * np.uint64(2))
    small = np.sort(rng.permutation(big)[:1000])
    assert (signature(big) == signature(small)).mean() > 0.8
