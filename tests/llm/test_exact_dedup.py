"""Exact copies by block naming against a dictionary of texts."""

import hashlib
import random
from collections import defaultdict

import pytest

from rungwise.llm.exact_dedup import drop_copies, exact_groups, integer_names

SCHEMA = "doc_id long, text string, keep_id string, level int, name string"


def made():
    rng = random.Random(3)
    texts = ["", None, "a", "a ", "A", "é" * 9, "x" * 70, "x" * 71, "😀" * 40]
    for length in (17, 64, 65, 200, 333, 1000):
        base = "".join(rng.choice("ab\né😀") for _ in range(length))
        texts += [base, base[:-1] + "z", base[: length // 2] + "z" + base[length // 2 + 1 :], base + "z"]
        texts += [base] * rng.randint(1, 5)
    texts += ["hot" * 50] * 40
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], rows[0], (None, "a"), (None, "alone"), (None, "alone")]


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for d, t in rows:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4096, 64, 7])
def test_groups_equal_brute_force(spark, block):
    rows = made()
    docs = spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SCHEMA).repartition(3)
    got = exact_groups(docs, block_chars=block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_drop_leaves_one_of_each_text(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SCHEMA)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    got = left.collect()
    assert len(got) == len({t or "" for _, t in rows})
    for r in got:
        ids = [d for d, t in rows if (t or "") == (r.text or "") and d is not None]
        assert r.doc_id == max(ids, default=None)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(docs).count() == 0
    assert drop_copies(docs).count() == 0


def test_names_follow_a_sort_of_short_keys(spark):
    blocks = spark.createDataFrame([("same head " * 9 + str(i % 50),) for i in range(200)], "block string")
    named = integer_names(blocks, ["block"], "test-names").collect()
    assert len(named) == len({r["name"] for r in named}) == len({r["block"] for r in named}) == 50
