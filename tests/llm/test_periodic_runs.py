"""Runs of words against a search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from rungwise.llm.periodic_runs import collapse, find_runs, plant_runs, run_digests, runs_of


def brute(words, exponent=4, least=6):
    """Every stretch that is maximal for a period, named by its least period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q):
                found.setdefault((i, length), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def made(seed):
    rng = random.Random(seed)
    docs = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 400, ["a", "b"] * 60, ["x"] + ["a", "b", "c"] * 9 + ["a"]]
    for _ in range(60):
        docs.append([rng.choice("ab") for _ in range(rng.randint(0, 80))])
    for _ in range(40):
        words = []
        while len(words) < 150:
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
            words += (unit * rng.randint(1, 12))[: rng.randint(1, 60)]
        docs.append(words)
    word = ["a", "b"]
    for _ in range(6):
        word = [y for x in word for y in (["a", "b", "a"] if x == "a" else ["a", "a"])]
    return docs + [word, (["p", "q", "r"] * 5 + ["z"]) * 8, [str(i % 17) for i in range(300)]]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    docs = made(seed)
    assert runs_of(docs) == [brute(d) for d in docs]


@pytest.mark.parametrize("exponent,least", [(3, 4), (3, 9), (5, 1), (4, 30)])
def test_other_limits(exponent, least):
    docs = made(9)
    assert runs_of(docs, exponent, least) == [brute(d, exponent, least) for d in docs]


def test_exponents_below_three_are_refused():
    with pytest.raises(ValueError):
        runs_of([["a"]], exponent=2)


def test_long_run_is_quick():
    words = ["a"] * 100_000 + ["b"] + ["c", "d", "e"] * 30_000
    assert runs_of([words]) == [[(0, 100_000, 1), (100_001, 90_000, 3)]]


def test_collapse_keeps_the_first_period():
    words = [b"x", *[b"a", b"b"] * 5, b"y"]
    assert collapse(words, runs_of([words])[0]) == b"x a b y"


def planted(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def test_query_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["é", "b", "\x85c", "d"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(151, None), (152, ""), (153, " \t\n"), (None, "a a a a a a a b"), (154, "\ta  b\na b a b a b a b "), rows[0], rows[0]]
    rows += [(i, "one\ttwo three " * 12) for i in range(200, 260)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    text = plant_runs(docs["text"], docs["doc_id"])
    got = run_digests(find_runs(docs.select("doc_id", text.alias("text"), "runs", "n_words")))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(expected(*r)) for r in rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect() if len(r["text"].split(" ")) < 600]
    small = spark.createDataFrame(rows, docs.schema)
    got = run_digests(find_runs(small.withColumn("text", plant_runs(small["text"], small["doc_id"]))))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(expected(*r)) for r in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert run_digests(find_runs(docs)).collect() == []
