"""Line deduplication against a count of lines."""

import hashlib
import random
from collections import Counter

import pytest

from rungwise.llm.line_dedup import LineRuns, drop_repeated_lines, line_digests

STRIP = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(rows, threshold=10, least=1):
    held = Counter(k for _, t in rows for k in {key_of(line) for line in (t or "").split("\n")})
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < least or held[key_of(x)] < threshold]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def made():
    rng = random.Random(4)
    pool = ["Share this", "share THIS ", "\tÉtat", "état", "", "  ", "a", "😀", "é", "No\x85w", "x\ry"] + [f"line {i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(pool))]
    rows = [(i, "\n".join(rng.choices(pool, weights, k=rng.randint(0, 9)) + [f"own {i}"])) for i in range(120)]
    rows += [(200 + i, "hot line\nhot line\n" + "z" * i) for i in range(60)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, "share this"), (None, "share this\nalone"), rows[0], rows[0], rows[3]]
    return rows


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("threshold,least,batches,fan,hot", [(10, 1, 4, 2, 10_000), (10, 1, 5, 3, 0), (3, 3, 1, 2, 20), (2, 2, 7, 2, 5)])
def test_equals_brute_force(spark, threshold, least, batches, fan, hot):
    rows = made()
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, line string, n int")
    out = drop_repeated_lines(docs, threshold=threshold, least_chars=least, batches=batches, fan=fan, hot_rows=hot)
    assert got(out) == brute(rows, threshold, least)


def test_digests(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got(line_digests(drop_repeated_lines(docs))) == [(1, 2, 0, sha("a\nb")), (2, 1, 0, sha(""))]


def test_runs_are_levelled_and_settled_lines_stay_out(spark):
    index = LineRuns(spark, threshold=3, fan=2)
    batch = lambda *lines: spark.createDataFrame([(x.encode(),) for x in lines], "line binary")
    index.add(batch("a", "a", "a", "b"))
    index.add(batch("a", "b", "c"))
    assert [len(level) for level in index.levels] == [0, 1]
    assert {bytes(r["line"]): r["n"] for r in index.runs()[0].collect()} == {b"a": 3, b"b": 2, b"c": 1}
    index.add(batch("a", "b"))
    assert [len(level) for level in index.levels] == [1, 1]
    assert {bytes(r["line"]): r["n"] for r in index.runs()[0].collect()} == {b"b": 1}
    index.add(batch("d"))
    assert [len(level) for level in index.levels] == [0, 0, 1]
    assert {bytes(r["line"]): r["n"] for r in index.repeated().collect()} == {b"a": 3, b"b": 3}


def test_runs_are_read_in_buckets_without_a_shuffle(spark):
    index = LineRuns(spark, fan=9)
    for _ in range(2):
        index.add(spark.createDataFrame([(b"a",), (b"b",)], "line binary"))
    one, two = index.runs()
    plan = one.join(two.hint("merge"), "line")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_digests(drop_repeated_lines(docs)).collect() == []
