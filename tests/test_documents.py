"""Documents cut in their splits against a parser of whole files."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rungwise.sources import documents, jsonl

ODD = ["a,b", 'q"uote', "back\\", "\\\\", "[", "]}", "{,", "", "é😀", "line\nbreak", '\\"', "]", ',"', "x" * 90]


def value(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.25:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if depth < 3 and kind < 0.5:
        return {rng.choice(ODD): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return rng.choice([rng.choice(ODD), rng.randint(-5, 5), True, None, 1.5])


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "8"}
    before = {name: spark.conf.get(name) for name in names}
    for name, setting in names.items():
        spark.conf.set(name, setting)
    yield
    for name, setting in before.items():
        spark.conf.set(name, setting)


def read(spark, path, layout=None):
    rows = jsonl.read_json_or_jsonl(spark, str(path), layout).orderBy(*jsonl.LINE_ORDER).select(F.to_json("v").alias("j")).collect()
    return [json.loads(r.j) for r in rows]


def wrapped(values):
    return [v if isinstance(v, dict) else {"value": v} for v in values]


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_over_many_splits(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent)
    values = [value(rng) for _ in range(120)]
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps(values, indent=indent, ensure_ascii=False) + "\n\n", encoding="utf-8")
    pieces = documents.read_pieces(spark, str(path))
    assert pieces.select("block").distinct().count() > 3
    assert read(spark, path, "document" if indent else None) == wrapped(values)


def test_dealing_splits_gives_the_same(spark, tmp_path, small_splits):
    rng = random.Random(7)
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps([value(rng) for _ in range(40)], indent=k))
    got = [sorted(map(tuple, documents.document_elements(spark, str(tmp_path), n).collect())) for n in (1, 10_000)]
    assert got[0] == got[1] and len(got[0]) == 120
    files = documents.document_elements(spark, str(tmp_path)).select("file", F.col("number").alias("at"))
    some = files.select("file").distinct().limit(2)
    for how, n in (("left_semi", 80), ("left_anti", 40)):
        assert {documents.of_files(files, some, how, limit).count() for limit in (0, 10)} == {n}


FORMS = [
    ("[]", []),
    (" [ \n ] ", []),
    ("{}", [{}]),
    ('{"a": [1,\n {"b": "]}"}],\n "c": 2}', [{"a": [1, {"b": "]}"}], "c": 2}]),
    ('[{"a":1}]\n[{"a":2}]', [{"value": [{"a": 1}]}, {"value": [{"a": 2}]}]),
    ('{"a":1}\n{"a":2}', [{"a": 1}, {"a": 2}]),
    ('[1,\n2,\n]', [{"value": 2}]),
    ('[1,2],', [{"value": [1, 2]}]),
    ('{"a":1},\n{"a":2},\n', [{"a": 1}, {"a": 2}]),
    ('[\n{"a":1},\n{bad},\n{"a":2}\n]', [{"a": 1}, {"a": 2}]),
    ('[{"a":1}\n{"a":2}]', []),
    ('["a\\\\", "b\\"", "c\\\\\\","]', [{"value": 'a\\'}, {"value": 'b"'}, {"value": 'c\\",'}]),
    ("[[1,2],[3,[4,5]]]", [{"value": [1, 2]}, {"value": [3, [4, 5]]}]),
    ('"text"', [{"value": "text"}]),
    ("", []),
    ("[}", []),
    ('[1, "open]', []),
    ("[NaN, 1]", [{"value": None}, {"value": 1}]),]


def test_forms(spark, tmp_path):
    for k, (content, _) in enumerate(FORMS):
        (tmp_path / f"{k:02}.json").write_text(content)
    got = {k: [] for k in range(len(FORMS))}
    for r in jsonl.read_json_or_jsonl(spark, str(tmp_path)).orderBy(*jsonl.LINE_ORDER).select("file", F.to_json("v").alias("j")).collect():
        got[int(r.file[-7:-5])].append(json.loads(r.j))
    assert got == {k: want for k, (_, want) in enumerate(FORMS)}


def test_files_of_several_forms(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text(json.dumps([{"a": i, "t": "x,y]" * 9} for i in range(30)]))
    (tmp_path / "b.json").write_text("".join(json.dumps({"b": i}) + ",\n" for i in range(30)) + "{bad\n")
    (tmp_path / "c.json").write_text(json.dumps({"c": list(range(200))}, indent=1))
    got = read(spark, tmp_path)
    assert [r["a"] for r in got if "a" in r] == list(range(30))
    assert [r["b"] for r in got if "b" in r] == list(range(30))
    assert [r["c"] for r in got if "c" in r] == [list(range(200))]


def test_runs_of_rows_of_one_split():
    rows = [("a", 0), ("a", 0), ("a", 9), ("b", 9), ("b", 9), ("a", 0)]
    batch = pa.RecordBatch.from_pydict({"file": [f for f, _ in rows], "block": [b for _, b in rows]})
    assert list(documents._runs(batch)) == [(("a", 0), 0, 2), (("a", 9), 2, 3), (("b", 9), 3, 5), (("a", 0), 5, 6)]
    assert list(documents._runs(batch.slice(0, 0))) == []
    assert list(documents._runs(batch.slice(5))) == [(("a", 0), 0, 1)]
