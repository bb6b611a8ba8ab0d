"""Files, hooks, plans and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rungwise import hooks
from rungwise.operators.collate import collate_chunks
from rungwise.plans.labelling import label, label_records
from rungwise.plans.preference import preference_pairs
from rungwise.plans.refinement import refine_records
from rungwise.plans.rollout import parsed_rollouts, questions, remote_replies, sampling_requests
from rungwise.operators.counters import counted
from rungwise.operators.requests import request_lines
from rungwise.results import with_results
from rungwise.session import materialize, releasing
from rungwise.sources import jsonl
from rungwise.sources.records import reasoning_records
from rungwise.streaming import incremental
from rungwise.streaming.collate import collate_left_over, left_over, stream_collate
from rungwise.streaming.incremental import append_new, append_once, read_once


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_read_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"id":"1"}', "", "  ", "{bad", '{"id":"2"} ')
    lines = jsonl.read_jsonl(spark, path, str(tmp_path / "missing.jsonl"))
    odd = ['{"a":1} x', '{"a":1}]', '{"a":1}}', '{"a":1},', '{"a":1}],[2', "[1]", '"s"', "1,2"]
    frame = spark.createDataFrame(list(enumerate(odd)), "i int, c string")
    parsed = frame.filter(jsonl.strict_json(F.col("c")).isNotNull()).collect()
    assert sorted(r.c for r in parsed) == ['"s"', "[1]"]
    assert sorted(r.i for r in jsonl.good_records(lines).select(jsonl.field("id").alias("i")).collect()) == ["1", "2"]
    assert [r.value for r in jsonl.bad_lines(lines).collect()] == ["{bad"]
    assert jsonl.read_jsonl(spark, str(tmp_path / "missing.jsonl")).count() == 0


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ('[{"a":1},2,"x"]', ['{"a":1}', '{"value":2}', '{"value":"x"}']),
        ('{"a":\n1}', ['{"a":1}']),
        ('{"a":1},\n{bad\n\n{"a":2}\n3,', ['{"a":1}', '{"a":2}', '{"value":3}']),
    ],
)
def test_read_json_or_jsonl(spark, tmp_path, content, want):
    path = tmp_path / "x.json"
    path.write_text(content)
    rows = jsonl.read_json_or_jsonl(spark, str(path)).orderBy(*jsonl.LINE_ORDER).select(F.to_json("v").alias("j")).collect()
    assert [r.j for r in rows] == want


def test_ids(spark, tmp_path):
    path = write(tmp_path / "skip.txt", '{"id":"a"}', '{"id":null}', "raw", "12", '{"id":7}', '{"x":1}')
    assert sorted(r.id for r in jsonl.excluded_ids(spark, path).collect()) == ["12", "7", "a", "raw", '{"x":1}']
    (tmp_path / "done").mkdir()
    write(tmp_path / "done" / "b.jsonl", '{"id":"b"}', "raw", '{"id":"b"}')
    write(tmp_path / "done" / "c.txt", '{"id":"c"}')
    assert [r.id for r in jsonl.processed_ids(spark, str(tmp_path / "done")).collect()] == ["b"]
    truth = write(tmp_path / "t.jsonl", '{"id":"a","answer":"x"}', '{"id":""}', '{"id":"a","answer":"y"}')
    rows = jsonl.last_record_by_id(jsonl.read_jsonl(spark, truth)).select("id", jsonl.field("answer").alias("a")).collect()
    assert [tuple(r) for r in rows] == [("a", "y")]


def test_split_and_merge(spark, tmp_path):
    lines = [json.dumps({"id": i}) for i in range(23)]
    path = write(tmp_path / "in.jsonl", *lines[:11], "", *lines[11:])
    read = jsonl.read_lines(spark, path)
    sharded = jsonl.with_shards(read, 5, jsonl.LINE_ORDER)
    out = tmp_path / "shards"
    jsonl.write_shards(sharded, str(out))
    got = {}
    for file in out.glob("shard=*/*.txt"):
        got.setdefault(int(file.parent.name[6:]), []).extend(file.read_text().split("\n")[:-1])
    assert got == {k + 1: lines[k * 5 : k * 5 + 5] for k in range(5)}
    rest = jsonl.skip_lines(read, 20).orderBy("idx").collect()
    assert [r.value for r in rest] == lines[20:]
    with pytest.raises(ValueError):
        jsonl.skip_lines(read, 23)
    mixed = write(tmp_path / "m.jsonl", '{"id":1,"note":"error"}', '{"id":2,"error":"x"}', "{bad", '{"a error":1}')
    merged = jsonl.read_jsonl(spark, mixed)
    assert jsonl.merged_records(merged).count() == 2
    assert tuple(jsonl.merge_counts(merged).first()) == (4, 2, 2)


def test_write_keeps_nulls_and_letters(spark, tmp_path):
    jsonl.write_jsonl(spark.createDataFrame([("é", None)], "a string, b string").coalesce(1), str(tmp_path / "o"))
    (file,) = (tmp_path / "o").glob("part-*")
    assert file.read_text(encoding="utf-8") == '{"a":"é","b":null}\n'


def test_hooks(spark):
    def load_answer():
        def answer(batch):
            if (batch["id"] == 3).any():
                raise ValueError("three")
            return pd.DataFrame({"completion": batch["id"].astype(str) + "!"})

        return answer

    frame = spark.range(8).select("id")
    good, bad = hooks.split_errors(hooks.complete(frame, load_answer, partitions=2))
    assert sorted(r.completion for r in good.collect()) == [f"{i}!" for i in range(8) if i != 3]
    assert [tuple(r) for r in bad.collect()] == [(3, "ValueError: three")]
    lengths = hooks.token_count(lambda: lambda s: s.str.len())
    rows = spark.createDataFrame([("ab",), ("",)], "t string").select(lengths("t").alias("n")).collect()
    assert sorted(r.n for r in rows) == [0, 2]


def test_rollout_plan(spark, tmp_path):
    asked = jsonl.read_jsonl(
        spark,
        write(
            tmp_path / "q.jsonl",
            '{"id":"folio_1","premise":["a","b ."],"question":"q","answer":"A"}',
            '{"id":"folio_1","premise":"a b.","question":"q","answer":"B"}',
            json.dumps({"id": "x_2", "premise": "w " * 4000, "question": "q"}),
        ),
    )
    rows = sampling_requests(questions(asked), samples=3).collect()
    assert sorted((r.id, r.answer, r.rep_idx, r.seed) for r in rows) == [("folio_1", "A", i, 20250815 + i) for i in range(3)]

    def reply(custom_id, content):
        return json.dumps({"custom_id": custom_id, "response": {"body": {"choices": [{"message": {"content": content}}]}}})

    text = "Step 1:\nPremises:\n- a\nConclusion:\n- b\nFinal:\n<answer>A</answer>"
    path = write(
        tmp_path / "r.jsonl",
        reply("folio_1__rep1__m", text), reply("folio_1__rep0__m", "first"), reply("folio_1__rep0__m", "second"),
        reply("folio_1__rep3__m", "no"), reply("folio_12__rep0__m", "other"), reply("folio_1__rep2__m", None),
    )
    truth = spark.createDataFrame([("folio_1", "p", "q", "A")], "id string, premise string, question string, answer string")
    (record,) = remote_replies(jsonl.read_json_or_jsonl(spark, path), truth).collect()
    assert record.generation == ["first", text] and record.extracted_answer == ["", "A"]

    lines = write(tmp_path / "p.jsonl", json.dumps([{"id": "a", "generation": [text]}, {"id": "b", "generations": [text, "x"]}]))
    got = {r.id: r.generations for r in parsed_rollouts(jsonl.read_jsonl(spark, lines)).collect()}
    assert [len(got["a"]), len(got["b"])] == [1, 2] and got["a"][0].steps[0].conclusion == "b"


STEP = "struct<n:int,premises:array<string>,assumptions:array<string>,conclusion:string>"
GENERATION = f"array<struct<final_tag:string,steps:array<{STEP}>>>"


def test_preference_plan(spark):
    def gen(tag):
        return (tag, [(1, ["p"], [], f"c{tag}")])

    rows = [
        ("folio_1", "p", "q", [gen("a"), gen("b"), gen("c")], [0.7, 0.9, 0.0], 0),
        ("folio_1", "longer", "", [gen("d"), gen("e")], [0.9, 0.2], 1),
        ("x", "p", "q", [gen("a"), gen("b")], [0.9], 2),
        (None, "p", "q", [gen("a"), gen("b")], [0.9, 0.1], 3),
    ]
    frame = spark.createDataFrame(
        rows, f"id string, premise string, question string, generations {GENERATION}, reward_score array<double>, at int"
    )
    (pair,) = preference_pairs(frame, "at").collect()
    assert pair.reward == [0.9, 0.2]
    assert pair.good_answer.endswith("Conclusion: cb\nFinal answer: [b]")
    assert pair.bad_answer.endswith("Conclusion: ce\nFinal answer: [e]")
    assert "Premise:\nlonger\n\nQuestion:\nq\n\nIs the question A)" in pair.question


def test_records_to_pairs(spark, tmp_path):
    def line(**fields):
        return json.dumps(fields)

    step = {"n": 1, "premises": ["p"], "assumption": "as one text", "conclusion": "c"}
    refined = {"premise": "p", "assumptions": ["x", "y"], "conclusion": "d", "logic_validity": 1.0}
    rewarded = write(
        tmp_path / "rewarded.jsonl",
        line(id="folio_1", premise=["a", "b"], question="q", generations=[{"steps": [step], "final_tag": "A"}, {"final_tag": "B"}], reward_score=["0.9", 0.1]),
        line(id="own", context="k", generations=[{"answer": "A", "reward": 0.8}, {"reward": "0.2"}, {"reward": "x"}], reward_score=[0.1]),
        line(id="broken", error="x"),
    )
    refined = write(tmp_path / "refined.jsonl", line(id="folio_1", premises="a b c", generations=[{"steps": [refined]}], reward_score=[0.95]))
    lines = jsonl.merged_records(jsonl.read_jsonl(spark, rewarded, refined))
    records = reasoning_records(lines)
    steps = {r.id + str(r.src): r.generations[0].steps for r in records.collect()}
    assert steps["folio_10"][0].assumptions == ["as one text"] and steps["folio_11"][0].premises == ["p"]
    assert steps["folio_11"][0].logic_validity == 1.0 and steps["own0"] == []
    indexed = jsonl.index_lines(records)
    got = {r.id: r for r in preference_pairs(indexed, "idx").collect()}
    assert set(got) == {"folio_1", "own"}
    assert got["folio_1"].reward == [0.95, 0.1] and got["own"].reward == [0.8, 0.2]
    assert "Assumption: x y\nConclusion: d" in got["folio_1"].good_answer
    assert "Premise:\na b c\n" in got["folio_1"].question and got["own"].good_answer == "Final answer: [A]"


def test_requests_and_counters(spark):
    frame = spark.createDataFrame(
        [("q__rep0__m", [("user", "é")], 7, 0.0)],
        "custom_id string, messages array<struct<role:string,content:string>>, max_tokens int, temperature double",
    )
    (row,) = request_lines(frame, "m").collect()
    assert json.loads(row.value) == {
        "custom_id": "q__rep0__m", "method": "POST", "url": "/v1/chat/completions",
        "body": {"model": "m", "messages": [{"role": "user", "content": "é"}], "max_completion_tokens": 7, "temperature": 0.0},
    }
    watched, seen = counted(spark.range(10), "run", even=F.col("id") % 2 == 0)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_rows": 10, "even": 5}


def test_labelling_plan(spark):
    steps = [(1, ["x"], ["s"], "- y"), (2, ["y"], [], "z"), (3, [], [], "w")]
    frame = spark.createDataFrame(
        [("1", "A", ["x. q."], [("A", steps), ("B", steps[:1]), (None, [])])],
        f"id string, answer string, premises array<string>, generations {GENERATION}",
    )

    def load():
        letters = {"x.": 0, "x": 0, "q.": 1, "y": 2, "z": 3}
        return lambda s: s.map(lambda t: [1.0 if i == letters[t] else 0.0 for i in range(4)])

    attempts = spark.createDataFrame(
        [("1", 0, 0, 0, True, True), ("1", 0, 1, 0, True, False)],
        "id string, gen_pos int, step_pos int, attempt int, syntactic_ok boolean, semantic_ok boolean",
    )
    got = {r.gen_pos: r for r in label(frame, hooks.embed(load), attempts).collect()}
    # Steps of the first generation: (1, 1), (1 by the carried conclusion, 0), (1 for no premise, 0).
    assert [(m.premise_validity, m.logic_validity) for m in got[0].step_validity] == [(1.0, 1.0), (1.0, 0.0), (1.0, 0.0)]
    assert got[0].reward == pytest.approx(0.5 * (1.0 + 0.5 + 0.5) / 3 + 0.5)
    assert got[1].reward == pytest.approx(0.25)
    assert got[2].reward == 0.0


def test_labelled_records(spark):
    steps = [(1, ["x"], [], "- y"), (2, ["x", "y"], [], "z")]
    rows = [(str(i), "A", ["x."], [("A", steps), ("A", steps)]) for i in range(4)] + [("none", "A", [], []), ("bad", "A", ["x."], [("A", steps)])]
    frame = spark.createDataFrame(rows, f"id string, answer string, premises array<string>, generations {GENERATION}")
    calls = spark.sparkContext.accumulator(0)

    def load():
        def vectors(texts):
            calls.add(len(texts))
            return texts.map(lambda t: [float("x" in t), float("y" in t), float("z" in t)])

        return vectors

    attempts = spark.createDataFrame([("0", 0, 0, 0, True, True)], "id string, gen_pos int, step_pos int, attempt int, syntactic_ok boolean, semantic_ok boolean")
    failures = spark.createDataFrame([("bad", "late"), ("bad", "broken"), ("other", "x")], "id string, error string")
    good, bad = label_records(frame, hooks.embed(load), attempts, failures=failures)
    for _ in range(2):
        got = {r.id: r for r in good.collect()}
        assert [tuple(r) for r in bad.collect()] == [("bad", "broken")]
    # The texts "x.", "x" and "y"; reading the result twice asks for none of them again.
    assert calls.value == 3
    assert set(got) == {"0", "1", "2", "3", "none"}
    assert got["none"].reward_score == [] and got["none"].per_step_validity == []
    assert got["1"].reward_score == pytest.approx([0.75, 0.75])
    assert got["0"].reward_score == pytest.approx([0.875, 0.75])
    assert [m.premise_validity for m in got["2"].per_step_validity[1]] == [1.0, 1.0]


def test_refinement_plan(spark):
    rows = [
        ("1", "A", [("A", [(1, ["p", "q"], ["s", "t"], "- y"), (2, [], [], "z")]), (None, [])], [0.5, 0.5]),
        ("2", "A", [("A", [(1, ["p"], ["bad"], "y")])], [0.5]),
    ]
    records = spark.createDataFrame(rows, f"id string, answer string, generations {GENERATION}, reward_score array<double>")

    def critique(rows, number):
        known = F.col("assumption") != "bad"
        return rows.withColumn("syntactic_ok", F.when(known, F.lit(True))).withColumn(
            "semantic_ok", (F.length("assumption") > 4) & (F.col("explanation") != "")
        )

    def rewrite(rows, number):
        return rows.withColumn("assumption", F.concat("assumption", F.lit("+")))

    good, bad, refined = refine_records(records, critique, rewrite, rounds=3)
    (record,) = good.collect()
    first, second = record.generations[0].steps
    assert (first.assumptions, first.logic_validity, first.syntactic_validity) == (["s t++"], 1.0, 1.0)
    assert (second.assumptions, second.logic_validity, second.syntactic_validity) == (["+++"], 0.0, 1.0)
    assert record.generations[1].steps == [] and "reward_score" not in good.columns
    assert [tuple(r) for r in bad.collect()] == [("2", "critique failed")]
    assert refined.history.count() == 3 + 2 + 2


def test_streams(spark, tmp_path):
    rows = [(f"u{i % 3}", f"t{i}", f"a{i}") for i in range(37)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "id string, text string, answer string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, text string, answer string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = (
        stream_collate(stream)
        .writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    full = spark.read.json(str(tmp_path / "out")).collect()
    batch = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, id string, text string, answer string")
    twin = collate_chunks(batch, ["at"], F.lit(0)).filter(F.size("generation") == 5)
    assert sorted(r.id for r in full) == sorted(r.id for r in twin.collect())
    texts = [t for r in full for t in r.generation]
    assert len(texts) == len(set(texts)) and all(len(r.generation) == 5 for r in full)

    done = spark.createDataFrame([("u1",)], "id string")
    for _ in range(2):
        append_new(stream, done, str(tmp_path / "new"), str(tmp_path / "d")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "new")).collect()) == ["u0", "u2"]


def test_outcomes_run_the_hook_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def answer(batch):
            if (batch["id"] == "b").any() and len(batch) > 1:
                raise ValueError("halve")
            if (batch["id"] == "b").any():
                raise ValueError('no "reply"')
            calls.add(len(batch))
            return pd.DataFrame({"completion": batch["id"].map(lambda i: f"{i} \u00e9\n")})

        return answer

    schema = "id string, note string"
    rows = spark.createDataFrame([("a", None), ("b", "x"), ("c", "y"), (None, "z")], schema)
    path = str(tmp_path / "out")
    jsonl.write_outcomes(hooks.complete(rows, load), path, ["id"])
    good = jsonl.read_outcome(spark, path, "good", f"{schema}, completion string, error string").collect()
    bad = jsonl.read_outcome(spark, path, "error", f"{schema}, error string").collect()
    assert calls.value == 3
    assert sorted(map(str, (r.id for r in good))) == ["None", "a", "c"] and all(r.error is None for r in good)
    assert [r.completion for r in good if r.id == "a"] == ["a \u00e9\n"]
    assert [tuple(r) for r in bad] == [("b", None, 'ValueError: no "reply"')]
    jsonl.write_outcomes(hooks.complete(rows.filter("id = 'a'"), load), str(tmp_path / "good"))
    assert jsonl.read_outcome(spark, str(tmp_path / "good"), "error", "id string, error string").count() == 0


def test_stored_tables_go_when_their_results_are_written(spark, tmp_path):
    rows = spark.range(5)
    outside = materialize(rows, "kept")
    with releasing(spark):
        inner = materialize(rows, "released")
        with releasing(spark):
            nested = materialize(rows, "released")
            nested_files = nested.inputFiles()
        inner.write.parquet(str(tmp_path / "out"))
        files = inner.inputFiles()
    with pytest.raises(RuntimeError, match="broken"), releasing(spark):
        lost = materialize(rows, "released").inputFiles()
        raise RuntimeError("broken")
    assert not any(jsonl.path_exists(spark, f) for f in [*files, *nested_files, *lost])
    assert materialize(outside, "kept").count() == spark.read.parquet(str(tmp_path / "out")).count() == 5


@pytest.mark.parametrize("salts", [1, 3])
def test_stream_and_its_leftovers_equal_the_batch_form(spark, tmp_path, salts):
    rows = [(f"u{i % 4}" if i % 9 else None, f't"{i}' if i % 5 else None, f"[a{i}" if i % 7 else None) for i in range(60)]
    schema = "id string, text string, answer string"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (
        stream_collate(stream, salts=salts)
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start().awaitTermination(120)
    )
    full = spark.read.parquet(str(tmp_path / "out")).collect()
    rest = collate_left_over(spark, str(tmp_path / "c")).collect()
    batch = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"at int, {schema}")
    twin = collate_chunks(batch, ["at"], F.lit(0)).collect()

    def sizes(records):
        return sorted((str(r.id), len(r.generation)) for r in records)

    def replies(records):
        return sorted(str((r.id, *pair)) for r in records for pair in zip(r.generation, r.extracted_answer))

    assert sizes(full + rest) == sizes(twin)
    assert replies(full + rest) == replies(twin) == sorted(str(r) for r in rows)
    assert all(len(r.generation) == 5 for r in full)
    held = left_over(spark, str(tmp_path / "c")).groupBy("id").count().collect()
    assert all(r["count"] <= salts * 4 for r in held)


def test_ids_are_written_once_without_state(spark, tmp_path, monkeypatch):
    schema = "id string, n int"
    for part in range(10):
        rows = [(f"u{i % 17}" if i % 11 else None, 100 * part + i) for i in range(part, part + 20)] * 2
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = spark.createDataFrame([("u1",)], "id string")
    out, checkpoint = str(tmp_path / "it's out"), str(tmp_path / "c")
    write, seen = incremental.write_once, []

    def lost_after_write(rows, batch, path, buckets):
        write(rows, batch, path, buckets)
        seen.append(batch)
        if seen == [0, 1]:
            raise RuntimeError("lost")

    monkeypatch.setattr(incremental, "write_once", lost_after_write)
    with pytest.raises(Exception, match="lost"):
        append_once(stream, done, out, checkpoint, 4).awaitTermination(120)
    # The session that starts again knows nothing of the table.
    for table in spark.catalog.listTables():
        if table.name.startswith("once_"):
            spark.sql(f"DROP TABLE {table.name}")
    append_once(stream, done, out, checkpoint, 4).awaitTermination(240)
    assert seen == [0, 1, *range(1, 10)]
    ids = [r.id for r in read_once(spark, out, schema).collect()]
    assert sorted(map(str, ids)) == sorted(["None", *(f"u{i}" for i in range(17) if i != 1)])
    assert not (tmp_path / "c" / "state").exists()


def test_finished_ids_are_not_shuffled(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}",) for i in range(100)], "id string")
    incremental.write_once(rows.limit(60), 0, str(tmp_path / "out"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        output = spark.table(incremental._output_table(spark, rows.schema, str(tmp_path / "out"), 4))
        new = incremental.new_rows(rows, 1, output, 4)
        plan = new._jdf.queryExecution().executedPlan().toString()
        left, right = plan.split("\n   +- ", 1)
        assert "SortMergeJoin" in left and "Exchange" in left and "Aggregate" in left[left.index("Exchange") :]
        assert "Exchange" not in right and "SelectedBucketsCount: 4 out of 4" in right
        assert new.count() == 40 and incremental.new_rows(rows, 0, output, 4).count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layout_does_not_depend_on_size(spark, tmp_path):
    texts = {
        "array.json": json.dumps([{"id": str(i), "n": i} for i in range(50)], indent=2),
        "object.json": json.dumps({"id": "one", "n": 1}, indent=1),
        "line.json": json.dumps([{"id": "a"}, {"id": "b"}]),
        "lines.json": "\n".join(json.dumps({"id": f"l{i}"}) for i in range(40)),
        "commas.json": "\n".join(json.dumps({"id": f"c{i}"}) + "," for i in range(40)) + "\n{broken\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = jsonl.read_json_or_jsonl(spark, str(tmp_path)).select(jsonl.field("id").alias("id")).collect()
    want = [str(i) for i in range(50)] + ["one", "a", "b"] + [f"l{i}" for i in range(40)] + [f"c{i}" for i in range(40)]
    assert sorted(r.id for r in found) == sorted(want)


def test_number_words_and_repeated_keys(spark, tmp_path):
    long = 'word \\" ' * 20000 + "end"
    lines = [
        '{"id":"a","r":[NaN,0.9,-Infinity,Infinity]}',
        '{"id":"x","id":"b","t":"NaN, \\"Infinity"}',
        '{"id":"c","r":[NaN}',
        '{"id":"d","r":[-1,2e-3]}',
        '{"id":"e","r":nan}',
        f'{{"id":"f","t":{json.dumps(long)},"r":NaN}}',
    ]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    read = jsonl.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    rows = jsonl.good_records(read).select(jsonl.field("id").alias("id"), F.to_json(jsonl.field("r", "variant")).alias("r"), jsonl.field("t").alias("t"))
    got = {r.id: (r.r, r.t) for r in rows.collect()}
    assert sorted(got) == ["a", "b", "d", "f"]
    assert got["a"][0] == "[null,0.9,null,null]" and got["b"][1] == 'NaN, "Infinity'
    assert got["f"] == ("null", long)
    assert jsonl.bad_lines(read).count() == 2


def test_a_hook_that_always_fails_stops_the_job(spark):
    def load():
        def fail(batch):
            raise OSError("down")

        return fail

    with pytest.raises(Exception, match="failed for all of 3 rows"):
        hooks.apply_hook(spark.range(10).coalesce(1), load, "x string", give_up_after=3).collect()
    assert hooks.apply_hook(spark.range(2).coalesce(1), load, "x string", give_up_after=3).filter("error is not null").count() == 2


def test_only_files_that_can_close_are_gathered(spark, tmp_path):
    texts = {
        "broken_first": '{"id":1, \n{"id":2},\n{"id":3},\n',
        "broken_ends": '{"id":1, \n{"id":4},\n{"id":5, \n',
        "array_by_line": '[\n{"id":6},\n{"id":7}\n]\n',
        "document": '[{"id":8,\n"x":[1]},\n{"id":9\n}]\n',
        "pretty": '{\n"id": 10\n}\n',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    read = jsonl.read_json_or_jsonl(spark, str(tmp_path))
    assert sorted(r.i for r in read.select(jsonl.field("id", "bigint").alias("i")).collect()) == [2, 3, 4, 6, 7, 8, 9, 10]
    # A line that reads as a value by its own place was not gathered.
    places = {n: sorted(r.at for r in jsonl.read_json_or_jsonl(spark, str(tmp_path / f"{n}.json")).collect()) for n in texts}
    assert places == {"broken_first": [1, 2], "broken_ends": [1], "array_by_line": [1, 2], "document": [0, 1], "pretty": [0]}


def test_results_are_made_once_for_each_input(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def shout(batch):
            calls.add(len(batch))
            if (batch["x"] == "bad").any():
                raise ValueError("bad")
            return pd.DataFrame({"y": batch["x"].map(lambda x: "none" if x is None else x + "!")})

        return shout

    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "a", "b", None, None, ""])], "i int, x string")
    run = lambda df, settings="m": with_results(df, lambda d: hooks.apply_hook(d, load, "y string"), "y string", ["x"], store, settings)
    want = [("a", "a!"), ("a", "a!"), ("b", "b!"), (None, "none"), (None, "none"), ("", "!")]
    assert [(r.x, r.y) for r in run(rows).orderBy("i").collect()] == want
    assert calls.value == 4
    assert [(r.x, r.y) for r in run(rows).orderBy("i").collect()] == want
    assert calls.value == 4
    more = rows.union(spark.createDataFrame([(9, "bad"), (10, "c")], "i int, x string"))
    got = {r.x: (r.y, r.error) for r in run(more).collect()}
    assert got["bad"] == (None, "ValueError: bad") and got["c"] == ("c!", None) and got["a"] == ("a!", None)
    made = calls.value
    good, bad = hooks.split_errors(run(more), keep=("i",))
    assert good.count() == 7 and [r.i for r in bad.collect()] == [9]
    # Only the input that failed was tried again, once for both outputs.
    assert calls.value == made + 1
    run(rows, "other model")
    assert calls.value == made + 5
