"""Step parsing against a plain loop written from the format's rules."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from rungwise.functions.steps import audit_generation, format_generation, parse_generation, read_steps, unfiltered

SF = Path("/root/testdata/sf0.001")

HEAD = re.compile(r"(?:^|\n)Step\s+(\d+)\s*:?\s*\n", re.I)
FINAL = re.compile(r"(?:^|\n)Final\s*:?", re.I)
SECTIONS = [re.compile(rf"(?:^|\n)\s*{h}\s*:\s*", re.I) for h in ("Premises?", "Assumptions?", "Conclusion")]


def bullets(block):
    return [re.sub(r"^[-•]\s*", "", s.strip()) for s in block.splitlines() if s.strip()]


def expected_steps(text):
    heads = list(HEAD.finditer(text))
    cut = FINAL.search(text)
    stops = [h.start() for h in heads[1:]] + [cut.start() if cut else len(text)]
    steps = []
    for head, stop in zip(heads, stops):
        block = text[head.end() : stop].strip()
        if not block:
            continue
        hits = [p.search(block) for p in SECTIONS]
        starts = sorted(h.start() for h in hits if h)
        parts = []
        for hit in hits:
            after = [s for s in starts if hit and s > hit.start()]
            parts.append(block[hit.end() : after[0] if after else len(block)].strip() if hit else "")
        steps.append((int(head.group(1)), bullets(parts[0]), bullets(parts[1]), " ".join(bullets(parts[2])).strip()))
    return steps


def random_text(rng):
    pieces = [
        "Step 1:\n", "Step 2\n", "step 10 :\n\n", "Premises:\n- a\n- b\n", "Premise: x\n", "Assumptions:\n• c\n",
        "Assumption:\n", "Conclusion:\n- so \U0001f600\n", "Conclusion: y\nz\n", "Final:\n", "Finally, done\n", "noise\n",
        "<answer> yes </answer>", "< Answer >no</answer >", "\n", "  ", " - d\n",
    ]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))


def test_parse_agrees_with_a_loop(spark):
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = frame.select("i", parse_generation(F.col("t")).alias("g")).orderBy("i").collect()
    for row, text in zip(rows, texts):
        steps, g = expected_steps(text), row.g
        numbers = [s[0] for s in steps]
        assert [tuple(s) for s in g.steps] == sorted(steps, key=lambda s: s[0]), text
        assert g.step_numbers == numbers
        assert g.step_order_ok == (numbers == sorted(numbers))
        assert g.missing_steps == [n for n in range(1, max(numbers, default=0) + 1) if n not in numbers]
        assert g.duplicate_steps == sorted({n for n in numbers if numbers.count(n) > 1})
        tag = re.search(r"<\s*answer\s*>\s*(.*?)\s*<\s*/\s*answer\s*>", text, re.I | re.S)
        assert g.final_tag == (tag.group(1).strip() if tag else None)


def test_final_option_and_absurd_numbers(spark):
    text = "Finally.\nStep 1:\nConclusion: a\nFinal:\n<answer>x</answer>"
    row = spark.range(1).select(
        parse_generation(F.lit(text)).alias("a"),
        parse_generation(F.lit(text), final_after_last_step=True).alias("b"),
        parse_generation(F.lit("Step 2000000000:\nConclusion: a")).alias("c"),
    ).first()
    assert row.a.steps == []
    assert [s.conclusion for s in row.b.steps] == ["a"]
    assert row.c.missing_steps is None and row.c.step_numbers == [2000000000]


def test_format(spark):
    text = "Step 4:\nPremises:\n- a , b\n- c\nAssumptions:\n- d\nConclusion:\n- e\n\nStep 9:\nConclusion: f\nFinal:\n<answer>x</answer>"
    g = parse_generation(F.lit(text))
    empty = parse_generation(F.lit("no step"))
    row = spark.range(1).select(
        format_generation(g["steps"], g["final_tag"]).alias("a"),
        format_generation(empty["steps"], empty["final_tag"]).alias("b"),
    ).first()
    assert row.a == (
        "Reasoning:\nStep 1:\nPremise: a, b c\nAssumption: d\nConclusion: e\n\n"
        "Step 2:\nPremise: \nAssumption: \nConclusion: f\nFinal answer: [x]"
    )
    assert row.b == "Final answer: []"


def test_numbers_beyond_an_int(spark):
    text = "Step 3:\nConclusion: a\nStep 99999999999:\nConclusion: b\nStep 2:\nConclusion: c"
    g = spark.range(1).select(parse_generation(F.lit(text)).alias("g")).first().g
    assert g.step_numbers == [3, 99999999999, 2] and not g.step_order_ok
    assert [tuple(r) for r in g.missing_ranges] == [(1, 1), (4, 99999999998)]
    none = spark.range(1).select(parse_generation(F.lit("Step 1:\nx")).alias("g")).first().g
    assert none.missing_ranges == [] and none.missing_steps == []


def test_exploded_steps_are_worked_out_once(spark):
    texts = spark.range(20).select("id", F.concat(F.lit("Step 1:\nPremises:\n- a"), F.col("id").cast("string"), F.lit("\nConclusion:\nc\n")).alias("text"))
    parsed = texts.select("id", parse_generation(F.col("text")).alias("g"))
    steps = parsed.select("id", F.explode(unfiltered(F.col("g.steps"))).alias("s"))
    assert "Filter (" not in steps._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.s.premises) for r in steps.orderBy("id").collect()] == [(i, [f"a{i}"]) for i in range(20)]


def test_audit_equals_the_whole_reading(spark):
    cases = ["Step 2:\na\nStep 1:\nb\nStep 1:\nc\nFinal:\n<answer>x</answer>", "Step 3:\n\nStep 5:\nz", "", None, "no steps", "Step 99999999999999999999:\na"]
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    for r in frame.select(audit_generation(F.col("t")).alias("a"), parse_generation(F.col("t")).alias("g")).collect():
        whole = r.g and {k: v for k, v in r.g.asDict().items() if k != "steps"}
        assert (r.a and r.a.asDict()) == whole


def test_steps_are_printed_once(spark):
    texts = spark.range(3).select(F.concat(F.lit("Step 1:\nPremises:\n- a"), F.col("id").cast("string"), F.lit("\nConclusion:\nc\n")).alias("text"))
    parsed = texts.select(parse_generation(F.col("text")).alias("g"))
    printed = parsed.select(format_generation(F.col("g.steps"), F.col("g.final_tag")).alias("p"))
    assert printed._jdf.queryExecution().analyzed().toString().count("\nAssumption: ") == 1
    assert printed.first().p.startswith("Reasoning:\nStep 1:\nPremise: a")


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_the_printing_query_works_out_no_audit(spark):
    plan = queries()["format_generation"](spark, str(SF))._jdf.queryExecution().analyzed().toString()
    assert "missing_ranges" not in plan and "duplicate_steps" not in plan


def test_headers_that_come_again_and_steps_alone(spark):
    block = "Step 2:\nAssumption: a\nPremise: b\nAssumptions: c\nPremises: d\nConclusion: e\nPremise\n: f\n"
    cases = [block, block + "Step\n3 :\n-\n- x\nConclusion:\n-\n- \u2002y\n-\nFinal z", "", None]
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    rows = frame.select(parse_generation(F.col("t")).alias("g"), read_steps(F.col("t")).alias("s")).collect()
    assert [tuple(s) for s in rows[0].s] == [(2, ["b", "Assumptions: c", "Premises: d"], ["a"], "e Premise : f")]
    assert [s.n for s in rows[1].s] == [2, 3] and rows[1].s[1].conclusion == "y"
    for row, case in zip(rows, cases):
        assert row.s == (row.g and row.g.steps)
        assert row.s is None or [tuple(s) for s in row.s] == expected_steps(case)


def test_long_steps_do_not_nest(spark):
    text = "Step 1:\nPremises:\n" + "- p\n" * 50_000 + "Conclusion:\n" + "c\n\n" * 50_000
    step = spark.createDataFrame([(text,)], "t string").select(read_steps(F.col("t")).alias("s")).first().s[0]
    assert step.premises == ["p"] * 50_000 and step.conclusion == " ".join(["c"] * 50_000)
