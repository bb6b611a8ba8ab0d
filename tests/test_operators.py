"""Operators against brute force on small fixtures, ordinary and heavy keys alike."""

import itertools
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungwise.functions import prover as PF
from rungwise.functions.relations import clauses_of
from rungwise.operators import closure, collate, critics, pairs, requests, rewards, rounds
from rungwise.operators.ordering import heavy_keys, rank_in_key, with_index
from rungwise.sources.jsonl import index_lines, read_lines

SOURCE = Path(__file__).resolve().parent.parent / "rungwise"


def test_no_local_checkpoint_and_no_collect():
    for file in SOURCE.rglob("*.py"):
        code = file.read_text()
        for word in ("localCheckpoint", ".collect()", ".toPandas()", "crossJoin"):
            assert word not in code, (file, word)


def skewed(rng, n=400):
    return [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 30)}", i) for i in range(n)]


@pytest.mark.parametrize("heavy_rows", [1_000_000, 5])
def test_rank_in_key(spark, heavy_rows):
    rows = skewed(random.Random(1))
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, at bigint").repartition(7)
    got = rank_in_key(frame, ["k"], ["at"], F.floor(F.col("at") / 16), heavy_rows=heavy_rows).collect()
    want = {}
    for k, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        want.update({(k, at): i + 1 for i, (_, at) in enumerate(group)})
    assert {(r.k, r.at): r["rank"] for r in got} == want
    hot = heavy_keys(frame, ["k"], 100).collect()
    assert [r[0] for r in hot] == ["hot"]


def test_with_index(spark):
    rows = [(i * 3,) for i in range(500)]
    random.Random(3).shuffle(rows)
    got = with_index(spark.createDataFrame(rows, "x bigint").repartition(9), ["x"]).collect()
    assert sorted((r.x, r.idx) for r in got) == [(i * 3, i) for i in range(500)]


def loop_carry(items, per_generation=False):
    out = {}
    for record, generations in items.items():
        bank = None
        for g, steps in enumerate(generations):
            bank = None if per_generation else bank
            last = None
            for s, h in enumerate(steps):
                if last:
                    bank = last
                out[record, g, s] = bank
                last = h or None
    return out


@pytest.mark.parametrize("heavy_rows", [1_000_000, 3])
@pytest.mark.parametrize("per_generation", [False, True])
def test_carry_conclusion(spark, heavy_rows, per_generation):
    rng = random.Random(4)
    items = {
        r: [[rng.choice(["", f"h{rng.random()}"]) for _ in range(rng.randint(1, 4))] for _ in range(rng.choice([1, 3, 200]))]
        for r in range(12)
    }
    rows = [(r, g, s, h) for r, gens in items.items() for g, steps in enumerate(gens) for s, h in enumerate(steps)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "id int, gen_pos int, step_pos int, hypothesis string").repartition(5)
    got = rewards.carry_conclusion(frame, per_generation=per_generation, heavy_rows=heavy_rows).collect()
    assert {(r.id, r.gen_pos, r.step_pos): r.previous_conclusion for r in got} == loop_carry(items, per_generation)


@pytest.mark.parametrize("in_one_row", [100_000, 2])
def test_step_confidence(spark, in_one_row):
    rng = random.Random(5)
    groups = {i: [round(rng.uniform(-9, 0), rng.choice([0, 1, 6])) for _ in range(n)] for i, n in enumerate((1, 3, 4, 5, 6, 50, 333))}
    groups[7] = [-1.0] * 40
    groups[8] = [-1.0] * 9 + [-500.0]
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    frame = spark.createDataFrame(rows, "id int, logprob double").repartition(6)
    got = {r.id: r for r in rewards.step_confidence(frame, ["id"], in_one_row=in_one_row).collect()}
    for k, vs in groups.items():
        values = np.array(vs)
        if len(vs) >= 5:
            values = np.clip(values, np.quantile(values, 0.1), np.quantile(values, 0.9))
        assert got[k].n_tokens == len(vs)
        assert got[k].mean_logprob == pytest.approx(values.mean(), abs=1e-9)
        assert got[k].confidence == pytest.approx(math.tanh(2 * (values.mean() + 3) / (1.5 + 1e-8)), abs=1e-9)
    assert spark.range(1).select(rewards.confidence_of(F.lit(None).cast("double"))).first()[0] == 0.0


@pytest.mark.parametrize("heavy_rows", [1_000_000, 2])
def test_premise_grounding(spark, heavy_rows):
    rng = np.random.default_rng(6)

    def unit():
        v = rng.normal(size=5)
        return [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)]

    base = [(i, p, unit()) for i, n in enumerate((600, 3, 0)) for p in range(n)]
    used = [(i, 0, s, p, unit()) for i in range(3) for s in range(3) for p in range(s)]
    carried = [(i, 0, 2, unit()) for i in (0, 1)]
    steps = [(i, 0, s) for i in range(3) for s in range(3)]
    got = rewards.premise_grounding(
        spark.createDataFrame(steps, "id int, gen_pos int, step_pos int"),
        spark.createDataFrame(used, "id int, gen_pos int, step_pos int, pos int, embedding array<float>"),
        spark.createDataFrame(base, "id int, pos int, embedding array<float>"),
        spark.createDataFrame(carried, "id int, gen_pos int, step_pos int, embedding array<float>"),
        heavy_rows,
    ).collect()
    for row in got:
        scores = []
        for i, _, s, _, v in used:
            if (i, s) == (row.id, row.step_pos):
                bank = [e for j, _, e in base if j == i] + [e for j, _, t, e in carried if (j, t) == (i, s)]
                best = max((float(np.dot(v, e)) for e in bank), default=0.0)
                scores.append(min(1.0, max(0.0, best)))
        assert row.premise_validity == pytest.approx(np.mean(scores) if scores else 1.0, abs=1e-6)


def test_verdicts_and_rewards(spark):
    attempts = [
        (1, [(True, True)]), (2, [(False, False), (True, False), (True, True)]), (3, [(True, False)]),
        (4, [(False, True), (False, False)]), (5, [(False, False)] * 3 + [(True, True)]), (6, [(None, None)]),
    ]
    rows = [(i, n, a, b) for i, flags in attempts for n, (a, b) in enumerate(flags)]
    judged = rewards.verdict_over_attempts(
        spark.createDataFrame(rows, "id int, attempt int, syntactic_ok boolean, semantic_ok boolean"), ["id"]
    )
    stored = F.when(F.col("id") == 3, F.lit(0.25))
    m = rewards.logic_metrics(F.col("proved"), F.col("well_formed"), F.lit(1.5) - F.col("id") / 4, stored)
    got = {r.id: tuple(r.m) for r in judged.select("id", m.alias("m")).collect()}
    assert got == {
        1: (1.0, True, True), 2: (1.0, True, True), 3: (0.25, True, True),
        4: (0.5, False, False), 5: (0.25, False, False), 6: (0.0, False, False),
    }
    tags = [("a", " a "), ("a", "A"), (None, None), ("", "x")]
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(tags)], "i int, t string, g string")
    score = rewards.outcome_score(F.col("t"), F.col("g"))
    loose = rewards.outcome_score(F.col("t"), F.col("g"), missing_match=True)
    got = [tuple(r)[1:] for r in frame.select("i", score.alias("s"), loose.alias("l")).orderBy("i").collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (0.0, 1.0), (0.0, 0.0)]


def test_pairs(spark):
    nan = float("nan")
    groups = {
        "tie_best": [0.9, 0.9, 0.1], "tie_worst": [0.9, 0.1, 0.1], "edge": [0.5, 0.1], "high": [0.9, 0.8],
        "one": [0.9], "zero": [0.9, 0.0], "nan": [0.9, nan, 0.2],
    }
    rows = [(k, i, f"{k}{i}", v) for k, vs in groups.items() for i, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "id string, at int, t string, r double").repartition(5)
    usable = frame.withColumn("r", pairs.usable_reward(F.col("r"))).filter("r is not null")
    got = pairs.within_thresholds(pairs.best_and_worst(usable, "id", "r", ["at"], ["t"])).collect()
    assert {(r.id, r.best.t, r.worst.t) for r in got} == {
        ("tie_best", "tie_best0", "tie_best2"), ("tie_worst", "tie_worst0", "tie_worst1"), ("nan", "nan0", "nan2")
    }


def test_merge_and_dedup(spark):
    rows = [("a", 0, "xx", "q"), ("a", 1, "yy", "qqq"), ("a", 2, "z", "rrr"), ("b", 0, "", "")]
    frame = spark.createDataFrame(rows, "id string, seq int, premise string, question string")
    got = pairs.merge_longest(frame, "id", ["premise", "question"], ["seq"]).collect()
    assert {tuple(r) for r in got} == {("a", "xx", "qqq"), ("b", "", "")}
    same = spark.createDataFrame(
        [("1", "Q", "g", "b", 1), ("1", " q ", "G", "B", 0), ("1", "q", "g", "c", 2)],
        "id string, question string, good_answer string, bad_answer string, src int",
    )
    assert sorted(r.src for r in pairs.dedup_pairs(same, ["src"]).collect()) == [0, 2]
    asked = spark.createDataFrame(
        [("1", "p", "q", "x", 1), ("1", "p", "q", "y", 0), ("1", "p", "r", "z", 2)],
        "id string, premise string, question string, answer string, seq int",
    )
    assert sorted(r.answer for r in requests.dedup_questions(asked, ["seq"]).collect()) == ["y", "z"]


def test_collation(spark):
    rows = [("a", 2, "c", "3", 0), ("a", 0, None, None, 1), ("a", 0, "a", "1", 2), ("a", 0, "late", "9", 3), ("a", 3, "d", "4", 4)]
    frame = spark.createDataFrame(rows, "id string, rep_idx int, text string, answer string, seq int")
    (got,) = collate.collate_replicas(collate.first_replies(frame, ["seq"])).collect()
    assert tuple(got) == ("a", ["a", "c"], ["1", "3"])
    truth = spark.createDataFrame([("a", "old", 0), ("a", "new", 1), ("", "x", 2), (None, "y", 3)], "id string, answer string, seq int")
    assert [tuple(r)[:2] for r in collate.keyed_truth(truth, ["seq"]).collect()] == [("a", "new")]
    left = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, v string")
    done = spark.createDataFrame([("1",), (None,)], "id string")
    assert sorted(r.v for r in collate.skip_processed(left, done).collect()) == ["y", "z"]


def test_unique_ids(spark):
    frame = spark.createDataFrame([("q", 0, 5), ("q", 0, 1), ("q", 1, 2), ("q", 0, 9)], "id string, rep_idx int, seq int")
    got = requests.unique_custom_ids(frame, "m", ["seq"], F.lit(0)).collect()
    assert {(r.seq, r.custom_id) for r in got} == {
        (1, "q__rep0__m"), (5, "q__rep0__m__dup1"), (9, "q__rep0__m__dup2"), (2, "q__rep1__m")
    }


def literal(n):
    return ("!" if n < 0 else "") + f"A{abs(n)}"


def written(n):
    return f"Not(A{-n})" if n < 0 else f"A{n}"


def truth_table(relations):
    atoms = sorted({abs(x) for _, x, y in relations for x in (x, y)})
    models = []
    for values in itertools.product([False, True], repeat=len(atoms)):
        world = dict(zip(atoms, values))

        def holds(n):
            return world[abs(n)] == (n > 0)

        tests = {
            "Implies": lambda x, y: not holds(x) or holds(y),
            "Or": lambda x, y: holds(x) or holds(y),
            "Equivalent": lambda x, y: holds(x) == holds(y),
            "unit": lambda x, y: holds(x),
        }
        if all(tests[kind](x, y) for kind, x, y in relations):
            models.append(world)
    stated = set()
    for kind, x, y in relations:
        if kind == "Implies":
            stated.add(frozenset((-x, y)))
        elif kind == "Or":
            stated.add(frozenset((x, y)))
        elif kind == "unit":
            stated.add(frozenset((x,)))
    literals = [s * a for a in atoms for s in (1, -1)]
    return {
        (literal(x), literal(y))
        for x in literals
        for y in literals
        if x != y
        and frozenset((-x, y)) not in stated
        and all(m[abs(x)] != (x > 0) or m[abs(y)] == (y > 0) for m in models)
    }


def test_derived_implications(spark):
    rng = random.Random(8)
    docs, want = [], {}
    for d in range(150):
        relations = [
            (rng.choice(["Implies", "Implies", "Or", "Equivalent", "unit"]), rng.choice([1, -1]) * rng.randint(1, 5), rng.choice([1, -1]) * rng.randint(1, 5))
            for _ in range(rng.randint(1, 6))
        ]
        relations = [(k, x, x if k == "unit" else y) for k, x, y in relations]
        lines = [written(x) if k == "unit" else f"{k}({written(x)}, {written(y)}) # why" for k, x, y in relations]
        declared = "".join(f"A{i}: fact {i}\n" for i in range(1, 6))
        docs.append((d, f"Logical Propositions:\n{declared}\nLogical Relations:\n" + "\n".join(lines)))
        want[d] = truth_table(relations)
    docs.append((999, "Logical Propositions:\nA1: a\nLogical Relations:\nOr(A1, A1, A1)\nA1"))
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    want = {(d, x, y) for d, ps in want.items() for x, y in ps}
    assert {tuple(r) for r in closure.derived_in_record(frame).collect()} == want
    clauses = closure.stated_clauses(frame)
    assert {tuple(r) for r in closure.derived_implications(clauses).collect()} == want
    assert {tuple(r) for r in closure.derived_implications(clauses, row_clauses=4).collect()} == want
    assert [r.doc_id for r in closure.unsupported_documents(clauses).collect()] == [999]


def test_clauses(spark):
    cases = {
        "Implies(A, Not(B))": [("!A", "!B")],
        "And(Or(A,B), Not(Not(C)))": [("A", "B"), ("C", "C")],
        "Equivalent(A, B)": [("!A", "B"), ("!B", "A")],
        "Not(A)": [("!A", "!A")],
        "Or(A, B, C)": None,
        "Implies(And(A, B), C)": None,
        "A, B": None,
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, e string")
    got = [r.c for r in frame.select("i", clauses_of(F.col("e")).alias("c")).orderBy("i").collect()]
    for expression, found in zip(cases, got):
        want = cases[expression]
        assert (found and sorted(tuple(sorted(c)) for c in found)) == (want and sorted(tuple(sorted(c)) for c in want)), expression


def test_rounds_call_a_hook_once_per_pending_row(spark):
    steps = spark.createDataFrame([(i, i, "a") for i in range(6)], "id int, need int, assumption string")
    calls = spark.sparkContext.accumulator(0)

    def critique(rows, number):
        @F.udf("boolean")
        def ask(need):
            calls.add(1)
            return number >= need

        return rows.withColumn("semantic_ok", ask.asNondeterministic()("need")).withColumn("syntactic_ok", F.lit(True))

    def rewrite(rows, number):
        return rows.withColumn("assumption", F.concat("assumption", F.lit(str(number))))

    out = rounds.refine_rounds(steps, critique, rewrite, rounds=3)
    got = {r.id: (r.assumption, r["round"], r.logic_validity) for r in out.steps.collect()}
    assert got == {0: ("a", 0, 1.0), 1: ("a0", 1, 1.0), 2: ("a01", 2, 1.0), 3: ("a012", 2, 0.0), 4: ("a012", 2, 0.0), 5: ("a012", 2, 0.0)}
    assert out.history.count() == 6 + 5 + 4
    assert calls.value == 6 + 5 + 4


def test_prover_text(spark):
    texts = F.array(F.lit("x"), F.lit("Try this: by (metis explanation_10 explanation_2) (3 ms)"))
    code = "t\nexplanation_2: two\nexplanation_10: ten\nexplanation_3: three\nproof -\n  using explanation_2\nqed"
    row = spark.range(1).select(
        PF.tactic(texts).alias("t"),
        PF.tactic(F.array(F.lit(" by simp (2 ms)"), F.lit("by auto"))).alias("b"),
        PF.tactic(F.array(F.lit("by auto"))).alias("n"),
        PF.cited_axioms(texts).alias("c"),
        PF.unused_axioms(F.lit(code)).alias("u"),
        PF.cited_axiom_text(F.lit(code), F.array(F.lit("explanation_3"), F.lit("explanation_10"))).alias("x"),
    ).first()
    assert (row.t, row.b, row.n) == ("by (metis explanation_10 explanation_2)", "by simp", None)
    assert row.c == ["explanation_2", "explanation_10"] and row.u == ["explanation_3", "explanation_10"]
    assert row.x == "explanation_10: ten\n\nexplanation_3: three"
    # A name is no part of a longer one.
    more = F.lit("explanation_10: ten\nexplanation_1: one\nexplanation_12: twelve")
    names = F.array(F.lit("explanation_1"), F.lit("explanation_10"))
    assert spark.range(1).select(PF.cited_axiom_text(more, names)).first()[0] == "explanation_10: ten\n\nexplanation_1: one"
    body = '{"errors":[{"message":"Inner syntax error","pos":{"line":2}}],"nodes":[{"messages":[{"kind":"writeln","message":"No proof found"}]}]}'
    quiet = '{"nodes":[]}'
    v = [PF.verdict(F.lit(f), PF.parse_body(F.lit(b))).alias(f"v{i}") for i, (f, b) in enumerate([(True, body), (False, body), (True, quiet)])]
    old = PF.verdict(F.lit(True), PF.parse_body(F.lit(quiet)), vacuous=True).alias("old")
    row = spark.range(1).select(*v, old).first()
    assert [tuple(x) for x in row] == [(False, False, False), (False, True, False), (False, True, False), (True, True, True)]


def test_coherence_ignores_what_is_not_finite_in_the_last_step(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0, 0.9, 0.2), ("a", 1, 0.6, 0.1), ("a", 2, nan, 0.0), ("b", 0, inf, 0.0), ("b", 1, 0.5, 0.1), ("b", 2, inf, 0.0)]
    rows += [("c", 0, nan, 0.0), ("c", 1, 0.3, 0.1), ("d", 0, 0.3, 0.1), ("e", 0, inf, 0.0), ("e", 1, 0.0, inf), ("e", 2, 0.1, 0.1)]
    scores = spark.createDataFrame(rows, "doc_id string, step_pos int, entailment double, contradiction double")
    got = {r.doc_id: r.coherence for r in critics.coherence(scores).collect()}
    assert got["a"] == pytest.approx(0.6) and got["b"] == inf and math.isnan(got["c"]) and got["d"] is None and math.isnan(got["e"])


def test_each_rewrite_is_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(text):
        calls.add(1)
        return text + "!"

    rewritten = F.udf(counted)
    steps = spark.createDataFrame([(i, "x") for i in range(4)], "id long, assumption string")
    critique = lambda rows, n: rows.withColumns({"syntactic_ok": F.lit(True), "semantic_ok": F.col("id") < 2})
    refined = rounds.refine_rounds(steps, critique, lambda rows, n: rows.withColumn("assumption", rewritten("assumption")), 3)
    for _ in range(2):
        assert sorted(r.assumption for r in refined.steps.collect()) == ["x", "x", "x!!!", "x!!!"]
    assert calls.value == 6


def test_long_chain_of_implications(spark):
    clauses = spark.createDataFrame([("d", f"!p{i}", f"p{i + 1}", False) for i in range(70)], "doc_id string, a string, b string, single boolean")
    got = closure.derived_implications(clauses)
    assert got.filter("x = 'p0' and y = 'p70'").count() == 1


def test_long_runs_of_not(spark):
    cases = [f"Implies({'Not(' * n}A{')' * n}, B)" for n in (1, 2, 3, 8, 77, 1000)]
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, e string")
    got = [r.c for r in frame.select("i", clauses_of(F.col("e")).alias("c")).orderBy("i").collect()]
    negative, positive = [("A", "B")], [("!A", "B")]
    long = spark.createDataFrame([(f"Or({'Not(' * 16_385}A{')' * 16_385}, Not(Not(B)))",)], "e string")
    assert [tuple(c) for c in long.select(clauses_of(F.col("e")).alias("c")).first().c] == [("!A", "B")]
    assert [[tuple(c) for c in row] for row in got] == [negative, positive, negative, positive, negative, positive]


def test_used_premises_of_one_generation_make_bounded_tiles(spark):
    from rungwise.operators.rewards import BANK_TILE, USED_STEPS, _used_tiles

    rows = [(1, 0, i // 3, i % 3, [1.0]) for i in range(3000)] + [(2, 0, 0, i, [1.0]) for i in range(3 * BANK_TILE)]
    used = spark.createDataFrame(rows, "id long, gen_pos long, step_pos long, pos long, embedding array<double>")
    sizes = {(r.id, r.n) for r in _used_tiles(used).selectExpr("id", "size(used) n").collect()}
    assert {n for i, n in sizes if i == 1} <= set(range(1, 3 * USED_STEPS + 1))
    assert {n for i, n in sizes if i == 2} == {BANK_TILE}


def test_large_cap_moves_no_row_into_one_task(spark):
    rows = [(None if i % 7 == 0 else float(i % 5), i) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y long").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))
    for k in (0, 43, 150, 300, 301):
        got = collate.item_cap(df, k, ["x", "y"], few=0)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want[:k], key=repr)
    plan = collate.item_cap(df, 150, ["x", "y"], few=0)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan


def test_index_in_splits_counts_and_moves_nothing(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"f{k}.txt").write_text("\n".join(f"{k}-{i}" if i % 4 else "" for i in range(50 * k)) + "\n")
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "8"}
    before = {name: spark.conf.get(name) for name in names}
    for name, setting in names.items():
        spark.conf.set(name, setting)
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 8
        indexed = index_lines(lines)
        plan = indexed._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
        want = [f"{k}-{i}" for k in range(6) for i in range(50 * k) if i % 4]
        assert [r.value for r in indexed.orderBy("idx").collect()] == want
        assert [r.idx for r in indexed.orderBy("idx").collect()] == list(range(len(want)))
        shuffled = index_lines(lines.repartition(3))
        assert [r.value for r in shuffled.orderBy("idx").collect()] == want
    finally:
        for name, setting in before.items():
            spark.conf.set(name, setting)


def test_pairs_are_dealt_before_they_are_sorted(spark):
    frame = spark.range(40).select(
        (F.col("id") % 10).alias("id"), F.concat(F.lit("Q  "), (F.col("id") % 10).cast("string")).alias("question"),
        F.lit("Good").alias("good_answer"), F.when(F.col("id") < 20, "bad").otherwise(" BAD ").alias("bad_answer"), F.col("id").alias("src"),
    )
    kept = pairs.dedup_pairs(frame, ["src"])
    assert "REPARTITION_BY_COL" in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.src) for r in kept.collect()) == [(i, i) for i in range(10)]
