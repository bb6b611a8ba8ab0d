"""Nested relations and forward chaining against truth tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rungwise import session
from rungwise.functions import entail
from rungwise.functions.relations import atoms_of, clauses_of, is_one_clause, minimal, normal_form
from rungwise.operators import closure, horn
from rungwise.session import releasing

RULES = {
    "Not": lambda a: not a,
    "And": lambda *a: all(a),
    "Or": lambda *a: any(a),
    "Implies": lambda a, b: not a or b,
    "Equivalent": lambda *a: len(set(a)) == 1,
}


def worlds(atoms):
    return [dict(zip(atoms, values)) for values in itertools.product([False, True], repeat=len(atoms))]


def holds(expression, world):
    return bool(eval(expression, {**RULES, **world}))  # expressions of this file only


def clause_holds(clause, world):
    return any(world[x.lstrip("!")] != x.startswith("!") for x in clause)


def nested(rng, depth, atoms):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(atoms)
    op = rng.choice(list(RULES))
    n = {"Not": 1, "Implies": 2}.get(op, rng.randint(1, 3))
    return f"{op}({', '.join(nested(rng, depth - 1, atoms) for _ in range(n))})"


def test_normal_form_of_nested_expressions(spark):
    rng = random.Random(4)
    cases = [nested(rng, rng.randint(0, 4), "ABCD") for _ in range(250)]
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, e string").repartition(4)
    for r in frame.select("e", normal_form(F.col("e")).alias("c"), clauses_of(F.col("e")).alias("two")).collect():
        for world in worlds("ABCD"):
            assert holds(r.e, world) == all(clause_holds(c, world) for c in r.c), (r.e, world)
            if r.two is not None:
                assert holds(r.e, world) == all(clause_holds(c, world) for c in r.two), (r.e, world)
        assert all(list(c) == sorted(set(c)) for c in r.c)


def test_what_cannot_be_read_is_null(spark):
    cases = ["", "And()", "And(A,)", "And(A", "A)", "(A)", "Not(A, B)", "Not(Not(A), B)", "Implies(A)", "Implies(A, B, C)", "Foo(A)", "A & B", "And", None]
    frame = spark.createDataFrame([(c,) for c in cases], "e string")
    assert [r.c for r in frame.select(normal_form(F.col("e")).alias("c")).collect()] == [None] * len(cases)


def test_minimal(spark):
    cases = [
        ([["A", "B"], ["!A", "B"], ["!B", "A"]], [["A"], ["B"]]),
        ([["A"], ["A", "B"]], [["A"]]),
        ([["!A", "A"]], []),
        ([["A"], ["!A"]], [[]]),
        ([], []),
    ]
    frame = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<array<string>>")
    got = frame.select("i", minimal(F.col("c")).alias("m")).orderBy("i").collect()
    assert [sorted(map(list, r.m)) for r in got] == [want for _, want in cases]


def literals(relations):
    named = sorted({w for e in relations for w in e.replace("(", " ").replace(")", " ").replace(",", " ").split()} - set(RULES))
    return named, [s + a for a in named for s in ("", "!")]


def by_truth_table(relations):
    atoms, lits = literals(relations)
    all_worlds = worlds(atoms)
    models = [w for w in all_worlds if all(holds(e, w) for e in relations)]

    def follows(x, y, w):
        return not clause_holds([x], w) or clause_holds([y], w)

    stated = {tuple(holds(e, w) for w in all_worlds) for e in relations}
    return {
        (x, y)
        for x in lits
        for y in lits
        if x != y
        and all(follows(x, y, w) for w in models)
        and tuple(follows(x, y, w) for w in all_worlds) not in stated
    }


def horn_relation(rng, atoms):
    def some(n):
        return ", ".join(rng.choice(atoms) for _ in range(n))

    body = some(rng.randint(1, 3))
    return rng.choice(
        [
            f"Implies(And({body}), {some(1)})",
            f"Implies(Or({body}), And({some(2)}))",
            f"Not(And({body}))",
            f"Equivalent({some(1)}, And({body}))",
            f"Or(Not(And({body})), {some(1)})",
            some(1) if rng.random() < 0.4 else f"Implies({some(1)}, Not({some(1)}))",
        ]
    )


def documents(spark, lists):
    declared = "".join(f"{a}: fact\n" for a in "ABCDEF")
    rows = [(d, f"Logical Propositions:\n{declared}Logical Relations:\n" + "\n".join(r)) for d, r in lists]
    return spark.createDataFrame(rows, "doc_id int, text string")


@pytest.mark.parametrize("limits", [{}, {"row_atoms": 3}, {"row_clauses": 2}])
def test_derived_horn(spark, limits):
    rng = random.Random(11)
    lists = [(d, [horn_relation(rng, "ABCDEF"[: rng.randint(2, 6)]) for _ in range(rng.randint(1, 5))]) for d in range(60)]
    want = {(d, x, y) for d, r in lists for x, y in by_truth_table(r)}
    got = [tuple(r) for r in horn.derived_horn(horn.document_relations(documents(spark, lists)), **limits).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_documents_beyond_horn(spark):
    lists = [
        (1, ["Implies(And(A, B), C)", "A", "Implies(A, Unknown)"]),
        (2, ["Or(A, B, C)"]),
        (3, ["Implies(A, B", "A"]),
        (4, ["Or(A, B)", "Implies(A, C)", "Not(Not(Implies(B, C)))"]),
        (5, []),
        (6, ["A", "Not(A)", "B"]),
        (7, ["Or(A, B)", "Or(C, Not(Not(Not(C))))", "And(D, Or(D, Not(Not(E))))"]),
    ]
    relations = horn.document_relations(documents(spark, lists))
    assert sorted(r.doc_id for r in horn.beyond_horn(relations).collect()) == [2, 3, 4, 7]
    want = {(d, x, y) for d in (1, 4, 6, 7) for x, y in by_truth_table([e for e in dict(lists)[d] if "Unknown" not in e])}
    assert {tuple(r) for r in horn.derived_from_relations(relations).collect()} == want
    nothing = documents(spark, lists).withColumn("text", F.lit(None).cast("string"))
    assert horn.derived_horn(horn.document_relations(nothing)).count() == 0
    assert horn.derived_horn(relations.limit(0)).count() == 0


def test_long_chain_with_two_premises(spark):
    n = 9
    atoms = [f"p{i}" for i in range(n)]
    text = "Logical Propositions:\n" + "\n".join(f"{a}: x" for a in atoms) + "\nLogical Relations:\n"
    text += "\n".join(f"Implies(And(p{i}, p{max(i - 1, 0)}), p{i + 1})" for i in range(n - 1))
    frame = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = {(r.x, r.y) for r in horn.derived_horn(horn.document_relations(frame), row_atoms=4).collect()}
    # Only the first rule starts from one premise; every other needs the two atoms before it.
    assert got == {("p0", f"p{j}") for j in range(2, n)} | {(f"!p{j}", "!p0") for j in range(2, n)}


def test_task_helpers_read_as_the_column_functions(spark):
    rng = random.Random(5)
    odd = ["", "And()", "And(A,)", "And(A", "A)", "(A)", "Not(A, B)", "Implies(A)", "Foo(A)", "A & B", "And", "!Not", "Or(A, A, A)", "Equivalent(A, A)"]
    cases = odd + [nested(rng, rng.randint(0, 4), "ABCD") for _ in range(250)]
    frame = spark.createDataFrame([(c,) for c in cases], "e string").repartition(4)
    columns = [normal_form(F.col("e")).alias("c"), clauses_of(F.col("e")).alias("two"), atoms_of(F.col("e")).alias("atoms")]
    for r in frame.select("e", *columns, is_one_clause(F.col("two")).alias("one")).collect():
        clauses, two = entail.clauses_in(r.e), entail.pairs_in(r.e)
        assert (clauses and [list(c) for c in clauses]) == (r.c if clauses is None or r.c else ()), r.e
        assert two == (r.two and tuple((p.a, p.b) for p in r.two)) or (two, r.two) == ((), []), r.e
        assert entail.atoms_in(r.e) == r.atoms
        assert two is None or entail.one_clause(two) == r.one


@pytest.mark.parametrize("row_atoms", [62, 4])
def test_long_chain_stores_one_table(spark, row_atoms):
    n = 40
    text = "Logical Propositions:\n" + "\n".join(f"p{i}: x" for i in range(n)) + "\nLogical Relations:\n"
    text += "\n".join(f"Implies(p{i}, p{i + 1})" for i in reversed(range(n - 1))) + f"\nNot(And(p{n - 1}, p0))"
    frame = spark.createDataFrame([(1, text)], "doc_id int, text string")
    with releasing(spark):
        got = [(r.x, r.y) for r in horn.derived_horn(horn.document_relations(frame), row_atoms=row_atoms).collect()]
        assert len(session._stored.get()) == 1
    assert len(got) == len(set(got))
    # p0 leads to the last atom, which excludes it: p0 is false, the others form the chain.
    chain = {(f"p{i}", f"p{j}") for i in range(1, n) for j in range(i + 2, n)}
    literals_ = [s + f"p{i}" for i in range(n) for s in ("", "!")]
    want = chain | {(f"!{b}", f"!{a}") for a, b in chain} | {("p0", y) for y in literals_} | {(x, "!p0") for x in literals_}
    assert set(got) == want - {("p0", "p0"), ("!p0", "!p0"), ("p0", "p1"), ("!p1", "!p0"), ("p0", f"!p{n - 1}"), (f"p{n - 1}", "!p0")}


def test_clauses_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(i):
        calls.add(1)
        return f"!p{i}"

    clauses = spark.range(20).select(
        (F.col("id") % 4).alias("doc_id"), F.udf(counted)("id").alias("a"), F.concat(F.lit("p"), (F.col("id") + 4).cast("string")).alias("b"), F.lit(False).alias("single")
    )
    got = {tuple(r) for r in closure.derived_implications(clauses).filter("x not like '!%'").collect()}
    assert got == {(d, f"p{d + 4 * i}", f"p{d + 4 * j}") for d in range(4) for i in range(6) for j in range(i + 1, 6)}
    assert calls.value == 20
