"""Reading proposition and relation lists into two-literal clauses (GEN-6, ITR-2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungwise.functions.text import WS, let, strip

# The section headers of the list format.
SECTION = rf"(?m)^{WS}*Logical (Propositions|Relations):[^\n]*"

CLAUSE_TYPE = "struct<a:string,b:string>"


def relation_sections(text: Column) -> Column:
    """``propositions`` as (key, meaning) and ``relations`` as expressions, in text order (GEN-6)."""
    names = F.regexp_extract_all(text, F.lit(SECTION), F.lit(1))

    def lines_of(bodies: Column, section: str) -> Column:
        chosen = F.zip_with(names, bodies, lambda n, b: F.when(n == section, F.split(b, "\n")))
        return F.filter(
            F.transform(F.flatten(F.filter(chosen, lambda c: c.isNotNull())), strip), lambda s: s != ""
        )

    def build(pieces: Column) -> Column:
        bodies = F.slice(pieces, F.lit(2), F.size(pieces))
        propositions = F.transform(
            F.filter(lines_of(bodies, "Propositions"), lambda s: F.contains(s, F.lit(":"))),
            lambda s: let(
                F.split(s, ":", 2), lambda kv: F.struct(strip(kv[0]).alias("key"), strip(kv[1]).alias("meaning"))
            ),
        )
        relations = F.filter(
            F.transform(lines_of(bodies, "Relations"), lambda s: strip(F.substring_index(s, "#", 1))),
            lambda s: s != "",
        )
        return F.struct(propositions.alias("propositions"), relations.alias("relations"))

    return let(F.split(strip(text), SECTION), build)


def negate(literal: Column) -> Column:
    """Opposite of a literal written ``A`` or ``!A``."""
    return F.when(literal.startswith("!"), F.substring(literal, F.lit(2), F.length(literal))).otherwise(
        F.concat(F.lit("!"), literal)
    )


_LITERAL = r"!?\w+"
_PART = rf"(?:Implies|Or|Equivalent)\({_LITERAL},{_LITERAL}\)|{_LITERAL}"


def compact(expression: Column) -> Column:
    """Expression without blanks, ``Not`` of a literal written out where it is innermost."""
    out = F.regexp_replace(F.regexp_replace(expression, WS + "+", ""), r"Not\((\w+)\)", "!$1")
    return F.regexp_replace(out, r"Not\(!(\w+)\)", "$1")


def clauses_of(expression: Column) -> Column:
    """Clauses of at most two literals that an expression stands for; null if it has others.

    A literal, ``Implies``, ``Or`` and ``Equivalent`` of two literals, and ``And`` of those are read by
    their form; calls within calls go through ``normal_form``. A single literal ``x`` is the clause
    (x or x). One call of three literals counts as beyond two even if some of them are the same.
    """

    def clause(a: Column, b: Column) -> Column:
        return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    def one(part: Column) -> Column:
        literals = F.regexp_extract_all(
            F.regexp_replace(part, r"^(Implies|Or|Equivalent)\(", ""), F.lit(_LITERAL), F.lit(0)
        )

        def build(ls: Column) -> Column:
            a, b = F.get(ls, F.lit(0)), F.get(ls, F.lit(1))
            return (
                F.when(part.startswith("Implies("), F.array(clause(negate(a), b)))
                .when(part.startswith("Or("), F.array(clause(a, b)))
                .when(
                    part.startswith("Equivalent("),
                    F.array(clause(negate(a), b), clause(a, negate(b))),
                )
                .otherwise(F.array(clause(a, a)))
            )

        return let(literals, build)

    def parts_of(e: Column) -> Column:
        inner = F.when(
            e.startswith("And("), F.regexp_replace(e, r"^And\((.*)\)$", "$1")
        ).otherwise(e)
        parts = F.regexp_extract_all(inner, F.lit(_PART), F.lit(0))
        whole = F.array_join(parts, ",") == inner
        return F.when(
            whole & (F.size(parts) > 0) & (e.startswith("And(") | (F.size(parts) == 1)), F.flatten(F.transform(parts, one))
        ).when(e.rlike(r"\(.*\("), as_pairs(normal_form(e), atoms_of(e)))

    return let(compact(expression), parts_of)


def as_pairs(clauses: Column, atoms: Column) -> Column:
    """Clauses of a normal form as literal pairs; null if one has no literal or more than two.

    Atoms that vanish in the normal form stay as (x or not x), in this order.
    """

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    def build(cs: Column) -> Column:
        left = F.array_except(atoms, F.transform(F.flatten(cs), lambda x: F.regexp_replace(x, "^!", "")))
        pairs = F.transform(cs, lambda c: pair(c[0], F.element_at(c, -1)))
        fits = F.forall(cs, lambda c: F.size(c).between(1, 2))
        return F.when(fits, F.concat(pairs, F.transform(left, lambda x: pair(x, negate(x)))))

    return let(clauses, build)


def is_one_clause(clauses: Column) -> Column:
    """Whether a relation's clauses are one, besides those that only keep an atom."""
    return F.size(F.filter(clauses, lambda c: c["b"] != F.concat(F.lit("!"), c["a"]))) == 1


OPERATORS = ("Not", "And", "Or", "Implies", "Equivalent")


def atoms_of(expression: Column) -> Column:
    """Names of the propositions in an expression, each once."""
    words = F.regexp_extract_all(expression, F.lit(r"\w+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*OPERATORS)))


_CNF = "array<array<string>>"
# A call being read: its operator (``Same`` for an even run of ``Not``), the parentheses it has open,
# its arguments so far, and of these the clauses of "all hold", "one holds", "all fail", "one fails".
# Those not wanted are null.
_CALL = f"struct<op:string,open:int,n:int,all:{_CNF},one:{_CNF},none:{_CNF},gap:{_CNF}>"
_READER = f"struct<calls:array<{_CALL}>,operand:boolean,ok:boolean>"
_VALUE = f"struct<pos:{_CNF},neg:{_CNF}>"


def normal_form(expression: Column) -> Column:
    """Clauses (arrays of literals ``A`` or ``!A``) of an expression nested in any way; null if it is none.

    One pass over the tokens with a stack of open calls. A call knows on opening whether its truth, its
    falsehood or both are asked for, so only clauses that are needed are multiplied out. A run of
    ``Not`` is one call. Clauses come out sorted, free of tautologies, reduced by ``minimal``; a
    tautology has none, a contradiction may have the empty clause. Multiplying out can take
    exponentially many clauses for ``Or`` of ``And`` and nested ``Equivalent``. Empty calls, trailing
    commas, unknown operators and infix forms are not read.
    """
    yes = F.array().cast(_CNF)
    no = F.array(F.array().cast("array<string>"))

    def call(op: Column, opened: Column, pos: Column, neg: Column) -> Column:
        flips, same = op == "Not", op == "Equivalent"
        conj, disj = op.isin("And", "Not", "Same"), op.isin("Or", "Implies")
        want = F.struct(
            F.when(flips, neg).otherwise(pos).alias("pos"), F.when(flips, pos).otherwise(neg).alias("neg")
        )
        return let(
            want,
            lambda w: F.struct(
                op.alias("op"),
                opened.alias("open"),
                F.lit(0).alias("n"),
                F.when((conj | same) & w["pos"], yes).alias("all"),
                F.when((disj & w["pos"]) | (same & w["neg"]), no).alias("one"),
                F.when((disj & w["neg"]) | (same & w["pos"]), yes).alias("none"),
                F.when((conj | same) & w["neg"], no).alias("gap"),
            ).cast(_CALL),
        )

    def swapped(top: Column) -> Column:
        """Whether the next argument is the premise of an implication."""
        return (top["op"] == "Implies") & (top["n"] == 0)

    def opening(top: Column, token: Column) -> Column:
        pos = top["all"].isNotNull() | top["one"].isNotNull()
        neg = top["none"].isNotNull() | top["gap"].isNotNull()
        name = F.substring_index(token, "(", 1)
        opened = F.when(name == "Not", F.floor(F.length(token) / 4)).otherwise(1).cast("int")
        op = F.when((name == "Not") & (opened % 2 == 0), "Same").otherwise(name)
        flip = swapped(top)
        return call(op, opened, F.when(flip, neg).otherwise(pos), F.when(flip, pos).otherwise(neg))

    def taken(top: Column, value: Column) -> Column:
        """The call with one more argument."""
        flip = swapped(top)
        given = F.struct(
            F.when(flip, value["neg"]).otherwise(value["pos"]).alias("pos"),
            F.when(flip, value["pos"]).otherwise(value["neg"]).alias("neg"),
        )
        return let(
            given,
            lambda v: F.struct(
                top["op"].alias("op"),
                top["open"].alias("open"),
                (top["n"] + 1).alias("n"),
                F.concat(top["all"], v["pos"]).alias("all"),
                _times(top["one"], v["pos"]).alias("one"),
                F.concat(top["none"], v["neg"]).alias("none"),
                _times(top["gap"], v["neg"]).alias("gap"),
            ).cast(_CALL),
        )

    def value_of(top: Column) -> Column:
        """Truth and falsehood of a call whose parentheses are closed."""
        flips, same, conj = top["op"] == "Not", top["op"] == "Equivalent", top["op"].isin("And", "Not", "Same")
        pos = F.when(same, _times(top["all"], top["none"])).when(conj, top["all"]).otherwise(top["one"])
        neg = F.when(same, F.concat(top["one"], top["gap"])).when(conj, top["gap"]).otherwise(top["none"])
        return F.struct(
            F.when(flips, neg).otherwise(pos).alias("pos"), F.when(flips, pos).otherwise(neg).alias("neg")
        ).cast(_VALUE)

    def state(calls: Column, operand: bool, ok: Column) -> Column:
        return F.struct(calls.alias("calls"), F.lit(operand).alias("operand"), ok.alias("ok")).cast(_READER)

    def rest(calls: Column) -> Column:
        return F.slice(calls, F.lit(1), F.size(calls) - 1)

    def put(calls: Column, value: Column) -> Column:
        return F.concat(rest(calls), F.array(taken(F.element_at(calls, -1), value)))

    def step(held: Column, token: Column) -> Column:
        calls, operand, ok = held["calls"], held["operand"], held["ok"]
        broken = state(calls, True, F.lit(False))

        def on_top(top: Column) -> Column:
            atom = F.struct(F.array(F.array(token)).alias("pos"), F.array(F.array(negate(token))).alias("neg"))
            inside = F.size(calls) > 1
            single = top["op"].isin("Not", "Same")
            full = (
                F.when(top["op"] == "Implies", top["n"] == 2)
                .when(single, top["n"] == 1)
                .otherwise(top["n"] > 0)
            )
            known = F.substring_index(token, "(", 1).isin(*OPERATORS)
            one_less = F.concat(rest(calls), F.array(top.withField("open", top["open"] - 1).cast(_CALL)))
            return (
                F.when(token.endswith("("), F.when(operand & known, state(F.concat(calls, F.array(opening(top, token))), True, ok)).otherwise(broken))
                .when(token == ",", F.when(~operand & inside & ~single, state(calls, True, ok)).otherwise(broken))
                .when(
                    token == ")",
                    F.when(operand | ~inside | ~full, broken)
                    .when(top["open"] > 1, state(one_less, False, ok))
                    .otherwise(state(put(rest(calls), value_of(top)), False, ok)),
                )
                .when(token.rlike(r"^!?\w+$") & operand & ~token.isin(*OPERATORS), state(put(calls, atom), False, ok))
                .otherwise(broken)
            )

        return F.when(~ok, held).otherwise(let(F.element_at(calls, -1), on_top))

    def result(held: Column) -> Column:
        whole = held["ok"] & ~held["operand"] & (F.size(held["calls"]) == 1) & (held["calls"][0]["n"] == 1)
        return F.when(whole, minimal(held["calls"][0]["all"]))

    squeezed = F.regexp_replace(expression, WS + "+", "")
    tokens = F.regexp_extract_all(squeezed, F.lit(r"(?:Not\()+|\w+\(|!?\w+|."), F.lit(0))
    root = call(F.lit("And"), F.lit(1), F.lit(True), F.lit(False))
    return F.aggregate(tokens, state(F.array(root), True, F.lit(True)), step, result)


def _times(some: Column, others: Column) -> Column:
    """Clauses of "one of both": every clause of one joined with every clause of the other."""

    def join(c: Column, d: Column) -> Column:
        return F.array_sort(F.array_union(c, d))

    def build(p: Column, q: Column) -> Column:
        product = F.flatten(F.transform(p, lambda c: F.transform(q, lambda d: join(c, d))))
        return F.array_distinct(F.filter(product, lambda c: ~F.exists(c, lambda x: F.array_contains(c, negate(x)))))

    return F.when(some.isNotNull() & others.isNotNull(), let(others, lambda q: build(some, q)))


def minimal(clauses: Column) -> Column:
    """Equivalent clauses without tautologies, without clauses that hold another, and without literals
    that one resolution takes away."""

    def shorter(cs: Column) -> Column:
        # One literal of a clause a round: two at once may need each other.
        def cut(c: Column) -> Column:
            spare = F.filter(
                c,
                lambda x: F.exists(
                    cs,
                    lambda d: F.array_contains(d, negate(x))
                    & (F.size(F.array_except(F.array_except(d, F.array(negate(x))), F.array_except(c, F.array(x)))) == 0),
                ),
            )
            return let(spare, lambda s: F.when(F.size(s) > 0, F.array_except(c, F.slice(s, 1, 1))).otherwise(c))

        return F.array_distinct(F.transform(cs, cut))

    def reduce(cs: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.size(F.flatten(cs)))
        short = F.aggregate(
            rounds,
            F.struct(cs.alias("now"), F.lit(True).alias("moved")),
            lambda held, _: F.when(
                held["moved"],
                let(shorter(held["now"]), lambda s: F.struct(s.alias("now"), (s != held["now"]).alias("moved"))),
            ).otherwise(held),
            lambda held: held["now"],
        )
        return let(
            short,
            lambda ss: F.filter(ss, lambda c: ~F.exists(ss, lambda d: (d != c) & (F.size(F.array_except(d, c)) == 0))),
        )

    clean = F.array_distinct(F.filter(clauses, lambda c: ~F.exists(c, lambda x: F.array_contains(c, negate(x)))))
    return let(clean, lambda cs: F.when(F.size(cs) > 1, reduce(cs)).otherwise(cs))
