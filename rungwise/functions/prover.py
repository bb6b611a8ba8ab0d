"""Reading a finished prover job: its message tree and the theory text it ran on (PRV-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungwise.functions.text import let, lines_of, strip

BODY_TYPE = (
    "struct<errors:array<struct<message:string,pos:struct<line:int>>>,"
    "nodes:array<struct<messages:array<struct<kind:string,message:string,pos:struct<line:int>>>>>>"
)

# The phrases a prover reports with.
SYNTAX_ERRORS = (
    "Type unification failed",
    "Inner lexical error",
    "Outer syntax error",
    "Inner syntax error",
    "Outer lexical error",
    "Malformed command syntax",
    "Undefined type name",
)
SYNTAX_WARNINGS = ("Introduced fixed type variable",)
NO_PROOF = "No proof found"
TRY_THIS = "Try this:"
EXPLANATION_NAME = r"explanation_\d+"


def _mentions(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return F.coalesce(found, F.lit(False))


def parse_body(body: Column) -> Column:
    """Typed form of a job body."""
    return F.from_json(body, BODY_TYPE)


def messages(parsed: Column) -> Column:
    """All messages of a parsed body in order."""
    nodes = F.transform(
        parsed["nodes"],
        lambda n: F.coalesce(n["messages"], F.array().cast("array<struct<kind:string,message:string,pos:struct<line:int>>>")),
    )
    return F.coalesce(
        F.flatten(nodes),
        F.array().cast("array<struct<kind:string,message:string,pos:struct<line:int>>>"),
    )


def verdict(finished: Column, parsed: Column, vacuous: bool = False) -> Column:
    """Proof, syntax and contradiction verdict of one job (PRV-1).

    Silence is no proof: with no message at all nothing holds, unless ``vacuous`` is set.
    """
    done = F.coalesce(finished, F.lit(False))
    ms = messages(parsed)
    spoken = F.lit(True) if vacuous else F.size(ms) > 0
    silent_on_failure = ~F.exists(
        ms, lambda m: F.contains(F.lower(F.coalesce(m["message"], F.lit(""))), F.lit(NO_PROOF.lower()))
    )
    refused = F.exists(ms, lambda m: F.contains(F.coalesce(m["message"], F.lit("")), F.lit(NO_PROOF)))
    broken = F.exists(ms, lambda m: _mentions(m["message"], SYNTAX_ERRORS))
    probe_broken = F.coalesce(
        F.exists(parsed["errors"], lambda e: _mentions(e["message"], SYNTAX_ERRORS)), F.lit(False)
    ) | F.exists(
        ms, lambda m: (m["kind"] == "warning") & _mentions(m["message"], SYNTAX_WARNINGS)
    )
    return F.struct(
        (done & spoken & ~refused & ~broken).alias("semantic_validity"),
        (~(done & (broken | probe_broken))).alias("syntactic_validity"),
        (done & spoken & silent_on_failure).alias("contradiction"),
    )


def error_positions(parsed: Column) -> Column:
    """Messages that mark bad syntax, with their lines: errors first, then warnings (PRV-2)."""
    empty = F.array().cast("array<struct<line:int,message:string>>")
    errors = F.transform(
        F.filter(parsed["errors"], lambda e: _mentions(e["message"], SYNTAX_ERRORS)),
        lambda e: F.struct(e["pos"]["line"].alias("line"), e["message"].alias("message")),
    )
    warnings = F.transform(
        F.filter(
            messages(parsed),
            lambda m: (m["kind"] == "warning") & _mentions(m["message"], SYNTAX_WARNINGS),
        ),
        lambda m: F.struct(m["pos"]["line"].alias("line"), m["message"].alias("message")),
    )
    return F.concat(F.coalesce(errors, empty), F.coalesce(warnings, empty))


def error_report(positions: Column) -> Column:
    """Numbered error list as text (PRV-2)."""
    return F.array_join(
        F.transform(
            positions,
            lambda p, i: F.concat(
                (i + 1).cast("string"), F.lit(". Error on line "), p["line"].cast("string"),
                F.lit(": "), p["message"],
            ),
        ),
        "\n",
    )


def offending_code(code: Column, positions: Column) -> Column:
    """Theory lines the errors point at (PRV-2).

    An error on an axiom header means the next line, one on a theorem header the next four.
    """

    def lines_at(lines: Column, first: Column, count: int) -> Column:
        return F.transform(
            F.slice(F.transform(lines, strip), first, F.lit(count)), lambda s: F.concat(s, F.lit("\n"))
        )

    def pick(lines: Column, at: Column) -> Column:
        here = F.get(lines, at - 1)
        return (
            F.when(here.isNull(), F.array().cast("array<string>"))
            .when(F.contains(here, F.lit("axiomatization where")), lines_at(lines, at + 1, 1))
            .when(F.contains(here, F.lit("hypothesis")), lines_at(lines, at + 1, 4))
            .otherwise(lines_at(lines, at, 1))
        )

    return let(
        lines_of(code),
        lambda lines: F.array_join(F.flatten(F.transform(positions, lambda p: pick(lines, p["line"]))), ""),
    )


def tactic(texts: Column) -> Column:
    """Proof step offered by the first fitting message of an array of texts, null if none (PRV-3)."""
    offers = F.filter(texts, lambda t: F.contains(t, F.lit(TRY_THIS)))
    by_lines = F.filter(F.transform(texts, strip), lambda t: t.startswith("by"))

    def offered(t: Column) -> Column:
        tail = strip(F.substring(t, F.locate(TRY_THIS, t) + F.lit(len(TRY_THIS)), F.length(t)))
        return F.when(
            F.contains(tail, F.lit("(")), strip(F.regexp_replace(tail, r"(?s)\([^(]*\z", ""))
        ).otherwise(tail)

    return F.when(F.size(offers) > 0, let(F.get(offers, F.lit(0)), offered)).otherwise(
        strip(F.regexp_substr(F.get(by_lines, F.lit(0)), F.lit(r"(?d)\Aby\s*.*?(?=\s*\(\d)")))
    )


def _name_number(name: Column) -> Column:
    return F.substring_index(name, "_", -1).try_cast("bigint")


def cited_axioms(texts: Column) -> Column:
    """Explanations named by proof offers, by number (PRV-4). None if a message reports failure."""
    offers = F.filter(texts, lambda t: F.contains(F.lower(t), F.lit(TRY_THIS.lower())))
    names = F.array_distinct(
        F.flatten(F.transform(offers, lambda t: F.regexp_extract_all(t, F.lit(EXPLANATION_NAME), F.lit(0))))
    )
    ordered = F.transform(
        F.array_sort(F.transform(names, lambda x: F.struct(_name_number(x).alias("n"), x.alias("name")))),
        lambda p: p["name"],
    )
    failed = F.exists(texts, lambda t: F.contains(F.lower(t), F.lit(NO_PROOF.lower())))
    return F.when(failed, F.array().cast("array<string>")).otherwise(ordered)


def cited_axiom_text(code: Column, names: Column) -> Column:
    """Theory lines of the cited explanations, in the order the theory states them (PRV-4).

    A line belongs to the whole names in it: that of ``explanation_10`` is none of ``explanation_1``.
    """

    def find(lines: Column) -> Column:
        found = F.transform(
            names,
            lambda name, i: let(
                F.filter(
                    lines,
                    lambda p: F.array_contains(p["names"], name),
                ),
                lambda hits: F.when(
                    F.size(hits) > 0,
                    F.struct(
                        F.get(hits, F.lit(0))["at"].alias("at"),
                        i.alias("i"),
                        strip(F.element_at(hits, -1)["s"]).alias("s"),
                    ),
                ),
            ),
        )
        kept = F.array_sort(F.filter(found, lambda p: p.isNotNull()))
        return F.array_join(F.transform(kept, lambda p: p["s"]), "\n\n")

    def named(s: Column, at: Column) -> Column:
        names_in = F.regexp_extract_all(s, F.lit(EXPLANATION_NAME), F.lit(0))
        return F.struct(at.alias("at"), s.alias("s"), names_in.alias("names"))

    return let(F.transform(F.split(code, "\n"), named), find)


def unused_axioms(code: Column) -> Column:
    """Explanations a theory states but its proof does not name, by number (PRV-4)."""
    proof = F.coalesce(F.regexp_substr(code, F.lit(r"(?s)proof -.*?qed")), F.lit(""))
    used = F.regexp_extract_all(proof, F.lit(EXPLANATION_NAME), F.lit(0))
    stated = F.array_distinct(F.regexp_extract_all(code, F.lit(EXPLANATION_NAME), F.lit(0)))
    rest = F.transform(
        F.array_except(stated, used), lambda x: F.struct(_name_number(x).alias("n"), x.alias("name"))
    )
    return F.transform(F.array_sort(rest), lambda p: p["name"])
