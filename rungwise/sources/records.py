"""Typed records from JSON lines whose fields vary in name and form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.text import as_list, to_text
from rungwise.sources.jsonl import LINE_ORDER, field, first_field

# Names under which records hold a field, in order of preference.
PREMISE_NAMES = ("premises", "premise", "context")
STEP_PREMISE_NAMES = ("premises", "premise")
STEP_ASSUMPTION_NAMES = ("assumptions", "assumption")
FINAL_NAMES = ("final_tag", "answer")


def _member(v: Column, name: str, type_: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", type_)


def _first_member(v: Column, names: tuple[str, ...]) -> Column:
    """First named field that is there and not empty."""
    options = []
    for name in names:
        value = _member(v, name, "variant")
        options.append(F.when(~F.to_json(value).isin("null", '""', "[]", "{}", "0", "false"), value))
    return F.coalesce(*options)


def _members(v: Column) -> Column:
    return F.coalesce(v, F.array().cast("array<variant>"))


def _step(v: Column, position: Column) -> Column:
    return F.struct(
        F.coalesce(_member(v, "n", "bigint"), position + 1).alias("n"),
        as_list(_first_member(v, STEP_PREMISE_NAMES)).alias("premises"),
        as_list(_first_member(v, STEP_ASSUMPTION_NAMES)).alias("assumptions"),
        _member(v, "conclusion", "string").alias("conclusion"),
        _member(v, "logic_validity", "double").alias("logic_validity"),
        _member(v, "syntactic_validity", "double").alias("syntactic_validity"),
    )


def _generation(v: Column) -> Column:
    final = _first_member(v, FINAL_NAMES)
    return F.struct(
        F.try_variant_get(final, "$", "string").alias("final_tag"),
        F.transform(_members(_member(v, "steps", "array<variant>")), lambda s, i: _step(s, i)).alias("steps"),
        _member(v, "reward", "string").alias("reward"),
    )


def reasoning_records(lines: DataFrame, premise_names: tuple[str, ...] = PREMISE_NAMES) -> DataFrame:
    """``id, premise, premises, question, answer, generations, reward_score`` of parsed lines.

    Lists and plain strings are both taken for premises and assumptions. ``premise`` is one text,
    ``premises`` the list of texts. A record's order columns stay.
    """
    premise = first_field(premise_names)
    return lines.select(
        field("id").alias("id"),
        F.coalesce(to_text(premise), F.lit("")).alias("premise"),
        as_list(premise).alias("premises"),
        to_text(first_field(("question",))).alias("question"),
        field("answer").alias("answer"),
        F.transform(
            _members(field("generations", "array<variant>")), lambda g: _generation(g)
        ).alias("generations"),
        field("reward_score", "array<string>").alias("reward_score"),
        *[c for c in LINE_ORDER if c in lines.columns],
    )
