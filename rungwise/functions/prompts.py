"""Prompt text: instructions by question family, chat messages, placeholders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungwise.functions.text import strip

# The answer instruction per profile and question family.
ANSWER_INSTRUCTIONS: dict[str, dict[str, str]] = {
    "pairs": {
        "folio": "Is the question A) True; B) False or C) Unknown based on the premises? Answer with exactly one label: A, B, or C.",
        "esnli": "Is the question entailment/contradiction/neutral based on the premises? Answer with exactly one label: entailment, contradiction, or neutral.",
        "multilogieval": "Answer with exactly one label: yes or no.",
        "proofwriter": "Is the question True/False/Unknown based on the premises? Answer with exactly one label: True, False, or Unknown.",
        "prontoqa": "Is the question True/false based on the premises? Answer with exactly one label: True or False.",
        "logiqa": "Is the question entailment/not-entailment based on the premises? Answer with exactly one label: entailment or not-entailment.",
        "proverqa": "Is the question A) True; B) False or C) Unknown based on the premises? Answer with exactly one label: A, B, or C.",
        "qasc": "Answer with exactly one label: A, B, C, D, E, F, G, or H.",
        "ar": "Answer with exactly one label: A, B, C, D, or E.",
    },
    "remote": {
        "folio": "Answer with exactly one label: True, False, or Uncertain.",
        "esnli": "Answer with exactly one label: entailment, contradiction, or neutral.",
        "multilogieval": "Answer with exactly one label: yes or no.",
        "proofwriter": "Answer with exactly one label: True, False, or Unknown.",
        "prontoqa": "Answer with exactly one label: True, False, or Unknown.",
        "logiqa": "Answer with exactly one label: entailment or not-entailment.",
        "proverqa": "Answer with exactly one label: True, False, or Unknown.",
        "qasc": "Answer with the OPTION LETTER ONLY: A, B, C, D, E, F, G, or H.",
    },
    "local": {
        "folio": "Answer with exactly one label: A, B, C.",
        "esnli": "Answer with exactly one label: entailment, contradiction, or neutral.",
        "multilogieval": "Answer with exactly one label: yes or no.",
        "proofwriter": "Answer with exactly one label: True, False, or Unknown.",
        "prontoqa": "Answer with exactly one label: True or False.",
        "logiqa": "Answer with exactly one label: entailment or not-entailment.",
        "proverqa": "Answer with exactly one label: True, False, or Unknown.",
        "qasc": "Answer with the OPTION LETTER ONLY: A, B, C, D, E, F, G, or H.",
        "ar": "Answer with the OPTION LETTER ONLY: A, B, C, D, or E.",
    },
}

# Wordings are content, not operators: pass your own to ``build_messages``.
SYSTEM_TEXT = (
    "Reason from the premises to the question in numbered steps. Give each step its premises, the "
    "assumptions it needs and its conclusion, and end with one final answer."
)
USER_TEMPLATE = "Premise:\n{premise}\n\nQuestion:\n{question}\n"


def answer_instruction(
    id_: Column, profile: str = "pairs", tables: Mapping[str, Mapping[str, str]] | None = None
) -> Column:
    """Instruction for the family an id starts with, empty for unknown families (TXT-9)."""
    table = (tables or ANSWER_INSTRUCTIONS)[profile]
    family = F.lower(F.substring_index(id_, "_", 1))
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), family), F.lit(""))


def fill(template: Column, **values: Column) -> Column:
    """Put values at their ``{name}`` places; unknown places stay as they are (TXT-16).

    One pass over the template: a value that itself holds ``{name}`` is not filled again.
    """
    place = r"\{([^}]+)\}"
    known = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])
    names = F.regexp_extract_all(template, F.lit(place), F.lit(1))
    filled = F.transform(
        names,
        lambda n: F.coalesce(F.try_element_at(known, n), F.concat(F.lit("{"), n, F.lit("}"))),
    )
    pieces = F.split(template, place)
    return F.array_join(
        F.zip_with(pieces, filled, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), ""
    )


def unfilled(text: Column) -> Column:
    """Names of the places still open in a text (lint for TXT-16)."""
    return F.regexp_extract_all(text, F.lit(r"\{([^}]+)\}"), F.lit(1))


def split_roles(text: Column) -> Column:
    """System and user part of a prompt; null unless there is exactly one user mark (TXT-16)."""
    parts = F.split(text, "USER: ")
    return F.when(
        F.size(parts) == 2,
        F.struct(
            F.replace(strip(parts[0]), F.lit("SYSTEM: "), F.lit("")).alias("system"),
            strip(parts[1]).alias("user"),
        ),
    )


def build_messages(
    premise: Column,
    question: Column,
    id_: Column,
    profile: str = "pairs",
    system: str = SYSTEM_TEXT,
    user: str = USER_TEMPLATE,
) -> Column:
    """System and user message of a question, the answer instruction after it (TXT-14)."""
    instruction = answer_instruction(id_, profile)
    asked = F.when(instruction != "", F.concat(question, F.lit("\n\n"), instruction)).otherwise(question)
    head, rest = user.split("{premise}")
    middle, tail = rest.split("{question}")

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(system)),
        message("user", F.concat(F.lit(head), premise, F.lit(middle), asked, F.lit(tail))),
    )


def collapse_messages(messages: Column) -> Column:
    """Flat prompt of a chat, with an open assistant turn at its end (TXT-15)."""
    turns = F.transform(
        messages, lambda m: F.concat(m["role"], F.lit("\n"), strip(m["content"]), F.lit("\n"))
    )
    return F.concat(F.array_join(turns, ""), F.lit("assistant\n"))
