"""Reading and writing step-formatted reasoning text, all inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungwise.functions.text import INK, WHITESPACE, WS, answer_tag, clean_bullets, joined_words, let, strip, tidied

# The headers of the step format. They stand at the start of a text or of a line;
# texts get a line break in front, which is quicker to look for than either. Bodies go on from line to line
# until a header comes; their loops give nothing back, so long ones do not nest.
STEP_HEADER = rf"\n(?iu:Step){WS}+(\d+){WS}*:?{WS}*\n"
STEP_BODY = rf"{STEP_HEADER}([^\n]*+(?:(?!{STEP_HEADER})\n[^\n]*+)*+)"
FROM_FINAL = r"(?s)\n(?iu:Final).*\z"
SECTION_WORD = rf"\n{WS}*+(?=([PACpac]))(?iu:Premises?|Assumptions?|Conclusion){WS}*+:"
SECTION_BODY = rf"{SECTION_WORD}([^\n]*+(?:(?!{SECTION_WORD})\n{WS}*+[^\n]*+)*+)"

STEP_TYPE = "struct<n:bigint,premises:array<string>,assumptions:array<string>,conclusion:string>"
GENERATION_TYPE = (
    "struct<final_tag:string,step_order_ok:boolean,step_numbers:array<bigint>,missing_steps:array<bigint>,"
    "missing_ranges:array<struct<first:bigint,last:bigint>>,"
    f"duplicate_steps:array<bigint>,steps:array<{STEP_TYPE}>>"
)


def _after_break(text: Column) -> Column:
    return F.concat(F.lit("\n"), text)


def step_blocks(text: Column, final_after_last_step: bool = False) -> Column:
    """Numbered blocks of a text, in text order, blank ones dropped (GEN-1).

    The last block ends at the first final header of the whole text, which may lie before it and
    then leaves nothing of it. With ``final_after_last_step`` only headers inside it count.
    """

    led = _after_break(text)

    def cut_last(last: Column) -> Column:
        if final_after_last_step:
            return F.regexp_replace(_after_break(last), FROM_FINAL, "")
        room = F.length(last) - F.length(F.regexp_extract(led, FROM_FINAL, 0))
        return F.substring(last, F.lit(1), F.greatest(room, F.lit(0)))

    def blocks(bodies: Column) -> Column:
        numbers = F.regexp_extract_all(led, F.lit(STEP_HEADER), F.lit(1))
        numbered = F.transform(
            numbers,
            lambda n, i: F.struct(
                n.try_cast("bigint").alias("n"),
                F.when(i == F.size(bodies) - 1, cut_last(F.get(bodies, i))).otherwise(F.get(bodies, i)).alias("block"),
            ),
        )
        return F.filter(numbered, lambda b: b["block"].rlike(INK))

    return let(F.regexp_extract_all(led, F.lit(STEP_BODY), F.lit(2)), blocks)


def sections(blocks: Column) -> Column:
    """Steps of an array of numbered blocks: premises, assumptions and conclusion of each (GEN-2).

    Each section runs from the end of its first header to the first header of another one, if that comes later.
    A header that comes again starts nothing. The blocks are taken on together from one form to the next, which
    costs less than forms of one block at a time.
    """

    def find(block: Column) -> Column:
        led = _after_break(block["block"])
        # The sections by the first letters of their headers, in text order.
        letters = F.array_join(F.regexp_extract_all(led, F.lit(SECTION_WORD), F.lit(1)), "")
        return F.struct(
            block["n"].alias("n"),
            led.alias("led"),
            F.translate(letters, "PAC", "pac").alias("order"),
            F.regexp_extract_all(led, F.lit(SECTION_BODY), F.lit(2)).alias("bodies"),
        )

    def place(found: Column) -> Column:
        firsts = [F.instr(found["order"], kind).alias(kind) for kind in "pac"]
        return F.struct(*[found[c].alias(c) for c in ("n", "led", "bodies")], *firsts)

    def lines(found: Column, own: str, *others: str) -> Column:
        at, bodies = found[own], found["bodies"]
        end = F.least(F.size(bodies) + 1, *[F.when(found[o] > at, found[o]) for o in others])
        again = F.regexp_extract_all(found["led"], F.lit(SECTION_BODY), F.lit(0))
        body = F.get(bodies, at - 1)
        whole = F.when(end - at > 1, F.concat(body, F.array_join(F.slice(again, at + 1, end - at - 1), ""))).otherwise(body)
        return F.when(at > 0, clean_bullets(whole)).otherwise(F.array().cast("array<string>"))

    def build(found: Column) -> Column:
        return F.struct(
            found["n"].alias("n"),
            lines(found, "p", "a", "c").alias("premises"),
            lines(found, "a", "p", "c").alias("assumptions"),
            # Lines have no white space at their ends, but some may be empty.
            F.trim(F.array_join(lines(found, "c", "p", "a"), " ")).alias("conclusion"),
        )

    return F.transform(F.transform(F.transform(blocks, find), place), build)


def order_ok(numbers: Column) -> Column:
    """Whether step numbers never fall (GEN-3)."""
    return numbers == F.array_sort(numbers)


def missing_numbers(numbers: Column, max_listed: int = 1_000_000) -> Column:
    """Numbers from 1 to the largest that do not occur (GEN-3).

    One absurd number would ask for an array of that length, so beyond ``max_listed`` the answer
    is null, which no other case gives; ``missing_ranges`` has the full answer whatever the numbers.
    """
    one = F.lit(1).cast("bigint")
    top = F.coalesce(F.array_max(numbers), F.lit(0).cast("bigint"))
    return F.when(top < 1, F.array().cast("array<bigint>")).when(
        top <= max_listed,
        F.array_except(F.sequence(one, F.greatest(F.least(top, F.lit(max_listed).cast("bigint")), one)), numbers),
    )


def missing_ranges(numbers: Column) -> Column:
    """The missing numbers as runs (first, last), at most one run per number that occurs (GEN-3)."""
    counted = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n > 0)))
    gaps = lambda s: F.transform(
        s,
        lambda n, i: F.struct(
            (F.when(i > 0, F.get(s, i - 1)).otherwise(F.lit(0).cast("bigint")) + 1).alias("first"), (n - 1).alias("last")
        ),
    )
    return let(counted, lambda s: F.filter(gaps(s), lambda g: g["first"] <= g["last"]))


def duplicate_numbers(numbers: Column) -> Column:
    """Numbers that occur more than once, sorted (GEN-3)."""
    return let(
        F.array_sort(numbers),
        lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))),
    )


def _audit(text: Column, blocks: Column) -> Column:
    """What the step numbers of the blocks tell, as a struct."""
    return let(
        F.transform(blocks, lambda b: b["n"]),
        lambda ns: F.struct(
            answer_tag(text).alias("final_tag"),
            order_ok(ns).alias("step_order_ok"),
            ns.alias("step_numbers"),
            missing_numbers(ns).alias("missing_steps"),
            missing_ranges(ns).alias("missing_ranges"),
            duplicate_numbers(ns).alias("duplicate_steps"),
        ),
    )


def audit_generation(text: Column, final_after_last_step: bool = False) -> Column:
    """``parse_generation`` without the steps themselves, whose sections need not be read then (GEN-3)."""
    return let(step_blocks(text, final_after_last_step), lambda blocks: _audit(text, blocks))


def _steps(blocks: Column) -> Column:
    placed = F.transform(
        blocks,
        lambda b, i: F.struct(b["n"].alias("n"), i.alias("at"), b["block"].alias("block")),
    )
    return sections(F.sort_array(placed))


def read_steps(text: Column, final_after_last_step: bool = False) -> Column:
    """The steps of ``parse_generation`` alone, for whom their numbers do not matter (GEN-4)."""
    return _steps(step_blocks(text, final_after_last_step))


def unfiltered(items: Column) -> Column:
    """An array to explode that was worked out on the way.

    Spark drops rows without members ahead of an explode. Of a plain column it does so below the step that
    works the array out, and so works it out once more for that filter.
    """
    return F.transform(items, lambda x: x)


def parse_generation(text: Column, final_after_last_step: bool = False) -> Column:
    """Structured form of one reasoning text (GEN-4)."""

    def build(blocks: Column) -> Column:
        return let(_audit(text, blocks), lambda audit: audit.withField("steps", _steps(blocks)))

    return let(step_blocks(text, final_after_last_step), build)


def format_step(position: Column, premise: Column, assumption: Column, conclusion: Column) -> Column:
    """One printed step (part of GEN-5)."""
    return F.concat(
        F.lit("Step "), position.cast("string"), F.lit(":\nPremise: "), premise, F.lit("\nAssumption: "), assumption,
        F.lit("\nConclusion:"), F.rtrim(F.concat(F.lit(" "), conclusion), F.lit(WHITESPACE)),
    )


def format_answer(steps_text: Column, final: Column) -> Column:
    """Printed steps followed by the final answer line (part of GEN-5)."""
    head = F.when(steps_text != "", F.concat(F.lit("Reasoning:\n"), steps_text, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, F.lit("Final answer: ["), strip(F.coalesce(final, F.lit(""))), F.lit("]"))


def format_generation(steps: Column, final: Column) -> Column:
    """Printed form of a structured generation, steps numbered afresh from 1 (GEN-5)."""
    joined_parts = F.transform(
        steps,
        lambda s: F.struct(
            *[joined_words(s[c]).alias(c) for c in ("premises", "assumptions")],
            F.coalesce(s["conclusion"], F.lit("")).alias("conclusion"),
        ),
    )
    printed = F.transform(
        joined_parts,
        lambda s, i: format_step(i + 1, *[tidied(s[c]) for c in ("premises", "assumptions", "conclusion")]),
    )
    joined = F.coalesce(F.array_join(printed, "\n\n"), F.lit(""))
    # Printed once: the answer looks at the text and then writes it. A printed step has no white space at its ends.
    return let(joined, lambda printed_steps: format_answer(printed_steps, final))
