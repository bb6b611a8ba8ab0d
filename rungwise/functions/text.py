"""Scalar text functions.

Python and Java disagree on what ``\\s``, ``^``, ``$`` and ``.`` mean. All patterns here are
written with an explicit white-space class and the ``(?d)`` flag (only ``\\n`` ends a line), so
that they match what Python's ``re`` matches on ``str``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
# Java asks a class member by member, so few members come first that decide for ASCII.
_OTHER_BLANKS = r"\xa0[[\x{1680}-\x{3000}]&&[\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]]"
_OTHER_BREAKS = r"\x1c\x1d\x1e\x85[[\x{2028}-\x{2029}]]"
_OTHER_SPACES = r"\x1c\x1d\x1e\x1f\x85\xa0[[\x{1680}-\x{3000}]&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
WS = rf"[\s[{_OTHER_SPACES}]]"
INK = rf"[!-~[\S&&[^{_OTHER_SPACES}]]]"
LINE_BLANK = rf"[\t\x1f\x20{_OTHER_BLANKS}]"
IN_LINE = rf"[ -~[[^\n]&&[^\x0b\x0c\r{_OTHER_BREAKS}]]]"

# Patterns of the exchange format.
SPACE_BEFORE_PUNCTUATION = WS + r"+([.,!?;:])"
OTHER_BREAK = r"\r\n?|[\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
ATOM_BREAK = rf"(?dm)(?<=[.!?]){WS}+|[\n\r]+|^{WS}*[-•]{WS}*"
ATOM_EDGE = " -•\t"
FINAL_BLOCK = rf"(?iusdm)\n{WS}*Final{WS}*:{WS}*<answer>.*?</answer>{WS}*$"
ANSWER_TAG_SPACED = rf"(?ius)<{WS}*answer{WS}*>{WS}*(.*?){WS}*<{WS}*/{WS}*answer{WS}*>"
ANSWER_TAG = rf"(?ius)<answer>{WS}*(.*?){WS}*</answer>"
CUSTOM_ID = r"(?d)^(.+?)__rep(\d+)__"

# A line with something in it, less one leading bullet; text that has blanks to close up or to drop.
BULLET_LINE = rf"(?={INK})(?:[-•]{LINE_BLANK}*+)?+((?:{IN_LINE}*{INK})?)"
UNTIDY = rf"[^!-~](?<={WS})(?:[.,!?;:]|{WS}|\z|(?<=\A{WS}))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends (``F.trim`` drops blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    """Strip, and make each run of white space one blank (TXT-3)."""
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), WS + "+", " ")


def canon(c: Column) -> Column:
    """Form under which two texts count as the same (TXT-2)."""
    return F.lower(squeeze(c))


def tidy(c: Column) -> Column:
    """Second half of the strict text form: punctuation closes up, long runs become one blank."""
    closed = F.regexp_replace(strip(c), SPACE_BEFORE_PUNCTUATION, "$1")
    return F.regexp_replace(closed, WS + "{2,}", " ")


def tidy_keep_lines(c: Column) -> Column:
    """Second half of the lenient text form: line breaks stay."""
    unix = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    closed = F.regexp_replace(unix, SPACE_BEFORE_PUNCTUATION, "$1")
    return strip(F.regexp_replace(closed, "[ \t]{2,}", " "))


def tidied(c: Column) -> Column:
    """Strict form of a text. One look tells that nothing would change, as of most texts."""
    return F.when(c.rlike(UNTIDY), tidy(c)).otherwise(c)


def joined_words(words: Column) -> Column:
    """A flat array of strings as one text, not yet in strict form."""
    return F.array_join(F.coalesce(words, F.array().cast("array<string>")), " ")


def words_to_text(words: Column) -> Column:
    """Strict text form of a flat array of strings (TXT-1a)."""
    return let(joined_words(words), tidied)


def _variant_kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _leaf_to_string(v: Column) -> Column:
    kind = _variant_kind(v)
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


_STRING = r'"(?:[^"\\]++|\\.)*+"'
_OPENING = "^(STRING|ARRAY|OBJECT)"


def _depth(v: Column) -> Column:
    """How deep lists and objects nest in a variant; brackets inside of strings do not count."""
    bare = F.regexp_replace(F.to_json(v), _STRING, "")
    none = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def take(state: Column, mark: Column) -> Column:
        open_ = state["open"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(open_.alias("open"), F.greatest(state["most"], open_).alias("most"))

    return F.aggregate(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0)), none, take, lambda state: state["most"])


def _leaves(v: Column, opens: Callable[[Column], Column], unnest: Callable[[Column], Column]) -> Column:
    """Members of ``v``, opened level by level, until none is left that opens.

    There is a round for each level and not for each bracket, so many members cost in proportion.
    """
    return F.aggregate(
        F.sequence(F.lit(0), _depth(v)),
        F.array(v),
        lambda level, _: F.when(F.exists(level, opens), F.flatten(F.transform(level, unnest))).otherwise(level),
    )


def _is_list(v: Column) -> Column:
    return _variant_kind(v).startswith("ARRAY")


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _unnest(v: Column) -> Column:
    return F.when(_is_list(v), _members(v)).otherwise(F.array(v))


def _opens(v: Column) -> Column:
    return _variant_kind(v).rlike("^(ARRAY|OBJECT|VOID)")


def _unnest_open(v: Column) -> Column:
    inner = F.lit(None).cast("variant")
    for key in ("value", "content", "text"):
        child = F.try_variant_get(v, f"$.{key}", "variant")
        inner = F.when(_variant_kind(child).rlike(_OPENING), child).otherwise(inner)

    def opened(kind: Column) -> Column:
        return (
            F.when(kind.startswith("ARRAY"), _members(v))
            .when(kind == "VOID", F.array().cast("array<variant>"))
            .when(kind.startswith("OBJECT"), F.array(F.coalesce(inner, v)))
            .otherwise(F.array(v))
        )

    return let(_variant_kind(v), opened)


def to_text(v: Column) -> Column:
    """Strict text form of a variant holding a string or lists of strings, nested in any depth (TXT-1a).

    Null gives the empty text.
    """
    words = F.transform(_leaves(v, _is_list, _unnest), _leaf_to_string)
    return F.coalesce(tidy(F.array_join(words, " ")), F.lit(""))


def to_text_open(v: Column) -> Column:
    """Lenient text form: objects yield ``text``, ``content`` or ``value``; nulls vanish (TXT-1b).

    Objects and lists are opened in any depth.
    """
    words = F.transform(_leaves(v, _opens, _unnest_open), _leaf_to_string)
    return F.coalesce(tidy_keep_lines(F.array_join(words, " ")), F.lit(""))


def atoms(c: Column) -> Column:
    """Sentences, lines and bullets of one text; the stripped text itself if nothing is left (TXT-4)."""
    parts = F.transform(F.split(c, ATOM_BREAK), lambda p: F.btrim(p, F.lit(ATOM_EDGE)))
    return let(
        F.filter(parts, lambda p: p != ""),
        lambda kept: F.when(F.size(kept) > 0, kept).when(c.isNotNull(), F.array(strip(c))).otherwise(kept),
    )


def atoms_of_list(texts: Column) -> Column:
    """TXT-4 over an array of texts; empty atoms are dropped."""
    return F.filter(F.flatten(F.transform(texts, atoms)), lambda a: a != "")


def lines_of(c: Column) -> Column:
    """Lines of a text, at any kind of line break.

    A split by a single character needs no pattern; one by a pattern compiles it for every row.
    """
    return F.split(F.regexp_replace(c, OTHER_BREAK, "\n"), "\n")


def clean_bullets(block: Column) -> Column:
    """Non-blank lines, stripped, less one leading bullet (TXT-5)."""
    return F.regexp_extract_all(block, F.lit(BULLET_LINE), F.lit(1))


def hypothesis(conclusion: Column) -> Column:
    """Conclusion without its trailing final-answer block and leading dash (TXT-6)."""
    body = strip(F.regexp_replace(F.coalesce(conclusion, F.lit("")), FINAL_BLOCK, ""))
    return F.regexp_replace(body, rf"^{WS}*-{WS}*", "")


def as_list(v: Column) -> Column:
    """Variant to strings: null to none, list to its members, scalar to one (TXT-7)."""
    return F.transform(F.when(v.isNull(), F.array().cast("array<variant>")).otherwise(_own_members(v)), _leaf_to_string)


def _own_members(v: Column) -> Column:
    kind = _variant_kind(v)
    return (
        F.when(kind == "VOID", F.array().cast("array<variant>"))
        .when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        .otherwise(F.array(v))
    )


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null on a miss. The pattern must not match the empty text."""
    return let(
        F.regexp_extract(c, pattern, 0),
        lambda hit: F.when(hit != "", F.regexp_extract(hit, pattern, group)),
    )


def answer_tag(c: Column) -> Column:
    """Content of the first answer tag, blanks allowed in the tag; null on a miss (TXT-8a)."""
    return strip(first_group(c, ANSWER_TAG_SPACED))


def answer_or_empty(c: Column) -> Column:
    """Content of the first answer tag; the empty text on a miss (TXT-8b)."""
    return F.coalesce(strip(first_group(c, ANSWER_TAG)), F.lit(""))


def custom_id_base(c: Column) -> Column:
    """Question id inside a request id, null if the form is not met (TXT-10)."""
    return first_group(c, CUSTOM_ID)


def custom_id_rep(c: Column) -> Column:
    """Replica number inside a request id, null if the form is not met (TXT-10)."""
    return first_group(c, CUSTOM_ID, 2).try_cast("bigint")


def question_key(id_: Column, premise: Column, question: Column) -> Column:
    """Digest under which two questions are the same request (TXT-12)."""
    return F.sha1(F.to_json(F.struct(id_.alias("id"), premise.alias("premise"), question.alias("question"))))


def completion_text(v: Column) -> Column:
    """Reply text of a completion envelope, from the first of three places holding a string (TXT-13)."""

    def string_at(path: str) -> Column:
        found = F.try_variant_get(v, path, "variant")
        return F.when(_variant_kind(found) == "STRING", F.try_variant_get(found, "$", "string"))

    return F.coalesce(
        string_at("$.response.body.choices[0].message.content"),
        string_at("$.body.choices[0].message.content"),
        string_at("$.response.body.choices[0].text"),
    )


def clean_reply(
    c: Column, prefix: str | None = None, numbered_list: bool = False, remove_number: bool = False
) -> Column:
    """Useful part of a model reply (TXT-17)."""
    numbers = rf"\d+\.{WS}*"

    def unnumber(t: Column) -> Column:
        bare = F.regexp_replace(t, numbers, "")
        return strip(F.regexp_replace(bare, OTHER_BREAK, "\n"))

    text = F.element_at(F.split(c, "</think>"), -1)
    fence = r"(?s)```(.*?)```"
    text = F.coalesce(first_group(text, fence), text)

    def finish(t: Column) -> Column:
        out = t
        if numbered_list:
            listed = F.coalesce(F.regexp_substr(t, F.lit(r"(?isd)(\d+\..*?(?:\n|$))+")), t)
            out = unnumber(listed) if remove_number else listed
        if prefix:
            tail = strip(F.substring(t, F.locate(prefix, t) + F.lit(len(prefix)), F.length(t)))
            if numbered_list and remove_number:
                tail = unnumber(tail)
            out = F.when(F.contains(t, F.lit(prefix)), tail).otherwise(out)
        return out

    return let(text, finish)


def numbered_sentences(c: Column, label: str = "", separator: str = ". ") -> Column:
    """One line per sentence, numbered by position before blank ones are dropped (TXT-18)."""
    parts = F.transform(
        F.split(c, rf"[.\n]{WS}*"),
        lambda s, i: F.struct(strip(s).alias("s"), (i + 1).alias("n")),
    )
    kept = F.filter(parts, lambda p: p["s"] != "")
    lines = F.transform(
        kept, lambda p: F.concat(F.lit(label), p["n"].cast("string"), F.lit(separator), p["s"], F.lit("\n"))
    )
    return F.array_join(lines, "")


def explanation_parts(c: Column) -> Column:
    """Steps, assumptions and summary of a written explanation (TXT-19)."""

    def between_colons(items: Column) -> Column:
        return F.transform(items, lambda s: strip(F.element_at(F.split(s, ":"), 2)))

    steps = between_colons(F.regexp_extract_all(c, F.lit(r"(?d)(Step \d+:[^\n]*)(?=\n)"), F.lit(1)))
    assumptions = between_colons(F.regexp_extract_all(c, F.lit(r"(?d)(Assumption:[^\n]*)(?=\n)"), F.lit(1)))
    therefore = F.regexp_substr(c, F.lit(r"(?d)Therefore,.*"))
    return let(
        steps,
        lambda s: F.struct(
            s.alias("steps"),
            assumptions.alias("assumptions"),
            F.coalesce(therefore, F.try_element_at(s, F.lit(-1))).alias("summary"),
        ),
    )


def if_then(step: Column) -> Column:
    """Condition and consequence of an ``IF .. THEN ..`` step, null without ``THEN`` (TXT-20)."""
    parts = F.split(step, "THEN")
    head = strip(F.btrim(F.element_at(parts, 1), F.lit("IF")))
    cut = F.when(head == "", head).otherwise(F.substring(head, F.lit(1), F.length(head) - 1))
    return F.when(
        F.size(parts) > 1,
        F.struct(F.concat(cut, F.lit(".")).alias("condition"), F.element_at(parts, 2).alias("consequence")),
    )
