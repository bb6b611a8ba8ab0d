"""Text functions against Python's own rules and hand-written cases."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from rungwise.functions import prompts as P
from rungwise.functions import text as T

SAMPLES = [
    "",
    "   ",
    "one two.  Three! four?\nfive",
    "a b c\x1cd",
    "- first\n- second\n\n• third\n-",
    "no stop",
    "x .  y , z ;w",
    "tabs\t\tand\r\nbreaks\r\r",
    "emoji \U0001f600. next",
    " - • ",
]


def column(spark, values, *columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [tuple(r)[1:] for r in frame.select("i", *[c.alias(f"o{k}") for k, c in enumerate(columns)]).orderBy("i").collect()]


def test_white_space_is_pythons():
    assert set(T.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_squeeze_canon(spark):
    c = F.col("c")
    for s, (a, b, d) in zip(SAMPLES, column(spark, SAMPLES, T.strip(c), T.squeeze(c), T.canon(c))):
        assert a == s.strip()
        assert b == re.sub(r"\s+", " ", s.strip())
        assert d == b.lower()


def test_atoms(spark):
    sentence = re.compile(r"(?<=[.!?])\s+|[\n\r]+|^\s*[-•]\s*", re.MULTILINE)

    def twin(s):
        kept = [p.strip(" -•\t") for p in sentence.split(s)]
        return [p for p in kept if p] or [s.strip()]

    for s, (got,) in zip(SAMPLES, column(spark, SAMPLES, T.atoms(F.col("c")))):
        assert got == twin(s), s
    row = spark.range(1).select(T.atoms_of_list(F.array(F.lit("a. b"), F.lit("  "))).alias("a")).first()
    assert row.a == ["a.", "b"]


def test_bullets(spark):
    def twin(s):
        lines = [x.strip() for x in s.splitlines() if x.strip()]
        return [re.sub(r"^[-•]\s*", "", x) for x in lines]

    for s, (got,) in zip(SAMPLES, column(spark, SAMPLES, T.clean_bullets(F.col("c")))):
        assert got == twin(s), s


def test_to_text(spark):
    cases = [
        ('"a  b ."', "a b.", "a b."),
        ('[["a"," b"],["c",["d"]]," !"]', "a b c d!", "a b c d!"),
        ('"x\\r\\ny"', "x y", "x\ny"),
        ('{"text":["x",null,{"value":"q"}]}', None, "x q"),
        ("null", "", ""),
        ("[1,true,2.5]", "1 True 2.5", "1 True 2.5"),
    ]
    v = F.try_parse_json("c")
    got = column(spark, [c[0] for c in cases], T.to_text(v), T.to_text_open(v))
    for (source, strict, lenient), (a, b) in zip(cases, got):
        if strict is not None:
            assert a == strict, source
        assert b == lenient, source


def test_answers_and_hypothesis(spark):
    texts = ["a <answer> x\ny </answer> <answer>z</answer>", "< ANSWER >b</ answer >", "none", "<answer></answer>", None]
    got = column(spark, texts, T.answer_tag(F.col("c")), T.answer_or_empty(F.col("c")))
    assert got == [("x\ny", "x\ny"), ("b", ""), (None, ""), ("", ""), (None, "")]
    texts = ["- so\n Final: <answer>a</answer> ", "so\nFinal: x", None, "Final: <answer>a</answer>"]
    assert column(spark, texts, T.hypothesis(F.col("c"))) == [("so",), ("so\nFinal: x",), ("",), ("Final: <answer>a</answer>",)]


def test_custom_ids(spark):
    ids = ["multi_136__rep0__m", "multi_1364__rep12__m__rep3__", "multi_136_rep0_", "__rep0__"]
    got = column(spark, ids, T.custom_id_base(F.col("c")), T.custom_id_rep(F.col("c")))
    assert got == [("multi_136", 0), ("multi_1364", 12), (None, None), (None, None)]


def test_completion_text(spark):
    lines = [
        '{"response":{"body":{"choices":[{"message":{"content":"a"}}]}},"body":{"choices":[{"message":{"content":"b"}}]}}',
        '{"body":{"choices":[{"message":{"content":"b"}}]}}',
        '{"response":{"body":{"choices":[{"text":"c","message":{"content":null}}]}}}',
        '{"response":{"body":{"choices":[]}}}',
        "{}",
    ]
    assert column(spark, lines, T.completion_text(F.try_parse_json("c"))) == [("a",), ("b",), ("c",), (None,), (None,)]


@pytest.mark.parametrize(
    ("reply", "options", "want"),
    [
        ("<think>1. x</think> y", {}, " y"),
        ("a ```b\nc``` d ```e```", {}, "b\nc"),
        ("x sentences: 1. a\n2. b ", {"prefix": "sentences:"}, "1. a\n2. b"),
        ("x sentences: 1. a\n2. b ", {"prefix": "sentences:", "numbered_list": True, "remove_number": True}, "a\nb"),
        ("intro\n1. a\n2. b\nend", {"numbered_list": True}, "1. a\n2. b\n"),
        ("intro\n1. a\n2. b\nend", {"numbered_list": True, "remove_number": True}, "a\nb"),
        ("plain", {"prefix": "absent", "numbered_list": True}, "plain"),
    ],
)
def test_clean_reply(spark, reply, options, want):
    assert column(spark, [reply], T.clean_reply(F.col("c"), **options)) == [(want,)]


def test_explanations(spark):
    written = ["Step 1: IF a b, THEN c: d\nStep 2: e\nAssumption: f\nTherefore, g\nh", "Step 1: last\nStep 2: unended", "none"]
    got = column(spark, written, T.explanation_parts(F.col("c")))
    assert tuple(got[0][0]) == (["IF a b, THEN c", "e"], ["f"], "Therefore, g")
    assert tuple(got[1][0]) == (["last"], [], "last")
    assert tuple(got[2][0]) == ([], [], None)
    steps = ["IF it rains, THEN wet", "no", "IFFI x THEN y THEN z"]
    got = [r and tuple(r) for (r,) in column(spark, steps, T.if_then(F.col("c")))]
    assert got == [("it rains.", " wet"), None, (".", " y ")]


def test_numbered_sentences(spark):
    assert column(spark, ["a.. b\nc."], T.numbered_sentences(F.col("c"))) == [("1. a\n3. b\n4. c\n",)]


def test_prompts(spark):
    ids = ["folio_1", "FOLIO_2", "ar_lsat_2", "unknown_3", "esnli"]
    got = [g for (g,) in column(spark, ids, P.answer_instruction(F.col("c"), "local"))]
    table = P.ANSWER_INSTRUCTIONS["local"]
    assert got == [table["folio"], table["folio"], table["ar"], "", table["esnli"]]
    filled = P.fill(F.col("c"), a=F.lit("{b}"), b=F.lit("x"))
    assert column(spark, ["{a} {b} {c}", "none", "{a}{a"], filled) == [("{b} x {c}",), ("none",), ("{b}{a",)]
    roles = P.split_roles(F.col("c"))
    got = [r and tuple(r) for (r,) in column(spark, ["SYSTEM: s\nUSER: u\n", "USER: a USER: b", "none"], roles)]
    assert got == [("s", "u"), None, None]
    messages = P.build_messages(F.lit("p"), F.lit("q"), F.col("c"), "remote", system="S", user="{premise}|{question}|")
    ((flat,),) = column(spark, ["multilogieval_1"], P.collapse_messages(messages))
    assert flat == "system\nS\nuser\np|q\n\nAnswer with exactly one label: yes or no.|\nassistant\n"


def test_lists_nested_without_bound(spark):
    deep = "[" * 40 + '"a [x], {y}"' + "]" * 39 + ',"b",{"k":["c",1]}]'
    v = F.try_parse_json("c")
    [(strict, lenient)] = column(spark, [deep], T.to_text(v), T.to_text_open(v))
    assert strict == 'a [x], {y} b {"k":["c",1]}'
    assert lenient.startswith("a [x], {y} b")


def test_objects_and_lists_take_turns_in_any_depth(spark):
    chat = '[{"content":[{"text":{"value":"x"}}]}]'
    deep = '[{"content":' * 30 + '[null, "y", {"other": 1}]' + "}]" * 30
    wide = "[" + ",".join(['{"text":"a"}'] * 2000) + "]"
    got = column(spark, [chat, deep, wide, "null", "[]", None], T.to_text_open(F.try_parse_json("c")))
    assert got == [("x",), ('y {"other":1}',), (" ".join(["a"] * 2000),), ("",), ("",), ("",)]


def test_many_members_and_brackets_in_strings(spark):
    strict = [[f"w{i} [x", [f'y"]{i}']] if i % 3 else f"z{i}" for i in range(30_000)]
    lenient = [{"text": {"value": [f"w{i}", f"]y{i}", None]}} if i % 3 else {"other": [i]} for i in range(30_000)]
    df = spark.createDataFrame([(json.dumps(strict), json.dumps(lenient))], "a string, b string")
    started = time.monotonic()
    (row,) = df.select(T.to_text(F.parse_json("a")).alias("a"), T.to_text_open(F.parse_json("b")).alias("b")).collect()
    assert time.monotonic() - started < 20  # a cost that grows with the square takes minutes
    assert row.a == " ".join(f'w{i} [x y"]{i}' if i % 3 else f"z{i}" for i in range(30_000))
    assert row.b == " ".join(f"w{i} ]y{i}" if i % 3 else f'{{"other":[{i}]}}' for i in range(30_000))


def test_classes_of_characters(spark):
    breaks = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + ["\U0001f600", "\U0010ffff"]
    classes = [T.WS, T.INK, T.LINE_BLANK, T.IN_LINE, "(?iu)" + T.WS]
    got = column(spark, chars, *[F.col("c").rlike(rf"\A(?:{k})\z") for k in classes])
    for c, row in zip(chars, got):
        space, line_end = c.isspace(), c in breaks
        assert tuple(row) == (space, not space, space and not line_end, not line_end, space), repr(c)


def test_words_close_up_like_the_plain_form(spark):
    cases = ["a b", " a", "a ", "a  b", "a .", "a\tb", "a\u00a0", "\u3000a", "a\n!b", "", " ", "a\x85;", "\u00e9 b", "a\u2028\u2029b"]
    c = F.col("c")
    for case, row in zip(cases, column(spark, cases, T.words_to_text(F.array(c)), T.tidy(c))):
        assert row[0] == row[1], repr(case)
