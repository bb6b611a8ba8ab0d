"""Counts against tokenizers that make the tokens."""

import random

import pytest
from tokenizers import Tokenizer, decoders, models

from rungwise.llm.token_counts import MODEL_PATH, SPACE_MARK, Counter, count_tokens, read_vocabulary


def reference(pieces, byte_fallback):
    extra = [("<unk>", 0.0)] + ([(f"<0x{i:02X}>", 0.0) for i in range(256)] if byte_fallback else [])
    return Tokenizer(models.Unigram([*extra, *pieces], unk_id=0, byte_fallback=byte_fallback))


def texts(seed, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("crossing", [True, False])
def test_small_vocabularies(byte_fallback, crossing):
    rng = random.Random(9)
    pieces = [(SPACE_MARK, -3.0)] + [("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), float(-rng.randint(1, 9))) for _ in range(25)]
    pieces += [(SPACE_MARK + "a", -2.0), (SPACE_MARK * 2, -4.0)] + ([("a" + SPACE_MARK + "b", -3.0)] if crossing else [])
    pieces = list(dict(pieces).items())
    counter, made = Counter(pieces, byte_fallback), reference(pieces, byte_fallback)
    assert counter.by_word != crossing
    for text in texts(1, "abcab  cdé😀\n"):
        assert counter.count(text)[0] == len(made.encode(SPACE_MARK + text.replace(" ", SPACE_MARK), add_special_tokens=False).ids), text


def test_public_vocabulary(spark):
    pieces, byte_fallback = read_vocabulary(MODEL_PATH)
    made = reference(pieces, byte_fallback)
    rows = list(enumerate(texts(2, "the and ing ion \n éüß 日本 😀 0123 ,.") + ["w" * 20_000, " ", "a  b   c", "x"]))
    rows += [rows[0], (None, "null id"), (7000, None), (7001, "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens int, best_score string")
    got = sorted(((r.doc_id, r.n_tokens) for r in count_tokens(docs).collect()), key=repr)
    count = lambda t: len(made.encode(SPACE_MARK + t.replace(" ", SPACE_MARK), add_special_tokens=False).ids) if t else 0
    assert got == sorted(((d, count(t)) for d, t in rows), key=repr)
    assert count_tokens(docs.limit(0)).count() == 0
