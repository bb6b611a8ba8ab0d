"""Rank-order profiles against a plain count, and held-out accuracy."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rungwise.llm.language_id import Profiles, UNKNOWN, drop_unidentified, grams, held_out, learn_profiles, letter_codes, predict, ranked
from rungwise.llm.queries import op10_language_id

SF = "/root/testdata/sf0.01"


def plain(text):
    """Most frequent n-grams by a dictionary, as tuples of code points; 1 is the boundary."""
    words, word = [], []
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word.append(ord(c))
        elif word:
            words.append(word)
            word = []
    line = [1] + [c for w in words for c in (*w, 1)]
    if not words:
        return []
    count = Counter((c,) for c in line if c != 1)
    count.update(zip(line, line[1:]))
    count.update(zip(line, line[1:], line[2:]))
    number = lambda g: sum(c << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [number(g) for g, _ in sorted(count.items(), key=lambda x: (-x[1], number(x[0])))]


def test_ranking_equals_plain_count():
    rng = random.Random(2)
    texts = ["", "123 !", "a", "Ünïcode ß ẞ", "日本 語", "a" * 5000] + ["".join(rng.choice("abé -1") for _ in range(200)) for _ in range(30)]
    for text in texts:
        assert ranked(grams(letter_codes(text)), 10_000).tolist() == plain(text)


def test_out_of_place_distance():
    lists = {"x": plain("aa bb aa")[:5], "y": plain("cc dd cc")[:5]}
    own = plain("aa bb")[:5]
    away = {n: sum(abs(lst.index(g) - i) if g in lst else 5 for i, g in enumerate(own)) for n, lst in lists.items()}
    assert Profiles(lists, 5).predict("aa bb") == ("x", 1 - away["x"] / 25)
    assert Profiles(lists, 5).predict("12") == (UNKNOWN, 0.0)
    assert Profiles({}, 5).predict("aa") == (UNKNOWN, 0.0)


def test_rows_and_rejection(spark):
    rows = [(1, "the cat sat", "en", "a", 1), (2, None, "en", "b", 2), (3, "..", "en", "c", 3), (4, "el gato", None, "d", 4), (4, "el gato", None, "d", 4), (None, "the dog", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    left = drop_unidentified(docs)
    assert left.columns == docs.columns
    assert sorted((tuple(r) for r in left.collect()), key=repr) == sorted((r for r in rows if r[0] not in (2, 3)), key=repr)
    none = spark.createDataFrame([], docs.schema)
    assert learn_profiles(none) == {} and predict(none, {}).count() == 0


def test_nothing_in_common_goes_and_nothing_learned_keeps_all(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(9)] + [(20, "αβγ δεζ", None), (21, "the αβγ", None), (22, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in drop_unidentified(docs).collect()) == [*range(9), 21]
    lettered = sorted(r[0] for r in rows if r[0] != 22)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    only_held_out = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.col("lang")))
    for given in (unlabelled, only_held_out):
        left = drop_unidentified(given)
        assert left.columns == docs.columns
        assert sorted(r.doc_id for r in left.collect()) == lettered


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_held_out_accuracy(spark):
    got = op10_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    joined = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.count() == docs.count()
    right, n = joined.agg(F.avg(F.expr("double(lang_pred = lang)")), F.count("*")).first()
    assert n > 200 and right > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0
    assert docs.filter(held_out(F.col("doc_id"))).count() == n
