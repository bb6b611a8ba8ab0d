"""The pipeline against plain versions of its stages, and the guard of the registry."""

import hashlib
import math
import random
from collections import Counter

from test_language_id import plain
from test_mixing_packing import plain_fit
from test_near_dedup import brute as near_brute

import corpus_pipeline
from __spark_entry__ import queries
from rungwise.llm.language_id import Profiles, UNKNOWN
from rungwise.llm.mixing import SEED, poisson_table
from rungwise.llm.packing import CAPACITY

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = random.Random(4)
    words = {"en": ["the", "of", "thing", "with", "near"], "fr": ["le", "eau", "dans", "être", "que"]}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "fr"])
        text = " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(rng.randint(20, 90)))
        if rows and rng.random() < 0.5:
            text = rng.choice(rows)[1]
            if rng.random() < 0.5:
                text += " tail" + str(i)
        if i % 40 == 3:
            text = rng.choice(["", "12 34", "long " * 4000])
        rows.append((i, text, lang, rng.choice(["a", "a", "a", "b", "c"]), len(text)))
    return rows + [(900, None, "en", "a", None), rows[7], (None, "only the null id", None, None, None)]


def plain_pipeline(rows):
    profiles = {}
    for lang in ("en", "fr"):
        count = Counter()
        for d, t, label, *_ in rows:
            if label == lang and t and __import__("zlib").crc32(str(d).encode()) % 3 != 1:
                count.update(Profiles_counts(t))
        profiles[lang] = [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))][:300]
    rows = [r for r in rows if Profiles(profiles).predict(r[1])[0] != UNKNOWN]
    by_text = {}
    for r in rows:
        held = by_text.get(r[1])
        if held is None or (r[0] is not None and (held[0] is None or r[0] > held[0])):
            by_text[r[1]] = r
    rows = list(by_text.values())
    near = {(d, c): k for d, _, c, k in near_brute([(r[0], r[1]) for r in rows], width=5)}
    rows = [r for r in rows if r[0] is None or any(k for (d, _), k in near.items() if d == r[0])]
    amounts = Counter(r[3] for r in rows)
    shares = sum(math.sqrt(n) for n in amounts.values())
    mixed = []
    for r in rows:
        n = amounts[r[3]]
        rate = math.sqrt(n) / shares * len(rows) / n
        key = f"{SEED}:{'' if r[0] is None else r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        first, steps = poisson_table(rate)
        mixed += [r] * (first + sum(s <= u for s in steps))
    text_key = lambda t: hashlib.md5(t.encode()).hexdigest()
    items = sorted(mixed, key=lambda r: (-(len(r[1]) % CAPACITY), -len(r[1]), r[0] is None, r[0] or 0, text_key(r[1])))
    chosen, left = plain_fit([(len(r[1]) % CAPACITY, r[3], text_key(r[1])) for r in items], CAPACITY)
    placed = [(r[0], len(r[1]) // CAPACITY, len(r[1]) % CAPACITY, left[b]) for r, b in zip(items, chosen)]
    placed += [(r[0], k, CAPACITY, 0) for r in items for k in range(len(r[1]) // CAPACITY)]
    return placed


def Profiles_counts(text):
    """n-gram counts of a text from the plain ranking's own tally."""
    codes, line = [], [1]
    for c in text.lower() + " ":
        if c.isalpha():
            codes.append(ord(c))
        elif codes:
            line += [*codes, 1]
            codes = []
    count = Counter(c for c in line if c != 1)
    count.update((a << 21) | b for a, b in zip(line, line[1:]))
    count.update((((a << 21) | b) << 21) | c for a, b, c in zip(line, line[1:], line[2:]))
    assert set(count) == set(plain(text))
    return count


def test_pipeline_equals_plain_version(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    flat = sorted(((r.doc_id, r.chunk, r.length, r.bin_left) for r in got), key=repr)
    assert flat == sorted(plain_pipeline(rows), key=repr)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(made(), COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    numbers = {name.split("_")[0] for name in queries() if name.startswith("op")}
    assert numbers >= {f"op{n}" for n in (1, 4, 5, 6, 7, 10)} and "pipeline" in queries()
