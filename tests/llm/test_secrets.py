"""Secret spans against a plain search."""

import hashlib
import random
import re

from rungwise.llm.secrets import KINDS, SCOPE_CHARS, scan_secrets

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SCHEMA = "doc_id long, text string, spans string, row int, kind string"


def brute(text):
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]

    def near(a, b):
        return (a[2] <= b[1] or b[2] <= a[1]) and b[1] <= a[2] + SCOPE_CHARS and b[2] >= a[1] - SCOPE_CHARS

    access = [s for s in base if s[0] == "access"]
    tokens = [("token", m.start(), m.end()) for m in re.finditer("[A-Za-z0-9/+]+", text) if len(m[0]) >= 40 and all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    tokens = [t for t in tokens if all(t[2] <= b[1] or b[2] <= t[1] for b in base) and any(near(t, a) for a in access)]
    ends = [("endpoint", m.start(), m.end()) for m in re.finditer(r"(?:https?|s3|ftp)://[A-Za-z0-9._-]+(?::[0-9]+)?", text)]
    secret = tokens + [s for s in base if s[0] == "assign"]
    ends = [e for e in ends if any(near(e, a) for a in access) and any(near(e, s) for s in secret)]
    order = lambda s: (s[1], KINDS.index(s[0]))
    say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=order))
    count = lambda k: sum(s[0] == k for s in base)
    return (*map(count, KINDS[:3]), hashlib.sha256(say(base).encode()).hexdigest(), say(base + tokens + ends))


def made():
    rng = random.Random(11)
    token = lambda n: "".join(rng.choice("abcXYZ019/+") for _ in range(n))
    pieces = [
        lambda: "AKIA" + "".join(rng.choice("ABZ059") for _ in range(rng.choice([3, 15, 16, 17, 30]))),
        lambda: rng.choice(["Password", "secret", "TOKEN", "api_key", "ApiKey", "passwd"]) + rng.choice(['" : "', "=", "' = '", ":", " "]) + token(rng.choice([2, 5, 6, 12, 45])),
        lambda: "token=token: " + token(9),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([5, 23, 24, 40]))),
        lambda: token(rng.choice([39, 40, 60])),
        lambda: rng.choice(["https://", "s3://", "http://"]) + "host.example.com" + rng.choice(["", ":8080", "/path/x"]),
        lambda: "é😀 " * rng.choice([1, 20, 90]),
        lambda: "plain words here " * rng.choice([1, 5, 30]),
    ]
    texts = ["".join(rng.choice(pieces)() + rng.choice([" ", "\n", "", "'"]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    texts += ["", "ſecret=abcdefgh", "toKen=abcdefgh", "AKIA", "f" * 5000, "AKIAAKIA" + "A" * 12 + " " + "aB3" * 14]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[4]), (None, None)]


def test_spans_equal_plain_search(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in scan_secrets(docs).collect()), key=repr)
    want = sorted(((d, *brute(t)) for d, t in rows), key=repr)
    assert got == want
    assert any("token:" in w[-1] for w in want) and any("endpoint:" in w[-1] for w in want)


def test_empty_table(spark):
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
