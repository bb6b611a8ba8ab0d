r"""Secret scan with multipart credential linking (native).

Base kinds are searched in every whole text: ``assign`` (a named value), ``access`` (an access
identifier) and ``hex``. They are always reported. Two weak kinds are only candidates: ``token``
(a long run of mixed letters and digits) and ``endpoint`` (scheme and host). Around every span lies
a scope of ``SCOPE_CHARS`` code points. A token counts when an access identifier lies in its scope;
an endpoint counts when an access identifier and a secret (assign or token) do. Tokens that overlap
a base span are that span and not reported again.

Positions come from the gaps between matches: the text split at the pattern gives the gaps, so the
running sum of gaps and matches is the place, in code points. Spans and scopes are joined as
intervals: both are spread over cells of one scope length and joined on document and cell.

Base matches are leftmost and do not overlap within a kind. A run of at least 24 hex digits is
found directly, which is the same as dropping shorter runs, because matches are whole runs; an
access identifier likewise. ``assign`` has to match first and be judged later, because a match that
fails uses up its text.

Defined results: a null text counts as empty. Every row gives one row, repeated rows and null ids
included; rows are told apart by a number of their own that is stored with the first pass. Only the
id and text columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.session import materialize

SCOPE_CHARS = 256

# The base patterns and the order of kinds.
KINDS = ("assign", "access", "hex", "token", "endpoint")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "token": r"[A-Za-z0-9/+]{40,}",
    "endpoint": r"(?:https?|s3|ftp)://[A-Za-z0-9._-]+(?::[0-9]+)?",
}
LEAST_VALUE = 6
_ASSIGN, _ACCESS, _HEX, _TOKEN, _ENDPOINT = range(len(KINDS))


def _counts(kind: str, whole: Column, text: Column) -> Column:
    """Whether each match of a kind holds."""
    if kind == "assign":
        return F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(2)), lambda v: F.char_length(v) >= LEAST_VALUE)
    if kind == "token":
        return F.transform(whole, lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"))
    return F.transform(whole, lambda m: F.lit(True))


def _parts(kind: str, whole: Column, text: Column) -> Column:
    """Gap, length and validity of the matches of one kind, in order."""
    gaps = F.slice(F.transform(F.split(text, PATTERNS[kind], -1), lambda s: F.char_length(s)), 1, F.size(whole))
    lengths = F.transform(whole, lambda m: F.char_length(m))
    zipped = F.zip_with(
        gaps,
        F.arrays_zip(lengths.alias("length"), _counts(kind, whole, text).alias("holds")),
        lambda gap, m: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), gap.alias("gap"), m["length"].alias("length"), m["holds"].alias("holds")
        ),
    )
    return F.when(F.size(whole) > 0, zipped).otherwise(F.array().cast("array<struct<kind:int,gap:int,length:int,holds:boolean>>"))


def _in_scope(left: DataFrame, right: DataFrame, scope: int, how: str) -> DataFrame:
    """Rows of ``left`` with (or without) a span of ``right`` within ``scope`` that does not overlap.

    A scope of 0 asks for overlap instead.
    """
    cell = max(scope, SCOPE_CHARS)
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))
    a = left.withColumn("cell", cells(F.col("start"), F.col("end")))
    b = right.select(
        F.col("row").alias("r"),
        F.col("start").alias("s"),
        F.col("end").alias("e"),
        cells(F.col("start") - scope, F.col("end") + scope).alias("c"),
    )
    apart = (a["end"] <= b["s"]) | (b["e"] <= a["start"])
    near = (b["s"] <= a["end"] + scope) & (b["e"] >= a["start"] - scope)
    found = a.join(b, (a["row"] == b["r"]) & (a["cell"] == b["c"]) & ((apart & near) if scope else ~apart), "left_semi").select(
        "row", "kind", "start", "end"
    ).distinct()
    return found if how == "with" else left.join(found, ["row", "kind", "start", "end"], "left_anti")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE_CHARS) -> tuple[DataFrame, DataFrame]:
    """The document rows (row, doc_id) and the reported spans (row, kind, start, end)."""
    text = F.col("text")
    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    matched = read.select("*", *[F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)).alias(f"m_{k}") for k in KINDS])
    rows = materialize(
        matched.select("row", "doc_id", F.concat(*[_parts(k, F.col(f"m_{k}"), text) for k in KINDS]).alias("parts")), "secret-rows"
    )
    order = Window.partitionBy("row", "kind").orderBy("pos")
    spans = materialize(
        rows.filter(F.size("parts") > 0)
        .select("row", F.posexplode("parts").alias("pos", "part"))
        .select("row", "pos", "part.*")
        .withColumn("end", F.sum(F.col("gap").cast("bigint") + F.col("length")).over(order))
        .filter("holds")
        .select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end"),
        "secret-spans",
    )
    base = spans.filter(F.col("kind") <= _HEX)
    access = spans.filter(F.col("kind") == _ACCESS)
    tokens = _in_scope(spans.filter(F.col("kind") == _TOKEN), base, 0, "without")
    tokens = materialize(_in_scope(tokens, access, scope, "with"), "secret-tokens")
    near_access = _in_scope(spans.filter(F.col("kind") == _ENDPOINT), access, scope, "with")
    endpoints = _in_scope(near_access, spans.filter(F.col("kind") == _ASSIGN).union(tokens), scope, "with")
    return rows.select("row", "doc_id"), base.union(tokens).union(endpoints)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE_CHARS) -> DataFrame:
    """One row per document row: counts of base kinds, digest of the base spans, all spans."""
    rows, spans = find_spans(docs, id_col, text_col, scope)
    name = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda only: F.array_join(
        F.transform(
            F.filter("spans", only),
            lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    # The spans of one document are bounded by its text.
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return (
        rows.join(by_row, "row", "left")
        .withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
        .select(
            "doc_id",
            count(_ASSIGN).alias("n_assign"),
            count(_ACCESS).alias("n_access"),
            count(_HEX).alias("n_hex"),
            F.sha2(listed(lambda s: s["kind"] <= _HEX), 256).alias("base_sha256"),
            listed(lambda s: F.lit(True)).alias("spans"),
        )
    )
