"""Implications that follow from the relations stated in a document (ITR-2)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.entail import Remembered, atoms_in, coded_lists, one_clause, paired, pairs_in, two_literal_pairs
from rungwise.functions.relations import negate, relation_sections
from rungwise.operators.ordering import heavy_keys, mark_heavy
from rungwise.session import materialize


class _Read:
    """What a task needs of one expression: its atoms, its clauses as pairs of literals, whether they are one."""

    def __init__(self, expression: str):
        self.expression, self.atoms, self.pairs = expression, atoms_in(expression), pairs_in(expression)
        self.single = None if self.pairs is None else one_clause(self.pairs)


def _listed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc_id``, the ``declared`` names and the ``relations`` of each text."""
    return docs.select(F.col(doc).alias("doc_id"), relation_sections(F.col(text)).alias("_s")).select(
        "doc_id", F.transform("_s.propositions", lambda p: p["key"]).alias("declared"), F.col("_s.relations").alias("relations")
    )


def _relations_of(batch: pa.RecordBatch, read: Remembered) -> Iterator[list[tuple[int, _Read]]]:
    """Relations of each text by place, those naming an undeclared proposition left out."""
    declared, names = coded_lists(batch["declared"])
    rows, expressions = coded_lists(batch["relations"])
    found = [read[e] for e in expressions]
    known: dict[tuple, set[str]] = {}
    for keys, row in zip(map(tuple, declared), rows):
        if keys not in known:
            known[keys] = {names[k] for k in keys}
        yield [(at, found[i]) for at, i in enumerate(row) if known[keys].issuperset(found[i].atoms)]


def stated_clauses(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per clause: ``doc_id, rel_pos, expression, a, b, single``.

    ``single`` tells whether the relation is this one clause. Relations beyond two literals give
    one row with null literals. Relations naming an undeclared proposition are dropped.
    """
    listed = _listed(docs, doc, text)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Remembered(_Read)
        for batch in batches:
            at, rows = [], []
            for row, relations in enumerate(_relations_of(batch, read)):
                for place, r in relations:
                    for a, b in ((None, None),) if r.pairs is None else r.pairs or ((None, None),):
                        at.append(row)
                        rows.append((place, r.expression, a, b, r.single))
            places, expressions, firsts, seconds, single = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(places, pa.int32()), pa.array(expressions, pa.string()),
                    pa.array(firsts, pa.string()), pa.array(seconds, pa.string()), pa.array(single, pa.bool_()),
                ],
                names=["doc_id", "rel_pos", "expression", "a", "b", "single"],
            )

    doc_type = listed.schema["doc_id"].dataType.simpleString()
    return listed.mapInArrow(make, f"doc_id {doc_type}, rel_pos int, expression string, a string, b string, single boolean")


def unsupported_documents(clauses: DataFrame) -> DataFrame:
    """Documents with a relation beyond two literals; nothing is derived for them."""
    return clauses.filter(F.col("a").isNull()).select("doc_id").distinct()


def _atom(literal: Column) -> Column:
    return F.regexp_replace(literal, "^!", "")


def derived_in_record(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, x, y`` for documents that each fit a row, without a shuffle.

    The relations of one text are few, so a task closes each over its literals; expressions that come
    again are read once a task.
    """
    listed = _listed(docs, doc, text)

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Remembered(_Read)
        for batch in batches:
            found = _Pairs(batch["doc_id"])
            for row, relations in enumerate(_relations_of(batch, read)):
                if all(r.pairs is not None for _, r in relations):
                    clauses = [(a, b, r.single) for _, r in relations for a, b in r.pairs]
                    yield from found.add(row, clauses)
            yield found.batch()

    doc_type = listed.schema["doc_id"].dataType.simpleString()
    return listed.mapInArrow(close, f"doc_id {doc_type}, x string, y string")


class _Pairs:
    """Pairs found for the documents of a batch."""

    def __init__(self, doc_ids: pa.Array):
        self.doc_ids, self.codes = doc_ids, {}
        self.at, self.x, self.y = [], [], []

    def add(self, row: int, clauses: Sequence[tuple[str, str, bool]]) -> Iterator[pa.RecordBatch]:
        """Pairs that follow from clauses of one document; a batch of them where they are many."""
        local: dict[str, int] = {}

        def code(literal: str) -> int:
            minus = literal.startswith("!")
            return 2 * local.setdefault(literal[1:] if minus else literal, len(local)) + minus

        numbered, stated = [], set()
        for a, b, single in clauses:
            pair = (code(a), code(b))
            numbered.append(pair)
            if single:
                stated.add((min(pair), max(pair)))
        own = [self.codes.setdefault(sign + name, len(self.codes)) for name in local for sign in ("", "!")]
        for x, y in two_literal_pairs(len(local), numbered, stated):
            self.at.append(row)
            self.x.append(own[x])
            self.y.append(own[y])
        if len(self.at) >= 1 << 20:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        made = paired(self.doc_ids, self.at, self.x, self.y, list(self.codes))
        self.at, self.x, self.y = [], [], []
        return made


#: Closing a document in its row takes the square of its literals, each time a set of them.
ROW_CLAUSES = 32


def derived_implications(clauses: DataFrame, row_clauses: int = ROW_CLAUSES) -> DataFrame:
    """All literal pairs ``x -> y`` a document entails and no single relation of it states.

    ``clauses(doc_id, a, b, single)``. Documents of at most ``row_clauses`` clauses are gathered into
    a row each and closed there; the others go through rounds of joins.
    """
    # Stored before the documents are counted, so that the clauses are worked out once.
    stored = materialize(clauses.select("doc_id", "a", "b", "single"), "clauses")
    large = materialize(heavy_keys(stored, ["doc_id"], row_clauses), "heavy-docs")
    tagged = mark_heavy(stored, ["doc_id"], large)
    gathered = (
        tagged.filter("not _heavy")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("a", "b", F.coalesce("single", F.lit(False)).alias("single"))).alias("_c"), F.bool_and(F.col("a").isNotNull()).alias("readable"))
        .filter("readable")
        .select("doc_id", F.col("_c.a").alias("a"), F.col("_c.b").alias("b"), F.col("_c.single").alias("single"))
    )

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, a_names = coded_lists(batch["a"])
            seconds, b_names = coded_lists(batch["b"])
            single, flags = coded_lists(batch["single"])
            found = _Pairs(batch["doc_id"])
            for row, (a, b, s) in enumerate(zip(firsts, seconds, single)):
                yield from found.add(row, [(a_names[i], b_names[j], flags[k]) for i, j, k in zip(a, b, s)])
            yield found.batch()

    doc_type = gathered.schema["doc_id"].dataType.simpleString()
    light = gathered.mapInArrow(close, f"doc_id {doc_type}, x string, y string")
    if large.isEmpty():
        return light
    return light.unionByName(_derived_by_rounds(materialize(tagged.filter("_heavy").drop("_heavy"), "heavy-clauses")))


def _derived_by_rounds(stored: DataFrame) -> DataFrame:
    """``derived_implications`` by joins alone.

    Each round joins the pairs that the round before found with all known ones, on either side, so
    chains double and the rounds grow with the logarithm of the longest. Rows are keyed by (document,
    literal) throughout; each round is stored, and the loop ends when one finds nothing.
    """
    supported = stored.join(unsupported_documents(stored), "doc_id", "left_anti")
    edges = materialize(
        supported.select("doc_id", negate(F.col("a")).alias("x"), F.col("b").alias("y"))
        .unionByName(supported.select("doc_id", negate(F.col("b")).alias("x"), F.col("a").alias("y")))
        .distinct(),
        "edges",
    )
    reach, found = edges, edges
    while not found.isEmpty():
        joined = [
            left.join(right.select("doc_id", F.col("x").alias("y"), F.col("y").alias("z")), ["doc_id", "y"]).select(
                "doc_id", "x", F.col("z").alias("y")
            )
            for left, right in ((found, reach), (reach, found))
        ]
        longer = joined[0].unionByName(joined[1]).join(reach, ["doc_id", "x", "y"], "left_anti").distinct()
        found = materialize(longer, "reach")
        reach = reach.unionByName(found)

    # x -> not x makes x false for good; a document where that holds for x and not x has no model.
    never = reach.filter(F.col("y") == negate(F.col("x"))).select("doc_id", F.col("x").alias("lit"))
    no_model = (
        never.join(never.select("doc_id", negate(F.col("lit")).alias("lit")), ["doc_id", "lit"], "left_semi")
        .select("doc_id")
        .distinct()
    )
    atoms = (
        edges.select("doc_id", _atom(F.col("x")).alias("atom"))
        .unionByName(edges.select("doc_id", _atom(F.col("y")).alias("atom")))
        .distinct()
    )
    literals = atoms.select(
        "doc_id", F.explode(F.array(F.col("atom"), F.concat(F.lit("!"), F.col("atom")))).alias("lit")
    )
    other = literals.select("doc_id", F.col("lit").alias("other"))
    from_false = never.join(other, "doc_id").select("doc_id", F.col("lit").alias("x"), F.col("other").alias("y"))
    to_true = never.join(other, "doc_id").select(
        "doc_id", F.col("other").alias("x"), negate(F.col("lit")).alias("y")
    )
    anything = (
        literals.join(no_model, "doc_id")
        .join(other, "doc_id")
        .select("doc_id", F.col("lit").alias("x"), F.col("other").alias("y"))
    )
    entailed = (
        reach.unionByName(from_false).unionByName(to_true).unionByName(anything)
        .filter(F.col("x") != F.col("y"))
        .distinct()
    )
    stated = supported.filter("single").select("doc_id", F.col("a").alias("_a"), F.col("b").alias("_b")).distinct()
    as_clause = entailed.withColumn("_a", F.least(negate(F.col("x")), F.col("y"))).withColumn(
        "_b", F.greatest(negate(F.col("x")), F.col("y"))
    )
    return as_clause.join(stated, ["doc_id", "_a", "_b"], "left_anti").select("doc_id", "x", "y")
