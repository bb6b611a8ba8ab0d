"""Implications that follow from relations with several premises (ITR-2, GEN-6).

A document is read when all clauses of its relations are Horn, that is have at most one literal that
is not negated: facts, rules from premises to one conclusion, and sets of atoms that exclude each
other. Then ``x -> y`` follows exactly when forward chaining from what it assumes reaches what it
concludes or a contradiction, so no search over truth values is needed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from rungwise.functions.entail import Remembered, atoms_in, clauses_in, coded_lists, horn_pairs, paired
from rungwise.functions.relations import CLAUSE_TYPE, as_pairs, is_one_clause, relation_sections
from rungwise.functions.text import let
from rungwise.operators.closure import derived_implications
from rungwise.session import materialize

#: A document with more atoms or clauses is dealt over several tasks.
ROW_ATOMS = 62
ROW_CLAUSES = 64
#: What one task assumes at once for a document: so many atoms and pairs of atoms, with at least one atom.
STARTS = 1 << 16

RELATIONS_TYPE = "array<struct<expression:string,atoms:array<string>,clauses:array<array<string>>>>"


def document_relations(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, relations``: each relation as ``expression``, its ``atoms``, its ``clauses`` in normal form.

    Relations naming an undeclared proposition are left out; one that cannot be read has null clauses.
    A null text has null relations. A task reads an expression that comes again only once.
    """
    listed = docs.select(F.col(doc).alias("doc_id"), relation_sections(F.col(text)).alias("_s")).select(
        "doc_id", F.transform("_s.propositions", lambda p: p["key"]).alias("declared"), F.col("_s.relations").alias("relations")
    )
    doc_type = listed.schema["doc_id"].dataType.simpleString()
    element = DataType.fromDDL(RELATIONS_TYPE).elementType

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = to_arrow_type(element)
        one = Remembered(lambda e: {"expression": e, "atoms": atoms_in(e), "clauses": clauses_in(e)})
        for batch in batches:
            declared, names = coded_lists(batch["declared"])
            rows, expressions = coded_lists(batch["relations"])
            found = [one[e] for e in expressions]
            forms = pa.array(found, form)
            known: dict[tuple, set[str]] = {}
            kept, ends = [], [0]
            for keys, row in zip(map(tuple, declared), rows):
                if keys not in known:
                    known[keys] = {names[k] for k in keys}
                kept += [i for i in row if known[keys].issuperset(found[i]["atoms"])]
                ends.append(len(kept))
            offsets = pa.array(ends, pa.int32(), mask=np.append(batch["relations"].is_null().to_numpy(zero_copy_only=False), False))
            lists = pa.ListArray.from_arrays(offsets, forms.take(pa.array(kept, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], names=["doc_id", "relations"])

    return listed.mapInArrow(read, f"doc_id {doc_type}, relations {RELATIONS_TYPE}")


def _positive(clause: Column) -> Column:
    return F.filter(clause, lambda x: ~x.startswith("!"))


def is_horn(relations: Column) -> Column:
    """Whether every relation could be read and no clause has two literals that are not negated."""
    return F.forall(
        relations,
        lambda r: r["clauses"].isNotNull() & F.forall(F.coalesce(r["clauses"], F.array()), lambda c: F.size(_positive(c)) <= 1),
    )


def beyond_horn(relations: DataFrame) -> DataFrame:
    """Documents with a relation that is not Horn or cannot be read; nothing is derived for them here."""
    return relations.filter(~is_horn(F.col("relations"))).select("doc_id")


def derived_horn(
    relations: DataFrame, row_atoms: int = ROW_ATOMS, row_clauses: int = ROW_CLAUSES
) -> DataFrame:
    """``doc_id, x, y``: literal pairs ``x -> y``, x not y, that a document entails and no relation states.

    ``relations(doc_id, relations)`` as ``document_relations`` gives them, one row a document. Literals are
    those of all atoms that its relations name. A document of more than ``row_atoms`` atoms or
    ``row_clauses`` clauses is copied to several rows, each for a share of its atoms and dealt on their own;
    both ways give the same rows. Documents without relations, and those of ``beyond_horn``, give none. A
    contradictory document entails every pair. "States" means that the relation is one clause once it is
    reduced by ``minimal``.
    """
    if not 0 < row_atoms <= ROW_ATOMS:
        raise ValueError(f"row_atoms must be 1 to {ROW_ATOMS}")
    read = materialize(_numbered(relations), "horn")
    n = F.size("atoms")
    share = F.greatest(F.lit(1), F.least(F.lit(row_atoms), F.floor(F.lit(STARTS) / n)))
    small = (n <= row_atoms) & (F.col("n_clauses") <= row_clauses)
    light = read.filter(small).withColumns({"first": F.lit(0), "last": n})
    heavy = read.filter(~small)
    pairs = _pairs(light)
    if heavy.isEmpty():
        return pairs
    dealt = heavy.withColumn("share", share.cast("int")).withColumn("first", F.explode(F.sequence(F.lit(0), n - 1, F.col("share"))))
    dealt = dealt.withColumn("last", F.least(n, F.col("first") + F.col("share"))).repartition("doc_id", "first")
    return pairs.unionByName(_pairs(dealt))


def _numbered(relations: DataFrame) -> DataFrame:
    """Horn documents with their ``atoms``, ``clauses`` as literal numbers, each ended by -1, and pairs ``stated``.

    Atom i is the literal 2i, its negation 2i + 1.
    """
    doc_type = relations.schema["doc_id"].dataType.simpleString()
    parts = relations.select("doc_id", F.col("relations.atoms").alias("atoms"), F.col("relations.clauses").alias("clauses"))
    horn = parts.filter("size(atoms) > 0 and not exists(clauses, c -> c is null)")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            relations_of = _rows(batch["clauses"])
            atoms_of = _rows(batch["atoms"])
            atoms, names = coded_lists(pc.list_flatten(batch["atoms"]))
            clauses_of = _rows(pc.list_flatten(batch["clauses"]))
            clauses, literals = coded_lists(pc.list_flatten(pc.list_flatten(batch["clauses"])))
            place = {name: i for i, name in enumerate(names)}
            for x in literals:
                place.setdefault(x.removeprefix("!"), len(place))
            signed = [(place[x.removeprefix("!")], x.startswith("!")) for x in literals]
            names = list(place)
            kept, found_atoms, found_clauses, found_stated, counts = [], [], [], [], []
            for row, (own, said) in enumerate(zip(atoms_of, relations_of)):
                local: dict[int, int] = {}
                for r in own:
                    for a in atoms[r]:
                        local.setdefault(a, len(local))
                rules, stated = {}, []
                for r in said:
                    its = [
                        tuple(2 * local.setdefault(a, len(local)) + minus for a, minus in map(signed.__getitem__, clauses[c]))
                        for c in clauses_of[r]
                    ]
                    rules.update(dict.fromkeys(its))
                    if len(its) == 1 and 1 <= len(its[0]) <= 2:
                        stated += (min(its[0]), max(its[0]))
                if not local or any(sum(not x & 1 for x in c) > 1 for c in rules):
                    continue
                kept.append(row)
                found_atoms.append([names[a] for a in local])
                found_clauses.append([x for c in rules for x in (*c, -1)])
                found_stated.append(stated)
                counts.append(len(rules))
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(kept, pa.int64())), pa.array(found_atoms, pa.list_(pa.string())),
                    pa.array(found_clauses, numbers), pa.array(found_stated, numbers), pa.array(counts, pa.int32()),
                ],
                names=["doc_id", "atoms", "clauses", "stated", "n_clauses"],
            )

    return horn.mapInArrow(read, f"doc_id {doc_type}, atoms array<string>, clauses array<int>, stated array<int>, n_clauses int")


def _rows(lists: pa.Array) -> list[range]:
    """Where the members of each row lie among those of all rows."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
    return [range(a, b) for a, b in zip([0, *ends], ends)]


def _pairs(documents: DataFrame) -> DataFrame:
    """``doc_id, x, y`` of documents as ``_numbered`` gives them, for their atoms from ``first`` to before ``last``."""
    doc_type = documents.schema["doc_id"].dataType.simpleString()

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            atoms, names = coded_lists(batch["atoms"])
            literals = [sign + name for name in names for sign in ("", "!")]
            shares = zip(batch["first"].to_pylist(), batch["last"].to_pylist())
            at, xs, ys = [], [], []
            for row, (own, flat, said, share) in enumerate(
                zip(atoms, batch["clauses"].to_numpy(zero_copy_only=False), batch["stated"].to_numpy(zero_copy_only=False), shares)
            ):
                clauses, clause = [], []
                for x in flat.tolist():
                    if x < 0:
                        clauses.append(clause)
                        clause = []
                    else:
                        clause.append(x)
                said = said.tolist()
                for x, y in horn_pairs(len(own), clauses, set(zip(said[::2], said[1::2])), range(*share)):
                    at.append(row)
                    xs.append(2 * own[x >> 1] + (x & 1))
                    ys.append(2 * own[y >> 1] + (y & 1))
                # One large document can have millions of pairs.
                if len(at) >= 1 << 20:
                    yield paired(batch["doc_id"], at, xs, ys, literals)
                    at, xs, ys = [], [], []
            yield paired(batch["doc_id"], at, xs, ys, literals)

    columns = ["doc_id", "atoms", "clauses", "stated", "first", "last"]
    return documents.select(*columns).mapInArrow(close, f"doc_id {doc_type}, x string, y string")


def derived_from_relations(relations: DataFrame) -> DataFrame:
    """``doc_id, x, y`` for every document that is Horn or has at most two literals in each clause.

    Horn documents are chained; of the others, those of two literals go through the closure of their
    implications. The rest give none.
    """
    stored = materialize(relations, "relations")
    others = stored.filter(~is_horn(F.col("relations"))).select("doc_id", F.explode("relations").alias("_r"))
    clauses = (
        others.withColumn("_pairs", as_pairs(F.col("_r.clauses"), F.col("_r.atoms")))
        # A relation that is no pair of literals is one row of nulls, which closes its document off.
        .withColumn("_unread", F.array(F.lit(None).cast(CLAUSE_TYPE)))
        .withColumn("single", is_one_clause(F.col("_pairs")))
        .select("doc_id", F.explode(F.coalesce("_pairs", "_unread")).alias("_c"), "single")
        .select("doc_id", "_c.a", "_c.b", "single")
    )
    return derived_horn(stored).unionByName(derived_implications(clauses))
