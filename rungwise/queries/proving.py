"""Prover results and derived implications."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.bridges import table, text
from rungwise.functions import prover as P
from rungwise.functions.relations import relation_sections
from rungwise.operators import closure, horn, prover
from rungwise.queries.registry import query

_MESSAGE_SQL = """CASE event_type WHEN 'error' THEN 'Inner syntax error in ' || event_id WHEN 'view' THEN 'No proof found' || event_id
  WHEN 'click' THEN 'Try this: by (metis x' || event_id || ') (1.2 s)' WHEN 'purchase' THEN ' by simp' || event_id || '  (3 ms)' ELSE 'Ok' END"""
_JOBS_SQL = f"WITH m AS (SELECT event_id // 3 AS job_id, event_id AS msg_pos, event_type, {_MESSAGE_SQL} AS message FROM events)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, at = F.col("event_type"), F.col("event_id")
    message = (
        F.when(kind == "error", text("Inner syntax error in ", at))
        .when(kind == "view", text("No proof found", at))
        .when(kind == "click", text("Try this: by (metis x", at, ") (1.2 s)"))
        .when(kind == "purchase", text(" by simp", at, "  (3 ms)"))
        .otherwise("Ok")
    )
    return table(spark, sf_dir, "events").select(
        F.floor(at / 3).alias("job_id"), at.alias("msg_pos"), kind.alias("event_type"), message.alias("message")
    )


@query(
    _JOBS_SQL
    + """, j AS (
  SELECT job_id, job_id % 11 <> 0 AS done, bool_or(event_type = 'view') AS refused, bool_or(event_type = 'error') AS broken FROM m GROUP BY job_id
)
SELECT job_id, done AND NOT refused AND NOT broken AS semantic_validity, NOT (done AND broken) AS syntactic_validity,
  done AND NOT refused AS contradiction FROM j
"""
)
def prover_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRV-1 on a message table."""
    messages = _messages(spark, sf_dir)
    jobs = messages.select("job_id").distinct().withColumn("finished", F.col("job_id") % 11 != 0)
    return prover.verdicts(jobs, messages)


@query(
    _JOBS_SQL
    + """
SELECT job_id, coalesce(
  min_by('by (metis x' || msg_pos || ')', CASE WHEN event_type = 'click' THEN msg_pos END),
  min_by('by simp' || msg_pos, CASE WHEN event_type = 'purchase' THEN msg_pos END)) AS tactic
FROM m GROUP BY job_id
"""
)
def tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRV-3: the first offered proof step of a job."""
    return prover.first_tactic(_messages(spark, sf_dir))


@query(
    """
WITH m AS (SELECT event_id // 3 AS job_id, event_id AS p, event_id % 9 + 1 AS line, event_type FROM events),
e AS (
  SELECT job_id, p, line, CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS part,
    CASE event_type WHEN 'error' THEN 'Outer syntax error' ELSE 'Introduced fixed type variable' END AS message
  FROM m WHERE event_type IN ('error', 'view')
), n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY part, p) AS k FROM e),
r AS (
  SELECT job_id, string_agg(k || '. Error on line ' || line || ': ' || message, chr(10) ORDER BY k) AS report,
    string_agg(CASE line WHEN 1 THEN 'theory T' || job_id || chr(10) WHEN 2 THEN 'ax: p' || job_id || chr(10) WHEN 3 THEN 'ax: p' || job_id || chr(10)
      WHEN 4 THEN 'a' || job_id || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'end' || chr(10)
      WHEN 5 THEN 'a' || job_id || chr(10) WHEN 6 THEN 'b' || chr(10) WHEN 7 THEN 'c' || chr(10) WHEN 8 THEN 'end' || chr(10) ELSE '' END, '' ORDER BY k) AS inner_code
  FROM n GROUP BY job_id
)
SELECT j.job_id, coalesce(report, '') AS report, coalesce(inner_code, '') AS inner_code, r.job_id IS NULL AS syntactic_validity
FROM (SELECT DISTINCT job_id FROM m) j LEFT JOIN r ON j.job_id = r.job_id
"""
)
def prover_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRV-1, PRV-2 on job bodies: error list and the theory lines it points at.

    A job has three messages, so its body is one small record.
    """
    at, kind = F.col("event_id"), F.col("event_type")
    position = F.struct((at % 9 + 1).cast("int").alias("line"))
    error = F.when(kind == "error", F.struct(F.lit("Outer syntax error").alias("message"), position.alias("pos")))
    message = F.struct(
        F.when(kind == "view", "warning").otherwise("writeln").alias("kind"),
        F.when(kind == "view", "Introduced fixed type variable").otherwise("Ok").alias("message"),
        position.alias("pos"),
    )

    def in_order(c):
        return F.transform(F.array_sort(F.collect_list(F.struct(at, c.alias("x")))), lambda p: p["x"])

    jobs = (
        table(spark, sf_dir, "events")
        .groupBy(F.floor(at / 3).alias("job_id"))
        .agg(in_order(error).alias("errors"), in_order(message).alias("messages"))
    )
    body = F.to_json(
        F.struct(
            F.filter("errors", lambda e: e.isNotNull()).alias("errors"),
            F.array(F.struct("messages")).alias("nodes"),
        )
    )
    job = F.col("job_id")
    code = text(
        "theory T", job, "\naxiomatization where\n  ax: p", job, "\ntheorem hypothesis:\n  a", job, "\n  b\n  c\nend"
    )
    parsed = jobs.select("job_id", P.parse_body(body).alias("body"), code.alias("code"))
    located = parsed.withColumn("at", P.error_positions(F.col("body")))
    return located.select(
        "job_id",
        P.error_report(F.col("at")).alias("report"),
        P.offending_code(F.col("code"), F.col("at")).alias("inner_code"),
        P.verdict(F.lit(True), F.col("body"))["syntactic_validity"].alias("syntactic_validity"),
    )


@query(
    """
WITH c AS (
  SELECT l_orderkey AS job_id, l_linenumber AS line, min(l_returnflag) AS f FROM lineitem GROUP BY ALL
), e AS (SELECT event_id AS job_id, user_id AS err_pos, event_id % 7 + 1 AS line FROM events WHERE event_type = 'error'),
w AS (
  SELECT e.job_id, err_pos, unnest(CASE f WHEN 'A' THEN [e.line + 1] WHEN 'R' THEN [e.line + 1, e.line + 2, e.line + 3, e.line + 4] ELSE [e.line] END) AS line
  FROM e JOIN c ON e.job_id = c.job_id AND e.line = c.line
)
SELECT w.job_id, w.err_pos, w.line, CASE f WHEN 'A' THEN 'axiomatization where' WHEN 'R' THEN 'theorem hypothesis: x' ELSE 'line ' || w.line END AS text
FROM w JOIN c ON w.job_id = c.job_id AND w.line = c.line
"""
)
def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRV-2, JON-5: errors of an event meet code lines of the order of that number."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("bigint").alias("line"))
        .agg(F.min("l_returnflag").alias("f"))
        .select(
            "job_id",
            "line",
            F.when(F.col("f") == "A", "axiomatization where")
            .when(F.col("f") == "R", " theorem hypothesis: x")
            .otherwise(text("  line ", F.col("line")))
            .alias("text"),
        )
    )
    errors = (
        table(spark, sf_dir, "events")
        .filter("event_type = 'error'")
        .select(F.col("event_id").alias("job_id"), F.col("user_id").alias("err_pos"), (F.col("event_id") % 7 + 1).alias("line"))
    )
    return prover.attribute_errors(errors, lines)


@query(
    """
WITH n AS (
  SELECT l_orderkey AS job_id, l_linenumber AS k, max(l_partkey) AS part, bool_or(l_returnflag = 'A') AS used FROM lineitem GROUP BY ALL
)
SELECT job_id, coalesce(string_agg('explanation_' || k, ',' ORDER BY k) FILTER (NOT used), '') AS unused,
  coalesce(string_agg('explanation_' || k, ',' ORDER BY k) FILTER (used), '') AS cited,
  coalesce(string_agg('explanation_' || k || ': part ' || part, chr(10) || chr(10) ORDER BY part, k) FILTER (used), '') AS cited_text
FROM n GROUP BY job_id
"""
)
def axiom_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRV-4: lines of an order as explanations, stated by part number; some named in the proof."""
    named = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("k"))
        .agg(F.max("l_partkey").alias("part"), F.bool_or(F.col("l_returnflag") == "A").alias("used"))
    )
    name = text("explanation_", F.col("k"))
    jobs = named.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "k", text("  ", name, ": part ", F.col("part")).alias("s")))).alias("stated"),
        F.array_sort(F.collect_list(F.when(F.col("used"), name))).alias("used"),
    )
    code = text(
        "theory\n", F.array_join(F.transform("stated", lambda s: s["s"]), "\n"), "\nproof -\n", F.array_join("used", " "), "\nqed"
    )
    offer = text("Try this: by (metis ", F.array_join(F.reverse("used"), " "), ")")
    return jobs.select("job_id", code.alias("code"), P.cited_axioms(F.array(F.lit("Ok"), offer)).alias("names")).select(
        "job_id",
        F.array_join(P.unused_axioms(F.col("code")), ",").alias("unused"),
        F.array_join("names", ",").alias("cited"),
        # The proof line names several of them at once and comes last, so it is cut off here.
        P.cited_axiom_text(F.substring_index("code", "\nproof", 1), F.col("names")).alias("cited_text"),
    )


_X, _Y = "(l_suppkey % 6)", "(l_partkey % 6)"
_KIND_SQL = "l_returnflag || l_linestatus"


def _relation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposition and relation list per order."""
    x, y = text("P", F.col("l_suppkey") % 6), text("P", F.col("l_partkey") % 6)
    kind = text(F.col("l_returnflag"), F.col("l_linestatus"))
    relation = (
        F.when(kind == "AO", text("Implies(", x, ", ", y, ") # if"))
        .when(kind == "AF", text("Not(", x, ")"))
        .when(kind == "NO", text("Or(Not(", x, "), Not(Not(", y, ")))"))
        .when(kind == "NF", text("And(Or(Not(", x, "), ", y, "), P0)"))
        .when(kind == "RO", text("Implies(Not(", x, "),Not(", y, "))"))
        .otherwise(text("Equivalent(", x, ", ", y, ")"))
    )
    return _listed(spark, sf_dir, relation)


def _listed(spark: SparkSession, sf_dir: str, relation: Column) -> DataFrame:
    """Lists of six propositions and of the relations that the lines of an order stand for."""
    declared = "\n".join(f"P{i}: fact {i} (from sentence {i})" for i in range(6))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("doc_id"))
        .agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", relation.alias("r")))).alias("_r"))
        .select(
            "doc_id",
            text(
                "Answer\n\nLogical Propositions: \n", declared, "\n\nLogical Relations:\n",
                F.array_join(F.transform("_r", lambda r: r["r"]), "\n"), "\nImplies(P0, Unknown)\n",
            ).alias("text"),
        )
    )


@query(
    f"""
SELECT l_orderkey AS doc_id, 6 AS n_propositions, 'P5=fact 5 (from sentence 5)' AS last_proposition,
  string_agg(CASE {_KIND_SQL} WHEN 'AO' THEN 'Implies(P' || {_X} || ', P' || {_Y} || ')' WHEN 'AF' THEN 'Not(P' || {_X} || ')'
    WHEN 'NO' THEN 'Or(Not(P' || {_X} || '), Not(Not(P' || {_Y} || ')))' WHEN 'NF' THEN 'And(Or(Not(P' || {_X} || '), P' || {_Y} || '), P0)'
    WHEN 'RO' THEN 'Implies(Not(P' || {_X} || '),Not(P' || {_Y} || '))' ELSE 'Equivalent(P' || {_X} || ', P' || {_Y} || ')' END, ';'
    ORDER BY l_partkey, l_suppkey, l_linenumber) || ';Implies(P0, Unknown)' AS relations
FROM lineitem GROUP BY l_orderkey
"""
)
def relation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-6: propositions and relations read back from their lists."""
    read = _relation_texts(spark, sf_dir).select("doc_id", relation_sections(F.col("text")).alias("s"))
    last = F.element_at("s.propositions", -1)
    return read.select(
        "doc_id",
        F.size("s.propositions").alias("n_propositions"),
        text(last["key"], "=", last["meaning"]).alias("last_proposition"),
        F.array_join("s.relations", ";").alias("relations"),
    )


_DERIVED_SQL = f"""
WITH RECURSIVE l AS (
  SELECT l_orderkey AS doc_id, {_KIND_SQL} AS kind, {_X} + 1 AS x, {_Y} + 1 AS y FROM lineitem
), c AS (
  SELECT doc_id, -x AS a, y AS b, true AS single FROM l WHERE kind IN ('AO', 'NO')
  UNION ALL SELECT doc_id, -x, -x, true FROM l WHERE kind = 'AF'
  UNION ALL SELECT doc_id, -x, y, false FROM l WHERE kind IN ('NF', 'RF')
  UNION ALL SELECT doc_id, 1, 1, false FROM l WHERE kind = 'NF'
  UNION ALL SELECT doc_id, x, -y, kind = 'RO' FROM l WHERE kind IN ('RO', 'RF')
), edge AS (SELECT doc_id, -a AS x, b AS y FROM c UNION SELECT doc_id, -b, a FROM c),
reach AS (
  SELECT doc_id, x, y FROM edge
  UNION SELECT r.doc_id, r.x, e.y FROM reach r JOIN edge e ON r.doc_id = e.doc_id AND r.y = e.x
),
never AS (SELECT doc_id, x AS lit FROM reach WHERE y = -x),
nomodel AS (SELECT DISTINCT n.doc_id FROM never n JOIN never m ON n.doc_id = m.doc_id AND n.lit = -m.lit),
lit AS (SELECT DISTINCT doc_id, unnest([abs(x), -abs(x), abs(y), -abs(y)]) AS lit FROM edge),
entailed AS (
  SELECT doc_id, x, y FROM reach
  UNION SELECT n.doc_id, n.lit, o.lit FROM never n JOIN lit o ON n.doc_id = o.doc_id
  UNION SELECT n.doc_id, o.lit, -n.lit FROM never n JOIN lit o ON n.doc_id = o.doc_id
  UNION SELECT p.doc_id, p.lit, o.lit FROM lit p JOIN nomodel USING (doc_id) JOIN lit o ON p.doc_id = o.doc_id
)
SELECT e.doc_id, CASE WHEN e.x < 0 THEN '!' ELSE '' END || 'P' || (abs(e.x) - 1) AS x, CASE WHEN e.y < 0 THEN '!' ELSE '' END || 'P' || (abs(e.y) - 1) AS y
FROM entailed e WHERE e.x <> e.y AND NOT EXISTS (
  SELECT 1 FROM c WHERE c.single AND c.doc_id = e.doc_id AND least(c.a, c.b) = least(-e.x, e.y) AND greatest(c.a, c.b) = greatest(-e.x, e.y))
"""


@query(_DERIVED_SQL)
def derived_implications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR-2, GEN-6: implications each list entails but does not state, worked out inside its row."""
    return closure.derived_in_record(_relation_texts(spark, sf_dir))


@query(_DERIVED_SQL)
def derived_from_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR-2 on a clause table, where a document may be too large for one row."""
    return closure.derived_implications(closure.stated_clauses(_relation_texts(spark, sf_dir)))


@query(_DERIVED_SQL)
def derived_from_clauses_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR-2 on a clause table, documents of more than nine clauses by rounds of joins."""
    return closure.derived_implications(closure.stated_clauses(_relation_texts(spark, sf_dir)), row_clauses=9)


# Nested relations over the atoms x, y, z of a line, and when they hold.
_NESTED = (
    ("Implies(And(x, y), z)", "NOT (x AND y) OR z"),
    ("Implies(x, And(y, Not(z)))", "NOT x OR (y AND NOT z)"),
    ("Not(And(x, Or(y, Not(Not(z)))))", "NOT (x AND (y OR z))"),
    ("Equivalent(And(x, y), z)", "(x AND y) = z"),
    ("Or(Not(And(x, y)), And(z, x))", "NOT (x AND y) OR (z AND x)"),
    ("Not(Implies(Or(x, Not(x)), Not(y)))", "y"),
)
_Z = "((l_orderkey + l_linenumber) % 6)"
_NESTED_KIND = "(l_partkey // 6 % 6)"


def _nested_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of relations with several premises, one list per order."""
    atoms = {
        "x": text("P", F.col("l_suppkey") % 6),
        "y": text("P", F.col("l_partkey") % 6),
        "z": text("P", (F.col("l_orderkey") + F.col("l_linenumber")) % 6),
    }
    kind = F.floor(F.col("l_partkey") / 6) % 6
    relation = F.lit(None).cast("string")
    for i, (form, _) in enumerate(_NESTED):
        parts = [atoms.get(part, F.lit(part)) for part in re.split(r"\b([xyz])\b", form)]
        relation = F.when(kind == i, text(*parts)).otherwise(relation)
    return _listed(spark, sf_dir, relation)


_HOLDS_SQL = " ".join(f"WHEN {i} THEN {rule}" for i, (_, rule) in enumerate(_NESTED))
_HORN_SQL = f"""
WITH l AS (
  SELECT l_orderkey AS doc_id, {_NESTED_KIND} AS k, {_X} AS px, {_Y} AS py, {_Z} AS pz FROM lineitem
), model AS (SELECT range AS m, range | (xor(range, 63) << 6) AS lits FROM range(64)),
bits AS (
  SELECT f.*, m, (m >> px) & 1 = 1 AS x, (m >> py) & 1 = 1 AS y, (m >> pz) & 1 = 1 AS z FROM (SELECT DISTINCT k, px, py, pz FROM l) f, model
), truth AS (SELECT k, px, py, pz, m, CASE k {_HOLDS_SQL} END AS v FROM bits),
meaning AS (SELECT k, px, py, pz, string_agg(CASE WHEN v THEN '1' ELSE '0' END, '' ORDER BY m) AS worlds FROM truth GROUP BY ALL),
world AS (
  SELECT doc_id, m FROM (SELECT DISTINCT * FROM l) l JOIN truth USING (k, px, py, pz) GROUP BY doc_id, m HAVING bool_and(v)
), atom AS (SELECT DISTINCT doc_id, unnest(CASE k WHEN 5 THEN [px, py] ELSE [px, py, pz] END) AS p FROM l),
lit AS (SELECT doc_id, unnest([p, p + 6]) AS c FROM atom),
sure AS (
  SELECT lit.doc_id, c, bit_and(lits) AS held FROM lit JOIN world USING (doc_id) JOIN model USING (m) WHERE (lits >> c) & 1 = 1 GROUP BY ALL
), follows AS (
  SELECT a.doc_id, a.c AS x, b.c AS y FROM lit a JOIN lit b ON a.doc_id = b.doc_id AND a.c <> b.c
  LEFT JOIN sure s ON s.doc_id = a.doc_id AND s.c = a.c WHERE s.held IS NULL OR (s.held >> b.c) & 1 = 1
), implied AS (
  SELECT a.c AS x, b.c AS y, string_agg(CASE WHEN (lits >> a.c) & 1 = 0 OR (lits >> b.c) & 1 = 1 THEN '1' ELSE '0' END, '' ORDER BY m) AS worlds
  FROM (SELECT range AS c FROM range(12)) a, (SELECT range AS c FROM range(12)) b, model WHERE a.c <> b.c GROUP BY ALL
), stated AS (SELECT DISTINCT doc_id, i.x, i.y FROM l JOIN meaning USING (k, px, py, pz) JOIN implied i USING (worlds))
SELECT f.doc_id, CASE WHEN f.x > 5 THEN '!' ELSE '' END || 'P' || (f.x % 6) AS x, CASE WHEN f.y > 5 THEN '!' ELSE '' END || 'P' || (f.y % 6) AS y
FROM follows f ANTI JOIN stated s ON f.doc_id = s.doc_id AND f.x = s.x AND f.y = s.y
"""


@query(_HORN_SQL)
def derived_horn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR-2, GEN-6 on relations with several premises, by forward chaining; the SQL tries every truth value."""
    return horn.derived_horn(horn.document_relations(_nested_texts(spark, sf_dir)))


@query(_HORN_SQL)
def derived_horn_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR-2 on relations with several premises, documents of more than five atoms in shares of five."""
    return horn.derived_horn(horn.document_relations(_nested_texts(spark, sf_dir)), row_atoms=5)
