"""Step and generation rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.bridges import STEP_POS_SQL, block_of, line_items, table
from rungwise.operators import rewards
from rungwise.operators.ordering import rank_in_key
from rungwise.queries.registry import query

_GROUNDING_SQL = """
WITH v AS (
  SELECT vec_id // 10 AS id, vec_id % 10 AS k, embedding::DOUBLE[] AS e FROM embeddings
), base AS (SELECT * FROM v WHERE k < 4),
used AS (SELECT id, (k - 4) // 2 AS step_pos, k, e FROM v WHERE k >= 4),
carried AS (SELECT id, (k - 4) // 2 + 1 AS step_pos, e FROM v WHERE k IN (4, 6)),
sims AS (
  SELECT u.id, u.step_pos, u.k, list_inner_product(u.e, b.e) AS sim FROM used u JOIN base b ON u.id = b.id
  UNION ALL
  SELECT u.id, u.step_pos, u.k, list_inner_product(u.e, c.e) FROM used u JOIN carried c ON u.id = c.id AND u.step_pos = c.step_pos
), best AS (SELECT id, step_pos, k, least(1.0, greatest(0.0, max(sim))) AS sim FROM sims GROUP BY ALL),
steps AS (SELECT DISTINCT vec_id // 10 AS id, s.step_pos FROM embeddings CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS step_pos) s)
SELECT steps.id, steps.step_pos, round(coalesce(avg(sim), 1.0), 6) AS premise_validity
FROM steps LEFT JOIN best ON steps.id = best.id AND steps.step_pos = best.step_pos GROUP BY ALL
"""


def _grounding(spark: SparkSession, sf_dir: str, heavy_rows: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("id"),
        (F.col("vec_id") % 10).alias("pos"),
        F.lit(0).alias("gen_pos"),
        "embedding",
    )
    named = vectors.withColumn("step_pos", F.floor((F.col("pos") - 4) / 2).cast("int"))
    used = named.filter("pos >= 4").select("id", "gen_pos", "step_pos", "pos", "embedding")
    # The first premise of a step stands in for the conclusion the next step may use.
    carried = named.filter("pos in (4, 6)").select(
        "id", "gen_pos", (F.col("step_pos") + 1).alias("step_pos"), "embedding"
    )
    base = vectors.filter("pos < 4").select("id", "pos", "embedding")
    steps = (
        vectors.select("id", "gen_pos")
        .distinct()
        .withColumn("step_pos", F.explode(F.sequence(F.lit(0), F.lit(3))))
    )
    scored = rewards.premise_grounding(steps, used, base, carried, heavy_rows)
    return scored.select("id", "step_pos", F.round("premise_validity", 6).alias("premise_validity"))


@query(_GROUNDING_SQL)
def premise_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-4: best cosine per premise, mean per step; the fourth step names no premise."""
    return _grounding(spark, sf_dir, 1_000_000)


@query(_GROUNDING_SQL)
def premise_grounding_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every record salted as a heavy one."""
    return _grounding(spark, sf_dir, 1)


_CARRY_SQL = f"""
WITH s AS (
  SELECT l_suppkey AS id, l_orderkey AS gen_pos, {STEP_POS_SQL} AS step_pos,
    CASE WHEN l_returnflag = 'R' THEN '' ELSE 'h' || l_partkey || l_linestatus END AS h FROM lineitem
), e AS (
  SELECT *, CASE WHEN h <> '' AND step_pos <> max(step_pos) OVER (PARTITION BY id, gen_pos) THEN h END AS offered FROM s
)
SELECT id, gen_pos, step_pos, last_value(offered IGNORE NULLS) OVER (
  PARTITION BY id ORDER BY gen_pos, step_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_conclusion
FROM e
"""


def _carry(spark: SparkSession, sf_dir: str, heavy_rows: int) -> DataFrame:
    steps = line_items(spark, sf_dir).select(
        F.col("l_suppkey").alias("id"),
        F.col("l_orderkey").alias("gen_pos"),
        "step_pos",
        F.when(F.col("l_returnflag") == "R", "")
        .otherwise(F.concat(F.lit("h"), F.col("l_partkey").cast("string"), "l_linestatus"))
        .alias("hypothesis"),
    )
    return rewards.carry_conclusion(steps, heavy_rows=heavy_rows).drop("hypothesis")


@query(_CARRY_SQL)
def carry_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1: orders as generations of their supplier; the carry runs across them."""
    return _carry(spark, sf_dir, 1_000_000)


@query(_CARRY_SQL)
def carry_conclusion_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a low limit, so that about half of the suppliers are cut into blocks."""
    return _carry(spark, sf_dir, 600)


@query(
    """
WITH a AS (
  SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt FROM events
), g AS (
  SELECT user_id, bool_or(event_type = 'purchase') AS proved, bool_or(event_type <> 'error') AS well_formed
  FROM a WHERE attempt < 3 GROUP BY user_id
), c AS (SELECT user_id, avg(value) / 100 - 0.2 AS confidence, max(user_id) AS u FROM events GROUP BY user_id)
SELECT g.user_id AS id,
  round(CASE WHEN u % 10 = 3 THEN 0.25 WHEN proved THEN 1.0 WHEN well_formed THEN 0.0 ELSE least(1.0, greatest(0.0, confidence)) END, 6) AS logic_validity,
  (u % 10 = 3 OR proved OR well_formed) AS syntactic_ok, (u % 10 = 3 OR proved) AS semantic_ok
FROM g JOIN c ON g.user_id = c.user_id
"""
)
def verdict_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6: verdict over the first three events of a user, with confidence and stored values."""
    events = table(spark, sf_dir, "events")
    ranked = rank_in_key(events, ["user_id"], ["event_id"], block_of("event_id"), "nth")
    attempts = ranked.select(
        "user_id",
        (F.col("nth") - 1).alias("attempt"),
        (F.col("event_type") != "error").alias("syntactic_ok"),
        (F.col("event_type") == "purchase").alias("semantic_ok"),
    )
    judged = rewards.verdict_over_attempts(attempts, ["user_id"])
    confidence = events.groupBy("user_id").agg((F.avg("value") / 100 - 0.2).alias("confidence"))
    stored = F.when(F.col("user_id") % 10 == 3, F.lit(0.25))
    metrics = rewards.logic_metrics(F.col("proved"), F.col("well_formed"), F.col("confidence"), stored)
    return judged.join(confidence, "user_id").select(F.col("user_id").alias("id"), metrics.alias("m")).select(
        "id", F.round("m.logic_validity", 6).alias("logic_validity"), "m.syntactic_ok", "m.semantic_ok"
    )


def _confidence_sql(key: str) -> str:
    return f"""
WITH t AS (SELECT {key} AS id, -(l_extendedprice / 9973) AS v FROM lineitem),
b AS (SELECT id, count(*) AS n, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM t GROUP BY id),
m AS (
  SELECT t.id, n, avg(CASE WHEN n >= 5 THEN greatest(lo, least(hi, v)) ELSE v END) AS c FROM t JOIN b ON t.id = b.id GROUP BY t.id, n
), z AS (SELECT id, n, c, tanh(2.0 * (c + 3.0) / (1.5 + 1e-8)) AS conf FROM m)
SELECT id, n AS n_tokens, round(c, 6) AS mean_logprob, round(conf, 6) AS confidence,
  round(greatest(0.0, (conf + 1) / 2) * 0.5, 6) AS soft_score FROM z
"""


def _confidence(spark: SparkSession, sf_dir: str, key: str, in_one_row: int) -> DataFrame:
    tokens = table(spark, sf_dir, "lineitem").select(
        F.col(key).alias("id"), (-(F.col("l_extendedprice") / 9973)).alias("logprob")
    )
    scored = rewards.step_confidence(tokens, ["id"], in_one_row=in_one_row)
    return scored.select(
        "id",
        "n_tokens",
        F.round("mean_logprob", 6).alias("mean_logprob"),
        F.round("confidence", 6).alias("confidence"),
        F.round(rewards.soft_score(F.col("confidence")), 6).alias("soft_score"),
    )


@query(_confidence_sql("l_orderkey"))
def step_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7, AGG-8: line prices of an order as token log-probabilities."""
    return _confidence(spark, sf_dir, "l_orderkey", 100_000)


@query(_confidence_sql("l_suppkey"))
def step_confidence_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per supplier with a low limit, so that most suppliers take the spread way."""
    return _confidence(spark, sf_dir, "l_suppkey", 580)


@query(
    f"""
WITH s AS (
  SELECT l_suppkey AS id, l_orderkey AS gen_pos, {STEP_POS_SQL} AS step_pos, l_tax * 10 AS p,
    CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.0 ELSE l_discount * 10 END AS l, l_returnflag, l_linestatus FROM lineitem
), g AS (
  SELECT id, gen_pos, avg(0.5 * p + 0.5 * l) AS r, CASE WHEN max(l_linestatus) = 'O' THEN 1.0 ELSE 0.0 END AS o,
    string_agg(CASE l_returnflag WHEN 'A' THEN 'true' ELSE 'false' END, ',' ORDER BY step_pos) AS flags
  FROM s GROUP BY id, gen_pos
)
SELECT id, gen_pos, round(r, 6) AS reasoning_score, o::DOUBLE AS outcome_score, round(least(1.0, greatest(0.0, 0.5 * r + 0.5 * o)), 6) AS reward, flags FROM g
"""
)
def generation_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5: lines as steps, orders of a supplier as generations."""
    flag = F.col("l_returnflag")
    logic = rewards.logic_metrics(flag == "A", flag == "N", F.col("l_discount") * 10, F.lit(None).cast("double"))
    steps = (
        line_items(spark, sf_dir)
        .withColumn("m", logic)
        .select(
            F.col("l_suppkey").alias("id"),
            F.col("l_orderkey").alias("gen_pos"),
            "step_pos",
            (F.col("l_tax") * 10).alias("premise_validity"),
            "m.logic_validity",
            "m.syntactic_ok",
            "m.semantic_ok",
            "l_linestatus",
        )
    )
    generations = steps.groupBy("id", "gen_pos").agg(
        F.concat(F.lit(" "), F.max("l_linestatus")).alias("final_tag"), F.lit("O").alias("gold")
    )
    scored = rewards.generation_rewards(generations, steps.drop("l_linestatus"))
    flags = F.transform("step_validity", lambda m: m["semantic_ok"].cast("string"))
    return scored.select(
        "id",
        "gen_pos",
        F.round("reasoning_score", 6).alias("reasoning_score"),
        "outcome_score",
        F.round("reward", 6).alias("reward"),
        F.array_join(flags, ",").alias("flags"),
    )
