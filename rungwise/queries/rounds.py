"""Refinement rounds, hooks and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.bridges import table, text
from rungwise.hooks import CRITIQUE, apply_hook, certainty, critique, embed, logprobs, tag, token_count
from rungwise.operators.rounds import Refined, refine_rounds, refine_soft_rounds
from rungwise.queries.registry import query
from rungwise.results import with_results
from rungwise.session import checkpoint_root
from rungwise.sources.jsonl import read_outcome, write_outcomes
from rungwise.streaming.collate import collate_left_over
from rungwise.streaming.collate import stream_collate as collate_stream
from rungwise.streaming.incremental import append_new, append_once, read_once

# A step holds from round k = user_id % 7 on; errors cannot be read in round 0; a signup's critic
# breaks in round 2. f: round of the end; e: first round that was read.
_ROUNDS_SQL = """
WITH s AS (
  SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS e,
    greatest(user_id % 7, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS f FROM events
), r AS (
  SELECT *, event_type = 'signup' AND f >= 2 AS broken, CASE WHEN event_type = 'signup' AND f >= 2 THEN 2 ELSE f END AS stop FROM s
)
"""


def _refined(spark: SparkSession, sf_dir: str) -> Refined:
    steps = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.lit("a").alias("assumption")
    )

    def critique(rows: DataFrame, number: int) -> DataFrame:
        unread = (F.col("event_type") == "error") & F.lit(number == 0)
        breaks = (F.col("event_type") == "signup") & F.lit(number == 2)
        return rows.withColumn("syntactic_ok", F.when(~breaks, ~unread)).withColumn(
            "semantic_ok", F.lit(number) >= F.col("user_id") % 7
        )

    def rewrite(rows: DataFrame, number: int) -> DataFrame:
        return rows.withColumn("assumption", text(F.col("assumption"), f"+{number}"))

    return refine_rounds(steps, critique, rewrite)


@query(
    _ROUNDS_SQL
    + """
SELECT event_id, least(stop, 4) AS round, CASE WHEN broken THEN 'critique failed' END AS error,
  CASE WHEN broken THEN CASE WHEN f = 2 THEN 1.0 ELSE 0.0 END WHEN f <= 4 THEN 1.0::DOUBLE ELSE 0.0 END AS logic_validity,
  CASE WHEN broken THEN 0.0 ELSE 1.0::DOUBLE END AS syntactic_validity,
  'a' || array_to_string(list_transform(range(e, least(stop, 5)), lambda i: '+' || i), '') AS assumption
FROM r
"""
)
def refine_until_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR-1: final state of each step."""
    return _refined(spark, sf_dir).steps.select(
        "event_id", "round", "error", "logic_validity", "syntactic_validity", "assumption"
    )


@query(
    _ROUNDS_SQL
    + """
SELECT h.round AS round, count(*) AS n_steps FROM r JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS round) h ON h.round <= stop GROUP BY h.round
"""
)
def refine_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR-1: how many steps took part in each round."""
    history = _refined(spark, sf_dir).history
    return history.groupBy("round").agg(F.count(F.lit(1)).alias("n_steps"))


@query(
    """
SELECT event_id, 'a' || '|0:' || (user_id % 3) || '|1:' || (user_id % 3 + 1) || '|2:' || (user_id % 3 + 2) AS assumption FROM events
"""
)
def refine_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ITR-3: three rounds whatever the critics say, their numbers in each rewrite."""
    steps = table(spark, sf_dir, "events").select("event_id", "user_id", F.lit("a").alias("assumption"))

    def critique(rows: DataFrame, number: int) -> DataFrame:
        return rows.withColumn("parsimony", F.col("user_id") % 3 + number)

    def rewrite(rows: DataFrame, number: int) -> DataFrame:
        return rows.withColumn("assumption", text(F.col("assumption"), f"|{number}:", F.col("parsimony")))

    return refine_soft_rounds(steps, critique, rewrite, rounds=3).steps.select("event_id", "assumption")


def _load_stub():
    """A stand-in for a model: it answers with the event type and fails for one user."""

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["user_id"] == 7).any():
            raise ValueError("no reply")
        return pd.DataFrame({"completion": "<answer>" + batch["event_type"] + "</answer>"})

    return answer


@query(
    """
SELECT event_id, CASE WHEN user_id <> 7 THEN '<answer>' || event_type || '</answer>' END AS completion,
  CASE WHEN user_id = 7 THEN 'ValueError: no reply' END AS error FROM events
"""
)
def hook_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-1, SNK-4: a hook that fails on some rows of its batches."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return apply_hook(events, _load_stub, "completion string").select("event_id", "completion", "error")


@query(
    """
SELECT event_id, 'good' AS outcome, user_id, '<answer>' || event_type || '</answer>' AS completion, NULL AS error FROM events WHERE user_id <> 7
UNION ALL SELECT event_id, 'error', NULL, NULL, 'ValueError: no reply' FROM events WHERE user_id = 7
"""
)
def outcome_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, SNK-4: records and error records of a hook, written in one pass and read back."""
    path = f"{checkpoint_root(spark)}/rungwise/outcomes-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    write_outcomes(apply_hook(events, _load_stub, "completion string"), path, ["event_id"])
    good = read_outcome(spark, path, "good", "event_id bigint, user_id bigint, completion string, error string")
    bad = read_outcome(spark, path, "error", "event_id bigint, user_id bigint, completion string, error string")
    return good.withColumn("outcome", F.lit("good")).unionByName(bad.withColumn("outcome", F.lit("error")))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _collated(spark: SparkSession, sf_dir: str, run: str, salts: int = 1) -> DataFrame:
    """Full records of the events of each user, from a stream that has ended."""
    replies = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("id"), text("E", F.col("event_id")).alias("text"), F.col("event_type").alias("answer")
    )
    (
        collate_stream(replies, salts=salts)
        .writeStream.format("parquet")
        .option("path", f"{run}/out")
        .option("checkpointLocation", f"{run}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema("id string, generation array<string>, extracted_answer array<string>").parquet(f"{run}/out")


@query("SELECT CAST(user_id AS VARCHAR) AS id, count(*) // 5 AS n_records, 5 AS n_replies FROM events GROUP BY user_id HAVING count(*) >= 5")
def stream_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1: full records of five per user from a file stream."""
    records = _collated(spark, sf_dir, f"{checkpoint_root(spark)}/rungwise/collate-{uuid.uuid4().hex}")
    return records.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_records"), F.max(F.size("generation")).alias("n_replies")
    )


@query(
    """
SELECT CAST(user_id AS VARCHAR) AS id, CAST(ceil(count(*) / 5) AS BIGINT) AS n_records,
  CASE WHEN count(*) % 5 = 0 THEN 5 ELSE count(*) % 5 END AS least_replies, count(*) AS n_replies,
  CAST(sum(event_id) AS BIGINT) AS sum_events, min(event_id) AS first_event, max(event_id) AS last_event, count(DISTINCT event_type) AS n_answers
FROM events GROUP BY user_id
"""
)
def stream_with_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1: the streamed records of each user and what its state still held hold every reply once."""
    run = f"{checkpoint_root(spark)}/rungwise/collate-{uuid.uuid4().hex}"
    records = _collated(spark, sf_dir, run).unionByName(collate_left_over(spark, f"{run}/checkpoint"))
    sized = records.select("id", F.size("generation").alias("_n"), F.arrays_zip("generation", "extracted_answer").alias("_r"))
    # The first reply of a record stands for the record.
    replies = sized.select("id", "_n", F.posexplode("_r").alias("_at", "_p")).withColumn(
        "event", F.substring("_p.generation", 2, 20).cast("bigint")
    )
    return replies.groupBy("id").agg(
        F.count(F.when(F.col("_at") == 0, 1)).alias("n_records"),
        F.min("_n").cast("bigint").alias("least_replies"),
        F.count(F.lit(1)).alias("n_replies"),
        F.sum("event").alias("sum_events"),
        F.min("event").alias("first_event"),
        F.max("event").alias("last_event"),
        F.count_distinct("_p.extracted_answer").alias("n_answers"),
    )


@query("SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-2: users that are not finished yet, each written once."""
    run = f"{checkpoint_root(spark)}/rungwise/incremental-{uuid.uuid4().hex}"
    done = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    stream = _event_stream(spark, sf_dir).select(F.col("user_id").alias("id"))
    append_new(stream, done, f"{run}/out", f"{run}/checkpoint").awaitTermination()
    return spark.read.schema("id bigint").json(f"{run}/out")


@query(
    "SELECT CASE WHEN event_id % 7 > 0 THEN user_id END AS id, event_id FROM events "
    "WHERE event_id % 7 = 0 OR user_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"
)
def stream_every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-2: every row of a user that is not finished, rows without a user included."""
    run = f"{checkpoint_root(spark)}/rungwise/incremental-{uuid.uuid4().hex}"
    done = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    stream = _event_stream(spark, sf_dir).select(F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("id"), "event_id")
    append_new(stream, done, f"{run}/out", f"{run}/checkpoint", one_per_id=False).awaitTermination()
    return spark.read.schema("id bigint, event_id bigint").json(f"{run}/out")


@query(
    "SELECT DISTINCT CASE WHEN event_id % 7 > 0 THEN user_id END AS id FROM events "
    "WHERE event_id % 7 = 0 OR user_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"
)
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-2: each user that is not finished is written in one of several batches, without state."""
    run = f"{checkpoint_root(spark)}/rungwise/once-{uuid.uuid4().hex}"
    done = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    id_ = F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("id")
    table(spark, sf_dir, "events").select(id_).repartition(8).write.parquet(f"{run}/in")
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 2).parquet(f"{run}/in")
    append_once(stream, done, f"{run}/out", f"{run}/checkpoint").awaitTermination()
    return read_once(spark, f"{run}/out", "id bigint")


def _load_critic():
    """A prover that finds steps of even users valid, is short of words for one event type, and fails for one user."""

    def judge(batch):
        if (batch["user_id"] == 7).any():
            raise ValueError("no proof")
        even, error = batch["user_id"] % 2 == 0, batch["event_type"] == "error"
        return pd.DataFrame(
            {"semantic_ok": even & ~error, "syntactic_ok": ~error, "error_code": batch["event_type"].where(error, ""), "solving_time": batch["user_id"] / 4}
        ).assign(proof_tactics=[[t] for t in batch["event_type"]], code="theory", logical_information=None)

    return judge


_TWO_RUNS_SQL = """
WITH r AS (SELECT user_id, event_type, bool_or(event_id % 2 = 0) AS early FROM events GROUP BY ALL),
e AS (SELECT event_id, e.user_id, e.event_type, CASE WHEN early THEN 'first' ELSE 'second' END AS run FROM events e JOIN r USING (user_id, event_type))
"""


def _in_two_runs(spark: SparkSession, sf_dir: str, hook, schema: str, inputs: list[str], settings: str) -> DataFrame:
    """Results for the even events, and then for all, of which the second run only makes what is missing."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").withColumn("words", text(F.col("event_type"), " ", F.col("user_id")))
    store = f"{checkpoint_root(spark)}/rungwise/store-{uuid.uuid4().hex}"
    with_results(events.filter("event_id % 2 = 0"), hook, schema, inputs, store, settings, "first")
    return with_results(events, hook, schema, inputs, store, settings, "second")


@query(
    _TWO_RUNS_SQL
    + """
SELECT event_id, CASE WHEN user_id <> 7 THEN user_id % 2 = 0 AND event_type <> 'error' END AS semantic_ok,
  CASE WHEN user_id <> 7 THEN event_type <> 'error' END AS syntactic_ok, CASE WHEN user_id <> 7 THEN event_type END AS tactic,
  CASE WHEN user_id <> 7 THEN user_id / 4.0 END AS solving_time,
  CASE WHEN user_id = 7 THEN 'second' ELSE run END AS run, CASE WHEN user_id = 7 THEN 'ValueError: no proof' END AS error
FROM e
"""
)
def critique_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-2, SNK-4: verdicts kept over two runs; inputs that failed are tried again."""
    judged = _in_two_runs(spark, sf_dir, lambda rows: critique(rows, _load_critic), CRITIQUE, ["user_id", "event_type"], "critic-1")
    return judged.select("event_id", "semantic_ok", "syntactic_ok", F.get("proof_tactics", F.lit(0)).alias("tactic"), "solving_time", "run", "error")


@query(
    _TWO_RUNS_SQL
    + """
SELECT event_id, (3 / sqrt(9 + n * n))::FLOAT AS x, (n / sqrt(9 + n * n))::FLOAT AS y, run
FROM (SELECT *, length(event_type || ' ' || user_id) AS n FROM e)
"""
)
def embed_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-3: unit vectors of texts kept over two runs."""

    def load():
        return lambda texts: texts.map(lambda t: [3 / (9 + len(t) ** 2) ** 0.5, len(t) / (9 + len(t) ** 2) ** 0.5])

    vectors = lambda rows: rows.withColumn("embedding", embed(load)(F.col("words")))
    made = _in_two_runs(spark, sf_dir, vectors, "embedding array<float>", ["words"], "embedder-1")
    return made.select("event_id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"), "run")


@query(
    _TWO_RUNS_SQL
    + """
SELECT event_id, (length(event_type) * -0.5 - 0.25)::DOUBLE AS logprob, (user_id % 6 + 1)::DOUBLE AS certainty, event_type AS noun, 2 AS tokens, run FROM e
"""
)
def scores_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-4: log-probabilities, certainty, tags and token counts of texts kept over two runs."""
    first = lambda s: s.str.split(" ").str[0]
    hooks = {
        "logprobs": logprobs(lambda: lambda s: first(s).map(lambda w: [-0.5] * len(w) + [-0.25])),
        "certainty": certainty(lambda: lambda s: s.str.split(" ").str[1].astype(int) % 6 + 1.0),
        "concepts": tag(lambda: lambda s: first(s).map(lambda w: [w])),
        "tokens": token_count(lambda: lambda s: s.str.count(" ") + 1),
    }
    score = lambda rows: rows.withColumns({name: hook(F.col("words")) for name, hook in hooks.items()})
    made = _in_two_runs(spark, sf_dir, score, "logprobs array<double>, certainty double, concepts array<string>, tokens int", ["words"], "scorer-1")
    total = F.aggregate("logprobs", F.lit(0.0), lambda a, b: a + b)
    return made.select("event_id", total.alias("logprob"), "certainty", F.get("concepts", F.lit(0)).alias("noun"), "tokens", "run")
