"""Prover results kept as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.functions.prover import NO_PROOF, SYNTAX_ERRORS
from rungwise.functions.text import strip


def verdicts(jobs: DataFrame, messages: DataFrame, vacuous: bool = False) -> DataFrame:
    """Verdict per job of ``jobs(job_id, finished)`` from ``messages(job_id, message)`` (PRV-1)."""
    broken = F.lit(False)
    for phrase in SYNTAX_ERRORS:
        broken = broken | F.contains("message", F.lit(phrase))
    seen = messages.groupBy("job_id").agg(
        F.bool_or(F.contains("message", F.lit(NO_PROOF))).alias("_refused"),
        F.bool_or(F.contains(F.lower("message"), F.lit(NO_PROOF.lower()))).alias("_failed"),
        F.bool_or(broken).alias("_broken"),
    )
    no = F.lit(False)
    spoken = F.lit(True) if vacuous else F.col("_refused").isNotNull()
    done = F.coalesce("finished", no)
    return jobs.join(seen, "job_id", "left").select(
        "job_id",
        (done & spoken & ~F.coalesce("_refused", no) & ~F.coalesce("_broken", no)).alias("semantic_validity"),
        (~(done & F.coalesce("_broken", no))).alias("syntactic_validity"),
        (done & spoken & ~F.coalesce("_failed", no)).alias("contradiction"),
    )


def attribute_errors(errors: DataFrame, code_lines: DataFrame) -> DataFrame:
    """Theory lines that errors point at (PRV-2, JON-5).

    ``errors(job_id, err_pos, line)`` and ``code_lines(job_id, line, text)`` meet on (job, line).
    An error on an axiom header means the next line, one on a theorem header the next four.
    """
    here = errors.join(code_lines, ["job_id", "line"]).select(
        "job_id",
        "err_pos",
        F.when(F.contains("text", F.lit("axiomatization where")), F.sequence(F.col("line") + 1, F.col("line") + 1))
        .when(F.contains("text", F.lit("hypothesis")), F.sequence(F.col("line") + 1, F.col("line") + 4))
        .otherwise(F.sequence(F.col("line"), F.col("line")))
        .alias("_lines"),
    )
    wanted = here.select("job_id", "err_pos", F.explode("_lines").alias("line"))
    return wanted.join(code_lines, ["job_id", "line"]).select(
        "job_id", "err_pos", "line", strip(F.col("text")).alias("text")
    )


def first_tactic(messages: DataFrame) -> DataFrame:
    """Proof step per job from the first fitting message of ``messages(job_id, msg_pos, message)`` (PRV-3)."""
    from rungwise.functions.prover import TRY_THIS, tactic

    offer = F.contains("message", F.lit(TRY_THIS))
    by_line = strip(F.col("message")).startswith("by")
    first = messages.groupBy("job_id").agg(
        F.min_by("message", F.when(offer, F.col("msg_pos"))).alias("_offer"),
        F.min_by("message", F.when(by_line, F.col("msg_pos"))).alias("_by"),
    )
    fitting = F.coalesce("_offer", "_by")
    return first.select(
        "job_id",
        F.when(fitting.isNotNull(), tactic(F.array(fitting))).alias("tactic"),
    )
