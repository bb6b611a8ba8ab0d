"""Step and generation rewards.

Flat tables are keyed by ``id``, ``gen_pos`` and ``step_pos``. ``id`` names the record a
generation came from; several records of one question are given their own ids first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.operators.ordering import (
    HEAVY_ROWS,
    block_keys,
    carry_last,
    heavy_keys,
    mark_heavy,
    tag_blocks,
    tag_heavy,
)
from rungwise.session import materialize

STEP_KEYS = ("id", "gen_pos", "step_pos")
BANK_TILE = 256
USED_STEPS = 64
GRID = 8
GENERATIONS_PER_BLOCK = 64
TOKENS_IN_ONE_ROW = 100_000

# The weights and the confidence prior.
PREMISE_WEIGHT = 0.5
LOGIC_WEIGHT = 0.5
REASONING_WEIGHT = 0.5
OUTCOME_WEIGHT = 0.5
PRIOR_MEAN = -3.0
PRIOR_STD = 1.5 + 1e-8
GAMMA = 2.0
WINSOR = 0.10
WINSOR_MIN_TOKENS = 5


def unit_clamp(c: Column) -> Column:
    """``c`` held to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def carry_conclusion(
    steps: DataFrame,
    hypothesis: str = "hypothesis",
    name: str = "previous_conclusion",
    per_generation: bool = False,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Conclusion each step may use as a premise (WIN-1).

    It is the last non-empty hypothesis of an earlier step that did not end its generation. The
    carry runs on across the generations of a record unless ``per_generation`` is set.
    """
    keys = ["id", "gen_pos"] if per_generation else ["id"]
    block = F.lit(0) if per_generation else F.floor(F.col("gen_pos") / GENERATIONS_PER_BLOCK)
    tagged = tag_blocks(steps, keys, block, heavy_rows)
    # A block holds whole generations, so the next row tells whether this one ends its generation.
    order = ["gen_pos", "step_pos"]
    inside = Window.partitionBy(*block_keys(keys)).orderBy(*order)
    ends = ~F.coalesce(F.lead("gen_pos").over(inside) == F.col("gen_pos"), F.lit(False))
    offered = tagged.withColumn(
        "_offered", F.when((F.col(hypothesis) != "") & ~ends, F.col(hypothesis))
    )
    return carry_last(offered, keys, order, "_offered", name).drop("_offered")


def _tile_maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Largest dot product of each used vector of a tile with the given vectors of another."""

    def matrix(vectors: pa.Array) -> np.ndarray:
        return np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)

    for batch in batches:
        tiles, best = [], []
        for used, given in zip(batch.column("used"), batch.column("given")):
            tiles.append(used.values)
            best.append((matrix(used.values.field("embedding")) @ matrix(given.values).T).max(axis=1))
        if tiles:
            rows = np.repeat(np.arange(len(tiles)), [len(t) for t in tiles])
            keys = [pa.concat_arrays([t.field(c) for t in tiles]) for c in ("gen_pos", "step_pos", "pos")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), *keys, pa.array(np.concatenate(best))],
                names=["id", "gen_pos", "step_pos", "pos", "sim"],
            )


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def _used_tiles(used: DataFrame) -> DataFrame:
    """Used premises of neighbouring steps in one list; neither many steps nor many premises make it long."""
    return (
        used.filter("embedding is not null")
        .groupBy("id", "gen_pos", F.floor(F.col("step_pos") / USED_STEPS).alias("_steps"), F.floor(F.col("pos") / BANK_TILE).alias("_premises"))
        .agg(F.collect_list(F.struct("gen_pos", "step_pos", "pos", "embedding")).alias("used"))
    )


def premise_grounding(
    steps: DataFrame,
    used: DataFrame,
    base: DataFrame,
    carried: DataFrame,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Premise validity per step (JON-4).

    ``used(id, gen_pos, step_pos, pos, embedding)`` are the premises a step names, ``base(id, pos,
    embedding)`` the given ones and ``carried(id, gen_pos, step_pos, embedding)`` the conclusion
    at hand. Each used premise counts with its best cosine, held to [0, 1]; a step counts with the
    mean. No premises give 1.0, nothing to compare with gives 0.0.

    Given vectors travel as tiles of at most ``BANK_TILE``, used ones as tiles of neighbouring steps
    of a generation. A pair of tiles is one product and gives one number per used
    premise, so the pairs of a record are never rows. A record with very many vectors of either
    kind is cut into a grid: each tile goes along one axis of it. Null vectors match nothing.
    """
    # Stored, so that both sides of the join cut the same records; twice a limited list.
    heavy = heavy_keys(used, ["id"], heavy_rows).union(heavy_keys(base, ["id"], heavy_rows)).distinct()
    heavy = materialize(heavy, "grounding-heavy")
    axis = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(GRID - 1))).otherwise(F.array(F.lit(0)))

    def on_grid(tiles: DataFrame, place: Column, own: str, other: str) -> DataFrame:
        return (
            mark_heavy(tiles, ["id"], heavy)
            .withColumn(own, F.when(F.col("_heavy"), F.pmod(place, F.lit(GRID))).otherwise(F.lit(0)).cast("int"))
            .withColumn(other, F.explode(axis))
            .drop("_heavy")
        )

    given_tiles = (
        base.filter("embedding is not null")
        .groupBy("id", F.floor(F.col("pos") / BANK_TILE).alias("_tile"))
        .agg(F.collect_list("embedding").alias("given"))
    )
    key_types = {f.name: f.dataType.simpleString() for f in used.schema}
    out = ", ".join(f"{c} {key_types[c]}" for c in (*STEP_KEYS, "pos")) + ", sim double"
    premise_keys = [*STEP_KEYS, "pos"]
    from_base = (
        on_grid(_used_tiles(used), F.xxhash64("gen_pos", "_steps", "_premises"), "_row", "_column")
        .join(on_grid(given_tiles, F.col("_tile"), "_column", "_row"), ["id", "_row", "_column"])
        .select("id", "used", "given")
        .mapInArrow(_tile_maxima, out)
    )
    from_carry = used.join(
        carried.withColumnRenamed("embedding", "_carried"), list(STEP_KEYS)
    ).select(*premise_keys, _dot(F.col("embedding"), F.col("_carried")).alias("sim"))
    unmatched = used.select(*premise_keys, F.lit(None).cast("double").alias("sim"))
    per_premise = (
        unmatched.unionByName(from_base)
        .unionByName(from_carry)
        .groupBy(*premise_keys)
        .agg(unit_clamp(F.coalesce(F.max("sim"), F.lit(0.0))).alias("sim"))
    )
    per_step = per_premise.groupBy(*STEP_KEYS).agg(F.avg("sim").alias("premise_validity"))
    return steps.join(per_step, list(STEP_KEYS), "left").withColumn(
        "premise_validity", F.coalesce("premise_validity", F.lit(1.0))
    )


def verdict_over_attempts(
    attempts: DataFrame, keys: Sequence[str] = STEP_KEYS, max_attempts: int = 3
) -> DataFrame:
    """Whether any of the first attempts proved the step, or at least was well formed (AGG-6)."""
    sound = F.coalesce("syntactic_ok", F.lit(False))
    proved = sound & F.coalesce("semantic_ok", F.lit(False))
    return (
        attempts.filter(F.col("attempt") < max_attempts)
        .groupBy(*keys)
        .agg(F.bool_or(proved).alias("proved"), F.bool_or(sound).alias("well_formed"))
    )


def logic_metrics(proved: Column, well_formed: Column, confidence: Column, stored: Column) -> Column:
    """Logic validity and its two flags; a stored validity overrides all (AGG-6)."""
    yes, no = F.lit(True), F.lit(False)

    def metrics(validity: Column, syntactic: Column, semantic: Column) -> Column:
        return F.struct(
            validity.cast("double").alias("logic_validity"),
            syntactic.alias("syntactic_ok"),
            semantic.alias("semantic_ok"),
        )

    return (
        F.when(stored.isNotNull(), metrics(stored, yes, yes))
        .when(proved, metrics(F.lit(1.0), yes, yes))
        .when(well_formed, metrics(F.lit(0.0), yes, no))
        .otherwise(metrics(unit_clamp(F.coalesce(confidence, F.lit(0.0))), no, no))
    )


def _quantile(ordered: Column, n: Column, p: float) -> Column:
    at = (n - 1) * F.lit(p)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def step_confidence(
    tokens: DataFrame,
    keys: Sequence[str] = STEP_KEYS,
    value: str = "logprob",
    in_one_row: int = TOKENS_IN_ONE_ROW,
) -> DataFrame:
    """Winsorised mean log-probability and confidence per step (AGG-7).

    Steps of ordinary size are sorted inside one row. Larger ones keep their values spread: see
    ``_large_means``. Null log-probabilities do not count.
    """
    # Steps too short to clamp always take the first way.
    limit = max(in_one_row, WINSOR_MIN_TOKENS - 1)
    tagged = tag_heavy(tokens.filter(F.col(value).isNotNull()), keys, limit)
    n = F.size("_values")
    clamped = F.when(
        n >= WINSOR_MIN_TOKENS,
        F.transform("_values", lambda v: F.greatest(F.col("_lo"), F.least(F.col("_hi"), v))),
    ).otherwise(F.col("_values"))
    small = (
        tagged.filter(~F.col("_heavy"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_values"))
        .withColumn("_lo", _quantile(F.col("_values"), n, WINSOR))
        .withColumn("_hi", _quantile(F.col("_values"), n, 1.0 - WINSOR))
        .select(
            *keys,
            n.cast("bigint").alias("n_tokens"),
            (F.aggregate(clamped, F.lit(0.0), lambda acc, v: acc + v) / n).alias("mean_logprob"),
        )
    )
    large = _large_means(tagged.filter("_heavy"), keys, value)
    return small.unionByName(large).withColumn("confidence", confidence_of(F.col("mean_logprob")))


def _large_means(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Winsorised means of steps with very many tokens.

    Values are counted by narrow ranges. The counts tell which ranges hold the four order
    statistics the two bounds are made of; only those ranges are ranked value by value, and all
    others enter the mean through their sums.
    """
    v = F.col(value).cast("double")
    binned = rows.select(*keys, v.alias("_v"), F.floor(v * 1024).alias("_bin"))
    in_key = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range in use; ranges are fixed in width, so their number does not follow the rows.
    bins = (
        binned.groupBy(*keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(in_key), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    )
    low_at, high_at = (F.col("_total") - 1) * F.lit(WINSOR), (F.col("_total") - 1) * F.lit(1.0 - WINSOR)
    wanted = [F.floor(low_at), F.ceil(low_at), F.floor(high_at), F.ceil(high_at)]
    holds = F.lit(False)
    for at in wanted:
        holds = holds | ((at >= F.col("_before")) & (at < F.col("_before") + F.col("_n")))
    ranked_bins = bins.filter(holds)
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v")
    # Equal values are folded first, so a range full of one value is one row.
    ranked = (
        binned.join(ranked_bins, [*keys, "_bin"])
        .groupBy(*keys, "_bin", "_v", "_before", "_total")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn(
            "_from",
            F.col("_before")
            + F.coalesce(
                F.sum("_c").over(in_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
    )
    picks = [
        F.max(F.when((at >= F.col("_from")) & (at < F.col("_from") + F.col("_c")), F.col("_v"))).alias(f"_q{i}")
        for i, at in enumerate(wanted)
    ]
    bounds = (
        ranked.groupBy(*keys, "_total")
        .agg(*picks)
        .withColumn("_lo", F.col("_q0") + (F.col("_q1") - F.col("_q0")) * (low_at - F.floor(low_at)))
        .withColumn("_hi", F.col("_q2") + (F.col("_q3") - F.col("_q2")) * (high_at - F.floor(high_at)))
        .select(*keys, "_lo", "_hi")
    )
    clamp = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col("_v")))
    # A range without an order statistic lies wholly below, between or above the bounds.
    plain = bins.filter(~holds).join(bounds, list(keys)).select(
        *keys,
        "_n",
        F.when(F.col("_sum") < F.col("_lo") * F.col("_n"), F.col("_lo") * F.col("_n"))
        .when(F.col("_sum") > F.col("_hi") * F.col("_n"), F.col("_hi") * F.col("_n"))
        .otherwise(F.col("_sum"))
        .alias("_s"),
    )
    ranked_part = ranked.join(bounds, list(keys)).select(
        *keys, F.col("_c").alias("_n"), (clamp * F.col("_c")).alias("_s")
    )
    return (
        plain.unionByName(ranked_part)
        .groupBy(*keys)
        .agg(F.sum("_n").alias("n_tokens"), (F.sum("_s") / F.sum("_n")).alias("mean_logprob"))
    )


def confidence_of(mean_logprob: Column) -> Column:
    """Squashed distance of a mean log-probability from the prior; 0.0 without tokens (AGG-7)."""
    z = (mean_logprob - F.lit(PRIOR_MEAN)) / F.lit(PRIOR_STD)
    return F.coalesce(F.tanh(F.lit(GAMMA) * z), F.lit(0.0))


def soft_score(confidence: Column) -> Column:
    """Half-weight score for a step no check could read (AGG-8)."""
    return F.greatest(F.lit(0.0), (confidence + 1.0) / 2.0) * 0.5


def step_score(premise_validity: Column, logic_validity: Column) -> Column:
    """Weighted step score (AGG-5)."""
    return F.lit(PREMISE_WEIGHT) * premise_validity + F.lit(LOGIC_WEIGHT) * logic_validity


def outcome_score(final_tag: Column, gold: Column, missing_match: bool = False) -> Column:
    """1.0 for an exact match of the trimmed answers.

    Two missing answers do not match unless ``missing_match`` is set.
    """
    from rungwise.functions.text import strip

    tag, want = strip(F.coalesce(final_tag, F.lit(""))), strip(F.coalesce(gold, F.lit("")))
    hit = tag == want
    if not missing_match:
        hit = hit & (tag != "")
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def generation_rewards(
    generations: DataFrame, step_metrics: DataFrame, missing_match: bool = False
) -> DataFrame:
    """Reward per generation with its step metrics in order (AGG-5).

    ``generations(id, gen_pos, final_tag, gold, ..)``; ``step_metrics`` has the step keys,
    ``premise_validity`` and the columns of ``logic_metrics``. A generation's steps come from one
    text, so the collected list is no longer than the text was.
    """
    metric = F.struct(
        "step_pos",
        F.struct(
            "premise_validity",
            "logic_validity",
            step_score(F.col("premise_validity"), F.col("logic_validity")).alias("step_score"),
            "syntactic_ok",
            "semantic_ok",
        ).alias("metric"),
    )
    per_generation = step_metrics.groupBy("id", "gen_pos").agg(
        F.avg(step_score(F.col("premise_validity"), F.col("logic_validity"))).alias("reasoning_score"),
        F.array_sort(F.collect_list(metric)).alias("_steps"),
    )
    return (
        generations.join(per_generation, ["id", "gen_pos"], "left")
        .withColumn("reasoning_score", F.coalesce("reasoning_score", F.lit(0.0)))
        .withColumn("outcome_score", outcome_score(F.col("final_tag"), F.col("gold"), missing_match))
        .withColumn(
            "reward",
            unit_clamp(
                F.lit(REASONING_WEIGHT) * F.col("reasoning_score")
                + F.lit(OUTCOME_WEIGHT) * F.col("outcome_score")
            ),
        )
        .withColumn("step_validity", F.transform("_steps", lambda s: s["metric"]))
        .drop("_steps")
    )


def record_rewards(generations: DataFrame) -> DataFrame:
    """Reward and step-metric lists per record, in generation order.

    The group is one input record, whose generations arrived in one row.
    """
    listed = F.array_sort(F.collect_list(F.struct("gen_pos", "reward", "step_validity")))
    return generations.groupBy("id").agg(listed.alias("_g")).select(
        "id",
        F.transform("_g", lambda g: g["reward"]).alias("reward_score"),
        F.transform("_g", lambda g: g["step_validity"]).alias("per_step_validity"),
    )
