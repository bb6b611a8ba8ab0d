"""The corpus operators as queries over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.bridges import table
from rungwise.llm import (
    centroids,
    exact_dedup,
    html_extract,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    periodic_runs,
    secrets,
    token_counts,
    topk_search,
    warc,
)
from rungwise.queries.registry import QueryFunction

LLM_QUERIES: dict[str, QueryFunction] = {}
LLM_ORACLES: dict[str, str] = {}


def corpus_query(sql: str | None = None):
    """Register a function under its own name."""

    def add(function: QueryFunction) -> QueryFunction:
        LLM_QUERIES[function.__name__] = function
        if sql is not None:
            LLM_ORACLES[function.__name__] = sql
        return function

    return add


@corpus_query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 8,192 code points; near copies and one source never meet."""
    return packing.pack_apart(table(spark, sf_dir, "documents"))


@corpus_query()
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


@corpus_query(topk_search.search_sql())
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every vector whose id is divisible by 50."""
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@corpus_query()
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 80 % of their four-word shingles."""
    return near_dedup.near_components(table(spark, sf_dir, "documents"), width=4, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


@corpus_query(exact_dedup.EXACT_GROUPS_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@corpus_query(mixing.MIX_SQL)
def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to shares of the square root of their source's size, as many as before."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "row.source", "row.text", "copy", "n_copies")


@corpus_query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with credentials that are linked from several parts."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@corpus_query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public 32k vocabulary, read as a unigram model."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@corpus_query()
def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@corpus_query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out(F.col("doc_id"))
    lists = language_id.learn_profiles(docs.filter(~held))
    predicted = language_id.predict(docs.select("doc_id", "text"), lists)
    return predicted.select("row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@corpus_query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document, of at least four periods and six words."""
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", periodic_runs.plant_runs(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic_runs.run_digests(periodic_runs.find_runs(planted))


@corpus_query(centroids.cluster_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 40 clusters after five rounds."""
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("scans")


@corpus_query(line_dedup.LINE_SQL)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents hold."""
    return line_dedup.line_digests(line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")))
