"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, chat_format, decontaminate, html_extract, mixing, near_dup, oracles, quality, secret_scan, substring_dedup, url_filter
from millrace.llm.common import table

# Rules of the URL filter, in the order of the contract.
URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)
#: The list of op10: what campaign links lead to, and every page on a host with one of these labels, as canonical URLs.
LISTED_QUERY, LISTED_HOSTS = r"[?&]utm_source=", r"(^|\.)(spam-|ads-|cheap-pills|casino-win)"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base rules, a digest of their spans, and all spans."""
    found = table(spark, sf_dir, "documents").select("doc_id", secret_scan.secrets(F.col("text")).alias("spans"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda span: span["kind"].isin(*kinds))

    base = of("assign", "access", "hex")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.scored(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_extract.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat_format.digests(chat_format.format_segments(turns.unionByName(extra))).drop("problem")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class and the links of every document: five words, Jaccard 0.8 or more."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of a mix by source: weights 3, 1, 2, 150 % of all words, at most 2 copies."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark")
    found = decontaminate.with_leaks(docs, items, "leaks").select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.*")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated windows of 35 words leave of every document."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=35)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = url_filter.host_of(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOSTS) | F.col("url").rlike(LISTED_QUERY)).select(url_filter.canonical(host, url_filter.path_of(F.col("url"))).alias("entry"))
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_quality": op2_quality, "op3_html_extract": op3_html_extract, "op4_chat_format": op4_chat_format, "op5_multi_index": op5_multi_index, "op6_ngram_jaccard": op6_ngram_jaccard, "op7_mixing": op7_mixing, "op8_decontaminate": op8_decontaminate, "op9_substring_dedup": op9_substring_dedup, "op10_url_filter": op10_url_filter}
ORACLES = {
    "op1_secret_scan": oracles.SECRETS,
    "op4_chat_format": oracles.CHAT,
    "op6_ngram_jaccard": oracles.NEAR,
    "op9_substring_dedup": oracles.REPEATS,
    "op10_url_filter": oracles.URLS,
}
