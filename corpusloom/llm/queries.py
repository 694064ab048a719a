"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .decontaminate import benchmark_hits
from .divergence import divergence_audit
from .embeddings import embedding_groups
from .fim import fill_in_middle, restored
from .hilbert import shard_documents
from .lines import line_dedup
from .mixing import mix
from .quality import score_quality
from .repeats import remove_repeats
from .simhash import simhash_groups
from .sql import ORACLES
from .toxicity import score_toxicity
from .url_filter import canonical_url, judge_urls
from .warc import resolve_revisits

__all__ = ["QUERIES", "ORACLES"]


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of every page: its full response at second ``page_id``, and a not-modified revisit some time later.

    The revisit has the page's entity tag; its delay, up to 4095 seconds, comes from the url.
    """
    base = pages.select("page_id", canonical_url(F.col("url")).alias("url"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.coalesce("url", F.lit("")).alias("raw"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    delay = F.conv(F.substring(F.md5(F.col("raw").cast("binary")), 1, 3), 16, 10).cast("long") + 1
    text = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    stored = text("Content-Type", "text/html", "Content-Length", F.length("raw").cast("string"), "ETag", tag, "Date", F.col("page_id").cast("string"), "Server", "origin")
    fresh = text("Content-Length", "0", "ETag", tag, "Date", (F.col("page_id") + delay).cast("string"), "Cache-Control", "max-age=60")
    one = lambda kind, ts, headers: F.struct(F.concat(F.lit(f"{kind}-"), F.col("page_id").cast("string")).alias("record_id"), ts.cast("long").alias("ts"), F.lit(kind).alias("kind"), headers.alias("headers"))
    both = base.select("url", "digest", F.explode(F.array(one("response", F.col("page_id"), stored), one("revisit", F.col("page_id") + delay, fresh))).alias("r"))
    return both.select("r.record_id", "url", "r.ts", "r.kind", "r.headers", F.when(F.col("r.kind") == "response", F.col("digest")).alias("digest"))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.get(F.map_values(F.map_filter("headers", lambda a, b: a == k)), F.lit(0))))
    page = lambda c: F.regexp_extract(c, "[0-9]+$", 0).cast("long")
    return resolved.select(page("record_id").alias("page_id"), "url", "ts", page("response_id").alias("response_page_id"), "response_ts", "outcome", "digest", F.when(F.col("outcome") == "resolved", F.array_join(lines, "; ")).alias("headers"))


def op2_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), radius=2, words_per_shingle=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The mixture's tree: domains by the source's number, their weights, and those of languages; sources of a node weigh alike.
DOMAINS = {"web": 0.4, "books": 0.3, "forums": 0.2, "reference": 0.1}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def mixture_levels(others: float = 0.0) -> tuple[dict, list]:
    """The tree's levels and the weights at each; others: the weight of each other language, and of none."""
    number = F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("long"), F.lit(0)) % len(DOMAINS)
    domain = F.get(F.array(*map(F.lit, DOMAINS)), number.cast("int"))
    by = lambda c, weights: F.coalesce(F.get(F.array(*(F.lit(w) for w in weights.values())), F.array_position(F.array(*map(F.lit, weights)), F.col(c)).cast("int") - 1), F.lit(others))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}, [by("domain", DOMAINS), by("lang", LANGUAGES), F.lit(1.0)]


def op8_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, weights = mixture_levels()
    return mix(table(spark, sf_dir, "documents"), levels, weights, fraction=0.5, epochs=2).drop("text_hash")


#: The rules of the contract, and hosts that the list blocks with all below them.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
LISTED_HOSTS = ["ads-track.example.com", "casino-win.example.net", "spam-farm.example.org", "adult-x.example.com", "cheap-pills.example.net", "free-bets.example.net"]


def url_entries(spark: SparkSession) -> DataFrame:
    rows = [(h, p, a, True) for h, p, a in URL_RULES] + [(h, "", "block", False) for h in LISTED_HOSTS]
    names = ("host", "path", "action", "ruled")
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows))))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_entries(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"), seed=1)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"), min_docs=3, top=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_rule_quality": op2_rule_quality,
    "op3_simhash": op3_simhash,
    "op4_cgk_decontamination": op4_cgk_decontamination,
    "op5_hilbert_sharding": op5_hilbert_sharding,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_weak_toxicity": op7_weak_toxicity,
    "op8_budget_mixing": op8_budget_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_line_winnowing": op10_line_winnowing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_suffix_repeats": op12_suffix_repeats,
    "op13_source_divergence": op13_source_divergence,
}
