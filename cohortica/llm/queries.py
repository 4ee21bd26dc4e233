"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.llm import chat, decontaminate, jaccard, langid, lines, oracle, packing, quality, recompress, runs, search, suffixes, tokens, warc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.dedup_words(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(_docs(spark, sf_dir), k=3, percent=90)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(_docs(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.shards(tokens.training_order(tokens.sequences(_docs(spark, sf_dir), VOCABULARY)))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return packing.pack(docs, clusters=jaccard.memberships(docs, k=3, percent=90))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_docs(spark, sf_dir)).drop("rejected_by")


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rivals(_docs(spark, sf_dir, "conversations"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_docs(spark, sf_dir), _docs(spark, sf_dir, "benchmark"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_docs(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.with_tails(_docs(spark, sf_dir)))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"), "runs", "collapsed")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return rows.select(
        "doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"), F.expr("-b.l * 1000 div b.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_docs(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_docs(spark, sf_dir), _docs(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
        op1_recompression,
        op2_ngram_jaccard,
        op3_suffix_dedup,
        op4_training_order,
        op5_best_fit_packing,
        op6_preference_pairs,
        op7_decontamination,
        op8_language_id,
        op9_fuzzy_lines,
        op10_quality_rules,
        op11_periodic_runs,
        op12_warc_salvage,
        op13_ranked_search,
    )
}
#: Without SQL: tests/llm holds op3, op5 and op9 against brute force, op4 by round trip and op8 by held-out accuracy.
ORACLE: dict[str, str] = {"op1_recompression": oracle.OP1, "op2_ngram_jaccard": oracle.OP2, "op6_preference_pairs": oracle.OP6, "op7_decontamination": oracle.OP7, "op10_quality_rules": oracle.OP10, "op11_periodic_runs": oracle.OP11, "op12_warc_salvage": oracle.OP12, "op13_ranked_search": oracle.OP13}
