"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import ann, byte_bpe, licenses, packing, pii, quality_classifier, quality_rules, simhash, toxicity, url_filters
from stemma.llm._common import read


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.train(docs)).withColumn("sure", F.expr("filter(licences, x -> x.confirmed)"))
    return found.select(
        "doc_id",
        F.col("n_paragraphs").cast("long").alias("n_paragraphs"),
        F.size("licences").cast("long").alias("n_predicted"),
        F.size("sure").cast("long").alias("n_confirmed"),
        F.nullif(F.array_join(F.array_sort(F.array_distinct("sure.family")), ","), F.lit("")).alias("families"),
        F.array_max("sure.probability").alias("probability"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    ranks = vocab.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.encode(read(spark, sf_dir, "documents"), ranks, vocab.PATTERN)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    digests = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return byte_bpe.decode(digests, ranks, keep_ids=False).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), vocab.path("word_bpe_49k.json")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents")), quality_rules.STRICT)
    base = quality_rules.fails(quality_rules.BASE)
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(quality_rules.ledger(read(spark, sf_dir, "documents")), quality_rules.STRICT)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, toxicity.labelled_rows(docs, read(spark, sf_dir, "labels"), "quality", 4, 2))
    return quality_classifier.score(docs, model).select("doc_id", toxicity.held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.labelled_rows(docs, read(spark, sf_dir, "labels"), "toxic", 5, 0))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents")).withColumnRenamed("k", "doc_id")
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {n})")).cast("long").alias(f"n_{kind}") for n, kind in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.spelled("base"), 256).alias("base_sha256"), pii.spelled("all").alias("spans"))


URL_RULES = [
    url_filters.Rule("allow", "org", "/"),
    url_filters.Rule("block", "example.org", "/es/"),
    url_filters.Rule("block", "example.org", "/en/1"),
    url_filters.Rule("allow", "com", "/fr/"),
    url_filters.Rule("block", "com", "/de/"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict:
    return {f.__name__: f for f in (op1_licenses, op2_byte_bpe, op3_packing, op4_simhash, op5_nearest, op6_quality_rules, quality_ablation, op7_quality_classifier, op8_toxicity, op9_pii, op10_url_filters)}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality_rules.ledger_sql(), "quality_ablation": quality_rules.ablation_sql(), "op10_url_filters": url_filters.judge_sql(URL_RULES)}
