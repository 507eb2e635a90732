"""Documents to packed training sequences.

STAGES are five functions of (spark, docs, sf_dir), each over all that the one before it kept:

1. quality_classifier: documents scored under 0.7 go.
2. quality_rules: documents that fail a rule of the policy go.
3. near_dedup: of each group of near-duplicates the one with the smallest id stays; of rows equal in id and text the one
   whose JSON is smallest.
4. pii: found personal data is replaced by its kind in angle brackets, and n_chars is counted anew.
5. packing: the texts as pieces of packed sequences.

All but the last return the columns of their input. Null texts are read as empty; repeated rows are one group in
stage 3; empty tables pass through; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import packing, pii, quality_classifier, quality_rules, simhash, toxicity
from stemma.llm._common import materialise, plain_text, read, release

#: What SQL cannot express here: the trained models, the fingerprints and the packing.
ORACLE_SQL = None

KEEP_SCORE = 0.7


def _whole(docs: DataFrame) -> DataFrame:
    """The text, and each row as one column."""
    return docs.select(plain_text("text").alias("t"), F.struct(*docs.columns).alias("row"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, toxicity.labelled_rows(docs, read(spark, sf_dir, "labels"), "quality", 4, 2))
    return quality_classifier.scored(_whole(docs), model).where(F.col("score") >= KEEP_SCORE).select("row.*")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.measured(_whole(docs)).where(~quality_rules.fails(quality_rules.STRICT)).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A key of the id and the text: repeated ids with other texts are other rows. The hash of both spreads copies.
    key = F.struct(F.col("doc_id"), F.xxhash64("doc_id", plain_text("text")).alias("h"))
    found = simhash.group(docs.select(key.alias("key"), "text"), id_col="key", text_col="text")
    winners = found.where(F.col("key") == F.col("component_id")).groupBy("key").agg(F.count("*").alias("n"))
    winners = winners.select(F.col("key.h").alias("h"), F.col("key.doc_id").alias("winner"), "n")
    rows = docs.select(F.struct(*docs.columns).alias("row"), key["h"].alias("h"))
    kept = rows.join(winners, (rows["h"] == winners["h"]) & F.col("row.doc_id").eqNullSafe(F.col("winner"))).select("row", rows["h"].alias("h"), "n")
    once = kept.where("n = 1").select("row.*")
    copies = kept.where("n > 1").groupBy("h").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.unionByName(copies)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = F.struct(*(c for c in docs.columns if c != "text"))
    found = pii.find(docs.select("doc_id", "text", rest.alias("row")), keep=("row",), with_text=True)
    clean = found.select("row", F.when(F.size("all") > 0, pii.redact(found)).otherwise(F.col("t")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return packing.pack(packing.pieces(docs, vocab.path("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        release(before)  # the tables of documents were not written here and stay
    return STAGES[-1][1](spark, docs, sf_dir)
