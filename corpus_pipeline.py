"""The corpus pipeline: stages that each read all that their predecessor kept, from documents to token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.llm import shared
from credsieve.llm.bpe import bpe_encode_decode
from credsieve.llm.decontamination import contaminated, contamination
from credsieve.llm.language import UNKNOWN, identify, train
from credsieve.llm.minhash import near_duplicates
from credsieve.llm.pii import DEMO_KEY, pseudonymise

#: A language is rejected where it is no more likely than all the others together.
LEAST_SCORE = 0.5
#: Near-duplicates: five words and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; those without letters or without a likely language go.

    Null and empty texts have no letters, so they go. Very long texts are judged whole, repeated rows alike. Of equally likely
    languages the first counts. From an empty table, or one without a language, nothing is learned and no document stays.
    """
    found = identify(docs, train(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, rows without an id last.

    Of rows that repeat id and text one stays, the first by its other columns as JSON. Texts that are null, empty or without words
    are in no group and all stay. Very long texts are compared whole; a similarity of just 0.8 links. An empty table stays empty.
    """
    keys = near_duplicates(docs, SHINGLE, PERCENT).where("first").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), (F.col("n_shingles") == 0).alias("_alone"))
    kept = keys.where("not _alone").groupBy("_id", "_digest").agg((F.count("*") > 1).alias("_often"))
    kept = kept.unionByName(keys.where("_alone").select("_id", "_digest", F.lit(False).alias("_often")).distinct())
    kept, _ = shared.stash(kept, "kept")
    own = docs.withColumn("_own", F.xxhash64(F.col("text").cast("string")))
    rows = own.join(kept, own["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")))
    once = rows.where("not _often").select(*docs.columns)
    if kept.where("_often").isEmpty():
        return once
    least = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*(c for c in docs.columns if c != "text")))).alias("row")
    return once.unionByName(rows.where("_often").groupBy("_id", "_digest").agg(least).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to half of its words or more.

    Null and empty texts hold none, so they stay. Very long texts are searched whole; an item of which just half is covered counts.
    Repeated rows stay or go together. An empty table stays empty.
    """
    found = contamination(docs, shared.table(spark, sf_dir, "benchmark"))
    return found.where(~contaminated(F.col("items"))).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows the text.

    Null texts stay null, with a null n_chars, and empty ones empty. Very long texts are searched whole. Equal values get equal
    pseudonyms, in repeated rows, too. An empty table stays empty.
    """
    done = pseudonymise(docs, DEMO_KEY)
    return done.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of every document.

    Null and empty texts have no ids and an empty text. Very long texts are encoded whole. Repeated rows give a row each. Equal
    texts have equal ids. An empty table gives no rows.
    """
    found = bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("tokens", tokens)]

#: Models, hashes and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = {"pipeline": None}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again.

    What a stage held in the shared folder is deleted when its result is written, and that when the next one's is; the last
    stage's result stays for the caller.
    """
    docs, before = shared.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = f"{shared.shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with shared.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        shared.forget(spark, *before)
        docs, before = spark.read.parquet(path), [path]
    return docs


QUERIES = {"pipeline": run}
