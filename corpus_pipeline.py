"""A corpus from raw documents to token ids, in five stages of the numbered operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm.bpe import encode_texts
from wavemill.llm.common import modest_batches, packed, shared_folder, table, unpacked
from wavemill.llm.decontaminate import find_leaks
from wavemill.llm.jaccard import ROW_KEY, jaccard_join, row_key
from wavemill.llm.language import UNKNOWN, fit, has_letter, predicted
from wavemill.llm.substrings import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no text, no letter) go; language and score don't filter.

    Where no document has a language to learn from, the same documents go. Null and empty texts go, very
    long ones are read whole; null ids, languages and sources and repeated rows stay as they are; an empty
    table stays empty; columns other than those of documents are left out."""
    modest_batches(spark)
    net = fit(docs)
    if net is None:
        return docs.where(has_letter("text")).select(*COLUMNS)
    read = docs.select(*COLUMNS, predicted(net)(F.col("text")).alias("p"))
    return read.where(F.col("p.lang_pred") != UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one of smallest doc_id stays (a null id is the smallest; ties: the text's hash).

    Repeated rows of an id and text stay once, the same text under several ids stays once, and so do null
    and empty texts of one id, which are like no other. An empty table stays empty; columns other than
    those of documents are left out. Texts travel compressed."""
    modest_batches(spark)
    first = jaccard_join(docs).where("chosen").select(*ROW_KEY).distinct()
    rest = [c for c in COLUMNS if c != "text"]
    own = docs.select(*row_key(), packed("text").alias("packed"), *rest)
    return own.join(first, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY).select(*[unpacked("packed").alias(c) if c == "text" else F.col(c) for c in COLUMNS])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that started earlier go; other texts stay as they are, and n_chars is that of the text that stays.

    Null and empty texts, and texts of fewer words than a window, stay. Repeated rows of an id and text are
    not earlier than each other. An empty table stays empty; columns other than those of documents are left out."""
    modest_batches(spark)
    out = dedup_substrings(docs, COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text).cast("long"), F.col("n_chars")).alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, by their texts: a leak says nothing of another text of the same or no doc_id.

    Null and empty texts stay, repeated rows go or stay together, an empty benchmark lets all stay; an
    empty table stays empty; columns other than those of documents are left out."""
    modest_batches(spark)
    own = docs.select(*row_key(), *COLUMNS)
    leaks = find_leaks(own, table(spark, sf_dir, "benchmark"), keep=tuple(ROW_KEY)).select(*ROW_KEY).distinct()
    return own.join(leaks, ROW_KEY, "left_anti").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and digests of them and of what they decode to, in place of the text.

    Null and empty texts have no ids; every row, repeated ones too, has its own; an empty table stays empty."""
    modest_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = encode_texts(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "n_chars"))
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("byte_bpe", token_ids),
]

#: A trained network and a vocabulary file decide what comes out: no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
