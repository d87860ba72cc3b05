"""The corpus pipeline: documents through the training-data operators.

``STAGES`` lists (name, function); each function takes
``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``.  All but the last return the
columns of documents.

1. quality: documents that the classifier scores below 0.3 go.
2. line_dedup: lines that occur in five documents or more stay in one; the
   texts and ``n_chars`` follow.  Documents stay, if need be without text.
3. near_dedup: one document of each group of near copies (five-word shingles,
   similarity 0.8) stays, and one row of those that repeat an id and a text.
4. mix: every document once, in the order of the mixing schedule; files read
   in their order follow the target weights.
5. bpe: token ids of every text, and the digest of the text decoded from them,
   in the order of the schedule, with each document's ``slot`` and ``place`` in it.

Null ids, null or empty texts, very long texts, repeated rows, empty tables and
further columns of any name are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollbook.llm import bpe, lines, minhash, mixing, quality
from rollbook.llm.common import spread, stored, table, text_of
from rollbook.llm.queries import tokenizer


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.cut(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length(text_of("text")).cast(docs.schema["n_chars"].dataType))
    return cut


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, words=5, percent=80)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Files are read in no set order, so the places are worked out anew; they pass by the tokenizer within the id.
    order = ["__slot", "__place"]
    placed = mixing.place(docs).select("doc_id", "text", *order).repartitionByRange(spread(spark), *order).sortWithinPartitions(*order)
    done = bpe.round_trip(placed.select(F.struct("doc_id", *order).alias("doc_id"), "text"), tokenizer("word_bpe_49k.json"))
    return done.select("doc_id.doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
                       F.col("doc_id.__slot").alias("slot"), F.col("doc_id.__place").alias("place"))


STAGES = [("quality", _quality), ("line_dedup", _line_dedup), ("near_dedup", _near_dedup), ("mix", _mix), ("bpe", _bpe)]

#: Trained scores, MinHash groups and token ids are beyond SQL; the stages are
#: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
