"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, extra ones included, whatever their names.  Its result is written as
Parquet and reread as the next one's docs.  An empty table passes through every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicant.llm import quality, sentencepiece_codec, toxicity
from indicant.llm.common import drop_stored, packed, shared_dir, stored, table
from indicant.llm.decontaminate import decontaminate
from indicant.llm.near_dedup import near_duplicates
from indicant.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger does not reject.

    It is trained on the labels of rows that are not held out.  Null and empty texts have no
    toxic word and stay; null ids and repeated rows are judged row by row; without labels of
    two classes everything gets the base rate, which rejects nothing unless all are toxic.
    """
    tagger = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(packed(docs, ["text"]), tagger, keep=["__doc"]).filter("predicted = 0").select("__doc.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null texts count as empty, null or missing metadata as a value of its own; null ids and
    repeated rows are judged row by row; without labels everything counts as good.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(packed(docs, ["text", *quality.META]), model, keep=["__doc"]).filter("predicted = 1").select("__doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    Texts without words are no copies of each other.  Of rows that repeat an id and its text,
    one stays; rows that repeat an id with other texts count as one document and stay or go
    together.  Rows without an id belong to no group; of equal texts among them one stays.
    """
    copies = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__copy")).distinct()
    left = docs.join(copies, docs.doc_id == copies["__copy"], "left_anti")
    again = docs.groupBy(docs.doc_id.alias("__id")).count().filter("count > 1").select("__id")
    if not again.limit(1).count():
        return left
    same = left.doc_id.eqNullSafe(again["__id"])
    return left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    Null and empty texts hold none and stay; null ids and repeated rows are judged row by row;
    null items have no window; an empty benchmark rejects nothing.
    """
    found = decontaminate(packed(docs, ["text"]), table(spark, sf_dir, "benchmark"), keep=["__doc"])
    return found.filter(~F.col("contaminated")).select("__doc.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled token ids of each document and whether they decode to its very text.

    Null texts count as empty and have no pieces; rows of equal id and text get the same
    pieces; the row's id, null included, seeds its draws.
    """
    model = tokenizer("piece_bpe_32k.model")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = sentencepiece_codec.encode_texts(text, model, keep=["doc_id", "text"])
    decoded = sentencepiece_codec.decode_texts(encoded.select("doc_id", "text", "ids", "n_pieces", F.col("ids").alias("packed")), model)
    return decoded.select("doc_id", "n_pieces", F.col("packed").alias("ids"), (F.col("decoded") == F.col("text")).alias("lossless"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_dedup", drop_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", tokenize),
]

#: The classifiers and the sampled segmentation are beyond SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, where, name)
            if k:
                drop_stored(spark, f"{where}/{STAGES[k - 1][0]}")
    return docs
