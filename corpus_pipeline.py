"""From raw documents to training pieces: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termlens.llm import common, curriculum, dartminhash, disclosure, nbest, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score (fitted on the labels beside the documents) rejects go.

    Null texts score as empty ones. Null ids, repeated rows and all columns stay as they are; an empty table stays empty.
    """
    score = toxicity.scorer(spark, toxicity.learn(spark, sf_dir, docs))
    return docs.where(score("text") < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays.

    Null texts are copies of empty ones; null ids come last; of equal rows one stays. An empty table stays empty.
    """
    return dartminhash.one_of_each(docs)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that give it away are replaced; every document stays.

    Null texts stay null; repeated rows and null ids keep their row; an empty table stays empty.
    """
    return disclosure.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets, in training order.

    Texts without a word (null ones too) have nothing to train on and go; a null source is a source. An empty table stays empty.
    """
    return curriculum.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, with the other segmentations of the four best.

    Null texts have no pieces; repeated rows and null ids keep their row; an empty table gives an empty result.
    """
    return nbest.encode_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", remove_pii),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Hashing, a fitted lexicon and segmentation aren't for SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is cut off in the shared checkpoint folder."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
