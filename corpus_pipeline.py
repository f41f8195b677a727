"""A training-data pipeline over documents: toxicity, language, near duplicates, packing.

Each stage works on all that the one before kept. Its result is written as Parquet and read again as the next one's input.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import jaccard, language, packing, toxicity
from faultline.llm.common import fold, table
from faultline.session import new_folder


_OWN = ("doc_id", "text")


def _held(docs: DataFrame) -> DataFrame:
    """Ids and texts beside the rest of their rows in one struct: operators replace columns that are named as their results."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in _OWN]
    return docs.select(*_OWN, *([F.struct(*rest).alias("row")] if rest else []))


def _rows(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(c if c in _OWN else f"row.`{c}`").alias(c) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from four of five folds, does not call toxic."""
    model = toxicity.learn(docs.filter(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    return _rows(toxicity.score(_held(docs), model).filter("predicted = 0"), docs)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are texts of one of the learned languages; all of them where no language could be learned.

    Documents without letters go, and those whose n-grams fit no learned language: noise and languages and scripts not learned.
    """
    model = language.learn(docs.filter(fold("doc_id", 4) != 2))
    if not model[0]:
        return docs
    return _rows(language.predict(_held(docs), model).filter(language.in_language()), docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents with similar sets of five words."""
    return _rows(jaccard.similarity_classes(_held(docs)).filter("kept"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of the documents, in pieces of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("language", in_a_language),
    ("ngram_jaccard", without_near_copies),
    ("packing", packed),
]

#: SQL cannot express the learned stages and the tokenizer; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
