"""A training corpus from raw documents: quality, near duplicates, repeated passages, source mix, packing.

Every stage reads what the stage before wrote, and works on all of it; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civic_spark.llm import mixing, ngramjoin, packing, quality, substrings
from civic_spark.llm.common import shared_folder
from civic_spark.llm.queries import GOOD, word_tokenizer

#: No SQL says what a trained score, MinHash candidates, a seeded mix and a packing return.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores ``GOOD`` or more by a model learned from the labels that are not held out.

    NULL and empty texts are scored like any other; rows with NULL in other columns, without an id or with the id of another row
    are judged by their text alone. Repeated rows stay or go together. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~quality.held_out())
    # a struct keeps the row apart from the score, whatever its columns are called
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return quality.score(rows, model).where(F.col("score") >= GOOD).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word Jaccard similarity of 0.8 or more, that with the smallest doc_id.

    Texts without words, rows without an id, and rows of one id with unrelated texts stay; of repeated rows one stays. An
    empty table stays empty.
    """
    return ngramjoin.deduplicated(docs, n=5, least=0.8)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the windows of 35 words that stand in more than one place.

    No row goes, also not one that loses all its words; a repeated row is another place. NULL texts stay NULL, texts that lose
    nothing stay as they are. An empty table stays empty.
    """
    return substrings.cleaned(docs, size=35)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, twice at most; those it does not take go.

    A NULL source is one of the sources, the last. Texts without words (NULL, empty, white space) are taken as often as the
    whole passes over their source. Repeated rows are documents of their own. An empty table stays empty.
    """
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens.

    A NULL or empty text is one piece, its end id. Repeated rows have pieces of their own; a NULL id stays NULL. An empty
    table gives no pieces.
    """
    return packing.pack_documents(docs, word_tokenizer(), end_id=2, max_tokens=4096)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeated_passages),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; every stage before is written as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name.split()[0]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
