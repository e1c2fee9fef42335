"""The corpus pipeline: five of the training-data operators over ``documents``, each stage over all that the last one kept.

1. toxicity: documents that the noisy-or model predicts toxic go; the model learns from ``labels``.
2. near_duplicates: of each component of the n-gram Jaccard join (five-word shingles, similarity 0.8) the smallest id stays.
3. repeated_passages: strings of 400 bytes that occur more than once among the documents that are left are cut out, and so are
   passages of over 50 words that stand in more than one of them; documents stay, shorter.
4. mixture: sources are replicated to target weights; a document may come several times or, by its draw, not at all.
5. packing: token sequences of at most 1024, one row for each piece.

Every stage goes by rows: repeated ids and rows without one are documents of their own, told apart by id and text. Nulls and
empty texts go through as each operator defines it (not toxic, copies of nothing, nothing to cut, a draw by the id, one end
token). Extra columns, whatever their names, are kept up to the last stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pluvia.llm.common import discard, stored, table
from pluvia.llm.jaccard_join import one_of_each
from pluvia.llm.mixing import replicated
from pluvia.llm.packing import packed_documents
from pluvia.llm.suffix_dedup import without_repeats
from pluvia.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, length=400, words=51)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return replicated(docs, "mix-1").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
            if last is not None:
                discard(last)  # the next stage reads this one's table only
            last = docs
    return docs
