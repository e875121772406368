"""A corpus through quality filtering, two kinds of deduplication, decontamination and tokenisation.

Each stage takes what its predecessor kept, as it was written, and all but the last return the columns of
documents. Stage by stage:

1. quality: documents that score below 0.3 go (op2's classifier, taught as there).
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. near_dedup: of documents linked by 5-word shingles with a Jaccard similarity of 0.8 or more, directly or
   through others, the smallest doc_id stays.
4. decontamination: documents that hold a benchmark item, verbatim or edited, go.
5. bpe: the ids of every remaining text, and the text they decode to.

An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyshelf.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from tallyshelf.llm.common import documents, keep, passing
from tallyshelf.llm.queries import tokenizer_file
from tallyshelf.sources.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs, pick="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", tokenise),
]

#: The first stage votes among neighbours, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; every stage's rows are written to the shared folder and read again, what else it wrote there goes."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with passing(spark) as own:
            docs = keep(stage(spark, docs, sf_dir), name)
            own.pop()
    return docs
