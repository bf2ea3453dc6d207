"""A corpus pipeline: five stages from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. Near duplicates are judged after exact ones are gone, the benchmark's passages are looked for in what is left, and the mix is computed over the final documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate as decontamination
from weftgraph.llm import exact_dedup as exact
from weftgraph.llm import mixing, near_dups
from weftgraph.llm import toxicity as toxic
from weftgraph.llm.common import discard, materialised

#: Not expressible in SQL as a whole: the toxicity model is trained. Tested against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects (score of 0.5 or more) go. Null and empty texts score by the bias alone, repeated rows alike;
    without labels none goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxic.toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest stays, of these the one with the smallest id; rows that repeat in both are
    one document. Null and empty texts are equal to each other."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that share four fifths of their five-word shingles, the one with the smallest id stays. Documents
    without words all stay."""
    return near_dups.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Null and empty texts are clean; without items all are."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontamination.decontaminate(docs, items).where("not contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the words it takes of each: a document taken twice has twice its size. Documents without words are
    not in the mix; rows that repeat share their words."""
    return mixing.mix_sources(docs).where(F.col("taken") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's result is written to the shared folder and read again, and removed once
    its successor's is written. Empty documents, benchmark or labels make stages keep what they get."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = materialised(stage(spark, docs, sf_dir))
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
