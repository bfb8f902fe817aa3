"""A corpus through five stages, each written as Parquet and read again as the next one's documents.

Edge cases hold for every stage: nulls in any column, empty and very long texts and repeated rows pass
as their operators state, and each stage's docstring says what becomes of rows with a null or repeated id; an
empty table stays empty; extra columns are kept by the first four.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet.llm import bpe, decontam, jaccard, linededup, store, toxicity
from velonet.llm.queries import vocabulary
from velonet.sources.shared import on_worker_path

#: None: no stage but the second can be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5; it learns from the labels of documents not held out.

    Rows are judged one by one, so null and repeated ids make no difference; null and empty texts are no evidence and stay.
    """
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.reject(docs, toxicity.fit(corpus, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of three lines or 50 words are cut, and n_chars made anew; a document of which nothing is left goes.

    Rows with a null id stay as they are; rows of one id and one text are cut alike.
    """
    cut = linededup.dedup_lines(docs)
    kept = cut.filter((F.col("n_removed") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (0.8 or more) the smallest doc_id stays.

    Rows with a null id stay; rows of one id stay if one of them does.
    """
    groups = jaccard.jaccard_components(docs, width=5, percent=80)
    gone = groups.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or edited, go. Rows with a null id stay; rows of one id stay or go together."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, and n_tokens, ids_sha256 and decoded_sha256: what the ids decode to is the text. Each row has its own; other columns go."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.encode(docs, vocabulary(), keep=tuple(keep), digest=True)


def _ready(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        on_worker_path(spark)
        store.bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [("toxicity", _ready(drop_toxic)), ("line dedup", _ready(drop_lines)), ("n-gram Jaccard join", _ready(drop_near_copies)), ("benchmark decontamination", _ready(drop_leaks)), ("byte-level BPE", _ready(tokenise))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = store.made()
    for name, stage in STAGES:
        docs = store.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        store.clear(spark, mark)  # the stage's own tables, and what it read
    return docs
