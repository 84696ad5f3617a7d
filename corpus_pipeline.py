"""From raw documents to token ids in five stages; each works on all that its predecessor kept.

What holds for every stage: a null or empty text and a null id are rows like others; texts of any length are read whole; an empty table
gives an empty one; extra columns of ``documents`` are ignored, whatever their names, since each stage passes on the five columns of
documents only.  Each stage's own cases are in its text.  Stages are written to the shared folder and read again; run() removes a
stage's table once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, decontam, ngram_join, quality, secrets, toxicity
from helixframe.llm.common import discard, stored
from helixframe.llm.registry import PER_CLASS, vocabulary_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.  It is fitted on PER_CLASS labelled rows of each class at most.

    A null text is scored as the empty one.  Repeated rows share their fate, a score at the threshold stays.  Without labels of both kinds the prior decides for all.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(*toxicity.labelled_sample(docs, labels, "quality", PER_CLASS)))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of least id.

    Texts without words and rows with a null id stay.  Of rows that repeat an id and its text one stays; an id's rows with different texts share their fate.
    """
    return ngram_join.keep_one(docs)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items.  A null text holds none; rows of equal texts share their fate, whatever their ids; an empty benchmark drops nothing."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows the text.  A null text stays null, with null n_chars; of spans that overlap the first names the whole; repeated rows stay."""
    found = secrets.scan_secrets(docs, keep=("doc_id", "lang", "source"), redacted=True)
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of all documents.  A null text has no tokens, as the empty one; repeated rows stay."""
    return bpe.bpe_encode(docs, vocabulary_path(), keep=("lang", "source"))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", uncontaminated_documents),
    ("secret scans", redacted_documents),
    ("BPE encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
            if held is not None:
                discard(held)
            held = docs
    return docs


#: No SQL expresses the classifier's training.
ORACLE_SQL = None
