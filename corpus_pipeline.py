"""A corpus pipeline over ``documents``: quality, near duplicates, repeats, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and gives a frame that is written as Parquet and read
again as the next one's ``docs``; all but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import documents, shared_table
from lorekeep.llm.jaccard import jaccard_components
from lorekeep.llm.packing import pack_documents
from lorekeep.llm.quality import score, train
from lorekeep.llm.queries import PASSAGE_WORDS, SEQUENCE, tokenizer
from lorekeep.llm.secret_scan import learn, scan
from lorekeep.llm.suffix import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document of a lower score is rejected.
LEAST_SCORE = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject."""
    model = train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates; of equal rows one."""
    # Rows without an id get one above all others from their text, so that a row with an id goes first.
    spare = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) + F.lit(1 << 62)
    keyed = docs.withColumn("_key", F.coalesce("doc_id", spare))
    kept = jaccard_components(keyed, "_key", "text").where("_key = component_id").select("_key").distinct()
    # One shuffle of the texts, by key: the rows of a key are together for both steps.
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key", "text"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that stand elsewhere too; documents of which nothing is left go."""
    return _counted(remove_repeats(docs.select(*COLUMNS), in_place=True, words=PASSAGE_WORDS).where("size(spans) = 0 or text <> ''"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret; all documents stay."""
    return _counted(scan(docs.select(*COLUMNS), learn(docs), redact=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the training sequence and place of each."""
    return pack_documents(docs, "doc_id", "text", tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), SEQUENCE)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is a table in the shared folder."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs)
    return docs
