"""From raw documents to packed sequences: five stages, each written and read again as the next one's documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonespark.llm.common import keep
from zonespark.llm.mixing import mixed_documents
from zonespark.llm.near_copies import first_of_near_copies
from zonespark.llm.packing import pack_documents
from zonespark.llm.quality_rules import kept_documents
from zonespark.llm.secrets import without_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go; nothing else does."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (sets of five-word shingles at a similarity of 0.8 or more) the document with the smallest doc_id stays."""
    return first_of_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in its text are masked."""
    return without_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; sources below their target weight are read again until the largest has been read once."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of full length, neighbours on the curve side by side."""
    pieces = pack_documents(docs)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids"
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Rules are learned and texts tokenised, which SQL cannot express; the tests check every stage against plain Python.
ORACLE_SQL = None
