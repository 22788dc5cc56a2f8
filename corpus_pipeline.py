"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of
`documents`; the last returns a row per packed piece. Every decision takes effect: rejected
languages and near-duplicates go, secrets are masked, sources are taken to their target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import language, mixing, near_dedup, packing, secrets
from terraframe.llm.queries import tokenizer_path
from terraframe.llm.tables import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without one that half of the text is in, go."""
    return language.accepted(language.identify(docs)).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity, the document of the least id stays."""
    return near_dedup.deduplicate(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans of secrets in them become a mask."""
    rows = secrets.redact(docs.select(COLUMNS))
    return rows.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by virtual finish time, once for each pass that takes them."""
    sized = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("__size"))
    return mixing.mix(sized, size="__size", whole=True).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its tokens' place in a sequence of at most 4096."""
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Mixtures, minhashes and tokens can't be told in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is kept in the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
