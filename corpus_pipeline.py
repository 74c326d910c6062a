"""A corpus pipeline: language ID, near duplicates, benchmark decontamination, source mix, token store.

Each stage takes what its predecessor kept, as a table written and read again. An empty table passes through all stages
as an empty table. Extra columns stay up to the mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.llm import benchmark_clean, jaccard_join, language_id, mixing, token_store
from cuesmith.llm.queries import END_ID, WEIGHTS, tokenizer
from cuesmith.llm.scratch import cut, fresh

#: Documents whose language is less sure than this go, as do those without a letter.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is found with a probability of LEAST_SCORE and more; null and empty texts go."""
    hide = {c: fresh(docs, f"__{c}") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    judged = language_id.identify(docs.withColumnsRenamed(hide), language_id.train(docs))
    kept = judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in hide.items()}).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles: the one with the least id. Rows equal in id and
    text are one document."""
    return jaccard_join.one_of_each_group(docs, 5, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; with no items, all."""
    return benchmark_clean.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the source mix takes them, a row for each pass over them, cut to the words taken. A null source is a
    source; texts without words go."""
    return mixing.mix_documents(docs, WEIGHTS)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token shards hold for each document, by ascending id (a null id first; rows of one id each)."""
    return token_store.read_store(token_store.write_store(docs, tokenizer("word_bpe_49k.json"), END_ID))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("source_mix", mixed),
    ("token_output", token_shards),
]

#: A trained classifier, a seeded mix and a tokenizer: SQL has none of them; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir: doc_id, start, n_tokens and ids_crc32 of every row that the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
