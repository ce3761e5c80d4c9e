"""A corpus pipeline: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Written out between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import langid, packing, quality, simhash
from parley.llm.common import checkpoint, free_name
from parley.llm.queries import tokenizer_path

#: How far the mean log-likelihood of an n-gram may be below that of the language's learning texts: a part for all
#: texts, and one over the root of the number of n-grams for short ones. Random letters are about 5 below.
LEAST_FIT, SHORT_TEXTS = -0.8, 6.0
#: Share of a text that must be in passages of the text's own language. Fixed with LEAST_FIT on held-out texts of sf0.1.
LEAST_AGREEMENT = 0.75


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below quality.KEEP_FROM."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = free_name(docs, "quality")
    return quality.scored(docs, quality.fit(docs, labels), name).where(F.col(f"{name}.score") >= quality.KEEP_FROM).select(*docs.columns)


def one_language(found: F.Column) -> F.Column:
    """Whether langid.examiner found a text to be in one of the languages, and in one alone."""
    fits = found["fit"] >= LEAST_FIT - SHORT_TEXTS / F.sqrt(found["n"])
    return (found["lang_pred"] != langid.UNKNOWN) & fits & (found["agreement"] >= LEAST_AGREEMENT)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, of letters that are no known language, or of mixed languages. Learns as the query does."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    langid.bounded_batches(spark)
    name, found = free_name(docs, "found"), langid.examiner(spark, model)(F.col("text"))
    return docs.withColumn(name, found).where(one_language(F.col(name))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Rows with a null id all stay; rows of one id are reduced to the first by the text's hash.
    """
    own = simhash.one_row_per_id(docs)
    dropped = simhash.similar_groups(own).where("doc_id <> component_id").select("doc_id")
    return own.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents left, each with its sequence and place in it."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: Learned models and fingerprints aren't expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is cut off in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
