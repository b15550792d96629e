"""A corpus pipeline in five stages; each works on what the one before kept.

1. quality: documents that the quality classifier scores below 0.5 go.
2. language: documents without a language, or whose best language has less than half of the belief, go.
3. near_duplicates: of each class of near-duplicate documents one stays.
4. mixing: sources are brought to weights that go with the square root of their size.
5. packing: the mixed documents become sequences of at most 4096 tokens.

Every stage takes and, but for the last, returns the columns of documents; further columns pass through.  Documents that repeat
another in id and text are one document for stage 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.llm import jaccard, langid, mixing, packing, quality
from wayledger.llm.queries import MIX_EXPONENT, table, tokenizer_file
from wayledger.llm.tables import stored

#: SQL can't express the classifiers and the tokenizer; tests/llm/test_pipeline.py compares the rows after every stage with plain Python.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.score(docs, quality.fit(docs, labels)).where("quality_score >= 0.5").select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language."""
    found = langid.predict(docs, langid.fit(docs))
    return found.where("lang_pred <> 'und' and lang_score >= 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: five-word shingles, similarity 0.8 or more."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    classes = jaccard.jaccard_join(keyed, id_column="_row")
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("_row")).distinct()
    return keyed.dropDuplicates(["_row"]).join(kept, "_row", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents such that sources weigh as the square root of their size, in shuffled order."""
    weights = mixing.tempered_weights(mixing.source_sizes(docs), MIX_EXPONENT)
    return mixing.mix(docs, weights).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    pieces = packing.pack(docs, tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
