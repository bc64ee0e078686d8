"""From raw documents to packed training sequences.

``STAGES`` lists (name, function).  Each function takes (spark, docs, sf_dir) and returns a
DataFrame; it is written as Parquet and read again as the next one's ``docs``, so every stage
works on all that its predecessor kept, and a lost executor costs a reread.  All stages but the last
return the columns of ``documents``.

1. toxicity: documents that the model rejects (score >= 0.3) go; the model is fitted on ``labels``.
2. near_dedup: one document of each SimHash component stays, the one with the smallest id.
3. decontamination: documents that contain a benchmark item, also with other numbers or names, go.
4. pii: personal data becomes its kind in angle brackets; no row goes.
5. packing: whole documents as pieces of sequences of 2048 tokens.

Nulls, empty texts, repeated rows and empty tables are handled as each operator's module says: a
null text scores as an empty one, has fingerprint zero, matches nothing, stays null, and is packed
as an end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontam, packing, pii, simhash, toxicity
from tidemark.session import ensure_checkpoint_dir, ship_package
from tidemark.sources.tables import read_table


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return (docs.withColumn("__tm_score", toxicity.scorer(spark, model))
            .filter(F.col("__tm_score") < toxicity.THRESHOLD).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return decontam.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Fingerprints, models and tokenizers are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.save(stage(spark, docs, sf_dir), name)
    return docs
