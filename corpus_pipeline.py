"""A corpus pipeline: toxic documents go, near copies go, personal data is masked, sources are mixed, what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
its result is written and read again before the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mensura.llm import mixing, neardup, packing, pii, toxicity
from mensura.llm.common import new_path, read, release


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return neardup.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    release(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", keep_clean),
    ("near_duplicates", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither trained models nor tokenizers; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        # The next stage's release() must leave its input.
        keep_input(path)
        docs = spark.read.parquet(path)
    return docs


def keep_input(path: str) -> None:
    from mensura.llm import common

    common._written.remove(path)
