"""A corpus pipeline over ``documents``: filter, dedupe, decontaminate, mix and shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.decontaminate import without_leaks
from panelforge.llm.frames import load, scratch_path, ship
from panelforge.llm.minhash_dedup import one_per_group
from panelforge.llm.mixing import mix
from panelforge.llm.pu_quality import good_documents, learn_quality
from panelforge.llm.sharding import interleave_shards

# Of every stage: empty tables give empty tables, texts are judged whole at any length, columns beyond
# doc_id, text and source are carried along, also where they have names that the operators use inside.


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more.

    Each row is judged by its own text, so rows that share an id, or have none, do not share their
    fate; null and empty texts score like a text without features. Without labels all rows stay.
    """
    ship(spark)
    return good_documents(docs, learn_quality(docs, load(spark, sf_dir, "labels")), threshold=0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component, null ids after all others.

    Of rows alike in id and text one stays. Texts without words are linked with nothing and stay.
    """
    ship(spark)
    return one_per_group(docs, percent=75, width=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited; null and empty texts hold none.

    Each row is judged by its own text, whatever its id.
    """
    ship(spark)
    return without_leaks(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken as often as the mix asks, weights 5, 2, 1 repeating over the sources.

    Copies are equal rows. Null sources are a source of their own, and texts without words are not
    taken beyond the copies that their place in the source gives; null ids are rows like others.
    """
    ship(spark)
    return mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the place in it of every document of the mix; copies of a document spread over the shards."""
    ship(spark)
    return interleave_shards(docs, n_shards=40)


STAGES = [("quality", good_quality), ("near_dedup", one_of_each), ("decontaminate", without_benchmark),
          ("mix", mix_sources), ("shard", shard)]

#: No SQL states the classifier's stage, so the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are written to the shared folder and read again by the next.

    The written rows go when the session ends.
    """
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
