"""From raw documents to token shards: the corpus operators as a chain of stages.

Each stage takes all that the one before it kept and returns the columns of documents, the last one the document table of
the shards as read back from their files. A stage's result is a Parquet table in the shared folder, which the next stage reads, so
that a lost executor costs the tasks it held.

Defined cases, for every stage: null and empty texts are documents like any other (the classifier judges them by its bias, they are near
duplicates of nothing, leak nothing, have size 0 in the mix and give the end id alone); very long texts pass whole; rows that repeat are
each judged, of near copies and of rows with the same doc_id one stays; a row without doc_id is judged by its text; ties go to the least
doc_id; columns beyond doc_id, text and source, whatever their names, pass through all stages but the last; an empty table stays empty.
"""

from __future__ import annotations

import functools
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import mix_cube, ngram_matrix, quality_subword, template_decon, token_planes
from plumbline.llm.common import ROW_GROUP, own_dir, remove, scratch, table, trim_driver


_chain = threading.local()  # folder: the intermediate tables of the stage that this thread ran last


def _stage(function):
    """Each stage's intermediate tables lie in a folder of its own. It is removed when this thread runs the chain's next stage, for the stage's
    result has been written by then; a first stage begins a new chain and removes nothing."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        old, _chain.folder = getattr(_chain, "folder", None), f"{own_dir(spark)}/stage-{uuid.uuid4().hex}"
        if old and function.__name__ != "quality":
            remove(spark, old)
        trim_driver(spark)
        with scratch(_chain.folder):
            return function(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_subword.accepted(docs, table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return ngram_matrix.one_of_each(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return template_decon.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_cube.apply_mix(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the shards."""
    import public_tokenizers

    return token_planes.encode_to_planes(docs, public_tokenizers.path("byte_bpe_50k.json"))[0]


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", tokens),
]

ORACLE_SQL = None  # no stage but the third has an equivalent in SQL; tests hold each against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from a table in the shared folder; what the stages before it wrote is removed on the way."""
    df, top = table(spark, sf_dir, "documents"), f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, df, sf_dir)
        made.write.option("parquet.block.size", ROW_GROUP).parquet(f"{top}/{k}")
        df = spark.read.schema(made.schema).parquet(f"{top}/{k}")
        if k:
            remove(spark, f"{top}/{k - 1}")
    remove(spark, _chain.folder)
    _chain.folder = None
    return df
