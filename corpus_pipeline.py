"""A corpus pipeline over ``documents``: each stage calls one operator on all
rows that the stage before kept, is written as Parquet and read again.

Every stage but the last returns the columns of ``documents``.  Ids that
repeat or are null are handled by a row number written beside them, so one
row of a group of copies stays even if its copies share an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, checked_broadcast, unused, with_key
from vigil.llm.decontaminate import decontaminate
from vigil.llm.exact_dedup import exact_dedup
from vigil.llm.language import fit, identify, sample
from vigil.llm.near_dup import near_dedup
from vigil.llm.pieces import round_trip


def _without(docs: DataFrame, key: str, columns: list[str], dropped: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped`` (written down first)."""
    name = unused("_gone", docs.columns)
    gone = scratch.cut(dropped.select(F.col(key).alias(name)), "dropped")
    return docs.join(checked_broadcast(gone), F.col(key) == F.col(name), "left_anti").select(*columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter have no language and go; all others stay, also
    if no label could be learnt from."""
    pred, score, letter = (unused(c, docs.columns) for c in ("_lang_pred", "_lang_score", "_has_letter"))
    found = identify(docs, fit(sample(docs, "lang", "text")), "text", pred, score, letter)
    return found.where(F.col(letter)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipe-exact")
    keyed, key = with_key(docs, "doc_id", "text", scratch)
    return _without(keyed, key, docs.columns, exact_dedup(keyed, id_col=key).where(~F.col("kept")), scratch)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word 5-shingles, similarity of 0.8 or more; the smallest id of a group stays."""
    scratch = Scratch(spark, "pipe-near")
    keyed, key = with_key(docs, "doc_id", "text", scratch)
    return _without(keyed, key, docs.columns, near_dedup(keyed, id_col=key).where(~F.col("kept")), scratch)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    scratch = Scratch(spark, "pipe-decon")
    keyed, key = with_key(docs, "doc_id", "text", scratch)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(keyed, key, docs.columns, decontaminate(keyed, bench, id_col=key).where("contaminated"), scratch)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_ids, decodes): ids of the whole text and
    whether they decode to it."""
    both = round_trip(docs.select("doc_id", "lang", "source", "text"))
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"),
                       F.col("same").alias("decodes"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", pieces_stage),
]

#: MinHash, language models and segmentation have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, before = scratch.cut(stage(spark, docs, sf_dir), name), docs
        scratch.drop(before)
    return docs
