"""A corpus pipeline over documents: toxicity, language, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns of
documents. Empty tables pass through; null texts count as empty ones (of no language, so they go at the second stage); extra columns are
carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, minhash, mixing, pieces, toxicity
from tidemark.llm.common import table, written

#: The least share of a text's letters that its language must have.
LEAST_LANGUAGE = 1 / 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    scored = toxicity.score(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")), names=("_toxicity", "_matches"))
    return scored.where(F.col("_toxicity") < toxicity.PREDICTED_AT).select(*docs.columns)


def drop_languageless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters, of which one language holds a third at least."""
    labelled = language.label(docs, language.learned(docs), names=("_lang", "_share"))
    return labelled.where((F.col("_lang") != language.UND) & (F.col("_share") >= LEAST_LANGUAGE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id."""
    found = minhash.near_duplicates(docs)
    return docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in a random global order."""
    own = [c for c in docs.columns if c in mixing.ADDED]  # columns of documents that mixing would replace
    aside = docs.withColumnsRenamed({c: f"_own_{c}" for c in own})
    mixed = mixing.mix(aside).select(*aside.columns)
    return mixed.withColumnsRenamed({f"_own_{c}": c for c in own})


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row, and whether they decode to its text."""
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.model_path(), decoded="decoded")
    return encoded.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_languageless),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Learned models and piece encoding have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
