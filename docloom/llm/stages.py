"""The stages of the corpus pipeline, each by one of this subpackage's operators. A stage takes (spark, docs, sf_dir) and returns what it keeps.

Defined cases, for all stages: null text counts as empty; a null doc_id, lang, source or n_chars stays as it is; rows that repeat are judged
each, but for the near-duplicate stage, which keeps one of them, and the mix, which may take a row up to three times; ties fall as the
operator's docstring says; very long texts are taken whole; an empty table stays empty; columns beyond COLUMNS are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import line_dedup, mixing, piece_codec, simhash_index, toxicity
from docloom.llm.common import parts, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5, which is each language's calibrated threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, keep_below=0.5)


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the runs of lines of 50 words or more that stand earlier in the corpus; n_chars follows."""
    return line_dedup.deduplicated(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more over five-word shingles): the one with the smallest doc_id."""
    return simhash_index.one_of_each(docs.select(*COLUMNS), words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time the mix takes a document, in the order of the shards and of each shard's shuffle: a file holds a run of it."""
    return mixing.in_shards(mixing.mixed(docs.select(*COLUMNS)), parts(spark)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids (with begin and end), and whether they decode to the text."""
    import public_tokenizers

    encoded = piece_codec.encode_column(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), same="round_trip", drop_text=True)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
