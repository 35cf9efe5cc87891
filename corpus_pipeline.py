"""The corpus pipeline: toxic documents go, lines that many documents share stay once, one document of each group of
near copies stays, sources are mixed to their target weights, and the mix is encoded.

Every stage takes what the one before it kept, as it is: null texts count as empty, empty texts and null ids pass
through all stages, texts may be of any length, rows may repeat, other columns may have any name and come through all
stages but the last, and an empty table gives an empty table of the stage's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, common, line_dedup, mixing, near_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, with the columns of docs.

    Null and empty texts have the score of a text without hits, so they stay. Repeated rows have the same score.
    Where several labels of an id differ, the higher counts; a null label is none."""
    labels = toxicity.training_labels(common.table(spark, sf_dir, "labels"))
    apart, back = common.set_aside(docs, ("score", "predicted"))
    return back(toxicity.score_toxicity(apart, labels).filter("predicted = 0"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that stay elsewhere; n_chars, where docs has it, follows the text.

    A null text becomes an empty one; a text may become empty and stays. Ties can't be: the largest id keeps a line.
    Rows of null ids are one document that keeps no shared line; rows that repeat an id lose the same lines."""
    apart, back = common.set_aside(docs, ("n_lines", "n_dropped", "kept_text"))
    out = line_dedup.drop_common_lines(apart)
    new = {"text": F.col("kept_text")} | ({"n_chars": F.char_length("kept_text").cast("long")} if "n_chars" in docs.columns else {})
    return back(out.withColumns(new))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of the smallest id, by runs of five words and a similarity of 0.8.

    Texts without words and null ids are linked with nothing and stay. Rows that repeat an id are one document."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows that repeat id, text and source count together.

    Texts without words stay once and count for nothing. A null source is one of its own. Which of equals has a copy
    more goes by a hash, so reruns agree."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded of each document of the
    mix, once for each copy. Null and empty texts: no ids."""
    return bpe.encode(docs, keep=["doc_id", "lang", "source"]).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL for learned scores, sketches, entropy balancing or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "corpus-pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
