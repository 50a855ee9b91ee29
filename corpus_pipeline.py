"""A corpus pipeline: toxic documents out, boilerplate lines out, near copies out, sources mixed to weights, texts encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import line_dedup, mixing, pieces, simhash, toxicity
from tidepool.llm._common import lean_workers, load, stage_table
from tidepool.llm.queries import BOILERPLATE, LEAST_PAGES, TOKENIZERS


#: Coded words that a worker keeps: fewer than by default, since the stages before have left their executors less memory.
REMEMBERED = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that a model, trained on the labelled rows outside the held-out fold, scores at 0.5 or more.

    Null, empty and blank texts hold no token and score as documents without any toxic one, so they stay; rows are judged one
    by one, repeated ones alike. An empty table stays empty; other columns pass through.
    """
    lean_workers(spark)
    model = toxicity.train_toxicity(docs, load(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without lines on more than a fiftieth of their source's pages (three at least), n_chars counted anew.

    Every row stays, its text empty if all its lines go; null texts stay null with null n_chars; rows without a source are one
    source. Equal texts of a source count as one page.
    """
    kept = line_dedup.drop_boilerplate(docs, host=F.col("source"), ratio=BOILERPLATE, min_pages=LEAST_PAGES)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles of Jaccard similarity 0.8 or more, chained.

    The one with the smallest id stays, null ids last. Rows with null or repeated ids go only as copies; null, empty and blank
    texts are copies of each other.
    """
    lean_workers(spark)
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources near weights 5, 2, 1, repeating, of all words; three copies at most.

    Sources without a name come last; documents without words add none and stay once. Reruns agree.
    """
    return mixing.mix_documents(docs, weights=(5, 2, 1), max_repeat=3.0, share=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the piece ids of the whole text and their number; null and empty texts have none."""
    lean_workers(spark)
    model = pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    return pieces.encode_documents(docs, model, remembered=REMEMBERED).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: Fingerprints, the trained model and the vocabulary have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs)
    return docs
