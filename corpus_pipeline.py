"""A training corpus from ``documents``: five stages, each one operator of ledgerlark.llm over all that the one before kept.

Each stage but the last returns the columns of documents. :func:`run` writes what a stage returns to the shared folder
and reads it again for the next, so a lost executor never costs more than its stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import exact_dedup, language_id, ngram_join, packing, pii
from ledgerlark.llm.columns import fresh, q
from ledgerlark.llm.marks import without
from ledgerlark.sources.shared import written
from ledgerlark.sources.tables import read_table

#: Documents whose cosine with every language isn't above this read like none of them, whatever their length.
MIN_SCORE = 0.0
#: The share of a length class's labelled documents that may score below its threshold, and how many of them set one.
LOST, LEAST = 0.001, 20


def _length_class(text: Column) -> Column:
    """Texts of the same power of two of characters."""
    return F.floor(F.log2(F.length(text) + F.lit(1))).cast("int")


def thresholds(scored: DataFrame, lang: str, size: str, score: str) -> dict[int, float]:
    """Score that all but LOST of the labelled documents reach, by length class; classes of fewer than LEAST have none."""
    low = scored.where(q(lang).isNotNull() & (q(score) > MIN_SCORE)).groupBy(q(size).alias("size"))
    rows = low.agg(F.count("*").alias("n"), F.percentile_approx(q(score), LOST, 100_000).alias("least")).where(F.col("n") >= LEAST)
    return {r["size"]: r["least"] for r in rows.collect()}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like one of the languages learned from them; ``lang`` stays as it was labelled.

    Texts that are null, empty or without letters go, as do those not above MIN_SCORE, and those below the threshold
    of their length class. A class without one takes that of the next shorter class that has; short texts score lower. Rows that repeat are judged one by one, other columns
    stay as they are, and an empty table (or one without labelled documents, from which nothing is learned) keeps none.
    """
    model = language_id.learn(docs.where(~language_id.held_out("doc_id")))
    pred, score, size = fresh(docs, "lang_pred", "score", "size")
    scored = written(language_id.identify(docs, model).withColumn(size, _length_class(q("text"))))
    least = F.lit(MIN_SCORE)
    for c, x in sorted(thresholds(scored, "lang", size, score).items()):
        least = F.when(q(size) >= c, F.lit(x)).otherwise(least)
    kept = scored.where((q(pred) != language_id.UNKNOWN) & (q(score) > MIN_SCORE) & (q(score) >= least))
    return kept.select(*[q(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, letter case of A-Z aside: that of the largest doc_id. Null counts as empty; an empty table stays one."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest doc_id.

    Rows of a null doc_id stay, as do texts without words but for one; rows that repeat a doc_id go or stay together; an
    empty table stays one.
    """
    dropped = written(ngram_join.ngram_join(docs).where("doc_id <> class_id").select("doc_id").distinct())
    return without(docs, dropped, "doc_id")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each span of personal data replaced by its kind; ``n_chars``, if there is one, counts the new text.

    A null text stays null; spans that overlap become one; rows that repeat are read one by one; an empty table stays one.
    """
    (found,) = fresh(docs, "pii")
    text = q(found)["redacted"]
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return pii.find_pii(docs, result_col=found).select(*[new[c].alias(c) if c in new else q(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    A null text counts as empty and has its end's token alone; rows that repeat are documents of their own; an empty table
    gives no piece.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("pii", private),
    ("packing", packed),
]

#: Learned prototypes, sketches and tokenizers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
