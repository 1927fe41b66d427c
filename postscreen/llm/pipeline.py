"""From raw documents to packed sequences, in five stages over whole tables.

Each stage takes what the one before has kept. Toxicity drops documents of score 0.3 or more, language ID those whose
language it can't tell, the near-duplicate stage all but one document of each group (five-word
shingles, similarity 0.8), mixing repeats or drops documents by the sources' weights, and packing
returns where each part of a document goes. All but the last return the columns of ``documents``.
Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postscreen.llm import jaccard, langid, mixing, packing, toxicity
from postscreen.llm.common import fold, small, table, unused, word_count
from postscreen.operators.ordinal import with_ordinal
from postscreen.session import materialise

THRESHOLD = 0.3


def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the training folds, and drops what it predicts.

    Null and empty texts have no hits and stay; texts are scored whole, repeated rows each, ties at the threshold go.
    """
    rows = toxicity.training_rows(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    model = toxicity.fit(rows, "text", "label")
    toxic = unused(docs, "toxic")
    return toxicity.score(docs, "text", model, toxic).filter(F.col(toxic) < THRESHOLD).select(*columns(docs))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the training folds of the documents that are left, and keeps those with a language.

    Null texts and those without a letter have none and go; where nothing can be learned, all stay. Texts are read whole,
    repeated rows each, and a tie goes to the language that comes first.
    """
    train = docs.filter(F.coalesce(fold(F.col("doc_id"), 5) != 0, F.lit(False)))
    return langid.keep_identified(docs, langid.fit(train, "text", "lang"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets that links at 0.8 reach: that of the smallest key.

    Rows without a key, and null or empty texts, are linked with nothing and stay; texts are read whole; of rows that repeat key and
    text one stays.
    """
    return jaccard.keep_one(docs, "doc_id", "text", jaccard.Rule(words=5, num=80, den=100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice.

    Rows are told apart by a number of their own, as keys may be null or repeat. The mix goes by their place in
    the order of keys and contents, which doesn't depend on partitions; only equal rows may change places.
    """
    row, copies = unused(docs, "row"), unused(docs, "copies")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    names = {"row": row, "doc_id": "doc_id", "source": "source"}
    narrow = numbered.select(
        *[F.col(f"`{c}`").alias(name) for name, c in names.items()],
        F.xxhash64(*columns(docs)).alias("content"), word_count(F.col("text")).alias("size"),
    )
    placed = materialise(with_ordinal(narrow, ["doc_id", "content", "row"], "place"), "placed")
    mixed = mixing.mix(placed, "place", F.col("size"), "source")
    taken = mixed.filter("copies > 0").select("place", F.col("copies").cast("int").alias(copies))
    taken = materialise(placed.select("place", F.col("row").alias(row)).join(taken, "place").drop("place"), "taken")
    rows = numbered.join(small(taken), row)
    repeated = rows.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each document goes; null and empty texts need no room, repeated rows are packed each."""
    sized = docs.select("doc_id", word_count(F.col("text")).alias("size"))
    return packing.pack_rows(sized, "doc_id", "size")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

# No stage but the last two could be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
