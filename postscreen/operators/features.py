"""Vocabulary and fixed-length encoding of texts."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscreen.functions.text import first_tokens, tokens
from postscreen.operators.ordinal import with_ordinal
from postscreen.session import materialise

# Ids of the special tokens.
PAD, UNKNOWN, START, END = 0, 1, 2, 3
FIRST_ID = 4
# A vocabulary of at most so many tokens and bytes is looked up, a larger one is joined.
MAX_LOOKUP, MAX_LOOKUP_BYTES = 200_000, 64 << 20


def build_vocab(df: DataFrame, text: str, size: int = 30_522, fold: bool = True) -> DataFrame:
    """``token, id`` of the most frequent tokens, ``size`` ids including the four special ones.

    Ties go by token. Ids are row numbers over ranges, so no task holds the whole vocabulary.
    """
    counts = (
        df.select(F.explode(tokens(F.col(text), fold)).alias("token"))
        .groupBy("token")
        .agg((-F.count(F.lit(1))).alias("_rank"))
    )
    top = counts.orderBy("_rank", "token").limit(max(size - FIRST_ID, 0))
    ranked = with_ordinal(top, ["_rank", "token"], "_pos")
    return ranked.select("token", (F.col("_pos") + FIRST_ID).cast("int").alias("id"))


def encode(
    df: DataFrame,
    text: str,
    vocab: DataFrame,
    max_length: int = 128,
    fold: bool = True,
    max_lookup: int = MAX_LOOKUP,
) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``, both of ``max_length``.

    Ids are start, the first ``max_length - 2`` tokens, end, then padding; the mask is 1 up to the
    end and 0 on the padding. The cut to ``max_length`` is what the operator is for.

    A vocabulary of up to ``max_lookup`` tokens and 64 MiB goes to the executors and whole Arrow
    batches are looked up in it, so the table is not shuffled. A larger one is joined by token.
    Rows come back one for one either way, whatever their keys.
    """
    if max_length < 2:
        raise ValueError("max_length must leave room for the start and end ids")
    kept = df.withColumn("_tokens", first_tokens(F.col(text), max_length - 2, fold))
    held = vocab.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token") + 12).alias("bytes")).first()
    short = held["n"] <= max_lookup and (held["bytes"] or 0) <= MAX_LOOKUP_BYTES
    ids = _looked_up(kept, vocab.select("token", "id").toArrow()) if short else _joined(kept, vocab)
    used = F.size("_ids") + 2
    padding = F.lit(max_length) - used
    return ids.withColumns(
        {
            "input_ids": F.concat(
                F.array(F.lit(START)), "_ids", F.array(F.lit(END)), F.array_repeat(F.lit(PAD), padding)
            ),
            "attention_mask": F.concat(
                F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), padding)
            ),
        }
    ).drop("_ids", "_tokens")


def _looked_up(df: DataFrame, local: pa.Table) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(local)
    unknown = UNKNOWN

    @F.arrow_udf("array<int>")
    def to_ids(words: pa.Array) -> pa.Array:
        names = shared.value.column("token").combine_chunks()
        ids = shared.value.column("id").combine_chunks().cast(pa.int32())
        flat = words.flatten()
        found = pc.index_in(flat, value_set=names.cast(flat.type))
        starts = pc.subtract(words.offsets, words.offsets[0])
        return pa.ListArray.from_arrays(starts, ids.take(found).fill_null(unknown))

    return df.withColumn("_ids", to_ids("_tokens"))


def _joined(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """By a join on the token. Rows have numbers of their own, written with them.

    A frequent token is a hot key of the larger side of the join, which adaptive execution splits.
    """
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "encode")
    words = rows.select("_row", F.posexplode("_tokens").alias("_pos", "token"))
    ids = (
        words.join(vocab.select("token", "id"), "token", "left")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("id", F.lit(UNKNOWN)).alias("id")))).alias("_pairs"))
        .select("_row", F.col("_pairs.id").alias("_ids"))
    )
    none = F.array().cast("array<int>")
    return rows.join(ids, "_row", "left").withColumn("_ids", F.coalesce("_ids", none)).drop("_row")
