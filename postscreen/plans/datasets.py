"""Building the data sets: scraped posts, the labelled set, an unlabelled set, training data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscreen.functions import (
    fill_text,
    is_valid_label,
    not_blank,
    parse_label,
    presence_flag,
    remove_emoji,
)
from postscreen.operators.dedup import keep_first
from postscreen.operators.sampling import Balanced, balance, split
from postscreen.operators.union import union_sources
from postscreen.session import materialise
from postscreen.sources.posts import require_columns

# Column names of the scraped and the labelled files.
FLAGS = {"link": "link/uri", "image": "images/0/alt"}
SCRAPED_COLUMNS = ("text", "repostCount", "replyCount", "link", "image", "createdAt")
UNUSED_COLUMNS = ("repostCount", "replyCount", "link", "image", "createdAt", "Unnamed: 0")
TEXT, LABEL = "text", "depressive"


def with_label(df: DataFrame, value: int, label: str = LABEL) -> DataFrame:
    """The same label on every row."""
    return df.withColumn(label, F.lit(int(value)))


def presence_flags(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Add for each ``output: source`` a flag that is 1 where the source is present."""
    return df.withColumns({out: presence_flag(F.col(f"`{src}`")) for out, src in flags.items()})


def valid_labels(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows labelled exactly 0 or 1, with the label as an int."""
    return df.filter(is_valid_label(F.col(label))).withColumn(label, parse_label(F.col(label)))


def rejected_labels(df: DataFrame, label: str = LABEL) -> DataFrame:
    """The other rows, as they are."""
    return df.filter(~is_valid_label(F.col(label)))


def drop_blank(df: DataFrame, text: str = TEXT) -> DataFrame:
    """Rows whose text is more than white space."""
    return df.filter(not_blank(F.col(text)))


def build_scraped(
    *scrapes: DataFrame,
    flags: Mapping[str, str] = FLAGS,
    columns: Sequence[str] = SCRAPED_COLUMNS,
    label: str = LABEL,
) -> DataFrame:
    """Union of the scrapes with presence flags, the named columns and the label 0."""
    flagged = presence_flags(union_sources(*scrapes, rank=None), flags)
    return with_label(flagged.select(*[F.col(f"`{c}`") for c in columns]), 0, label)


def build_final(
    labelled: DataFrame,
    extra: DataFrame,
    order_by: Sequence[str],
    text: str = TEXT,
    label: str = LABEL,
) -> DataFrame:
    """Valid rows of ``labelled`` and the positive posts of ``extra``, without emoji.

    ``extra`` is de-duplicated before its positives are taken, in the order of ``order_by``: a
    text first seen with another label is left out. The union is not de-duplicated.
    """
    first = keep_first(extra.select(*dict.fromkeys([text, label, *order_by])), [text], order_by)
    # The label of this set may be numeric, so 1.0 counts as 1.
    positive = first.filter(F.col(label).cast("string").try_cast("double") == 1).select(
        text, F.lit(1).alias(label)
    )
    clean = characterised(labelled, label).select(text, label)
    return union_sources(clean, positive, rank=None).withColumn(text, remove_emoji(F.col(text)))


def characterised(labelled: DataFrame, label: str = LABEL) -> DataFrame:
    """Valid rows of the labelled set without the columns that only describe the scrape."""
    return valid_labels(labelled.drop(*UNUSED_COLUMNS), label)


def build_unlabelled(df: DataFrame, key: str = "id", text: str = TEXT) -> DataFrame:
    """``key, text`` and the label 0, in the shape a model reads. Fails if a column is absent."""
    return with_label(require_columns(df, key, text).select(key, text), 0)


def clean_texts(
    df: DataFrame,
    order_by: Sequence[str],
    text: str = TEXT,
    lowercase: bool = False,
    null_text: str = "",
) -> DataFrame:
    """Fill missing texts, optionally lower-case, drop blank ones, keep the first of each.

    Blank texts go by exploding an array that is empty for them. A filter would be moved below the
    expressions that make the text, such as emoji removal, which would then run once for the test
    and once more for the result.
    """
    filled = fill_text(F.col(text), null_text)
    if lowercase:
        filled = F.lower(filled)
    kept = df.withColumn(text, F.explode(F.filter(F.array(filled), not_blank)))
    return keep_first(kept, [text], order_by)


@dataclass(frozen=True)
class Prepared:
    """Training data.

    ``table`` is the cleaned set with its ``side``. ``weighted`` is the training side with the
    number of ``copies`` that balances the classes, ``train`` the same with the copies made.
    """

    table: DataFrame
    weighted: DataFrame
    train: DataFrame
    val: DataFrame


def prepare(
    df: DataFrame,
    key: str,
    text: str = TEXT,
    label: str = LABEL,
    lowercase: bool = False,
    null_text: str = "",
    frac: float = 0.2,
    seed: int = 42,
    exact: bool = False,
    mode: str | None = "even",
) -> Prepared:
    """Clean, split once, and balance the training side.

    The cleaned set is written to the shared folder, so that training, scoring and error analysis
    all see the same rows and none repeats the de-duplication. The side is a function of the key
    alone and is not written. ``mode`` is one of ``balance``, or None for one copy each.
    """
    cleaned = materialise(
        clean_texts(df.select(key, text, label), [key], text, lowercase, null_text), "cleaned"
    )
    table = split(cleaned, key, frac, seed, exact)
    train = table.filter(F.col("side") == "train").drop("side")
    val = table.filter(F.col("side") == "val").drop("side")
    if mode is None:
        balanced = Balanced(train.withColumn("copies", F.lit(1).cast("long")), heavy=False)
    else:
        balanced = balance(train, label, key, seed, mode)
    return Prepared(table, balanced.weighted, balanced.repeated(), val)
