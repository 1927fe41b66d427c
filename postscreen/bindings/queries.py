"""One query per operator over the given tables, each over whole tables and whole texts.

``depressive`` is ``labels.toxic``, the key is ``doc_id``, and ``1 - quality`` stands in for a
prediction where no model is needed. The tables hold no missing text, blank text or emoji, so
``dirty`` puts some in by ``doc_id``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postscreen.functions import fill_text, remove_emoji, strip, tokens
from postscreen.operators import bayes, epochs, errors, features, linear, metrics, ordinal, report, sampling, subwords
from postscreen.operators.dedup import first_index, keep_first, keep_first_incremental
from postscreen.operators.union import union_sources
from postscreen.plans import datasets, training
from postscreen.session import materialise, new_table_path, spread
from postscreen.sources import arriving, models, posts, ranges

LABEL = datasets.LABEL
# Text put into ``dirty``: white space only, and emoji of several make-ups.
SPACES = " \t\u00a0\n"
SMILE = "\U0001f600"
MIXED = (
    "\U0001f44d\U0001f3fd 1\ufe0f\u20e3 \U0001f1e7\U0001f1f7 \u2764\ufe0f\u200d\U0001f525 \u00a9 \u231a"
    " \U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f \u0646\u200d 7#"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for heavy work on their texts."""
    return spread(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")


def texts_and(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents with other columns, for heavy work on their texts."""
    return spread(documents(spark, sf_dir).select("doc_id", "text", *columns), "doc_id")


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents, for heavy work on their texts."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias(LABEL))
    return texts(spark, sf_dir).join(labels, "doc_id")


def posts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its label where it has one."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("toxic", LABEL)
    return documents(spark, sf_dir).join(labels, "doc_id", "left")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("toxic", LABEL)
    return documents(spark, sf_dir).join(labels, "doc_id")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with missing, blank and emoji texts and with labels as dirty strings."""
    kind, label = F.col("doc_id") % 11, F.col("doc_id") % 7
    text = (
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, SPACES)
        .when(kind == 2, SMILE)
        .when(kind == 3, F.concat("text", F.lit(f" {SMILE}")))
        .otherwise(F.col("text"))
    )
    raw = (
        F.when(label == 0, " 1 ")
        .when(label == 1, "1.0")
        .when(label == 2, F.lit(None).cast("string"))
        .when(label == 3, "maybe")
        .otherwise("0")
    )
    return documents(spark, sf_dir).withColumns({"text": text, LABEL: raw})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the stand-in prediction."""
    pred = 1 - F.col("quality")
    return labelled(spark, sf_dir).withColumns({"pred": pred, "p1": 0.1 + 0.8 * pred})


def text_number(value: Column) -> Column:
    """A number from the md5 of a text, to be summed over a set of texts."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def _text_sums(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(text_number(F.col(text))).alias("text_sum")
    )


# --- cleaning and de-duplication ---------------------------------------------------------------


def label_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean the posts and report how often each class occurs."""
    df = spread(dirty(spark, sf_dir).select("doc_id", "text", LABEL), "doc_id")
    cleaned = datasets.clean_texts(df.withColumn("text", remove_emoji(F.col("text"))), ["doc_id"])
    return report.value_counts(datasets.valid_labels(cleaned), LABEL)


def presence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"has_label": LABEL, "has_quality": "quality"}
    flagged = datasets.presence_flags(posts_all(spark, sf_dir), flags)
    return datasets.with_label(flagged, 0).select("doc_id", *flags, LABEL)


def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = union_sources(
        documents(spark, sf_dir).drop("n_chars"), table(spark, sf_dir, "conversations")
    )
    counted = ["text", "doc_id", "lang", "source", "conv_id", "turn", "role"]
    return both.groupBy("source_rank").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in counted]
    )


def valid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.valid_labels(dirty(spark, sf_dir)).select("doc_id", LABEL)


def rejected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.rejected_labels(dirty(spark, sf_dir)).select("doc_id", LABEL)


def strip_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = dirty(spark, sf_dir).withColumn("text", fill_text(F.col("text")))
    return datasets.drop_blank(filled).select(
        "doc_id", F.length(strip(F.col("text"))).alias("stripped_length")
    )


def emoji_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, F.concat(F.lit(MIXED), "text", F.lit(MIXED))).otherwise(F.col("text"))
    df = texts(spark, sf_dir).select("doc_id", remove_emoji(text).alias("text"))
    return df.select("doc_id", F.length("text").alias("length"), F.md5("text").alias("digest"))


def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    return keep_first(rows, ["text"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


def merged_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each text over two deliveries, the second merged by the digests of the first; either may hold the earlier row."""
    rows = documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", "text")
    early = F.col("source") < "src5"
    kept = keep_first(rows.filter(early), ["text"], ["doc_id"])
    index = materialise(first_index(kept, ["text"], ["doc_id"]), "index")
    added, dropped = keep_first_incremental(rows.filter(~early | F.col("source").isNull()), index, ["text"], ["doc_id"])
    left = kept.join(dropped.select(F.col("place.doc_id").alias("doc_id")), "doc_id", "left_anti")
    return left.unionByName(added).select("doc_id", "lang", "source", "n_chars")


def first_of_each_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without regard to case; every other text starts with a capitalised word."""
    prefix = F.when(F.col("doc_id") % 2 == 0, "NOTE ").otherwise("note ")
    text = F.lower(F.concat(prefix, F.col("text")))
    df = documents(spark, sf_dir).select("doc_id", text.alias("text"))
    return keep_first(df, ["text"], ["doc_id"]).select("doc_id")


def _source_label() -> Column:
    return (F.col("source") >= "src5").cast("int").alias(LABEL)


def dedup_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each text, then positives: a text first seen as negative is gone.

    The label comes from the source, so that copies of a text can have conflicting ones.
    """
    df = documents(spark, sf_dir).select("doc_id", "text", _source_label())
    return keep_first(df, ["text"], ["doc_id"]).filter(F.col(LABEL) == 1).select("doc_id", LABEL)


# --- order, reports ----------------------------------------------------------------------------


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "lang", "source")
    return report.head(rows, ["doc_id"], 20)


def _digested(df: DataFrame) -> DataFrame:
    """The whole text told by its digest."""
    return df.withColumn("digest", F.md5("text")).drop("text")


def with_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "n_chars", "text")
    return _digested(ordinal.with_ordinal(rows, ["n_chars", "doc_id"]))


def file_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted ranges written as files, whose rows are then numbered where they stand."""
    path = new_table_path(spark, "sorted")
    rows = documents(spark, sf_dir).select("doc_id", "n_chars", "text")
    rows.repartitionByRange("n_chars", "doc_id").sortWithinPartitions("n_chars", "doc_id").write.parquet(path)
    return _digested(ordinal.file_ordinal(spark, path))


def number_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return (
        ordinal.number_parts(rows, ["doc_id"], 500)
        .groupBy("part")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("doc_id").alias("first_id"),
            F.max("doc_id").alias("last_id"),
            F.sum(text_number(F.col("text"))).alias("text_sum"),
        )
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.profile(posts_all(spark, sf_dir)).select("column", "rows", "non_null")


def box_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.box_summary(documents(spark, sf_dir), "source")


def box_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.box_outliers(documents(spark, sf_dir), "lang")


def frequency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = report.frequency_report(posts_all(spark, sf_dir), LABEL)
    return counts.withColumn("share", F.round("share", 6))


# --- metrics and errors ------------------------------------------------------------------------


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir), LABEL, "pred")


def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics(scored(spark, sf_dir), LABEL, "pred")


def metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics(scored(spark, sf_dir), LABEL, "pred", ["source"])


def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    forms = {
        "rows": metrics.log_loss(df, LABEL, "p1"),
        "batches": metrics.log_loss(df, LABEL, "p1", 8, ["doc_id"]),
    }
    named = [d.select(F.lit(n).alias("form"), F.round("loss", 6).alias("loss")) for n, d in forms.items()]
    return named[0].unionByName(named[1])


def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    return errors.first_errors(df, "false_positive", 15, ["doc_id"], LABEL, "pred").select(
        "doc_id", LABEL, "pred"
    )


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5("text").alias("digest"), LABEL)


def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    return _digest(
        errors.false_positives(df, LABEL, "pred", distinct_text="text", order_by=["doc_id"])
    )


def false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    return _digest(
        errors.false_negatives(df, LABEL, "pred", distinct_text="text", order_by=["doc_id"])
    )


def true_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(errors.true_positives(scored(spark, sf_dir), LABEL, "pred"))


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.outcome_summary(scored(spark, sf_dir), LABEL, "pred", "text")


# --- sampling ----------------------------------------------------------------------------------


def split_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(sampling.split(documents(spark, sf_dir).select("doc_id", "text"), "doc_id"))


def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return _digested(sampling.split(rows, "doc_id", exact=True))


def oversample_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled_texts(spark, sf_dir).select("doc_id", LABEL, "text")
    return _digested(sampling.oversample(df, LABEL, "doc_id"))


def oversample_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled_texts(spark, sf_dir).select("doc_id", LABEL, "text")
    return _digested(sampling.oversample(df, LABEL, "doc_id", mode="bootstrap"))


def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(sampling.shuffle(documents(spark, sf_dir).select("doc_id", "lang", "text"), "doc_id"))


def shuffle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(sampling.shuffled_batches(documents(spark, sf_dir).select("doc_id", "text"), "doc_id"))


# --- tokens, models ----------------------------------------------------------------------------


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(F.col("text"))
    return texts(spark, sf_dir).select(
        "doc_id",
        F.size(words).alias("n_tokens"),
        F.md5(F.concat_ws(" ", words)).alias("digest"),
    )


def _train_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled_texts(spark, sf_dir)
    return sampling.split(df, "doc_id").filter("side = 'train'")


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build_vocab(_train_side(spark, sf_dir), "text")


def encode(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    words = features.build_vocab(_train_side(spark, sf_dir), "text")
    coded = features.encode(texts(spark, sf_dir), "text", words, **options)
    return coded.select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
    )


def _bayes(spark: SparkSession, sf_dir: str, fold_case: bool = True) -> bayes.NaiveBayesModel:
    return bayes.fit_nb(_train_side(spark, sf_dir), "text", LABEL, fold_case=fold_case)


def _bayes_scores(spark: SparkSession, sf_dir: str, fold_case: bool = True) -> DataFrame:
    model = _bayes(spark, sf_dir, fold_case)
    return bayes.score(model, texts(spark, sf_dir), "doc_id", "text")


def nb_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _bayes(spark, sf_dir).weights
    return weights.select("token", "n", F.round(F.get("w", F.lit(0)), 6).alias("weight"))


def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bayes_scores(spark, sf_dir).select("doc_id", "pred")


def nb_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bayes_scores(spark, sf_dir).select("doc_id", F.round("p1", 6).alias("p1"))


def stack_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = linear.stack(
        {"a": _bayes_scores(spark, sf_dir), "b": _bayes_scores(spark, sf_dir, False)}, "doc_id"
    )
    return both.select("doc_id", F.round("p_a", 6).alias("p_a"), F.round("p_b", 6).alias("p_b"))


def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled_texts(spark, sf_dir)
    scores = bayes.out_of_fold(df, "doc_id", "text", LABEL)
    return scores.select("doc_id", LABEL, F.round("p1", 6).alias("p1"))


def metrics_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per step of a run; the steps are the folds of an out-of-fold run."""
    df = labelled_texts(spark, sf_dir)
    scores = bayes.with_fold(bayes.out_of_fold(df, "doc_id", "text", LABEL), "doc_id")
    steps = scores.select(F.lit("bayes").alias("run"), F.col("fold").alias("step"), LABEL, "pred")
    return metrics.metrics(steps, LABEL, "pred", ["run", "step"])


def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    frames = [df.select(F.lit("stand_in").alias("model"), LABEL, "pred")]
    for name, fold_case in (("bayes_folded", True), ("bayes_cased", False)):
        model = _bayes(spark, sf_dir, fold_case)
        scores = bayes.score(model, labelled_texts(spark, sf_dir), "doc_id", "text", [LABEL])
        frames.append(scores.select(F.lit(name).alias("model"), LABEL, "pred"))
    return metrics.compare(union_sources(*frames, rank=None), LABEL, "pred")


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled_texts(spark, sf_dir)
    return training.error_report(_bayes(spark, sf_dir), df, "doc_id").summary


def error_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error sets of a model written under its name, and read back."""
    found = training.error_report(_bayes(spark, sf_dir), labelled_texts(spark, sf_dir), "doc_id")
    path = new_table_path(spark, "errors")
    training.write_error_report(found, path, "bayes")
    kinds = {"false_positive": "false_positives", "false_negative": "false_negatives"}
    sides = [
        posts.read_posts(spark, f"{path}/bayes/{name}", f"doc_id long, text string, {LABEL} int")
        .select(F.lit(kind).alias("kind"), "doc_id", F.md5("text").alias("digest"), LABEL)
        for kind, name in kinds.items()
    ]
    return sides[0].unionByName(sides[1])


def lr_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = linear.fit_lr(_train_side(spark, sf_dir), "text", LABEL)
    return linear.score_lr(model, texts(spark, sf_dir)).select("doc_id", "p1", "pred")


def meta_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = datasets.prepare(labelled_texts(spark, sf_dir), "doc_id")
    return training.train_stacked(data, "doc_id").scores


EPOCHS = epochs.Settings(batch_size=512)


def epoch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation side scored by a model after each of its epochs."""
    split = sampling.split(labelled_texts(spark, sf_dir), "doc_id")
    done = epochs.fit_epochs(split.filter("side = 'train'"), "doc_id", "text", LABEL, new_table_path(spark, "epochs"), EPOCHS)
    return epochs.score_epochs(done, split.filter("side = 'val'"), "text", EPOCHS, "doc_id", LABEL)


def metrics_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics(epoch_scores(spark, sf_dir), LABEL, "pred", ["epoch"])


# A public vocabulary and its ids of the start and the end of a text.
SUBWORDS, SUBWORD_START, SUBWORD_END = "word_bpe_49k.json", 49406, 49407


def _subword_file() -> str:
    return importlib.import_module("public_tokenizers").path(SUBWORDS)


def subword_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each subword of the vocabulary occurs."""
    return subwords.subword_counts(texts(spark, sf_dir), "text", _subword_file())


def subword_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = subwords.encode_subwords(texts(spark, sf_dir), "text", _subword_file(), SUBWORD_START, SUBWORD_END)
    return coded.select("doc_id", "input_ids", "attention_mask")


def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, ids and padding over all batches, each padded to its longest row."""
    batches = subwords.pad_batches(subword_encode(spark, sf_dir), "doc_id")
    used = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)
    return batches.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(used).alias("ids"),
        F.sum(F.size("input_ids") - used).alias("padding"),
    )


def external_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for an outside model: longer posts are likelier to be of class 1."""

    # Local, so that it reaches the workers by value and they need not have this package.
    def length_model() -> Callable:
        import numpy as np

        def predict(texts):
            lengths = np.array([len(t) for t in texts], dtype="float64")
            return 1.0 / (1.0 + np.exp(-(lengths - 1500.0) / 1000.0))

        return predict

    scores = linear.score_external(texts(spark, sf_dir), "text", length_model)
    return scores.select("doc_id", F.round("p1", 6).alias("p1"), "pred")


# --- whole jobs --------------------------------------------------------------------------------


def build_scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.regexp_extract("text", "https?://[^ \n]+", 0)
    first = documents(spark, sf_dir).select(
        "text",
        F.col("n_chars").alias("repostCount"),
        F.col("source").alias("createdAt"),
        F.when(link != "", link).alias("link/uri"),
    )
    second = table(spark, sf_dir, "conversations").select(
        "text",
        F.col("turn").alias("replyCount"),
        F.col("role").alias("createdAt"),
        F.when(F.col("role") != "user", F.col("role")).alias("images/0/alt"),
    )
    return _text_sums(datasets.build_scraped(first, second), ["link", "image", LABEL])


def build_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spread(
        documents(spark, sf_dir).select("doc_id", "text", _source_label()), "doc_id"
    )
    raw = spread(dirty(spark, sf_dir).select("doc_id", "text", LABEL), "doc_id")
    final = datasets.build_final(raw, extra, ["doc_id"])
    return _text_sums(final, [LABEL])


def prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spread(dirty(spark, sf_dir).select("doc_id", "text"), "doc_id")
    labels = posts_all(spark, sf_dir).select("doc_id", LABEL)
    # Unlabelled posts stand for class 0.
    df = raw.join(labels, "doc_id").fillna(0, [LABEL])
    data = datasets.prepare(df, "doc_id", lowercase=True, exact=True)
    train = data.train.select(F.lit("train").alias("side"), "text", LABEL)
    val = data.val.select(F.lit("val").alias("side"), "text", LABEL)
    return _text_sums(train.unionByName(val), ["side", LABEL])


def build_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = documents(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return _text_sums(datasets.build_unlabelled(raw), [LABEL]).withColumn(
        LABEL, F.col(LABEL).cast("int")
    )


def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on both sides: with the raw table split again, and with one prepared table."""
    rows = documents(spark, sf_dir).select("doc_id", "text").withColumn(LABEL, F.lit(0))
    data = datasets.prepare(rows, "doc_id", mode=None)
    raw_val = sampling.split(rows, "doc_id").filter("side = 'val'")
    cases = {"split_again": raw_val, "split_once": data.val}
    counts = [
        errors.leaked(data.train, val, "text").agg(
            F.lit(name).alias("construction"),
            F.count(F.lit(1)).alias("texts"),
            F.coalesce(F.sum("n_val"), F.lit(0)).alias("val_rows"),
        )
        for name, val in cases.items()
    ]
    return counts[0].unionByName(counts[1])


# --- files -------------------------------------------------------------------------------------


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "csv")
    posts.write_posts(documents(spark, sf_dir).select("doc_id", "lang", "text"), path)
    back = posts.read_posts(spark, path, "doc_id long, lang string, text string")
    return back.select("doc_id", "lang", F.md5("text").alias("digest"))


def csv_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with line breaks in fields, read back in byte ranges."""
    path = new_table_path(spark, "csv")
    posts.write_posts(documents(spark, sf_dir).select("doc_id", "lang", "text"), path)
    back = ranges.read_posts_by_ranges(spark, path, "doc_id long, lang string, text string")
    return back.select("doc_id", "lang", F.md5("text").alias("digest"))


def csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a file that has them in another order, among others."""
    path = new_table_path(spark, "csv")
    posts.write_posts(documents(spark, sf_dir).select("source", "text", "n_chars", "doc_id"), path)
    back = posts.read_posts(spark, path, "doc_id long, text string")
    return back.select("doc_id", F.md5("text").alias("digest"))


def _dirty_csv(spark: SparkSession, sf_dir: str) -> str:
    """Files of whole texts with stray quotes in an unquoted field; every fifth record has a field too many."""
    path = new_table_path(spark, "tolerant")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    stray = F.when(F.col("doc_id") % 7 == 0, 'it"s a "b').otherwise(F.col("source"))
    excess = F.when(F.col("doc_id") % 5 == 0, "too many")
    record = F.concat_ws(",", F.col("doc_id").cast("string"), stray, quoted, "lang", excess)

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("record", pa.string())])
        yield pa.RecordBatch.from_pydict({"record": ["doc_id,source,text,lang"]}, schema=kind)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, schema=kind)

    rows = texts_and(spark, sf_dir, "source", "lang").select(record.alias("record"))
    rows.mapInArrow(with_header, "record string").write.text(path)
    return path


def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a field too many are told apart from good ones, whole texts and all."""
    return _sides(*posts.read_tolerant(spark, _dirty_csv(spark, sf_dir), "lang string, text string, doc_id long"))


def tolerant_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records, read in byte ranges."""
    return _sides(*ranges.read_tolerant_by_ranges(spark, _dirty_csv(spark, sf_dir), "lang string, text string, doc_id long"))


def _sides(good: DataFrame, rejected: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    bad_id = F.substring_index("record", ",", 1).cast("long")
    return good.select("doc_id", "lang", F.md5("text").alias("digest"), F.lit(0).alias("rejected")).unionByName(
        rejected.select(bad_id.alias("doc_id"), none.alias("lang"), none.alias("digest"), F.lit(1).alias("rejected"))
    )


def unlabelled_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From file to file: read what is sound, label it 0, write, and read again."""
    good, _ = posts.read_tolerant(
        spark, _dirty_csv(spark, sf_dir), "doc_id long, text string", na_values=[]
    )
    path = new_table_path(spark, "unlabelled")
    posts.write_posts(datasets.build_unlabelled(good.withColumnRenamed("doc_id", "id")), path)
    back = posts.read_posts(spark, path, f"id long, text string, {LABEL} int", na_values=[])
    return _text_sums(back, [LABEL])


def parts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "parts")
    rows = documents(spark, sf_dir).select("doc_id", "lang", "text")
    posts.write_parts(rows, path, ["doc_id"], 500, "documents")
    return _parts_written(spark, path)


def arriving_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries as CSV, a run of the stream after each, from one checkpoint."""
    landing, path, log = (new_table_path(spark, x) for x in ("landing", "parts", "log"))
    rows = documents(spark, sf_dir).select("doc_id", "lang", "text")
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    third = F.floor((F.col("doc_id") - ends["low"]) * 3 / (ends["high"] - ends["low"] + 1))
    for delivery in range(3):
        posts.write_posts(rows.filter(third == delivery), landing, "append")
        stream = arriving.read_arriving(spark, landing, "doc_id long, lang string, text string", na_values=())
        arriving.write_arriving_parts(stream, path, log, ["doc_id"], 500, "documents").awaitTermination()
    return _parts_written(spark, path)


def _parts_written(spark: SparkSession, path: str) -> DataFrame:
    kind = "doc_id long, lang string, text string, documents_part long"
    back = spark.read.schema(kind).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return back.groupBy(F.col("documents_part").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
        F.sum(text_number(F.col("text"))).alias("text_sum"),
    )


def counts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "counts")
    posts.write_counts(posts_all(spark, sf_dir), LABEL, path)
    return posts.read_posts(spark, path, f"{LABEL} int, count long")


def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "model")
    models.save_model(spark, _bayes(spark, sf_dir), path)
    model = models.load_model(spark, path)
    scores = bayes.score(model, texts(spark, sf_dir), "doc_id", "text")
    return scores.select("doc_id", "pred", F.round("p1", 6).alias("p1"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "label_frequency": label_frequency,
    "presence_flags": presence_flags,
    "union_sources": union_of_sources,
    "valid_labels": valid_labels,
    "rejected_labels": rejected_labels,
    "strip_blank": strip_blank,
    "remove_emoji": emoji_removed,
    "keep_first": first_of_each,
    "keep_first_incremental": merged_by_index,
    "keep_first_folded": first_of_each_folded,
    "dedup_then_filter": dedup_then_filter,
    "head_rows": head_rows,
    "with_ordinal": with_ordinal,
    "file_ordinal": file_ordinal,
    "number_parts": number_parts,
    "profile": profile,
    "box_summary": box_summary,
    "box_outliers": box_outliers,
    "frequency_report": frequency_report,
    "confusion": confusion,
    "metrics": metrics_report,
    "metrics_by_source": metrics_by_source,
    "log_loss": log_loss,
    "first_errors": first_errors,
    "false_positives": false_positives,
    "false_negatives": false_negatives,
    "true_positives": true_positives,
    "outcome_summary": outcome_summary,
    "split_bucket": split_bucket,
    "split_exact": split_exact,
    "oversample_even": oversample_even,
    "oversample_bootstrap": oversample_bootstrap,
    "shuffle": shuffle_rows,
    "shuffle_batches": shuffle_batches,
    "tokens": token_counts,
    "vocab": vocab,
    "encode": encode,
    "encode_joined": lambda spark, sf_dir: encode(spark, sf_dir, max_lookup=1),
    "nb_weights": nb_weights,
    "nb_predict": nb_predict,
    "nb_proba": nb_proba,
    "stack_features": stack_features,
    "out_of_fold": out_of_fold,
    "metrics_by_step": metrics_by_step,
    "compare_models": compare_models,
    "error_report": error_report,
    "error_files": error_files,
    "lr_predict": lr_predict,
    "meta_predict": meta_predict,
    "epoch_scores": epoch_scores,
    "metrics_by_epoch": metrics_by_epoch,
    "subword_vocab": subword_vocab,
    "subword_encode": subword_encode,
    "padded_batches": padded_batches,
    "external_score": external_score,
    "build_scraped": build_scraped,
    "build_final": build_final,
    "prepare": prepare,
    "build_unlabelled": build_unlabelled,
    "leaked": leaked,
    "csv_round_trip": csv_round_trip,
    "csv_by_name": csv_by_name,
    "csv_by_ranges": csv_by_ranges,
    "tolerant_scan": tolerant_scan,
    "tolerant_by_ranges": tolerant_by_ranges,
    "unlabelled_file": unlabelled_file,
    "parts_round_trip": parts_round_trip,
    "arriving_parts": arriving_parts,
    "counts_round_trip": counts_round_trip,
    "model_round_trip": model_round_trip,
}
