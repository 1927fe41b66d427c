"""Encoding with a subword tokenizer that is given as a file, fixed or padded to the longest of a batch.

No tokenizer is trained here. The file is read by the driver and sent to the executors with the job; every
executor tokenizes Arrow batches, a bounded piece at a time. Where a tokenizer never looks across blanks, words are counted
before they are tokenized, and a row that keeps its first ids only is tokenized as far as they reach.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts and characters that are tokenized at a time.
PIECE_ROWS, PIECE_CHARS = 1_000, 1 << 20
# Characters for each id that is kept, of which the ids are looked for first.
HEAD_CHARS = 12
# The blanks at which a text is split; tokenizers split at them and others.
BLANKS = " \t\n\r"
# Texts whose ids tell whether blanks matter.
_PROBES = ("ab", "12", "a1", "it's", "-", ".", "\u00e9", "\u65e5", "A")

# Tokenizers that a Python worker has built, by the contents of their file.
_BUILT: dict[str, object] = {}


def _tokenizer(source: str):
    from tokenizers import Tokenizer

    if source not in _BUILT:
        _BUILT.clear()
        _BUILT[source] = Tokenizer.from_str(source)
    return _BUILT[source]


def _ids_of(source: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in _tokenizer(source).encode_batch_fast(texts, add_special_tokens=False)]


def splits_at_blanks(source: str) -> bool:
    """Whether a text's ids are those of the words between its blanks, one after the other.

    Only for a pre-tokenizer that begins by keeping the matches of a pattern which says what a match may hold in classes
    of letters, digits and what is neither nor a blank; nothing may cut or fill a text, and no added token may hold a blank.
    """
    t = json.loads(source)
    first = t.get("pre_tokenizer") or {}
    if first.get("type") == "Sequence":
        first = (first.get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    known = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    normalizer = t.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    alike = all(n["type"] in ("NFC", "Lowercase") or n == spaces for n in steps)
    added = t.get("added_tokens") or []
    apart = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or set(x["content"]) & set(BLANKS) for x in added)
    if not (known and kept and alike and apart) or t.get("truncation") or t.get("padding"):
        return False
    pairs = [(a, b) for a in _PROBES for b in _PROBES]
    joined = _ids_of(source, [f"{a}{blank}{b}" for a, b in pairs for blank in BLANKS])
    alone = dict(zip(_PROBES, _ids_of(source, list(_PROBES)), strict=True))
    return joined == [alone[a] + alone[b] for a, b in pairs for _ in BLANKS]


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of few rows and characters; a longer text is a list of its own."""
    for at in range(0, len(texts), PIECE_ROWS):
        piece, chars = [], 0
        for t in texts.slice(at, PIECE_ROWS).to_pylist():
            if piece and chars + len(t or "") > PIECE_CHARS:
                yield piece
                piece, chars = [], 0
            piece.append(t)
            chars += len(t or "")
        if piece:
            yield piece


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _first_ids(df: DataFrame, text: Column, source: str, most: int) -> DataFrame:
    """``df`` with ``_ids``, the first ``most`` ids of each text; none for a missing one."""
    shared = df.sparkSession.sparkContext.broadcast(source)

    @F.arrow_udf("array<int>")
    def whole(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.int32()))]
        for piece in _pieces(texts):
            some = iter(_ids_of(shared.value, [t for t in piece if t is not None]))
            parts.append(pa.array([None if t is None else next(some)[:most] for t in piece], pa.list_(pa.int32())))
        return pa.concat_arrays(parts)

    @F.arrow_udf("array<int>")
    def head(texts: pa.Array, more: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.int32()))]
        rest = iter(more.to_pylist())
        for piece in _pieces(texts):
            cut = [(t, next(rest)) for t in piece]
            # The last word may go on behind the head.
            kept = [t[: max(t.rfind(b) for b in BLANKS) + 1] if m else t or "" for t, m in cut]
            found = _ids_of(shared.value, kept)
            short = [m and len(x) < most for x, (_, m) in zip(found, cut, strict=True)]
            parts.append(pa.array([None if s else x[:most] for x, s in zip(found, short, strict=True)], pa.list_(pa.int32())))
        return pa.concat_arrays(parts)

    if not splits_at_blanks(source):
        return df.withColumn("_ids", whole(F.coalesce(text, F.lit(""))))
    chars = HEAD_CHARS * (most + 1)
    longer = F.coalesce(F.length(text) > chars, F.lit(False))
    begun = df.withColumn("_head", head(F.substring(text, 1, chars), longer))
    # Heads of too few ids: their texts are tokenized whole.
    return begun.withColumn("_ids", F.coalesce("_head", whole(F.when(F.col("_head").isNull(), text)))).drop("_head")


def subword_counts(df: DataFrame, text: str, path: str) -> DataFrame:
    """id, n: how often each subword of the file occurs; a missing text has none.

    Where the tokenizer splits at blanks, words are counted first and each distinct one is tokenized once.
    """
    source = _read(path)
    shared = df.sparkSession.sparkContext.broadcast(source)
    texts = df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    if splits_at_blanks(source):
        words = texts.select(F.explode(F.split("text", f"[{BLANKS}]+")).alias("text")).filter("text != ''")
        counted = words.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = texts.withColumn("n", F.lit(1).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[int] = Counter()  # as many as the vocabulary has, at most
        for batch in batches:
            times = iter(batch.column("n").to_pylist())
            for piece in _pieces(batch.column("text")):
                ids = _ids_of(shared.value, piece)
                flat = np.array([x for found in ids for x in found], np.int64)
                each = np.repeat([next(times) for _ in piece], [len(found) for found in ids]).astype(np.int64)
                held, place = np.unique(flat, return_inverse=True)
                sums = np.zeros(len(held), np.int64)
                np.add.at(sums, place, each)
                for i, n in zip(held.tolist(), sums.tolist(), strict=True):
                    own[i] += n
        yield pa.RecordBatch.from_pydict({"id": pa.array(list(own), pa.int32()), "n": pa.array(list(own.values()), pa.int64())})

    return counted.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode_subwords(
    df: DataFrame, text: str, path: str, start: int, end: int, pad: int = 0, max_length: int = 128
) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask`` of ``max_length``: start, the first ids, end, then ``pad``.

    The cut to ``max_length`` is what the operator is for. A missing text is encoded like an empty one. Where the tokenizer
    splits at blanks, a text is tokenized up to a blank behind its first ids, or whole if it has too few of them there.
    """
    if max_length < 2:
        raise ValueError("max_length must leave room for the start and end ids")
    kept = _first_ids(df, F.col(text), _read(path), max_length - 2)
    kept = kept.withColumn("_ids", F.coalesce("_ids", F.array().cast("array<int>")))
    used = F.size("_ids") + 2
    return kept.withColumns(
        {
            "input_ids": F.concat(
                F.array(F.lit(start)), "_ids", F.array(F.lit(end)), F.array_repeat(F.lit(pad), F.lit(max_length) - used)
            ),
            "attention_mask": F.concat(
                F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_length) - used)
            ),
        }
    ).drop("_ids")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of all lists, one list after the other, and where each begins and how many it has."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), offsets[:-1] - offsets[0], np.diff(offsets)


def pad_batches(df: DataFrame, key: str, batch_size: int = 32, pad: int = 0, gather: int = 4096) -> DataFrame:
    """key, batch, place, input_ids, attention_mask: rows of like length together, each batch padded to its longest.

    ``df`` has ``input_ids`` and ``attention_mask`` padded to one length. A task sorts what it gathers by length and cuts it into
    batches, numbered by task, so nothing is shuffled and no batch spans tasks.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, gather):
                part = whole.slice(at, gather)
                (ids, starts, _), (masks, _, lengths) = (_flat(part.column(c)) for c in ("ids", "mask"))
                sizes = np.bincount(np.repeat(np.arange(len(lengths)), lengths), masks, minlength=len(lengths)).astype(np.int64)
                order = np.argsort(sizes, kind="stable")
                group = np.arange(len(order)) // batch_size
                # In order of size, the last row of a batch is its longest.
                last = np.minimum((group + 1) * batch_size, len(order)) - 1
                used, width = sizes[order], sizes[order][last]
                ends = np.concatenate([[0], np.cumsum(width)])
                place = np.arange(ends[-1]) - np.repeat(ends[:-1], width)
                held = place < np.repeat(used, width)
                flat = np.full(len(place), pad, np.int32)
                flat[held] = ids[(np.repeat(starts[order], width) + place)[held]]
                offsets = pa.array(ends.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(order)),
                        pa.array(number + group),
                        pa.array((np.arange(len(order)) - group * batch_size).astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(flat)),
                        pa.ListArray.from_arrays(offsets, pa.array(held.astype(np.int32))),
                    ],
                    names=["key", "batch", "place", "input_ids", "attention_mask"],
                )
                number += int(group[-1]) + 1

    rows = df.select(F.col(key).alias("key"), F.col("input_ids").alias("ids"), F.col("attention_mask").alias("mask"))
    schema = f"key {kind}, batch long, place int, input_ids array<int>, attention_mask array<int>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
