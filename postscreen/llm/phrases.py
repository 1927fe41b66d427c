"""Phrase collocations from an FM-index for each shard of the corpus.

A text is lower-cased (A-Z) and cut into pieces at punctuation and line ends, and pieces into words at blanks and tabs. Tasks
gather documents into shards of about ``SHARD`` words, over word ids of their own. The index of a shard is
the BWT of its words, with a separator for each piece's end, sorted by the next ``DEPTH`` words; the position of a
row's next suffix is the stable order of the BWT's symbols. That order extends all intervals by one word at
once: rows are in one interval of depth d + 1 if their first words are equal and the rows of their next
suffixes are in one interval of depth d. To the right, an interval is cut by the intervals one deeper within it; to
the left, by the symbols of its rows' BWT. Both give the counts of a phrase with one word more.

Counts are summed over shards in three rounds: words, phrases of two and of three words. Each round sends hashes
and counts, in buckets by hash, and leaves a bitmap of the hashes that occur ``least`` times in all. The next
round extends an interval only if both of its parts are marked. The bitmap has a bound in size whatever
the corpus; a bit set by chance only lets a phrase through to the last round, in which the phrases themselves are
counted exactly, by name.

A task holds one shard's arrays at a time, of 32 bits but for hashes. A shard is a row group of its own in the file of the indexes, and a bitmap is a
file sent with the job, mapped by the tasks of an executor and copied by none.

Scores are made with DataFrame joins of phrases with their parts, in decimals of 38 digits.

Defined results: a null text is empty; a null language is ``und``; empty texts count no words; repeated rows count as often
as they are there; a phrase never spans two pieces; an empty table gives no rows. Ties in score go by count and phrase. A
text longer than a shard is a shard of its own. Other columns take no part, whatever their names.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import SparkContext, SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postscreen.llm.common import parts_for
from postscreen.llm.gaps import expand, squeeze
from postscreen.session import materialise, new_table_path

SHARD, DEPTH = 1_500_000, 4
LEAST, SCALE, INSIDE, TOP = 30, 2_000_000, 80, 2000
# Hashes that a bucket gathers, and bits of a bitmap: at most 2^28, or 32 MiB.
BUCKET, MAX_BITS, MAX_BUCKETS = 2_000_000, 28, 1 << 20
# Phrases that a task gathers before it sends them, added up in so many parts; those that are Python's at a time, and hashes
# looked up at a time.
GATHER, PARTS, NAMES, LOOKUP = 1_000_000, 8, 1 << 16, 1 << 18
UNKNOWN = "und"

# Signs that end a piece become a line end, a tab becomes a blank.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
INDEX = "shard long, words binary, of binary, langs array<string>, bwt binary, n_words long"


# --- an index ------------------------------------------------------------------------------------


def bwt(text: np.ndarray) -> np.ndarray:
    """The BWT of ``text`` (cyclic, symbols from 0, 0 separates), rows sorted by their first ``DEPTH`` symbols."""
    rank = text.astype(np.int64)
    n, width = len(text), 1
    order = np.arange(n)
    while width < DEPTH:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        width *= 2
    return text[order - 1]


class Index:
    """Intervals of a shard, found by extension through its BWT."""

    def __init__(self, symbols: np.ndarray, hashes: np.ndarray) -> None:
        # Row j's suffix is one word longer than that of row next[j].
        self.before = symbols
        self.next = np.argsort(symbols, kind="stable").astype(np.int32)
        self.first = symbols[self.next]
        self.hashes = hashes
        self.depth = 1
        low = self._cut(self.first)
        self.hash = hashes[self.first[low]]
        self.whole = self.first[low] != 0

    def _cut(self, *ranks: np.ndarray) -> np.ndarray:
        """Intervals of the rows that are alike in all ``ranks``; their first rows."""
        change = np.ones(len(self.first), bool)
        change[1:] = False
        for x in ranks:
            change[1:] |= x[1:] != x[:-1]
        self.intervals = np.cumsum(change, dtype=np.int32)
        self.intervals -= 1
        self.low = np.flatnonzero(change).astype(np.int32)
        self.count = np.diff(self.low, append=np.int32(len(self.first)))
        return self.low

    def extend(self, marked: np.ndarray) -> None:
        """One word to the left of every interval; ``marked`` tells which intervals may be part of a longer one."""
        old, to = self.intervals, self.intervals[self.next]
        low = self._cut(self.first, to)
        tails, words = to[low], self.first[low]
        whole = marked[old[low]] & marked[tails] & self.whole[tails] & (words != 0)
        del old, to
        hashes = self.hash[tails]
        hashes += np.uint64(self.depth)
        hashes = _mix(hashes)
        hashes += self.hashes[words]
        self.hash, self.whole = _mix(hashes), whole
        self.depth += 1

    def words(self, rows: np.ndarray) -> np.ndarray:
        """The symbols of the phrases at the rows, one column for each of their words."""
        out = []
        for _ in range(self.depth):
            out.append(self.first[rows])
            rows = self.next[rows]
        return np.stack(out, axis=1)

    def extensions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, count, side) of each one-word extension; side 0 is left (BWT), 1 right (next words)."""
        inside = np.flatnonzero(self.whole[self.intervals])
        last = inside
        for _ in range(self.depth):
            last = self.next[last]
        out = []
        for side, symbol in enumerate((self.before[inside], self.first[last])):
            key = self.intervals[inside].astype(np.int64) * (int(self.first.max()) + 1) + symbol
            distinct, n = np.unique(key[symbol != 0], return_counts=True)
            who, what = np.divmod(distinct, int(self.first.max()) + 1)
            out.append((who, what, n, np.full(len(who), side)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _mix(x: np.ndarray) -> np.ndarray:
    """``x`` itself, mixed in its place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


# --- shards --------------------------------------------------------------------------------------


class _Shard:
    """Word ids of the documents gathered so far; 0 separates pieces."""

    def __init__(self) -> None:
        self.ids: dict[bytes, dict[bytes, int]] = {}
        self.names: list[bytes] = [b""]
        self.of: list[int] = [0]
        self.text: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.size = 0

    def add(self, lang: str, raw: bytes) -> None:
        known = self.ids.setdefault(lang, {b"": -1, b"\n": 0})
        words = raw.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        found = list(map(known.get, words))
        if None in found:
            number = list(self.ids).index(lang)
            for w in dict.fromkeys(words):
                if w not in known:
                    known[w] = len(self.names)
                    self.names.append(w)
                    self.of.append(number)
            found = list(map(known.__getitem__, words))
        codes = np.array(found, np.int32)
        self.text += [codes[codes >= 0], np.zeros(1, np.int32)]
        self.size += int((codes > 0).sum())

    def row(self, number: int) -> dict:
        text = np.concatenate(self.text)
        langs, of = list(self.ids), np.array(self.of, np.int32)
        return {
            # Words hold no line end.
            "shard": number, "words": b"\n".join(self.names), "of": of.tobytes(), "langs": langs,
            "bwt": bwt(text).tobytes(), "n_words": int((text != 0).sum()),
        }


def build(df: DataFrame, text: str, lang: str, shard: int = SHARD) -> DataFrame:
    """The index of each shard, one row each; see ``INDEX``."""
    kinds = [("shard", pa.int64()), ("words", pa.binary()), ("of", pa.binary()), ("langs", pa.list_(pa.string())),
             ("bwt", pa.binary()), ("n_words", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, _Shard()
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for spoken, raw in zip(langs, batch.column("raw"), strict=True):
                held.add(spoken, raw.as_py())
                if held.size >= shard or len(held.text) >= shard:
                    yield pa.RecordBatch.from_pylist([held.row(number)], schema=schema)
                    number, held = number + 1, _Shard()
        if len(held.text) > 1:
            yield pa.RecordBatch.from_pylist([held.row(number)], schema=schema)

    rows = df.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("raw"),
    )
    return rows.mapInArrow(run, INDEX)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The shards one after another; their long columns are not copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            yield {c: x.as_buffer() if isinstance(x, pa.BinaryScalar) else x.as_py() for c, x in row.items()}


def _load(row: dict) -> tuple[Index, list[bytes], np.ndarray]:
    """A shard's index, its words and the place of each word's language."""
    names, of = row["words"].to_pybytes().split(b"\n"), np.frombuffer(row["of"], np.int32)
    # The hash of a word goes with its language.
    seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in row["langs"]]
    hashes = np.zeros(len(names), np.uint64)
    hashes[1:] = np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[k]) for w, k in zip(names[1:], of[1:], strict=True)), np.uint64, len(names) - 1)
    return Index(np.frombuffer(row["bwt"], np.int32), hashes), names, of


def _send_mark(context: SparkContext, mark: np.ndarray) -> str:
    """The name of a bitmap that is sent with the jobs from now on, to each executor once."""
    with tempfile.NamedTemporaryFile(dir=os.path.realpath(context._temp_dir), delete=False) as f:
        mark.tofile(f)
    context.addFile(f.name)
    return os.path.basename(f.name)


def _marks(names: list[str]) -> list[np.ndarray]:
    return [np.memmap(SparkFiles.get(x), np.uint8, "r") for x in names]


def _seen(mark: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes are marked."""
    out = np.empty(len(hashes), bool)
    for i in range(0, len(hashes), LOOKUP):
        at = hashes[i : i + LOOKUP] >> np.uint64(64 - bits)
        out[i : i + LOOKUP] = (mark[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
    return out


def _deepen(index: Index, marks: list[np.ndarray], bits: int) -> None:
    """Extend by one word for each bitmap, as far as the bitmaps allow."""
    for mark in marks:
        index.extend(index.whole & _seen(mark, index.hash, bits))


# --- rounds --------------------------------------------------------------------------------------


def frequent_hashes(
    indexes: DataFrame, marks: list[str], bits: int, buckets: int, width: int, least: int
) -> np.ndarray:
    """The bitmap of the phrases one word longer than there are ``marks`` (files sent) that occur ``least`` times in all.

    Sent are the first ``width`` bits of the hashes, enough that few meet by chance, and counts up to ``least``.
    """
    schema = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
    kind = np.min_scalar_type(least)
    inner = width - buckets  # bits of a hash within its bucket

    def found(row: dict, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The first bits of a shard's hashes, rising, with their counts."""
        index = _load(row)[0]
        _deepen(index, held, bits)
        whole = np.flatnonzero(index.whole)
        hashes = index.hash[whole]
        counts = np.minimum(index.count[whole], least).astype(kind)
        del index, whole
        hashes >>= np.uint64(64 - width)
        order = np.argsort(hashes)
        return hashes[order], counts[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _marks(marks)
        for row in _rows(batches):
            hashes, counts = found(row, held)
            # Buckets are ranges of hashes; their number is a power of two.
            bucket = (hashes >> np.uint64(inner)).astype(np.int64)
            hashes &= np.uint64((1 << inner) - 1)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            for s in range(0, len(starts), 512):
                bounds = [*starts[s : s + 512], starts[s + 512] if s + 512 < len(starts) else len(hashes)]
                rows = [
                    {"bucket": int(bucket[i]), "hashes": squeeze(hashes[i:j]), "counts": counts[i:j].tobytes()}
                    for i, j in zip(bounds, bounds[1:], strict=False)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def total(table: pa.Table) -> pa.Table:
        hashes = np.concatenate([expand(x) for x in table.column("hashes").to_pylist()])
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), kind)
        order = np.argsort(hashes)
        hashes = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        often = hashes[starts][np.add.reduceat(counts[order].astype(np.int64), starts) >= least]
        # The part of the bitmap that belongs to the bucket.
        number = table.column("bucket")[0].as_py()
        part = np.zeros(1 << (bits - buckets), np.uint8)
        part[(often >> np.uint64(width - bits)).astype(np.int64)] = 1
        return pa.table({"bucket": pa.array([number], pa.int64()), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    sent = indexes.select("words", "of", "langs", "bwt").mapInArrow(count, "bucket long, hashes binary, counts binary")
    parts = sent.groupBy("bucket").applyInArrow(total, "bucket long, bits binary")
    # All parts together are the bitmap, 2^bits / 8 bytes; one job makes them.
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = len(out) >> buckets
    for batch in parts.toArrow().to_batches():
        for number, part in zip(batch.column("bucket").to_pylist(), batch.column("bits"), strict=True):
            out[number * width : (number + 1) * width] = np.frombuffer(part.as_buffer(), np.uint8)
    return out


def named(indexes: DataFrame, marks: list[str], bits: int, buckets: int, least: int) -> DataFrame:
    """lang, k, phrase, f of all phrases of up to ``DEPTH`` words that occur ``least`` times; exact.

    A task adds up its shards and sends the phrases that the bitmaps leave, in order and compressed, in buckets by hash.
    """
    schema = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])
    names = ["lang", "bucket", "phrase", "f"]

    def found(row: dict, held: list[np.ndarray]) -> Iterator[pa.Table]:
        index, words, of = _load(row)
        langs = pa.array(row["langs"], pa.string())
        for k in range(1, DEPTH + 1):
            if k > 1:
                _deepen(index, [held[k - 2]], bits)
            which = np.flatnonzero(index.whole & _seen(held[k - 1], index.hash, bits) if k <= len(held) else index.whole)
            for i in range(0, len(which), NAMES):
                own = which[i : i + NAMES]
                symbols = index.words(index.low[own])
                bucket = (index.hash[own] >> np.uint64(64 - buckets)).astype(np.int32) if buckets else np.zeros(len(own), np.int32)
                phrases = pa.array([b" ".join([words[w] for w in x]) for x in symbols.tolist()], pa.binary())
                spoken = langs.take(pa.array(of[symbols[:, 0]]))
                yield pa.table([spoken, pa.array(bucket), phrases, pa.array(index.count[own])], names)

    def packed(table: pa.Table) -> Iterator[dict]:
        table = table.group_by(names[:3]).aggregate([("f", "sum")])
        table = table.sort_by([(c, "ascending") for c in names[:3]]).combine_chunks()
        langs, phrases = table.column("lang").chunk(0), table.column("phrase").chunk(0)
        bucket, f = table.column("bucket").to_numpy(), table.column("f_sum").to_numpy()
        new = np.ones(len(bucket), bool)
        new[1:] = pc.not_equal(langs[1:], langs[:-1]).to_numpy(zero_copy_only=False) | (bucket[1:] != bucket[:-1])
        starts = np.flatnonzero(new).tolist()
        for i, j in zip(starts, [*starts[1:], len(bucket)], strict=True):
            # Words hold no line end.
            yield {
                "bucket": int(bucket[i]), "lang": langs[i].as_py(), "counts": zstandard.compress(f[i:j].tobytes()),
                "phrases": zstandard.compress(b"\n".join(phrases[i:j].to_pylist())),
            }

    def send(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held)
        held.clear()
        part = table.column("bucket").to_numpy() * PARTS >> buckets
        for p in range(PARTS):
            own = table.filter(pa.array(part == p))
            if own.num_rows:
                rows = packed(own)
                while some := list(islice(rows, 256)):
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped, held, n = _marks(marks), [], 0
        for row in _rows(batches):
            for table in found(row, mapped):
                held.append(table)
                n += table.num_rows
                if n >= GATHER:
                    yield from send(held)
                    n = 0
        if n:
            yield from send(held)

    def total(table: pa.Table) -> pa.Table:
        phrases = [x for raw in table.column("phrases").to_pylist() for x in zstandard.decompress(raw).split(b"\n")]
        counts = b"".join(zstandard.decompress(x) for x in table.column("counts").to_pylist())
        rows = pa.table([pa.array(phrases, pa.binary()), pa.array(np.frombuffer(counts, np.int64))], ["phrase", "f"])
        rows = rows.group_by("phrase").aggregate([("f", "sum")])
        rows = rows.filter(pc.greater_equal(rows.column("f_sum"), least))
        phrases = rows.column("phrase").to_pylist()
        lang = pa.array([table.column("lang")[0].as_py()] * len(phrases), pa.string())
        k = pa.array([x.count(b" ") + 1 for x in phrases], pa.int32())
        return pa.table([lang, k, pa.array(phrases, pa.binary()), rows.column("f_sum")], ["lang", "k", "phrase", "f"])

    sent = indexes.select("words", "of", "langs", "bwt").mapInArrow(run, "bucket long, lang string, phrases binary, counts binary")
    return sent.groupBy("bucket", "lang").applyInArrow(total, "lang string, k int, phrase binary, f long")


def totals(indexes: DataFrame) -> DataFrame:
    """lang, n: all words of each language."""

    schema = pa.schema([("lang", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            of = np.frombuffer(row["of"], np.int32)
            counts = np.bincount(np.frombuffer(row["bwt"], np.int32), minlength=len(of))
            n = np.zeros(len(row["langs"]), np.int64)
            np.add.at(n, of[1:], counts[1:])
            yield pa.RecordBatch.from_pydict({"lang": row["langs"], "n": n}, schema=schema)

    found = indexes.select("of", "langs", "bwt").mapInArrow(run, "lang string, n long")
    return found.groupBy("lang").agg(F.sum("n").alias("n"))


# --- the operator --------------------------------------------------------------------------------


def count(df: DataFrame, text: str, lang: str, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of up to four words with f >= ``least``, and (lang, n)."""
    spark = df.sparkSession
    path = new_table_path(spark, "indexes")
    # Word ids and hashes don't shrink under a fast codec. A shard is a row group: neither writer nor reader holds more.
    build(df, text, lang, shard).write.options(**{"compression": "zstd", "parquet.block.row.count.limit": "1"}).parquet(path)
    indexes = spark.read.schema(INDEX).parquet(path)
    size = indexes.agg(F.sum("n_words")).first()[0] or 0
    bits = min(MAX_BITS, max(16, int(size // 8).bit_length()))
    wanted = max(parts_for(size, BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = min(bits - 3, (min(wanted, MAX_BUCKETS) - 1).bit_length())
    width = min(64, int(size).bit_length() + 10)
    marks: list[str] = []
    for _ in range(1, DEPTH):
        marks.append(_send_mark(spark.sparkContext, frequent_hashes(indexes, marks, bits, buckets, width, least)))
    found = named(indexes, marks, bits, buckets, least)
    found = found.withColumn("phrase", F.col("phrase").cast("string"))
    return materialise(found, "phrases"), materialise(totals(indexes), "totals")


def score(grams: DataFrame, sizes: DataFrame, scale: int = SCALE, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best of each language, from counted phrases."""
    words = F.split("phrase", " ")
    longer = grams.filter("k > 1")

    def part(start: int, length: Column) -> Column:
        return F.array_join(F.slice(words, start, length), " ")

    # A phrase within a longer one is within one that is longer by a word, which occurs as often at least.
    ends = longer.filter("k > 2").select(
        "lang", F.explode(F.array(part(1, F.col("k") - 1), part(2, F.col("k") - 1))).alias("phrase"), "f"
    )
    around = ends.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = longer.join(around, ["lang", "phrase"], "left").filter(
        F.col("around").isNull()
        | (F.col("around").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * inside)
    )
    cut = kept.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cut = cut.withColumns({"left": F.array_join(F.slice(words, F.lit(1), F.col("j")), " "),
                           "right": F.array_join(F.slice(words, F.col("j") + 1, F.col("k") - F.col("j")), " ")})
    lefts = grams.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = grams.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cut = cut.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    exact = F.expr(f"(cast(a as decimal(20,0)) * cast({scale} as decimal(17,0))) div (cast(l as decimal(20,0)) + r)")
    cut = cut.withColumn("score", exact)
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "j", "l", "r")).alias("low"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn("rank", F.row_number().over(order))
    best = ranked.filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The collocations of each language of ``df``."""
    return score(*count(df, text, lang))
