"""Packing a stream of documents, in its order, into windows by dynamic programming.

Each task takes the documents it reads in their order, turns them into token ids and gathers chunks of about
``CHUNK`` ids. A chunk is cut into windows of at most ``capacity`` ids. Cuts may fall at the end of a document (free), at the end of
a sentence, or, where no sentence ends for a while, at any of some further places, each at a penalty. The cost of a packing
is its padding, the penalties of its cuts and a fixed part for each window. With f(j) the least cost up to place j,

    f(j) = penalty(j) + min over i with place(j) - place(i) <= capacity of f(i) + padding(j - i) + overhead

and as padding is capacity - place(j) + place(i), the minimum is that of f(i) + place(i) over a sliding window, which a
monotone queue keeps. A window whose length is a power of two needs no padding, which adds at most
one more i for each power. No rows are shuffled, and nothing is gathered beyond a chunk.

Tokens come from a tokenizer file. Its rules never look across blanks, so words between blanks are encoded
once and remembered; texts are put together from them.

Defined results: a null or empty text is one piece that holds only the end token; a text longer than a chunk is a chunk of its
own and gives many pieces; rows that repeat and null keys are packed like others; an empty table gives no rows. Of
equally cheap packings the one with the longer last window is taken. Other columns take no part, whatever their names.
Sequences are numbered by the partition that is read; another order of the rows gives another packing.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, CHUNK = 4096, 1 << 20
# Costs in tokens of padding: a window, a cut at the end of a sentence, and one elsewhere.
OVERHEAD, AT_SENTENCE, ELSEWHERE = 16, 4, 12
# Where no sentence ends, a cut may fall every so many ids.
STRIDE = 32
# Characters that end a sentence.
ENDS = ".!?…。！？"
REMEMBER = 1_000_000


class Words:
    """Token ids of texts, put together from those of their words, which are remembered.

    For tokenizers that drop blanks, lower-case ASCII and end the last token of a run of letters in ``</w>``, as the public
    word vocabulary does. A text has there the ids of the words between its blanks, and a blank between
    a letter or digit and a sign changes nothing.
    """

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        # Words of letters alone are encoded together and told apart by their last tokens.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.ends = array("I"), array("q", [0])
        self.packed = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _add(self, words: list[str], ids: list[int], ends: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.ends), len(self.ends) + len(words)), strict=True))
        self.ends.frombytes((ends + len(self.flat)).astype(np.int64).tobytes())
        self.flat.extend(ids)

    def _learn(self, words: list[str]) -> None:
        letters, mixed = [], []
        for w in words:
            (letters if w.isalpha() else mixed).append(w)
        for i in range(0, len(letters), 2_000):
            some = letters[i : i + 2_000]
            ids = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(self.last[np.array(ids, np.int64)]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._add(some, ids, ends)
            else:  # normalised into something that is not one run of letters
                mixed += some
        for i in range(0, len(mixed), 2_000):
            some = mixed[i : i + 2_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, [x for f in found for x in f], np.cumsum([len(f) for f in found]))
        ends = np.array(self.ends)
        lengths = np.diff(ends, prepend=0)
        self.packed = np.array(self.flat, np.uint32), lengths, ends - lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; null is empty."""
        texts = pc.coalesce(texts, pa.scalar("", texts.type))
        # The strings of special tokens are told by their case.
        plain = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        apart = pc.replace_substring_regex(plain, r"([0-9A-Za-z])([.,;:!?])", r"\1 \2")
        for blank in "\t\n\r":
            apart = pc.replace_substring(apart, blank, " ")
        split = pc.split_pattern(apart, " ")
        words = split.flatten().dictionary_encode()
        if len(self.known) > REMEMBER:
            self.clear()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        flat, lengths, starts = self.packed
        at = np.array([self.known[w] for w in distinct], np.int64)[words.indices.to_numpy()]
        n = lengths[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(int(n.sum()))]
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, np.diff(np.concatenate([[0], ends])[bounds])


# The words that a Python worker remembers, by its tokenizer; the next task of the worker goes on with them.
_WORKER: dict[str, Words] = {}


def words_of(tokenizer: str) -> Words:
    """The remembered words of this worker."""
    if tokenizer not in _WORKER:
        _WORKER.clear()
        _WORKER[tokenizer] = Words(tokenizer)
    return _WORKER[tokenizer]


def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each id, whether its token ends in a sign that ends a sentence."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer)
    out = np.zeros(t.get_vocab_size(), bool)
    # Tokens of byte-level vocabularies spell other bytes than ASCII in letters of their own; those are decoded.
    signs = {"".join(t.id_to_token(i) for i in t.encode(s, add_special_tokens=False).ids).removesuffix("</w>") for s in ENDS}
    for token, i in t.get_vocab().items():
        out[i] = any(token.removesuffix("</w>").endswith(s) for s in signs if s)
    return out


def places(lengths: np.ndarray, ends: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Where a chunk may be cut (first 0, last its length), and the penalty of each cut.

    ``lengths`` are those of the documents, ``ends`` the places behind the end of a sentence.
    """
    bounds = np.cumsum(lengths)
    total = int(bounds[-1])
    at = np.unique(np.concatenate([[0], bounds, ends]))
    # Stretches without an end are cut at a stride.
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > STRIDE)
    n = (gaps[wide] - 1) // STRIDE
    inside = np.repeat(at[wide], n) + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    # What is left behind the last full window can be cut into powers of two.
    rest, tail = total % capacity, []
    for k in range(capacity.bit_length() - 1, -1, -1):
        if rest >> k & 1:
            tail.append(total - (rest & ((1 << k) - 1)))
    found = np.unique(np.concatenate([at, inside, [total - rest], tail])).astype(np.int64)
    penalty = np.full(len(found), ELSEWHERE, np.int64)
    penalty[np.isin(found, ends)] = AT_SENTENCE
    penalty[np.isin(found, bounds)] = 0
    penalty[0] = 0
    return found, penalty


def cuts(at: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY, overhead: int = OVERHEAD) -> list[int]:
    """Indexes in ``at`` of the cuts of the cheapest packing, the last place included."""
    n = len(at)
    # For each place, the earlier ones at a distance that is a power of two below the capacity.
    later, earlier = [], []
    for k in range(capacity.bit_length()):
        if 1 << k >= capacity:
            break
        i = np.searchsorted(at, at - (1 << k))
        hit = np.flatnonzero((at >= 1 << k) & (at[i] == at - (1 << k)))
        later.append(hit)
        earlier.append(i[hit])
    to = np.concatenate([np.empty(0, np.int64), *later])
    order = np.argsort(to, kind="stable")
    exact_to = [*to[order].tolist(), n]
    exact_from = np.concatenate([np.empty(0, np.int64), *earlier])[order].tolist()

    place, extra = at.tolist(), penalty.tolist()
    least, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f(i) + place(i), place(i), i
    e = 0
    for j in range(1, n):
        here = place[j]
        while queue[0][1] < here - capacity:
            queue.popleft()
        value, _, i = queue[0]
        cost = value + capacity - here
        while exact_to[e] == j:
            other = exact_from[e]
            if least[other] < cost:
                cost, i = least[other], other
            e += 1
        cost += overhead + extra[j]
        least[j], back[j] = cost, i
        value = cost + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, here, j))
    out, j = [], n - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def _pieces(lengths: np.ndarray, ids: np.ndarray, is_end: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of a chunk lie: document, start in it, length, window, offset, and place in the chunk."""
    ends = np.flatnonzero(is_end[ids]) + 1
    at, penalty = places(lengths, ends, capacity)
    windows = at[cuts(at, penalty, capacity)]
    bounds = np.cumsum(lengths)
    starts = np.unique(np.concatenate([[0], bounds[:-1], windows[:-1]])).astype(np.int64)
    document = np.searchsorted(bounds, starts, side="right")
    window = np.searchsorted(windows, starts, side="right")
    first = np.concatenate([[0], windows[:-1]])
    return {
        "document": document,
        "start": starts - (bounds - lengths)[document],
        "length": np.diff(np.append(starts, bounds[-1])),
        "window": window,
        "offset": starts - first[window],
        "place": starts,
    }


def pack(
    df: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY
) -> DataFrame:
    """key, start, length, ids (little-endian, 32 bits each), doc_tokens, sequence_id, offset of every piece.

    ``tokenizer_path`` is read by the driver and sent to the executors with the job. ``end_id`` ends every document.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    shared = df.sparkSession.sparkContext.broadcast((tokenizer, sentence_ends(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, is_end = shared.value
        if end_id >= len(is_end):
            is_end = np.append(is_end, np.zeros(end_id + 1 - len(is_end), bool))
        words = words_of(file)
        # One number for each window: the partition above bit 33.
        number = TaskContext.get().partitionId() << 33

        def flush(keys: list[pa.Array], ids: list[np.ndarray], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            flat, sizes = np.concatenate(ids), np.concatenate(lengths)
            p = _pieces(sizes, flat, is_end, capacity)
            raw = flat.astype("<u4").tobytes()
            held = pa.concat_arrays(keys)
            # Bounded batches: a piece has at most capacity ids.
            for i in range(0, len(p["place"]), 1024):
                s = slice(i, i + 1024)
                offsets = np.append(p["place"][s], p["place"][s][-1] + p["length"][s][-1])
                chunk = pa.py_buffer(raw[offsets[0] * 4 : offsets[-1] * 4])
                small = pa.py_buffer(((offsets - offsets[0]) * 4).astype(np.int32).tobytes())
                binary = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, small, chunk])
                yield pa.RecordBatch.from_arrays(
                    [
                        held.take(pa.array(p["document"][s])), pa.array(p["start"][s]), pa.array(p["length"][s]), binary,
                        pa.array(sizes[p["document"][s]]), pa.array(number + p["window"][s]), pa.array(p["offset"][s]),
                    ],
                    names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            number += int(p["window"][-1]) + 1

        keys, ids, lengths, n = [], [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                found, sizes = words.encode(some.column("text"))
                found = np.insert(found, np.cumsum(sizes), np.uint32(end_id))
                keys.append(some.column("key"))
                ids.append(found)
                lengths.append(sizes + 1)
                n += len(found)
                if n >= CHUNK:
                    yield from flush(keys, ids, lengths)
                    keys, ids, lengths, n = [], [], [], 0
        if n:
            yield from flush(keys, ids, lengths)

    kind = dict(df.dtypes)[key]
    schema = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, {schema}")
    return out.withColumnRenamed("key", key)
