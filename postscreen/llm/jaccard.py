"""N-gram Jaccard join in the metric space of shingle sets (distance 1 - Jaccard), exact.

Nearly all pairs of documents are at distance about 1, where no pivot tells them apart. So the
space is first cut, without loss, into crowds that cannot link to one another:

* Equal sets become one, the one with the smallest document.
* Shingles have an order from rare to common, the same for all sets: by how many documents hold them, told by bitmaps of
  bounded size, then by hash. Two sets that link share all but so few of their shingles that they
  share one of the rarest of each. Sets that share none of these with another are linked with nothing; the others fall into
  crowds by the rare shingles that they share. Passages that many documents hold are common, and chain nothing.
  Crowds of more than a few documents are cut again in the same way, counted within these crowds. Each task keeps one
  document for a shingle and tells the crowds that it sees itself, so that a shingle which is in a third of all
  documents leaves a task once.

Each crowd is then joined by pivots. In a crowd that fits a task, a few pivots far from one another meet all members,
those within the radius are linked, and the members left open fall into the Voronoi regions of their nearest
pivots; windows of distances bring in the partners from beyond a region's border, and regions are joined in the
same way, down to a few sets, or to regions that pivots don't divide, in which each open member meets all. A crowd that doesn't fit goes through
levels: a few pivots per region get their distances to all members in many tasks; members that the pivots leave in different components
are open; every open member goes to the Voronoi region of its nearest pivot, and the
triangle inequality gives a window of distances to all pivots in which the partners of a region's open members must lie, so
that members of other regions near the border are replicated into it. Regions that fit a task are joined there,
others go to the next level, and what is still too large after the last level is joined in blocks of open members against blocks of all.

Shingles are compared by 64-bit hashes, equal sets by 128 bits and rare shingles by 40 bits and their bucket; those
that are taken for equal by chance only make a crowd larger. Text is in words
between ASCII white space, with A-Z lower-cased.

Defined results: null and empty texts, and texts of no words, have the empty set and are linked with
nothing; a text with fewer words than a shingle has one shingle, all of its words; rows that
share a key are one document, linked by either text; rows without a key take no part and have
no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postscreen.llm.common import binary, parts_for, small, unused
from postscreen.llm.gaps import expand, squeeze
from postscreen.llm.graph import components
from postscreen.session import materialise

_UPPER = bytes(range(256)).lower()
# Shingles that one task may hold, and pivots for each region and level.
FITS = 4_000_000
PIVOTS = 16
LEVELS = 3
# Within a task: sets that need no regions, pivots, levels of regions, the share of the sets that a region may hold, and
# how often regions may repeat a set on average.
FEW, CENTRES, DEEPEST, SHRINK, REPEAT = 32, 16, 6, 0.8, 1.5
# Shingles of a crowd from which it is cut again by its rarest shingles.
RECUT = 100_000


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link when den * intersection >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    @property
    def radius(self) -> float:
        return 1 - self.num / self.den

    def differ(self, n: int) -> int:
        """Most shingles in which a set of ``n`` differs from one that it links with."""
        return n * (self.den - self.num) // self.num


# --- sets --------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's shingles. Hashes of words are remembered."""

    def __init__(self, words: int, remember: int = 500_000) -> None:
        self.words, self.remember, self.known = words, remember, {}

    def __call__(self, raw: bytes) -> np.ndarray:
        tokens = raw.translate(_UPPER).split()
        if not tokens:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        width = min(self.words, len(codes))
        n = len(codes) - width + 1
        acc = np.full(n, width, np.uint64)
        for j in range(width):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n])
        return np.unique(acc)


@cache
def size_class(n: int, rule: Rule) -> tuple[int, int, int]:
    """(number, first size, first size of the next) of the class that holds ``n``.

    A class is half as wide again as the one before, and wide enough that sets that link are in
    one class or in neighbouring ones.
    """
    k, low = 0, 1
    while True:
        high = max(low + 1, -(-low * 3 // 2), -(-low * rule.den // rule.num))
        if n < high:
            return k, low, high
        k, low = k + 1, high


# Numbers of documents that share a shingle from which it counts as more common, and bits of each bitmap:
# 4 to 8 for a shingle, at most 2^26, which are 8 MiB.
COMMON = (2, 4, 16, 128)
MAX_BITS = 26


def prefix_keys(hashes: np.ndarray, rule: Rule, levels: list[np.ndarray]) -> np.ndarray:
    """Keys of the rarest shingles of a set; two sets that link share one.

    Shingles go by how common they are, then by hash, the same order for all sets. Two sets that link share more than all but
    so many of the larger one's shingles that its rarest ones can't all be missing from the other, nor the
    other's from it: so both prefixes hold a common shingle. Keys are made for the class of sizes, and, where a set can
    link with one of the class below, for that too.
    """
    n = len(hashes)
    if not rule.differ(n):
        return np.empty(0, np.uint64)
    at = (hashes >> np.uint64(64 - (len(levels[0]) * 8).bit_length() + 1)).astype(np.int64)
    byte, bit = at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)
    rank = np.zeros(n, np.uint8)
    for mark in levels:
        rank += (mark[byte] & bit) != 0
    # Hashes rise, so a stable order by rank goes by hash among equals.
    prefix = hashes[np.argsort(rank, kind="stable")[: n - -(-n * rule.num // rule.den) + 1]]
    number, low, _ = size_class(n, rule)
    classes = [number, *([number - 1] if number and (low - 1) * rule.den >= n * rule.num else [])]
    return np.concatenate([_mix(prefix + np.uint64(c << 40)) for c in classes])


def commonness(df: DataFrame, rule: Rule, total: int) -> list[np.ndarray]:
    """For each of ``COMMON``, a bitmap of the shingles that so many of the texts of ``df`` (raw) hold.

    Tasks send the first bits of hashes and small counts in buckets of hash ranges. A bit that is set by chance only makes a shingle
    count as more common than it is.
    """
    bits = min(MAX_BITS, max(16, int(total).bit_length() + 3))
    buckets = min(bits - 3, (parts_for(total, GATHER) - 1).bit_length())
    width = min(64, bits + 4)
    schema = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.unique(np.concatenate(held) >> np.uint64(64 - width), return_counts=True)
        counts = np.minimum(counts, COMMON[-1]).astype(np.uint8)
        bucket = (hashes >> np.uint64(width - buckets)).astype(np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        rows = [
            {"bucket": int(bucket[i]), "hashes": squeeze(hashes[i:j] & np.uint64((1 << (width - buckets)) - 1)), "counts": counts[i:j].tobytes()}
            for i, j in zip(starts, [*starts[1:], len(hashes)], strict=True)
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, n = Shingler(rule.words), [], 0
        for batch in batches:
            for raw in binary(batch, "raw"):
                held.append(shingles(raw))
                n += len(held[-1])
                if n >= GATHER:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    def add(table: pa.Table) -> pa.Table:
        hashes = np.concatenate([expand(x) for x in table.column("hashes").to_pylist()])
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).astype(np.int64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        sums, at = np.add.reduceat(counts[order], starts), (hashes[starts] >> np.uint64(width - bits)).astype(np.int64)
        out = []
        for least in COMMON:
            part = np.zeros(1 << (bits - buckets), np.uint8)
            part[at[sums >= least]] = 1
            out.append(np.packbits(part).tobytes())
        return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([out], pa.list_(pa.binary()))})

    sent = df.select("raw").mapInArrow(count, "bucket long, hashes binary, counts binary")
    found = sent.groupBy("bucket").applyInArrow(add, "bucket long, bits array<binary>")
    levels = [np.zeros((1 << bits) // 8, np.uint8) for _ in COMMON]
    each = len(levels[0]) >> buckets
    for row in found.toLocalIterator():
        for level, part in zip(levels, row["bits"], strict=True):
            level[row["bucket"] * each : (row["bucket"] + 1) * each] = np.frombuffer(part, np.uint8)
    return levels


def prints(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """key, n_shingles and fp (128 bits of the set) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(rule.words)
        for batch in batches:
            sizes, fps = [], []
            for raw in binary(batch, "raw"):
                s = shingles(raw)
                sizes.append(len(s))
                fps.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary())],
                names=["key", "n_shingles", "fp"],
            )

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(run, "key long, n_shingles long, fp binary")


# --- crowds ------------------------------------------------------------------------------------


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``a``, ``b`` contracted: each node but the smallest of its component, with the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label != label[label]).any():
            label = label[label]
    beyond = label != np.arange(len(nodes))
    return nodes[beyond], nodes[label[beyond]]


def meet(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key once with its smallest node, and pairs that join the nodes which share keys."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = nodes[new][np.cumsum(new) - 1]
    shared = nodes != first
    return keys[new], nodes[new], *stars(nodes[shared], first[shared])


# Shingles and keys that a task gathers before it hands them on, and that a bucket holds.
GATHER = 2_000_000
LOW_BITS = np.uint64((1 << 40) - 1)


def _dealt(keys: list[np.ndarray], nodes: list[int], n_buckets: int) -> pa.RecordBatch:
    """Rows of one bucket each: keys with their documents, or pairs that are known to share a key."""
    owner = np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
    flat, owner, a, b = meet(np.concatenate(keys), owner)
    bucket = ((flat >> np.uint64(40)) * np.uint64(n_buckets)) >> np.uint64(24)
    order = np.lexsort((owner, bucket))
    flat, owner, bucket = flat[order] & LOW_BITS, owner[order], bucket[order]
    # Five bytes a key, and for each document of a bucket how many of them are its own.
    packed = flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    change = np.ones(len(flat), bool)
    change[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(change)
    counts, heads, of = np.diff(at, append=len(flat)), owner[at], bucket[at]
    rows = []
    numbers, begin = np.unique(of, return_index=True)
    for number, i, j in zip(numbers, begin, [*begin[1:], len(of)], strict=True):
        cut = packed[at[i] : at[j] if j < len(at) else len(flat)]
        rows.append((int(number), heads[i:j], counts[i:j], cut.tobytes()))
    for i in range(0, len(a), 1000):
        both = np.concatenate([a[i : i + 1000], b[i : i + 1000]])
        rows.append((int(xxhash.xxh3_64_intdigest(both.tobytes()) % n_buckets), both, None, None))
    names = ["bucket", "nodes", "counts", "keys"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) of one bucket, b the smallest document that the bucket joins with a."""
    told = pdf[pdf["keys"].isna()]
    pairs = [np.asarray(x).reshape(2, -1) for x in told["nodes"]]
    rows = pdf[pdf["keys"].notna()]
    if len(rows):
        packed = np.frombuffer(b"".join(rows["keys"]), np.uint8).reshape(-1, 5)
        keys = np.zeros((len(packed), 8), np.uint8)
        keys[:, :5] = packed
        owner = np.repeat(np.concatenate(list(rows["nodes"])), np.concatenate(list(rows["counts"])))
        pairs.append(np.stack(meet(keys.view("<u8").ravel(), owner)[2:]))
    a, b = stars(*np.concatenate(pairs, axis=1))
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def sharing(
    df: DataFrame, key: str, text: str, rule: Rule, n_buckets: int, levels: list[np.ndarray]
) -> DataFrame:
    """Pairs (a, b) that join the documents which share one of their rarest shingles, by the bitmaps of ``levels``."""
    shared = df.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, marks = Shingler(rule.words), shared.value
        keys, nodes, held = [], [], 0
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), binary(batch, "raw"), strict=True):
                found = prefix_keys(shingles(raw), rule, marks)
                if len(found):
                    keys.append(found)
                    nodes.append(node)
                    held += len(found)
                if held >= GATHER:
                    yield _dealt(keys, nodes, n_buckets)
                    keys, nodes, held = [], [], 0
        if held:
            yield _dealt(keys, nodes, n_buckets)

    rows = df.select(F.col(key).cast("long").alias("node"), F.col(text).cast("binary").alias("raw"))
    dealt = rows.filter("node is not null").mapInArrow(
        run, "bucket long, nodes array<long>, counts array<long>, keys binary"
    )
    return dealt.groupBy("bucket").applyInPandas(_met, "a long, b long").distinct()


def sets(df: DataFrame, rule: Rule) -> DataFrame:
    """``df`` (group, node, raw) with the set of each text instead of the text, without empty sets.

    A row without shingles links with nothing, also where its document has other rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(rule.words)
        for batch in batches:
            found = [shingles(raw).view(np.int64) for raw in binary(batch, "raw")]
            batch = batch.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))
            lists = pa.array([x for x in found if len(x)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("node"), lists], names=["group", "node", "hashes"])

    return df.select("group", "node", "raw").mapInArrow(run, "group long, node long, hashes array<long>")


# --- within a task -----------------------------------------------------------------------------


def _shared(hashes: np.ndarray, starts: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Size of the intersection of the (sorted) pivot with each set."""
    at = np.minimum(np.searchsorted(pivot, hashes), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == hashes).astype(np.int64), starts)


def inverted(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the sets, where each one's list starts, and the lists of the sets that hold it."""
    hashes = np.concatenate(found)
    order = np.argsort(hashes, kind="stable")
    holders = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])[order]
    hashes = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[starts], np.append(starts, len(hashes)), holders


def local_links(found: list[np.ndarray], open_: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that join the sets into their components.

    Sets that are not open are known to be in one component with one another. A pivot's
    intersections with all sets are counted along the lists of its shingles. Pivots are open sets outside the main component, until it alone has sets that have not been a pivot.
    """
    n = len(found)
    sizes = np.array([len(s) for s in found])
    distinct, starts, holders = inverted(found)
    comp = np.where(open_, np.arange(n), n)
    waiting = open_.copy()
    links = []
    while waiting.any():
        if open_.all():
            names, counts = np.unique(comp[waiting], return_counts=True)
            main = names[counts.argmax()]
        else:
            main = comp[~open_][0]
        todo = np.flatnonzero(waiting & (comp != main))
        if not len(todo):
            break
        p = todo[0]
        waiting[p] = False
        lists = np.searchsorted(distinct, found[p])
        both = np.bincount(np.concatenate([holders[starts[i] : starts[i + 1]] for i in lists]), minlength=n)
        near = np.flatnonzero(rule.den * both >= rule.num * (sizes + sizes[p] - both))
        near = near[comp[near] != comp[p]]
        if len(near):
            joined = np.unique(comp[near], return_index=True)
            links += [(int(p), int(near[i])) for i in joined[1]]
            comp[np.isin(comp, joined[0])] = comp[p]
    return links


def region_links(found: list[np.ndarray], open_: np.ndarray, rule: Rule, depth: int = 0) -> list[tuple[int, int]]:
    """Links that join the sets into their components, over Voronoi regions of a few pivots.

    Pivots are open sets far from one another. Each meets all sets, and links with those within the radius. A set outside the main
    component that has been no pivot is still open and belongs to the region of its nearest pivot; partners of
    a region's open sets have, to every pivot, a distance within the radius of one of theirs, so the sets between the
    least and the greatest, wherever they are, join the region. Regions that pivots hardly divide are joined set by set.
    """
    n = len(found)
    if n <= FEW or open_.sum() <= FEW or depth == DEEPEST:
        return local_links(found, open_, rule)
    sizes = np.array([len(s) for s in found])
    distinct, starts, holders = inverted(found)
    distances, pivots, nearest = [], [], np.full(n, np.inf)
    comp = np.where(open_, np.arange(n), n)
    links = []
    for _ in range(CENTRES):
        far = np.where(open_, nearest, -1.0)
        p = int(far.argmax())
        if far[p] <= rule.radius:
            break
        lists = np.searchsorted(distinct, found[p])
        both = np.bincount(np.concatenate([holders[starts[i] : starts[i + 1]] for i in lists]), minlength=n)
        union = sizes + sizes[p] - both
        d = 1 - both / union
        near = np.flatnonzero(rule.den * both >= rule.num * union)
        joined = np.unique(comp[near], return_index=True)
        links += [(p, int(near[i])) for c, i in zip(*joined, strict=True) if c != comp[p]]
        comp[np.isin(comp, joined[0])] = comp[p]
        distances.append(d)
        pivots.append(p)
        nearest = np.minimum(nearest, d)
        nearest[p] = -1
    del distinct, starts, holders  # not held while the regions make their own
    main = comp[~open_][0] if not open_.all() else np.bincount(comp).argmax()
    still = open_ & (comp != main)
    still[pivots] = False
    taking_part = still | (comp == main) if not open_.all() else np.ones(n, bool)
    d = np.stack(distances, axis=1)
    home = d.argmin(axis=1)
    inside = []
    for region in np.unique(home[still]):
        inner = still & (home == region)
        low, high = d[inner].min(axis=0) - rule.radius - 1e-9, d[inner].max(axis=0) + rule.radius + 1e-9
        inside.append(np.flatnonzero(((d >= low) & (d <= high)).all(axis=1) & taking_part))
    if sum(map(len, inside)) > REPEAT * n:
        # The pivots hardly divide these sets.
        return links + local_links(found, comp != main, rule)
    for members in inside:
        # Sets that are not open must be of one component, the main one; others from beyond the border stay open.
        way = region_links if len(members) <= SHRINK * n else local_links
        more = way([found[i] for i in members], comp[members] != main, rule, *([depth + 1] if way is region_links else []))
        links += [(int(members[a]), int(members[b])) for a, b in more]
    return links


def _join_groups(pdf: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    out: list[tuple[int, int]] = []
    pdf = pdf.sort_values(["group", "node"])
    for _, rows in pdf.groupby("group", sort=False):
        nodes = rows["node"].to_numpy()
        found = [h.view(np.uint64) for h in rows["hashes"]]
        links = region_links(found, rows["open"].to_numpy(bool), rule)
        out += [(nodes[a], nodes[b]) for a, b in links]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def join_local(members: DataFrame, n_tasks: int, rule: Rule) -> DataFrame:
    """Links (a, b) within each group of ``members`` (group, node, hashes, open); groups fit a task."""
    binned = members.withColumn("bin", F.pmod(F.xxhash64("group"), F.lit(n_tasks)))
    return binned.groupBy("bin").applyInPandas(
        lambda pdf: _join_groups(pdf[["group", "node", "hashes", "open"]], rule), "a long, b long"
    )


# --- large crowds ------------------------------------------------------------------------------


def _distances(members: DataFrame, pivots: DataFrame, rule: Rule) -> DataFrame:
    """group, node, open and the distances to the pivots of its group, with the set dropped.

    ``pivots`` has group, node, hashes; members meet them by group and a salt, as many as the group
    has tasks' worth of members.
    """
    packed = pivots.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("node", "hashes"))).alias("pivots"))
    salts = members.groupBy("group").agg(F.sum(F.size("hashes")).alias("total"))
    salts = materialise(salts.withColumn("salts", F.ceil(F.col("total") / F.lit(FITS)).cast("int")), "salts")
    left = members.join(salts.drop("total"), "group").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    right = packed.join(salts.drop("total"), "group")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).drop("salts")

    def run(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = {"group": rows["group"], "node": rows["node"], "open": rows["open"]}
        if not len(rows) or not len(near):
            return pd.DataFrame({**out, "shared": [], "n": [], "sizes": []})
        found = [h.view(np.uint64) for h in rows["hashes"]]
        sizes = np.array([len(s) for s in found])
        hashes, starts = np.concatenate(found), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sets_ = [np.asarray(p["hashes"], np.int64).view(np.uint64) for p in near["pivots"].iloc[0]]
        both = np.stack([_shared(hashes, starts, np.sort(p)) for p in sets_], axis=1)
        return pd.DataFrame({**out, "shared": list(both), "n": sizes, "sizes": [[len(p) for p in sets_]] * len(rows)})

    schema = "group long, node long, open boolean, shared array<long>, n long, sizes array<long>"
    return (
        left.drop("salts").groupBy("group", "salt").cogroup(right.groupBy("group", "salt")).applyInPandas(run, schema)
    )


def _main_components(masks: pd.DataFrame) -> pd.DataFrame:
    """Which of a group's link masks belong to its main component; at most 2^PIVOTS masks."""
    parent = list(range(PIVOTS))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for mask in masks["mask"]:
        bits = [i for i in range(PIVOTS) if mask >> i & 1]
        for i in bits[1:]:
            parent[root(i)] = root(bits[0])
    comp = pd.Series(
        [root((int(m) & -int(m)).bit_length() - 1) if m else -1 for m in masks["mask"]], index=masks.index
    )
    linked = comp >= 0
    settled = linked & ~masks["open"]
    if not masks["open"].all():  # what was the main component before still is
        main = set(comp[settled])
    else:
        weight = masks["rows"][linked].groupby(comp[linked]).sum()
        main = {weight.idxmax()} if len(weight) else set()
    return masks[["group", "open", "mask"]].assign(main=~masks["open"] | comp.isin(main))


def _level(members: DataFrame, level: int, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """One level over large groups: the links found, and the members (group, node, open) of the regions left."""
    counts = members.filter("open").groupBy("group").agg(F.count(F.lit(1)).alias("n_open"))
    likely = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 20)) * F.col("n_open") < 8 * PIVOTS * (1 << 20)
    order = Window.partitionBy("group").orderBy(F.xxhash64("node", F.lit(level)), "node")
    chosen = (
        members.filter("open").join(counts, "group").filter(likely).select("group", "node", "hashes")
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS).drop("place")
    )
    pivots = materialise(chosen, "pivots")
    d = _distances(members, pivots, rule)
    union = F.transform(F.arrays_zip("shared", "sizes"), lambda p: p["sizes"] + F.col("n") - p["shared"])
    d = d.withColumn("union", union)
    near = F.transform(F.arrays_zip("shared", "union"), lambda p: rule.den * p["shared"] >= rule.num * p["union"])
    dist = F.transform(F.arrays_zip("shared", "union"), lambda p: 1 - p["shared"] / p["union"])
    bits = F.aggregate(
        F.transform(near, lambda x, i: F.when(x, F.pow(F.lit(2), i).cast("long")).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda s, x: s + x,
    )
    d = materialise(d.select("group", "node", "open", bits.alias("mask"), dist.alias("dist")), "distances")
    ranks = pivots.groupBy("group").agg(F.sort_array(F.collect_list("node")).alias("pivots"))
    linked = d.filter("mask > 0").join(ranks, "group")
    each = F.transform("pivots", lambda p, i: F.when(F.expr("mask").bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0, p))
    links = linked.select(F.col("node").alias("a"), F.explode(F.filter(each, lambda p: p.isNotNull())).alias("b")).filter("a <> b")

    masks = d.groupBy("group", "open", "mask").agg(F.count(F.lit(1)).alias("rows"))
    mains = masks.groupBy("group").applyInPandas(_main_components, "group long, open boolean, mask long, main boolean")
    d = d.join(mains, ["group", "open", "mask"]).join(ranks, "group")
    # Members outside the main component that have not been a pivot are still open.
    still = F.col("open") & ~F.col("main") & ~F.array_contains("pivots", F.col("node"))
    home = F.expr("array_position(dist, array_min(dist)) - 1")
    # A pivot outside the main component has met all others and takes no part any more.
    d = d.withColumns({"still": still, "home": home}).filter("still or main").drop("pivots", "mask", "main", "open")
    d = materialise(d, "level")
    opens = d.filter("still")
    low = [F.min(F.get("dist", F.lit(i))).alias(f"low{i}") for i in range(PIVOTS)]
    high = [F.max(F.get("dist", F.lit(i))).alias(f"high{i}") for i in range(PIVOTS)]
    regions = materialise(opens.groupBy("group", "home").agg(*low, *high), "regions")
    regions = regions.withColumnRenamed("home", "region")
    inside = F.lit(True)
    for i in range(PIVOTS):
        x = F.get("dist", F.lit(i))
        ok = (x >= F.col(f"low{i}") - rule.radius - 1e-9) & (x <= F.col(f"high{i}") + rule.radius + 1e-9)
        inside = inside & (x.isNull() | ok)
    border = F.element_at("dist", (F.col("region") + 1).cast("int")) <= F.array_min("dist") + 2 * rule.radius + 1e-9
    placed = d.join(regions, "group").filter(inside & border)
    left = placed.select(F.xxhash64("group", "region").alias("region_id"), "node", "group", F.col("still").alias("open"))
    return links, left


def join_large(members: DataFrame, rule: Rule) -> list[DataFrame]:
    """Links within groups of any size; ``members`` has group, node, hashes, open."""
    out = []
    for level in range(LEVELS):
        links, left = _level(members, level, rule)
        out.append(links)
        left = materialise(left.distinct(), "left")
        if left.isEmpty():
            return out
        placed, total = members.agg(F.count(F.lit(1)), F.sum(F.size("hashes"))).first()
        if left.count() > placed * parts_for(total, FITS // 2):
            # The pivots hardly divide these members: blocks repeat them less often than regions would.
            state = left.select("group", "node", "open").distinct()
            rest = state.join(members.select("group", "node", "hashes").distinct(), ["group", "node"])
            return [*out, _blocks(rest, rule)]
        text = members.select("group", "node", "hashes").distinct()
        inner = left.join(text, ["group", "node"]).select(F.col("region_id").alias("group"), "node", "hashes", "open")
        inner = materialise(inner, "inner")
        sizes = inner.groupBy("group").agg(F.sum(F.size("hashes")).alias("total"))
        sizes = materialise(sizes, "totals")
        fitting = inner.join(sizes.filter(F.col("total") <= FITS).select("group"), "group", "left_semi")
        total = sizes.filter(F.col("total") <= FITS).agg(F.sum("total")).first()[0] or 0
        out.append(join_local(fitting, parts_for(total, FITS), rule))
        members = inner.join(sizes.filter(F.col("total") > FITS).select("group"), "group", "left_semi")
        if members.isEmpty():
            return out
    return [*out, _blocks(members, rule)]


def _blocks(members: DataFrame, rule: Rule) -> DataFrame:
    """The exact way for what no pivot divides: blocks of open members against blocks of all."""
    totals = members.groupBy("group").agg(F.sum(F.size("hashes")).alias("total"))
    n = F.ceil(F.col("total") / F.lit(FITS // 2)).cast("int")
    rows = members.join(totals.withColumn("n", n).drop("total"), "group")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    rows = rows.withColumn("pair", F.explode(pairs))
    rows = rows.withColumn("group", F.xxhash64("group", "pair.i", "pair.j")).select("group", "node", "hashes", "open")
    return rows.groupBy("group").applyInPandas(lambda pdf: _join_groups(pdf, rule), "a long, b long")


# --- the join ----------------------------------------------------------------------------------


def link(df: DataFrame, key: str, text: str, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The key and set size of all rows, and links (a, b) that join documents into their components."""
    rows = materialise(prints(df, key, text, rule), "prints")
    keyed = rows.filter("key is not null and fp is not null")
    again = keyed.groupBy("fp").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = keyed.join(small(materialise(again.select("fp", "rep"), "again")), "fp").filter("key <> rep")
    copies = materialise(copies.select("key", "rep").distinct(), "copies")

    conf = df.sparkSession.conf

    def sharing_rare(texts: DataFrame, amount: int) -> DataFrame:
        """Pairs of the documents of ``texts`` (node, raw) that share a rare shingle; they hold ``amount`` shingles."""
        keys = 2 * amount * (1 - rule.num / rule.den)
        n_buckets = max(parts_for(keys, GATHER), int(conf.get("spark.sql.shuffle.partitions")))
        return sharing(texts, "node", "raw", rule, n_buckets, commonness(texts, rule, amount))

    texts = df.select(F.col(key).cast("long").alias("node"), F.col(text).cast("binary").alias("raw"))
    pairs = sharing_rare(texts, rows.agg(F.sum("n_shingles")).first()[0] or 0)
    # A document all of whose texts are copies of others' leaves its links to those.
    mixed = F.min(F.xxhash64("fp")) != F.max(F.xxhash64("fp"))
    several = keyed.groupBy("key").agg(mixed.alias("mixed")).filter("mixed").select("key")
    away = copies.select("key").distinct().join(several, "key", "left_anti").withColumnRenamed("key", "node")
    crowds = components(pairs).join(small(materialise(away, "away")), "node", "left_anti")
    sizes = rows.filter("key is not null").groupBy(F.col("key").alias("node")).agg(F.sum("n_shingles").alias("n_shingles"))
    crowds = materialise(crowds.join(sizes, "node"), "crowds")

    def weighed(of: DataFrame) -> DataFrame:
        """group, node, total (shingles of the group) of the crowds of more than one document."""
        sums = of.groupBy("component").agg(F.sum("n_shingles").alias("total"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        sums = small(materialise(sums.select("component", "total"), "weights"))
        return materialise(of.join(sums, "component").select(F.col("component").alias("group"), "node", "n_shingles", "total"), "crowds")

    def members(of: DataFrame) -> DataFrame:
        return sets(texts.join(small(of.select("group", "node")), "node"), rule).withColumn("open", F.lit(True))

    crowd = weighed(crowds)
    wide = crowd.filter(F.col("total") > RECUT)
    held = wide.agg(F.sum("n_shingles")).first()[0]
    if held:
        # In a large corpus the bitmaps fill up, and sets are chained by chance; within the crowds they tell what is rare.
        inside = materialise(texts.join(small(wide.select("node")), "node"), "inside")
        again = components(sharing_rare(inside, held))
        again = weighed(again.join(wide.select("node", "n_shingles"), "node"))
        crowd = crowd.filter(F.col("total") <= RECUT).unionByName(again)

    fitting, large = crowd.filter(F.col("total") <= FITS), crowd.filter(F.col("total") > FITS)
    total = fitting.select("group", "total").distinct().agg(F.sum("total")).first()[0] or 0
    found = [join_local(members(fitting), parts_for(total, FITS), rule)]
    if not large.isEmpty():
        found += join_large(materialise(members(large), "large"), rule)
    links = reduce(DataFrame.union, [x.select("a", "b") for x in found])
    return rows.select("key", "n_shingles"), links.union(copies.select("key", "rep"))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """key, n_shingles and component_id (the smallest key that it reaches by links) of every row."""
    rows, links = link(df, key, text, rule)
    comp = components(links)
    out = rows.join(comp.withColumnRenamed("node", "key"), "key", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("component", "key").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows of ``df`` without those linked to a document with a smaller key.

    Of rows that share key and text the one with the smallest hash of its contents stays, so that reruns agree; rows without a
    key stay, and so do other texts of a key.
    """
    mine = unused(df, "key")
    found = materialise(join(df, key, text, rule).select(F.col(key).alias(mine), "component_id"), "groups")
    away = small(materialise(found.filter(F.col(mine) != F.col("component_id")).select(mine).distinct(), "away"))
    kept = df.join(away, F.col(f"`{key}`") == F.col(mine), "left_anti")
    several = found.filter(F.col(mine).isNotNull()).groupBy(mine).count().filter("count > 1").select(mine)
    several = materialise(several, "several")
    if several.isEmpty():
        return kept
    several = small(several)
    same = F.col(f"`{key}`") == F.col(mine)
    columns = [F.col(f"`{c}`") for c in df.columns]
    # Partial aggregates keep one row of a text for each task, however often it is there.
    one = kept.join(several, same, "left_semi").groupBy(columns[df.columns.index(key)].alias("k"), F.md5(F.coalesce(f"`{text}`", F.lit(""))).alias("d"))
    one = one.agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return kept.join(several, same, "left_anti").unionByName(one)
