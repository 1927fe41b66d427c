"""Toxicity: a lexicon trie walked by Levenshtein automata, and scores from the words around.

Learning. From the labelled training rows Spark counts, for each word, in how many toxic and in
how many clean texts it occurs; then the same for the beginnings of words, so that inflected
forms meet in their stem. What stands out by its smoothed log-odds, and stands in many different settings, is the lexicon: whole
words, and stems (a word that begins so). Words of clean texts that look like a misspelled entry are noted. A second pass over the same rows counts how often each kind of
evidence (exact or misspelled, quoted or not, how many) marks a toxic text: those counts give the
scores, so that nothing about them is set by hand.

Matching. The union of the Levenshtein automata of all entries is the set of pairs (trie node,
edits so far) that a word can reach; these sets are made once each and kept as the states of a
deterministic automaton, so that a word costs one look-up per character.

Defined results: a null text is empty; a text without any hit has the share of toxic rows among
training rows without a hit as its score; rows without a label teach nothing; where no row or no
toxic row teaches, nothing is in the lexicon and every score is 0. Repeated rows count each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscreen.llm.common import fold, unused
from postscreen.session import materialise

# Words may hold characters that stand in for letters.
TOKEN = re.compile(r"\w+(?:[*@$]+\w+)*")
# Words that report speech, and quotation marks: what stands near them is more often quoted. Fixed values.
REPORTING = frozenset("said says wrote writes quoted quote called calls term word slur dit sagte dijo".split())
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
# U+2019 between letters is an apostrophe.
MARK = re.compile(f"[{''.join(sorted(set(OPENING + CLOSING) - {'’'}))}]|(?<![^\\W\\d_])’|’(?![^\\W\\d_])")
WINDOW = 6
STEM_MIN, STEM_MAX = 4, 10
PAIRS = "word string, toxic long, clean long"


def max_edits(length: int, stem: bool = False) -> int:
    """Edits that an entry of this length allows; a stem, which leaves its word's end open, fewer."""
    return (0 if length < 8 else 1) if stem else (0 if length < 5 else 1 if length < 9 else 2)


# --- lexicon -----------------------------------------------------------------------------------


def word_counts(df: DataFrame, text: str, label: str, hold: int = 200_000) -> DataFrame:
    """word, toxic, clean: in how many texts of each label it occurs. Partial counts per task.

    The empty word counts the texts themselves.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_pydict(
                {
                    "word": pa.array(names, pa.string()),
                    "toxic": pa.array([seen[1][w] for w in names], pa.int64()),
                    "clean": pa.array([seen[0][w] for w in names], pa.int64()),
                }
            )

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update({"", *TOKEN.findall(t.lower())})
                if len(seen[0]) + len(seen[1]) > hold:
                    yield out()
                    seen[0].clear()
                    seen[1].clear()
        yield out()

    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("int").alias("y"))
    return rows.mapInArrow(count, PAIRS).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def settings(df: DataFrame, text: str, words: list[str], stems: list[str]) -> DataFrame:
    """entry, settings: between how many different pairs of neighbours each entry stands in ``df``.

    Each text counts with one setting of the entry, that of the smallest hash: a word that a text shares with its
    own copies only, or repeats, has few, however often it was copied.
    """
    known, starts = frozenset(words), frozenset(stems)
    lengths = [n for n in range(STEM_MIN, STEM_MAX + 1) if any(len(s) == n for s in starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                tokens, least = ["", *TOKEN.findall(t.lower()), ""], {}
                for k, w in enumerate(tokens):
                    found = [w[:n] for n in lengths if n <= len(w) and w[:n] in starts]
                    found += [w] * (w in known and w not in found)
                    if found:
                        near = xxhash.xxh3_64_intdigest(" ".join(tokens[k - 1 : k + 2])) >> 1
                        least.update((e, min(near, least.get(e, near))) for e in found)
                seen.update(least.items())
        entries, near = [e for e, _ in seen], [n for _, n in seen]
        yield pa.RecordBatch.from_pydict({"entry": pa.array(entries, pa.string()), "near": pa.array(near, pa.int64())})

    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "entry string, near long").groupBy("entry").agg(F.count_distinct("near").alias("settings"))


def lexicon(
    labelled: DataFrame, counts: DataFrame, n_toxic: int, n_clean: int, least_odds: float = 4.0,
    support: int = 3, size: int = 2000,
) -> list[tuple[str, bool]]:
    """(entry, is a stem): words and beginnings of words that stand out in the toxic texts.

    An entry has log-odds of ``least_odds`` or more, and it occurs in ``support`` toxic texts and in as many
    different settings, whatever the number of rows. Its settings and clean texts are so far from the labels' shares that chance
    would make less than one such word of all that there are (a bound on their binomial tail); that asks for
    few texts more as rows and words become more. The ``size`` words and the ``size`` stems of the highest
    log-odds are looked at. A stem counts the texts of its words, added up.
    """
    def odds(toxic: str, clean: str) -> Column:
        up = (F.col(toxic) + 0.1) / (n_toxic + 1)
        return F.log(up / ((F.col(clean) + 0.1) / (n_clean + 1)))

    part = n_toxic / (n_toxic + n_clean)
    n_words = max(1, counts.count())

    def evident(t: int, c: int) -> bool:
        told = t * math.log(t / ((t + c) * part)) + (c * math.log(c / ((t + c) * (1 - part))) if c else 0.0)
        return t >= support and told >= math.log(n_words)

    def standing_out(df: DataFrame) -> dict[str, int]:
        df = df.filter(F.col("toxic") >= support).withColumn("odds", odds("toxic", "clean"))
        df = df.filter(F.col("odds") >= least_odds)
        df = df.orderBy(F.desc("odds"), F.length("word"), "word").limit(size)
        return {r["word"]: r["clean"] for r in df.select("word", "clean").collect()}

    words = standing_out(counts.filter(F.length("word") >= 3))
    lengths = F.sequence(F.lit(STEM_MIN), F.least(F.length("word"), F.lit(STEM_MAX)))
    starts = (
        counts.filter(F.length("word") >= STEM_MIN)
        .withColumn("n", F.explode(lengths))
        .groupBy(F.expr("left(word, n)").alias("word"))
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("forms"))
        .filter("forms >= 3")
    )
    stems = standing_out(starts)
    varied = settings(labelled.filter("label = 1"), "text", list(words), list(stems)).collect()
    clean = {**words, **stems}
    varied = {r["entry"] for r in varied if evident(r["settings"], clean[r["entry"]])}
    words = [w for w in words if w in varied]
    kept: list[str] = []
    for s in stems:  # the clearest of each family
        if s in varied and not any(s.startswith(k) or k.startswith(s) for k in kept):
            kept.append(s)
    # Words that begin so stay: they allow more edits than their stem, which is for the forms that are no entry.
    return sorted([(w, False) for w in words] + [(s, True) for s in kept])


class Automaton:
    """The Levenshtein automata of all entries over their trie, made deterministic as words need it."""

    def __init__(self, entries: list[tuple[str, bool]], most_states: int = 200_000) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, bool]]] = [[]]  # (entry, edits allowed, stem)
        self.reach: list[int] = [0]  # most edits that an entry below allows
        self.most_states = most_states
        for i, (entry, stem) in enumerate(entries):
            node, edits = 0, max_edits(len(entry), stem)
            self.reach[0] = max(self.reach[0], edits)
            for ch in entry:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][ch]
                self.reach[node] = max(self.reach[node], edits)
            self.ends[node].append((i, edits, stem))
        self._start()

    def _start(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.stems: list[tuple[int, int] | None] = []
        self.words: list[tuple[int, int] | None] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.dead = self._state({})
        self.first = self._state(self._close({0: 0}))

    def _close(self, best: dict[int, int]) -> dict[int, int]:
        """Adds what is reached by leaving letters of an entry out."""
        todo = list(best.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.reach[child] and best.get(child, 99) > e + 1:
                    best[child] = e + 1
                    todo.append((child, e + 1))
        return best

    def _state(self, best: dict[int, int]) -> int:
        key = tuple(sorted(best.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            ends = [(e, i, stem) for node, e in key for i, k, stem in self.ends[node] if e <= k]
            self.stems.append(min(((e, i) for e, i, stem in ends if stem), default=None))
            self.words.append(min(((e, i) for e, i, _ in ends), default=None))
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        best: dict[int, int] = {}

        def add(node: int, e: int) -> None:
            if e <= self.reach[node] and e < best.get(node, 99):
                best[node] = e

        for node, e in self.states[state]:
            add(node, e + 1)  # a letter too many
            for c, child in self.children[node].items():
                add(child, e + (c != ch))
        return self._state(self._close(best))

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry that allows as many edits."""
        if len(self.states) > self.most_states:
            self._start()
        state, found = self.first, None
        for ch in word:
            nxt = self.moves.get((state, ch))
            if nxt is None:
                nxt = self.moves[state, ch] = self._move(state, ch)
            state = nxt
            if state == self.dead:
                return found
            stem = self.stems[state]
            if stem is not None and (found is None or stem < found):
                found = stem
        end = self.words[state]
        return end if found is None or (end is not None and end < found) else found


# --- evidence ----------------------------------------------------------------------------------


def quoted(text: str, start: int, end: int, words: list[str]) -> bool:
    """Whether the place is set in quotation marks or reported, by the ``WINDOW`` words around it."""
    # One character more on the right: a mark is looked at with both its neighbours.
    left = [m for m in MARK.finditer(text, max(0, start - 60), start + 1) if m.start() < start]
    right = (m for m in MARK.finditer(text, end, end + 61) if m.start() < end + 60)
    inside = len(left) % 2 == 1 and any(m.group() in CLOSING for m in right)
    return inside or bool(REPORTING.intersection(words))


def evidence(
    text: str, automaton: Automaton, cache: dict[str, tuple[int, int] | None], other: frozenset[str]
) -> list[str]:
    """The kinds of evidence in a text, the strongest first: kind, context and number of its hits; empty for none.

    ``other`` has words of clean texts that only look like a misspelled entry.

    ``x`` stands for exact and ``m`` for misspelled hits; ``q`` for hits of a kind that are all quoted. An
    unquoted misspelled hit is before a quoted exact one.
    """
    low = text.lower()
    hits = set()
    for w in set(TOKEN.findall(low)):
        if w not in cache:
            if len(cache) > 500_000:
                cache.clear()
            hit = automaton.match(w)
            cache[w] = None if hit is not None and hit[0] and w in other else hit
        if cache[w] is not None:
            hits.add(w)
    if not hits:
        return []
    # By itself, as the cache may have been cleared between.
    exact = {w for w in hits if automaton.match(w)[0] == 0}
    tokens = list(TOKEN.finditer(low))
    found = []
    for kind, words in (("x", exact), ("m", hits - exact)):
        places = [k for k, m in enumerate(tokens) if m.group() in words]
        if not places:
            continue
        context = "q"
        for k in places:
            around = [m.group() for m in tokens[max(0, k - WINDOW) : k + WINDOW + 1]]
            if not quoted(low, *tokens[k].span(), around):
                context = "u"
                break
        found.append(kind + context + ("3" if len(places) >= 3 else str(len(places))))
        if context == "u" and kind == "x":
            break
    return sorted(found, key=lambda k: (k[1] == "q", k[0] == "m"))


@dataclass(frozen=True)
class ToxicityModel:
    entries: list[tuple[str, bool]] = field(default_factory=list)
    other: frozenset[str] = frozenset()
    scores: dict[str, float] = field(default_factory=dict)


def _kinds(
    df: DataFrame, text: str, entries: list[tuple[str, bool]], other: frozenset[str],
    scores: dict[str, float] | None = None, name: str = "kind",
) -> DataFrame:
    """``df`` with ``name``: '' or the strongest kind of evidence, by ``scores`` where they are known."""
    schema = df.withColumn(name, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = Automaton(entries), {}
        for batch in batches:
            found = [evidence(t or "", automaton, cache, other) for t in batch.column(text).to_pylist()]
            kinds = [max(f, key=scores.__getitem__) if f and scores else f[0] if f else "" for f in found]
            arrays = [*batch.columns, pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def lookalikes(
    counts: DataFrame, entries: list[tuple[str, bool]], n_toxic: int, n_clean: int, size: int = 20_000
) -> dict[str, int]:
    """Words of clean texts within an entry's edits, with their number of clean texts; the ``size`` commonest.

    A word whose own log-odds speak for toxic texts, twice as much at least and by more than their standard error, is none: one clean text
    that quotes a misspelled entry, or has a wrong label, doesn't take it away.
    """
    # Half a text for each word, shared out like the labels: no count says nothing, 0 toxic texts say clean.
    part = n_toxic / (n_toxic + n_clean)
    up, down = F.col("toxic") + F.lit(0.5 * part), F.col("clean") + F.lit(0.5 * (1 - part))
    odds = F.log(up / F.lit(float(n_toxic))) - F.log(down / F.lit(float(n_clean or 1)))
    clean = odds <= F.greatest(F.lit(math.log(2)), F.sqrt(1 / up + 1 / down))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(entries)
        for batch in batches:
            hits = [automaton.match(w) for w in batch.column("word").to_pylist()]
            yield batch.filter(pa.array([h is not None and h[0] > 0 for h in hits], pa.bool_()))

    near = counts.filter("clean > 0 and word <> ''").filter(clean).select("word", "clean")
    near = near.mapInArrow(run, "word string, clean long").orderBy(F.desc("clean"), "word").limit(size)
    return {r["word"]: r["clean"] for r in near.collect()}


def fit(labelled: DataFrame, text: str, label: str, **options) -> ToxicityModel:
    """Learn from all rows of ``labelled`` whose label is 0 or 1."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("label").isin(0, 1))
    counts = materialise(word_counts(rows, "text", "label"), "words")
    total = counts.filter("word = ''").first()
    if total is None or not total["toxic"]:
        return ToxicityModel()
    entries = lexicon(rows, counts.filter("word <> ''"), total["toxic"], total["clean"], **options)
    near = lookalikes(counts, entries, total["toxic"], total["clean"])
    # A word seen in one clean text only could not have been known for that text.
    often = frozenset(w for w, n in near.items() if n > 1)
    found = _kinds(rows, "text", entries, often).groupBy("kind").agg(
        F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("rows")
    )
    scores = smoothed({r["kind"]: (r["toxic"], r["rows"]) for r in found.collect()})
    return ToxicityModel(entries, frozenset(near), scores)


def smoothed(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Share of toxic texts for each kind of evidence, drawn towards that of the wider kind by 4 rows."""
    def share(match, towards: float) -> float:
        own = [counts[k] for k in counts if match(k)]
        return (sum(t for t, _ in own) + 4 * towards) / (sum(n for _, n in own) + 4)

    out = {"": share(lambda k: not k, 0.0)}
    for kind in "xm":
        wide = share(lambda k: k[:1] == kind, 0.5)
        for context in "uq":
            mid = share(lambda k: k[:2] == kind + context, wide)
            for many in "123":
                out[kind + context + many] = share(lambda k: k == kind + context + many, mid)
    return {k: math.floor(v * 1e6) / 1e6 for k, v in out.items()}


def score(df: DataFrame, text: str, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``df`` with the score, 0 to 1, as column ``name``; a column of that name is replaced."""
    if not model.entries:
        return df.withColumn(name, F.lit(model.scores.get("", 0.0)))
    known = F.create_map(*[F.lit(x) for kv in sorted(model.scores.items()) for x in kv])
    kind = unused(df, "kind")
    found = _kinds(df, text, model.entries, model.other, model.scores, kind)
    return found.withColumn(name, known[F.col(kind)]).drop(kind)


def training_rows(
    documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int = 50_000
) -> DataFrame:
    """Text and label of the labelled rows whose crc32 of the key, modulo 4, is not 2.

    At most about ``per_label`` rows of each label: labels go by the hash of their key, and where documents repeat
    keys, a share of the rows is taken by their number. So the keys that are broadcast and the rows that are
    learned from are bounded, and no text is shuffled. A key with several labels has the largest.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    marks = marks.filter(F.col("key").isNotNull() & (fold(F.col("key"), 4) != 2))
    marks = marks.groupBy("key").agg(F.max("label").alias("label"))
    chosen = [
        marks.filter(F.col("label") == y).orderBy(F.xxhash64("key"), "key").limit(per_label)
        for y in (0, 1)
    ]
    marks = F.broadcast(materialise(chosen[0].union(chosen[1]), "labels"))
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.join(marks, "key")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if max(counts.values(), default=0) > per_label:
        share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, per_label / n))])[F.col("label")]
        rows = rows.filter(F.pmod(F.xxhash64("key", "row"), F.lit(1 << 20)) < share * (1 << 20))
    return rows.select("text", "label")


def detect(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """Key, ``held_out``, ``score`` and ``predicted`` of each document."""
    model = fit(training_rows(documents, labels, key, text, label), "text", "label")
    held = F.coalesce(fold(F.col(key), 4) == 2, F.lit(False))
    rows = documents.select(F.col(key).alias("key"), held.alias("held_out"), F.col(text).alias("text"))
    scored = score(rows, "text", model)
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
