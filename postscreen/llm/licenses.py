"""Licence scans by a positional index of rare words.

Each template (a phrase or a notice) is indexed by its rarest words, by document frequency over
the whole table, with their positions in the template. A file's licence words are looked up from
the highest IDF down; postings that agree on the same relative position are an alignment; an
alignment counts if its words fit the template and its mandatory key phrases stand inside.

Only A-Z are lower-cased, and a word is a run of anything but the ASCII characters that are
neither digits nor letters. Defined results: a null text is empty and has no words; repeated rows
are scanned each by itself; every place of a phrase counts, however often it occurs.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscreen.llm.common import binary, unused

# The base phrases and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Wording of public licences and their notices, each with its key phrases.
NOTICES = {
    "agpl": ("gnu affero general public license", ("affero general public license",)),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "gpl-2.0": (
        "this work is licensed under the gnu general public license version 2",
        ("general public license version 2",),
    ),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        ("general public license version 3",),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
        ("permission to use copy modify", "with or without fee"),
    ),
    "lgpl": ("gnu lesser general public license", ("lesser general public license",)),
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files",
        ("permission is hereby granted free of charge",),
    ),
    "mit-release": ("released under the mit license", ("mit license",)),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software", "public domain"),
    ),
}

# All ASCII characters but digits and letters become blanks; upper case becomes lower case.
_FOLD = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower()
)


def words(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8."""
    return raw.translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool


def templates() -> list[Template]:
    def split(text: str) -> tuple[bytes, ...]:
        return tuple(text.encode().split())

    base = [Template(label, split(p), (split(p),), True) for p, label in BASE.items()]
    return base + [
        Template(label, split(t), tuple(split(k) for k in keys), False)
        for label, (t, keys) in NOTICES.items()
    ]


@dataclass(frozen=True)
class Index:
    templates: list[Template]
    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    needed: list[int] = field(default_factory=list)


def build_index(df: DataFrame, text: str, per_template: int = 4) -> Index:
    """Index the ``per_template`` rarest words of each template (all words of a base phrase).

    Document frequencies are counted over all rows; what reaches the driver is a count for each
    word of the templates.
    """
    known = templates()
    vocabulary = frozenset(w for t in known for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for raw in binary(batch, "raw"):
                seen.update(vocabulary.intersection(words(raw)))
        names, n = [w.decode() for w in seen], list(seen.values())
        yield pa.RecordBatch.from_pydict({"word": pa.array([*names, ""]), "n": pa.array([*n, rows])})

    raw = df.select(F.col(text).cast("binary").alias("raw"))
    counts = raw.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in counts.collect()}
    total = found.pop(b"", 0)
    idf = {w: math.log((total + 1) / (found.get(w, 0) + 1)) for w in vocabulary}
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    needed = []
    for i, t in enumerate(known):
        rare = sorted(set(t.words), key=lambda w: (-idf[w], w))
        rare = set(rare if t.base else rare[:per_template])
        places = [(w, j) for j, w in enumerate(t.words) if w in rare]
        for w, j in places:
            postings[w].append((i, j))
        # All words of a base phrase must agree, and half of a notice's postings.
        needed.append(len(places) if t.base else -(-len(places) // 2))
    return Index(known, idf, dict(postings), needed)


def _contains(window: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    n = len(phrase)
    return any(tuple(window[i : i + n]) == phrase for i in range(len(window) - n + 1))


def align(file: list[bytes], index: Index, least: float = 0.8, slack: int = 3) -> list[tuple[int, int, float]]:
    """(template, start, share of the template's words that fit) of every accepted alignment."""
    licence = sorted(index.postings.keys() & set(file), key=lambda w: (-index.idf[w], w))
    # A template can only stand here if enough of its indexed words do.
    here: Counter[int] = Counter()
    for w in licence:
        here.update(i for i, _ in index.postings[w])
    open_ = {i for i, n in here.items() if n >= index.needed[i]}
    looked_up = {w: p for w in licence if (p := [(i, j) for i, j in index.postings[w] if i in open_])}
    if not looked_up:
        return []
    places: dict[bytes, list[int]] = {w: [] for w in looked_up}
    for at, w in enumerate(file):
        if w in places:
            places[w].append(at)
    votes: Counter[tuple[int, int]] = Counter()
    for w in looked_up:  # from the highest IDF down
        for i, j in looked_up[w]:
            votes.update((i, at - j) for at in places[w])
    out = []
    for (i, start), n in votes.items():
        t = index.templates[i]
        if n < index.needed[i] or start < -slack:
            continue
        fits = sum(
            0 <= start + j < len(file) and file[start + j] == w for j, w in enumerate(t.words)
        ) / len(t.words)
        if fits < (1 if t.base else least):
            continue
        window = file[start : start + len(t.words)] if t.base else file[max(0, start - slack) : start + len(t.words) + slack]
        if all(_contains(window, k) for k in t.keys):
            out.append((i, start, fits))
    return sorted(out)


def scan(df: DataFrame, text: str, index: Index | None = None) -> DataFrame:
    """``df`` with ``n_words``, ``places`` (label, base, start, score of each alignment).

    Other columns are kept as they are.
    """
    index = index or build_index(df, text)
    df = df.drop("n_words", "places")
    shared = df.sparkSession.sparkContext.broadcast(index)
    place = "array<struct<label:string,base:boolean,start:bigint,score:double>>"
    column = unused(df, "raw")
    kept = df.withColumn(column, F.col(text).cast("binary"))
    arrow = pa.list_(
        pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("score", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for batch in batches:
            counts, places = [], []
            for raw in binary(batch, column):
                file = words(raw)
                counts.append(len(file))
                places.append(
                    [
                        {"label": idx.templates[i].label, "base": idx.templates[i].base, "start": at, "score": s}
                        for i, at, s in align(file, idx)
                    ]
                )
            rest = batch.drop_columns([column])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(counts, pa.int64()), pa.array(places, arrow)],
                names=[*rest.schema.names, "n_words", "places"],
            )

    schema = df.withColumns({"n_words": F.lit(0).cast("long"), "places": F.lit(None).cast(place)}).schema
    return kept.mapInArrow(run, schema)


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The columns that sum up ``places``."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    return scanned.withColumns(
        {
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(starts),
            "last_word": F.array_max(starts),
            "base_labels": _labels(base),
            "labels": _labels(F.col("places")),
            "score": F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)),
        }
    ).drop("places")
