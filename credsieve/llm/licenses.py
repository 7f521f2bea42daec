"""License scan: exact base phrases by words, short notices with a few wrong characters by seeds and bounded-error matching.

A notice that may hold k errors is split into k + 1 pieces; any passage within k edits holds one piece unchanged (pigeonhole).
An Aho-Corasick automaton finds all pieces of all notices in one pass; only where one stands does the regex library look for the
whole notice with at most k errors, best match first, and report the span and its errors.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import LETTER_WORDS, buffer_of, slices, words_of

# The base phrases of the contract, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices in wide public use, as words, with our labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version 2", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the bsd 3 clause license", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under a creative commons attribution", "cc"),
    ("dedicated to the public domain under cc0 1 0", "cc0"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier apache 2 0", "apache"),
    ("spdx license identifier gpl 3 0", "gpl"),
]


def errors_allowed(notice: str) -> int:
    """One error for each 16 characters, four at most."""
    return min(4, len(notice) // 16)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:z]) for a, z in zip(cuts[:-1], cuts[1:])]


class Scanner:
    def __init__(self, notices: list[tuple[str, str]]):
        import ahocorasick
        import regex

        self.notices = [(text, label, errors_allowed(text)) for text, label in notices]
        self.shapes = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}(?![^ ])") for text, _, k in self.notices]
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (text, _, k) in enumerate(self.notices):
            for at, piece in pieces(text, k):
                seeds.setdefault(piece, []).append((n, at))
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> set[tuple[int, int]]:
        """(notice, about where it would start)."""
        return {(n, end + 1 - size - at) for end, (size, places) in self.automaton.iter(text) for n, at in places}

    def confirm(self, text: str, n: int, about: int) -> tuple[int, int, int] | None:
        """Start, end and errors of the notice nearest that place."""
        notice, _, k = self.notices[n]
        low = max(0, about - k)
        if low:  # from a word's start on
            low = text.rfind(" ", 0, low) + 1
        found = self.shapes[n].search(text, low, min(len(text), about + len(notice) + 2 * k))
        return (found.start(), found.end(), sum(found.fuzzy_counts)) if found else None


_scanners: dict[int, Scanner] = {}


def _scanner(notices: tuple) -> Scanner:
    if hash(notices) not in _scanners:
        _scanners[hash(notices)] = Scanner(list(notices))
    return _scanners[hash(notices)]


_OUT = pa.schema([
    ("id", pa.int64()), ("n_words", pa.int64()),
    ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("notices", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("score", pa.float64())]))),
])
_DDL = "id long, n_words long, base array<struct<label string, word long>>, notices array<struct<label string, first_word long, last_word long, errors int, score double>>"


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_words, base: array<struct<label, word>>, notices: array<struct<label, first_word,
    last_word, errors, score>>).

    base has all places where the words of a base phrase stand one after the other (word: the first one's number, from 0), in
    the order of the text; notices the spans of words within the errors allowed of a notice, the best of those that overlap; score
    is 1 - errors / length. Of overlapping spans with equal scores the first by label, then by place counts. Null and empty texts
    have no words. Very long texts are searched whole, in time that grows with their length and number of notices. Rows that
    repeat are scanned each; a null id stays. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    shared.small_batches(docs.sparkSession)
    wanted = tuple(notices if notices is not None else NOTICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(wanted)
        phrases = [(label, words_of(pa.array([p]), LETTER_WORDS)[3]) for p, label in BASE.items()]
        for batch in batches:
            for a, z in slices(batch, 1):
                texts = batch.column(1).slice(a, z - a)
                starts, ends, cuts, hashes = words_of(texts, LETTER_WORDS)
                data, _ = buffer_of(texts)
                n_texts = len(texts)
                base: list[list] = [[] for _ in range(n_texts)]
                marks: list[list] = [[] for _ in range(n_texts)]
                doc_of = lambda words: np.searchsorted(cuts, words, side="right") - 1
                for label, want in phrases:
                    m = len(want)
                    if len(hashes) < m:
                        continue
                    hit = hashes[: len(hashes) - m + 1] == want[0]
                    for i in range(1, m):
                        hit &= hashes[i : len(hashes) - m + 1 + i] == want[i]
                    at = np.flatnonzero(hit)
                    at = at[doc_of(at) == doc_of(at + m - 1)]
                    for d, w in zip(doc_of(at).tolist(), at.tolist()):
                        base[d].append({"label": label, "word": w - int(cuts[d])})
                # All words in one string, one blank between words and a line for each text.
                if len(starts):
                    flat = LETTER_WORDS[data]
                    inside = flat != 0
                    low = np.where(inside, flat - 1, 32).astype(np.uint8)
                    for d in np.flatnonzero(np.diff(cuts)).tolist():
                        x, y = int(starts[cuts[d]]), int(ends[cuts[d + 1] - 1])
                        line = low[x:y]
                        blank = line == 32
                        if blank.any():
                            line = line[~(blank & np.concatenate([[False], blank[:-1]]))]
                        text = line.tobytes().decode()
                        seen = scanner.candidates(text)
                        if seen:
                            marks[d] = _spans(scanner, text, seen)
                for d in range(n_texts):
                    base[d].sort(key=lambda x: (x["word"], x["label"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(np.diff(cuts), pa.int64()), pa.array(base, _OUT.field("base").type), pa.array(marks, _OUT.field("notices").type)], schema=_OUT)
        shared.give_back()

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _DDL)
    return found.withColumnRenamed("id", id_col)


def _spans(scanner: Scanner, text: str, seen: set[tuple[int, int]]) -> list[dict]:
    found: dict[tuple[str, int, int], tuple[int, float]] = {}
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    for n, about in sorted(seen):
        hit = scanner.confirm(text, n, about)
        if hit:
            notice, label, _ = scanner.notices[n]
            a, z, errors = hit
            first = int(np.searchsorted(blanks, a))
            key = (label, first, first + text[a:z].strip().count(" "))
            found[key] = min(found.get(key, (errors, 0.0)), (errors, 1 - errors / len(notice)), key=lambda x: (x[0], -x[1]))
    best: list[dict] = []
    starts: list[int] = []  # of what is taken, which never overlaps
    ends: list[int] = []
    for (label, first, last), (errors, score) in sorted(found.items(), key=lambda x: (-x[1][1], x[0])):
        at = bisect(starts, last)
        if not at or ends[at - 1] < first:
            starts.insert(at, first)
            ends.insert(at, last)
            best.append({"label": label, "first_word": first, "last_word": last, "errors": errors, "score": score})
    return sorted(best, key=lambda b: (b["first_word"], b["label"]))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(shared.table(spark, sf_dir, "documents"))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    words = F.transform("base", lambda x: x["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        text(labels("base")).alias("base_labels"),
        text(F.concat(labels("base"), labels("notices"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda x: x["score"])), F.lit(0.0))).alias("score"),
        "notices",
    )
