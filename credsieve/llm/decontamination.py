"""Benchmark decontamination by greedy string tiling (Wise 1993, running Karp-Rabin).

Documents and benchmark items are compared as words of letters and digits, A-Z in lower case. Runs of five words that a
document shares with an item are seeds, joined by their hash; items of fewer words have one seed, all their words. For each
document and item with a seed in common, tiles are marked: the longest run of unmarked words that both hold, again and again
down to the length of a seed, whatever the order of the passages. Each pass finds the greatest length that has a match by
hashes of all unmarked runs of a length, and marks all its matches. Space is linear in the words of both, however often a word
repeats. The share of an item's words under tiles is its coverage.

The benchmark is the small side: its seeds are broadcast in parts of a checked size, one pass over the documents each, and
documents are never shuffled, so no passage is hot however many documents hold it. Where there are several parts, what one of
them found is written before the next is broadcast, so one part is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import LETTER_WORDS, shingles_of, slices, words_of

#: Characters of benchmark text in a part: its hashes and seeds take about 8 bytes for each.
PART_CHARS = 8 << 20


class Seeds:
    """Items of one part and where their seeds stand."""

    def __init__(self, ids: list[int], texts: list[str], width: int):
        _, _, cuts, hashes = words_of(pa.array(texts, pa.string()), LETTER_WORDS)
        self.ids, self.words = ids, [hashes[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        for n, w in enumerate(self.words):
            if len(w):
                own = np.unique(shingles_of(w, width))
                found.setdefault(min(len(w), width), []).append((own, np.full(len(own), n)))
        for size, parts in found.items():
            seeds, items = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(seeds, kind="stable")
            self.by_width[size] = seeds[order], items[order]

    def places(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Where in hashes seeds of this size stand."""
        seeds = self.by_width[size][0]
        if len(hashes) < size:
            return np.zeros(0, np.int64)
        own = shingles_of(hashes, size)
        low = np.searchsorted(seeds, own)
        return np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == own)

    def items(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Items that share a seed of this size."""
        at = self.places(hashes, size)
        if not len(at):
            return at
        seeds, items = self.by_width[size]
        own = np.unique(shingles_of(hashes, size)[at])
        low, high = np.searchsorted(seeds, own), np.searchsorted(seeds, own, side="right")
        return np.unique(np.concatenate([items[a:z] for a, z in zip(low, high)]))


_BASE = np.uint64(0x9E6C63D0676A9A99)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Runs:
    """Hashes of runs of words of one text, of any length, and which words are marked."""

    def __init__(self, words: np.ndarray, unmarked: np.ndarray):
        self.free, n = unmarked.copy(), len(words)
        up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)]), dtype=np.uint64) for x in (_BASE, _INVERSE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)])

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the unmarked runs of this length, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[length:] == taken[: len(taken) - length])
        return at, (self.sums[at + length] - self.sums[at]) * self.down[at]


def _covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words under runs of a size that begin at some places."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return np.cumsum(edges)[:n] > 0


def tiles(doc: np.ndarray, item: np.ndarray, size: int) -> tuple[int, int]:
    """Words of the item under tiles, and the number of tiles; doc and item are hashes of words.

    Of the longest matches, the first in the document is marked first, with its first unmarked place in the item.
    """
    if min(len(doc), len(item)) < size:
        return 0, 0
    ours, theirs = shingles_of(doc, size), shingles_of(item, size)
    near = np.flatnonzero(np.isin(ours, theirs))
    if not len(near):
        return 0, 0
    # Words beside these cannot be in a match; they are left out, and a gap stays between what is left.
    marked = _covered(near, size, len(doc))
    keep = marked.copy()
    keep[1:] |= marked[:-1]
    a, b = _Runs(doc[keep], marked[keep]), _Runs(item, _covered(np.flatnonzero(np.isin(theirs, ours)), size, len(item)))
    shared_words, count, top = int(b.free.sum()), 0, min(len(a.free), len(item))
    while True:
        low, high = size - 1, top  # the greatest length with a match
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if np.isin(a.of(mid)[1], b.of(mid)[1]).any() else (low, mid - 1)
        if low < size:
            return shared_words - int(b.free.sum()), count
        top = length = low
        (starts, ours), (places, theirs) = a.of(length), b.of(length)
        hit = np.isin(ours, theirs)
        by_hash: dict[int, list[int]] = {}
        for p, h in zip(places[::-1].tolist(), theirs[::-1].tolist()):
            by_hash.setdefault(h, []).append(p)
        end = -1
        for d, h in zip(starts[hit].tolist(), ours[hit].tolist()):
            if d < end:
                continue
            waiting = by_hash[h]
            while waiting and not b.free[waiting[-1] : waiting[-1] + length].all():
                waiting.pop()
            if waiting:
                p = waiting.pop()
                a.free[d : d + length] = b.free[p : p + length] = False
                count, end = count + 1, d + length


_ITEMS = "array<struct<item_id: bigint, coverage: double, tiles: int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """docs with a column items: array<struct<item_id, coverage, tiles>> of the benchmark items that share a run of `width`
    words (or all their words, if fewer), in the order of item_id.

    Null and empty texts share nothing, on either side; items without words are never found. Items that repeat are found
    once each, as are rows of docs. Very long texts are compared whole, in space linear in their words. Of equally long matches
    the first in the document counts, then the first in the item. An empty benchmark or table of documents is no error. All
    columns of docs stay; a column named items, in any case of its letters, is replaced.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // part_chars))
    names = shared.without(docs.columns, "items")
    out = docs.select(*names, F.array().cast(_ITEMS).alias("items"))
    text_at = shared.place(names, text_col)
    before = None
    for k in range(parts):
        # A part holds about part_chars characters; that is what is collected and broadcast at a time.
        rows = (items if parts == 1 else items.where(F.expr(f"pmod(xxhash64(item, text), {parts}) = {k}"))).orderBy("item", "text").collect()
        sent = spark.sparkContext.broadcast(Seeds([r.item for r in rows], [r.text for r in rows], width))
        out = out.mapInArrow(_finder(sent, width, text_at, len(names)), out.schema)
        if k < parts - 1:
            out, path = shared.stash(out, "parts")
            sent.destroy()
            if before:
                shared.forget(spark, before)
            before = path
    return out.withColumn("items", F.array_sort("items"))


def _finder(sent, width: int, text_at: int, items_at: int):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))

    def found_in(seeds: Seeds, hashes: np.ndarray, sizes: list[int]) -> list[dict]:
        out = []
        for size in sizes:
            for n in seeds.items(hashes, size).tolist():
                words, count = tiles(hashes, seeds.words[n], size)
                out.append({"item_id": seeds.ids[n], "coverage": words / len(seeds.words[n]), "tiles": count})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = sent.value
        for batch in batches:
            for a, z in slices(batch, text_at):
                rows = batch.slice(a, z - a)
                _, _, cuts, hashes = words_of(rows.column(text_at), LETTER_WORDS)
                hits: dict[int, list[int]] = {}
                for size in seeds.by_width:
                    # Runs that cross from one text into the next are looked up again text by text.
                    at = seeds.places(hashes, size)
                    for n in np.unique(np.searchsorted(cuts, at, side="right") - 1).tolist():
                        hits.setdefault(n, []).append(size)
                items = rows.column(items_at)
                if hits:
                    lists = items.to_pylist()
                    for n, sizes in hits.items():
                        lists[n] = lists[n] + found_in(seeds, hashes[cuts[n] : cuts[n + 1]], sizes)
                    items = pa.array(lists, kind)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(items_at)), items], names=rows.schema.names)
        shared.give_back()

    return run


#: Share of an item's words that makes a document contaminated.
COVERAGE = 0.5


def contaminated(items, coverage: float = COVERAGE):
    return F.exists(items, lambda i: i["coverage"] >= coverage)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document: whether it is contaminated, and the items that reach the coverage."""
    found = contamination(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), shared.table(spark, sf_dir, "benchmark"))
    enough = F.filter("items", lambda i: i["coverage"] >= COVERAGE)
    return found.select(
        "doc_id",
        contaminated(F.col("items")).alias("contaminated"),
        F.transform(enough, lambda i: i["item_id"]).alias("item_ids"),
        F.round(F.coalesce(F.array_max(F.transform("items", lambda i: i["coverage"])), F.lit(0.0)), 6).alias("coverage"),
        F.size("items").alias("n_sharing"),
    )
