"""Shards of near-equal bytes: the minimax contiguous partition of ordered groups of equal texts.

Groups are ordered by a digest of their text. The least capacity with which a greedy pass needs no more than the wanted
shards is found by binary search; with it, cuts are put where shares are most even. The pass runs over a bounded histogram instead of all groups: 65,536 ranges of digests
at first; ranges in which a cut may fall are split in 256, again and again, until each holds one group, so the result is
that of a pass over all groups. Everything else is DataFrame functions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Cells that number the rows of a shard: rows go to one by a hash of their id, and so are numbered in parallel. What is
#: broadcast is one number a cell, so there are fewer of them where shards are many.
CELLS, MOST_CELLS = 4096, 1_000_000
#: Ranges split in a round, each in 256.
SPLIT = 1024
_NO_TEXT = "0" * 64


class Ranges:
    """Ranges of the order with their sizes; a range of one group (or of nothing to split) is whole."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        rows = sorted(rows)
        self.keys = [r[0] for r in rows]
        self.sizes = [r[1] for r in rows]
        self.whole = [r[2] == 1 for r in rows]
        self.upto = [0]
        for s in self.sizes:
            self.upto.append(self.upto[-1] + s)

    def cuts(self, capacity: int, shards: int, fluid: bool) -> list[int] | None:
        """Where a greedy pass ends each shard, in bytes from the start; None if it needs more shards.

        fluid: ranges that aren't whole may be cut anywhere; else no range may be cut.
        """
        at, out = 0, []
        for _ in range(shards):
            k = bisect_right(self.upto, at + capacity) - 1
            end = self.upto[k]
            if fluid and k < len(self.sizes) and not self.whole[k]:
                end = at + capacity
            end = max(end, at)
            out.append(end)
            at = end
            if at >= self.upto[-1]:
                return out + [at] * (shards - len(out))
        return None

    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """Ends of shards within a feasible capacity, each as near as can be to an equal share of what is left."""
        total, latest = self.upto[-1], [0] * shards + [self.upto[-1]]
        for k in range(shards - 1, 0, -1):  # the first end from which the rest still fits
            latest[k] = self.upto[bisect_left(self.upto, latest[k + 1] - capacity)]
        at, out = 0, []
        for k in range(1, shards):
            share = at + (total - at) / (shards - k + 1)
            j = bisect_left(self.upto, share)
            near = min(self.upto[max(j - 1, 0) : j + 1], key=lambda b: abs(b - share))
            at = max(latest[k], min(near, self.upto[bisect_right(self.upto, at + capacity) - 1]))
            out.append(at)
        return [*out, total]

    def least(self, shards: int, fluid: bool) -> int:
        low = max([-(-self.upto[-1] // shards), *(s for s, w in zip(self.sizes, self.whole) if w or not fluid)], default=0)
        high = max(low, self.upto[-1])
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.cuts(mid, shards, fluid) is not None else (mid + 1, high)
        return low

    def open(self, shards: int) -> list[str]:
        """Ranges in which a cut of the best partition may fall."""
        low, high = self.least(shards, True), self.least(shards, False)
        first, last = self.cuts_from(low, shards), self.cuts(high, shards, True)
        found = {}
        for a, z in zip(first, last):
            k = max(0, bisect_right(self.upto, a) - 1)
            while k < len(self.sizes) and self.upto[k] <= z:
                if not self.whole[k] and self.sizes[k]:
                    found[self.keys[k]] = self.sizes[k]
                k += 1
        return sorted(found, key=lambda k: (-found[k], k))

    def cuts_from(self, capacity: int, shards: int) -> list[int]:
        """As cuts(fluid=False), but a range too large for a shard stops the pass where it is."""
        at, out = 0, []
        for _ in range(shards):
            at = max(at, self.upto[bisect_right(self.upto, at + capacity) - 1])
            out.append(at)
        return out


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The least capacity, and the first key of every shard but the first. groups: (key: hexadecimal, size long)."""

    def histogram(rows: DataFrame, width: int) -> list[tuple[str, int, int]]:
        found = rows.groupBy(F.substring("key", 1, width).alias("k")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        return [(r.k, r.s, r.n) for r in found.collect()]

    rows = {r[0]: r for r in histogram(groups, 4)}
    while True:
        ranges = Ranges(list(rows.values()))
        # Largest first, so that a group too large for a fair share stands alone early; the others wait for later rounds.
        again = ranges.open(shards)[:SPLIT]
        if not again:
            break
        # Keys in `again` have all lengths so far; a range is split from where it stands.
        deeper = {}
        for size in sorted({len(k) for k in again}):
            part = groups.where(F.substring("key", 1, size).isin([k for k in again if len(k) == size]))
            deeper |= {r[0]: r for r in histogram(part, size + 2)}
        for k in again:
            del rows[k]
        rows |= deeper
    capacity = ranges.least(shards, False)
    ends = ranges.even_cuts(capacity, shards)
    firsts = []
    for e in ends[:-1]:
        k = bisect_right(ranges.upto, e) - 1
        # The key of the group after the cut; beyond the last one, a key above all.
        firsts.append(ranges.keys[k] if k < len(ranges.keys) else "g")
    return capacity, firsts


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, size, text_crc32, law, shard, slot, grown_shard, group_key).

    size is the text's UTF-8 bytes (none if null) plus overhead. Rows of equal texts are one group and stay in one shard;
    rows without text are a group, too. Groups are in the order of group_key, the text's SHA-256, and each shard holds a
    run of them; the largest shard is as small as any such cut allows (a group larger than a fair share fills its shard alone
    if that is best). law is `bytes`. slot numbers a shard's rows from 0 without gaps, in the order of a hash of the id,
    then the id and text; rows that repeat get slots of their own. text_crc32 is null without text, and 0 for an empty one, whose
    group is another; both have the size overhead. Texts of equal digests alone are ties, and equal texts. Very long texts are
    groups like others. Fewer groups than shards leave shards empty. An empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.coalesce(F.sha2(text, 256), F.lit(_NO_TEXT)).alias("key"),
    )
    base, _ = shared.stash(base, "sized")
    groups, groups_path = shared.stash(base.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, firsts = minimax_cuts(groups, shards)
    shared.forget(spark, groups_path)
    shard = sum((F.when(F.col("key") >= k, 1).otherwise(0) for k in firsts), F.lit(0))
    per_shard = max(1, min(CELLS, MOST_CELLS // shards))
    placed = base.withColumn("shard", shard.cast("int")).withColumn("cell", F.expr(f"cast(pmod(xxhash64(id, key), {per_shard}) as int)"))
    # Rows before each cell: at most MOST_CELLS numbers, or one for each shard.
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "key"))
    numbered = placed.withColumn("rank", rank).join(F.broadcast(cells), ["shard", "cell"])
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("key").alias("group_key"),
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(shared.table(spark, sf_dir, "documents")).drop("group_key")
