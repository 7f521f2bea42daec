"""Near-duplicate documents: MinHash bands find candidates, odd sketches verify them, full shingle sets confirm what is left.

Equal shingle sets are one class, whatever their number; all that follows works on classes. A class has 160 MinHash
samples in 32 bands of 5, and an odd sketch (Mitzenmacher, Pagh, Pham 2014) of these samples: 512 parity bits, of which the
XOR of two sketches counts the samples that differ. Two rounds follow, both within tiles of bounded size:
 A. each class goes to one tile, that of the least class that shares a band with it;
 B. bands that still hold two components or more: the classes outside the largest component of the band meet all its
    classes, in tiles of chunks.
A tile first sees sketches alone, 64 bytes a class. Pairs whose sketches differ in more bits than a similar pair could (see
most_flips) are passed over, and only classes with a pair left have their full sets computed again and sent to the tile, once,
where the pairs that aren't linked already are confirmed. So a band that much boilerplate makes hot costs XORs of sketches in
as many tiles as it needs, not sets. Tiles return links of a forest, never all pairs. Links within a component that is found
already are not looked for, and every other pair that shares a band is met in round B, so components are whole but for pairs
that share no band: at 0.85, one pair in 10^8; at 0.8, three in 10^6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import components
from .words import BLANK_WORDS, mix, shingles_of, slices, words_of

BANDS, ROWS, BITS = 32, 5, 512
SAMPLES = BANDS * ROWS
#: Classes in a chunk, and bytes of their sets, both on average; a tile holds two chunks at most.
CHUNK, CHUNK_BYTES = 512, 16 << 20
#: Places of classes in tiles that may be broadcast to pick documents by, some 200 bytes each.
MOST_PLACES = 200_000

_seeds = mix(np.arange(1, 3 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = (_seeds[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MASKS = (_seeds[SAMPLES : 2 * SAMPLES] >> np.uint64(32)).astype(np.uint32)
_ADDED = _seeds[2 * SAMPLES :]


def most_flips(similarity: float) -> int:
    """Bits in which sketches of sets as similar as this differ at most, but for one pair in a milliard or so.

    Six deviations of the differing samples (binomial), then four of the parity bits they flip.
    """
    off = SAMPLES * (1 - similarity) + 6 * math.sqrt(SAMPLES * similarity * (1 - similarity))
    flips = min(2 * off, 2 * SAMPLES)
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * flips / BITS)) + 4 * math.sqrt(BITS / 4 * (1 - math.exp(-4 * flips / BITS))))


def samples(found: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of 64-bit hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for a in range(0, len(x), 2048):
        np.minimum(low, ((x[a : a + 2048, None] ^ _MASKS) * _FACTORS).min(axis=0), out=low)
    return low


def bands_and_sketches(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low: a row of samples for each set. Band hashes (int64) and odd sketches (uint64 words)."""
    wide = mix(low.astype(np.uint64) + _ADDED)
    bands = mix(wide.reshape(len(low), BANDS, ROWS).sum(axis=2, dtype=np.uint64) + _ADDED[:BANDS])
    places = (wide >> np.uint64(32)).astype(np.int64) % BITS
    odd = np.bincount((places + np.arange(len(low))[:, None] * BITS).ravel(), minlength=len(low) * BITS).astype(np.uint8) & 1
    return bands.view(np.int64), np.packbits(odd.reshape(len(low), BITS), axis=1).view(np.uint64)


_PROFILE = "id long, digest long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    _, _, cuts, hashes = words_of(texts, BLANK_WORDS)
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield np.unique(shingles_of(hashes[s:e], k))


def _keys(found: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, whatever its order."""
    two = np.stack([mix(found ^ np.uint64(0x5851F42D4C957F2D)), mix(found * np.uint64(0xD1342543DE82EF95))]).sum(axis=1, dtype=np.uint64)
    a, b = mix(two + np.uint64(len(found))).view(np.int64).tolist()
    return a, b


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(id, digest, n_shingles, k1 and k2: the set's key, bands, sketch) from (id, digest, text); only id, digest and 0 for a
    text without words."""
    out = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch, 2):
                sizes, keys, low = [], [], []
                for found in _sets(batch.column(2).slice(a, z - a), k):
                    sizes.append(len(found))
                    if len(found):
                        keys.append(_keys(found))
                        low.append(samples(found))
                filled = np.array(sizes) > 0
                put = iter(range(len(keys)))
                place = pa.array([next(put) if f else None for f in filled], pa.int32())
                if keys:
                    bands, sketches = bands_and_sketches(np.stack(low))
                    k1, k2 = (pa.array(x, pa.int64()) for x in zip(*keys))
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                    cols = [k1, k2, bands, pa.array([s.tobytes() for s in sketches], pa.binary())]
                else:
                    cols = [pa.array([], t.type) for t in list(out)[3:]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, z - a) for c in (0, 1)), pa.array(sizes, pa.int64()), *(c.take(place) for c in cols)], schema=out)
        shared.give_back()

    return docs.mapInArrow(run, _PROFILE)


def _differ(sketch: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bits in which the sketches differ from another one."""
    return np.bitwise_count(sketch ^ other).sum(axis=1, dtype=np.int64)


def _met(outer: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The pairs of a tile, as a class and all those that it meets: outer ones meet all later ones; if there are none, all do."""
    order = np.argsort(node, kind="stable")
    some = outer.any()
    order = np.concatenate([order[outer[order]], order[~outer[order]]]) if some else order
    for rank, i in enumerate(order):
        if some and not outer[i]:
            break
        yield i, order[rank + 1 :]


def _alike(sizes: np.ndarray, sketch: np.ndarray, i: int, js: np.ndarray, percent: int, flips: int) -> np.ndarray:
    """Those of js whose size and sketch allow for the similarity."""
    js = js[100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])]
    return js[_differ(sketch[js], sketch[i]) <= flips]


def _link(node: np.ndarray, comp: np.ndarray, outer: np.ndarray, sketch: np.ndarray, items: list[np.ndarray], percent: int, flips: int) -> list[tuple[int, int]]:
    """Links of a forest over components: (comp, comp) of confirmed pairs that were not linked yet.

    outer: whether the class is outside the largest component; pairs of two that aren't are not met here, unless none is.
    """
    sizes = np.array([len(x) for x in items])
    _, inverse = np.unique(np.concatenate(items), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    ids = [inverse[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
    seen = np.zeros(int(inverse.max()) + 1 if len(inverse) else 1, bool)
    _, mine = np.unique(comp, return_inverse=True)
    names = np.zeros(mine.max() + 1, np.int64)
    names[mine] = comp
    links: list[tuple[int, int]] = []
    for i, js in _met(outer, node):
        js = _alike(sizes, sketch, i, js[mine[js] != mine[i]], percent, flips)
        if not len(js):
            continue
        seen[ids[i]] = True
        both = np.add.reduceat(seen[np.concatenate([ids[j] for j in js])], np.concatenate([[0], np.cumsum(sizes[js])[:-1]]), dtype=np.int64)
        seen[ids[i]] = False
        for j in js[100 * both >= percent * (sizes[js] + sizes[i] - both)]:
            if mine[i] != mine[j]:
                links.append((int(names[mine[i]]), int(names[mine[j]])))
                a, b = sorted((int(mine[i]), int(mine[j])), key=lambda c: names[c])
                mine[mine == b] = a
    return links


def _binary(column: pa.ChunkedArray) -> list[np.ndarray]:
    """64-bit words of each value, without a copy of them."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _columns(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tile with one row for each class; node, comp, outer, sketch."""
    node, first = np.unique(np.asarray(t["node"]), return_index=True)
    t = t.take(first)
    return t, node, np.asarray(t["comp"]), np.array(t["outer"].to_pylist(), dtype=bool), np.stack(_binary(t["sketch"]))


_TILE = "a long, b int, c int, d int"


def _tiles(rows: DataFrame):
    """rows by tile, dealt to a number of tasks of their own: tiles are few bytes and much work, so tasks must not be merged by size."""
    tile = ("a", "b", "c", "d")
    return rows.repartition(shared.buckets(rows.sparkSession), *tile).groupBy(*tile)


def _survivors(rows: DataFrame, percent: int, flips: int) -> DataFrame:
    """Of rows (a to d: the tile, node, comp, outer, n_shingles, sketch), those with a partner in their tile that their sketches
    allow for, in another component; without n_shingles and sketch."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int32()), ("c", pa.int32()), ("d", pa.int32()), ("node", pa.int64()), ("comp", pa.int64()), ("outer", pa.bool_())])

    def run(t: pa.Table) -> pa.Table:
        t, node, comp, outer, sketch = _columns(t)
        sizes, left = np.asarray(t["n_shingles"]), np.zeros(len(node), bool)
        for i, js in _met(outer, node):
            js = _alike(sizes, sketch, i, js[comp[js] != comp[i]], percent, flips)
            left[js] = True
            left[i] |= len(js) > 0
        return t.filter(pa.array(left)).select(out.names).cast(out)

    return _tiles(rows).applyInArrow(run, f"{_TILE}, node long, comp long, outer boolean")


def _confirm(rows: DataFrame, percent: int, flips: int) -> DataFrame:
    """Of rows (a to d: the tile, node, comp, outer, sketch, items), the links (u, v) by components."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        t, node, comp, outer, sketch = _columns(t)
        links = _link(node, comp, outer, sketch, _binary(t["items"]), percent, flips) if len(node) > 1 else []
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=out)

    return _tiles(rows).applyInArrow(run, "u long, v long")


def _with_sets(texts: DataFrame, found: DataFrame, classes: DataFrame, left: DataFrame, shingle: int) -> DataFrame:
    """left (tile, node, comp, outer) with sketch and items, the class's sorted 64-bit shingle hashes.

    Sets come from the whole text of one document of the class, which is told by its id and the digest of its text. Each is
    shuffled once, to its tile.
    """
    places = left.groupBy("node").agg(F.collect_list(F.struct("a", "b", "c", "d", "comp", "outer")).alias("places"))
    wanted = classes.select("node", "k1", "k2", "sketch", F.col("row.id").alias("row_id"), F.col("row.digest").alias("row_digest")).join(places, "node")
    small = left.count() <= MOST_PLACES
    hint = F.broadcast if small else lambda df: df
    # Rows that repeat in id and text: one of them is enough, however many there are.
    keys = wanted.select("row_id", "row_digest", "node")
    same = lambda df: (df["id"].eqNullSafe(F.col("row_id"))) & (df["digest"] == F.col("row_digest"))
    rows = found.select("id", "digest")
    often = rows.join(hint(keys), same(rows)).groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.lit(True).alias("often"))
    wanted = wanted.join(often, "node", "left")
    picked = texts.join(hint(wanted), same(texts)).select("text", "k1", "k2", "node", "sketch", "often", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch, 0):
                part = batch.slice(a, z - a)
                want = zip(part.column(1).to_pylist(), part.column(2).to_pylist())
                items = [s.tobytes() if len(s) and _keys(s) == key else None for s, key in zip(_sets(part.column(0), shingle), want)]
                put = pa.RecordBatch.from_arrays([*part.columns[3:], pa.array(items, pa.binary())], names=[*part.schema.names[3:], "items"])
                yield put.filter(put.column("items").is_valid())
        shared.give_back()

    kept = picked.drop("text", "k1", "k2")
    sets = picked.mapInArrow(run, kept.withColumn("items", F.lit(b"")).schema)
    once = sets.where("often is null").select("node", "sketch", "places", "items")
    if not often.isEmpty():
        once = once.unionByName(sets.where("often").groupBy("node").agg(*(F.first(c).alias(c) for c in ("sketch", "places", "items"))))
    return once.select("node", "sketch", "items", F.explode("places").alias("p")).select("p.*", "node", "sketch", "items")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id, kept, digest, first).

    Words are runs of anything but blanks, A-Z in lower case. Documents are linked where the shingle sets A and B have
    100 * |A and B| >= percent * |A or B|; component_id is the least id that links reach, the row's own included, and kept
    tells whether that is the row's own. Texts that are null, empty or without words have no shingles and are linked with
    nothing, so they are kept; texts of fewer words than a shingle have one, the whole. Rows with a null id take part;
    they get the least id of their component (null if it has none). Rows that repeat an id are rows of their own and all
    say kept where that id is the component's. digest is xxhash64 of the text; first tells whether a row's id and digest are the
    least of the component, null ids last, so it is true of one row of each component but for rows that repeat both. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    flips = most_flips(percent / 100)
    shared.small_batches(spark)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    found, _ = shared.stash(profiles(texts, shingle), "profiles")
    firsts = (F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch"))
    classes = found.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest")).alias("row"), *firsts)
    classes, _ = shared.stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sketches = classes.select("node", "n_shingles", "sketch")

    banded = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared_bands = banded.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1")
    met, met_path = shared.stash(banded.join(shared_bands.select("band", "first"), "band"), "met")

    def chunks(size, shingles):
        """Chunks for so many classes with so many shingles of 8 bytes; 0 for none."""
        return F.ceil(F.greatest(size / CHUNK, shingles * 8 / CHUNK_BYTES)).cast("int")

    def linked(tiles: DataFrame) -> tuple[DataFrame, list[str]]:
        rows = tiles.join(sketches, "node")
        left, left_path = shared.stash(_survivors(rows, percent, flips), "survivors")
        links, links_path = shared.stash(_confirm(_with_sets(texts, found, classes, left, shingle), percent, flips), "links")
        return components(links), [left_path, links_path]

    # Round A: the tile of a class is the least class that it meets; that class is in its own tile too.
    mine = met.groupBy("node", "n_shingles").agg(F.min("first").alias("center"))
    mine, mine_path = shared.stash(mine, "centers")
    sized = mine.groupBy("center").agg(chunks(F.count("*"), F.sum("n_shingles")).alias("chunks"))
    dealt = mine.join(sized, "center")
    members = dealt.where("node <> center").select("center", F.expr("cast(pmod(xxhash64(node), chunks) as int)").alias("chunk"), "node")
    heads = members.select("center", "chunk").distinct().withColumn("node", F.col("center"))
    none = F.lit(0).alias
    tiles = members.unionByName(heads).select(F.col("center").alias("a"), F.col("chunk").alias("b"), none("c"), none("d"), "node", F.col("node").alias("comp"), F.lit(False).alias("outer"))
    first, first_paths = linked(tiles)

    # Round B: bands that hold several components still.
    now = met.select("band", "node", "n_shingles").join(first, "node", "left").select("band", "node", "n_shingles", F.coalesce("root", "node").alias("comp"))
    mixed = now.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.sum(F.expr("cast(xxhash64(node) as decimal(20,0))")).alias("sign"), F.count("*").alias("size"))
    mixed = mixed.where("a <> b").groupBy("sign", "size").agg(F.min("band").alias("band")).select("band")
    rest, rest_path = shared.stash(now.join(mixed, "band"), "mixed")
    by_comp = rest.groupBy("band", "comp").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"))
    largest = by_comp.groupBy("band").agg(F.max(F.struct("size", "comp", "shingles")).alias("top"), F.sum("size").alias("all"), F.sum("shingles").alias("shingles"))
    inner, outers = chunks(F.col("top.size"), F.col("top.shingles")), chunks(F.col("all") - F.col("top.size"), F.col("shingles") - F.col("top.shingles"))
    largest = largest.select("band", F.col("top.comp").alias("main"), inner.alias("inner"), outers.alias("outers"))
    placed = rest.join(largest, "band").withColumn("outer", F.col("comp") != F.col("main"))
    placed = placed.withColumn("own", F.expr("cast(pmod(xxhash64(node), if(outer, outers, inner)) as int)"))
    # A tile is an outer chunk with an inner one (kind 0) or with a later outer one (kind 1).
    across = placed.where("not outer").select("band", "node", "comp", "outer", F.lit(0).alias("kind"), F.col("own").alias("y"), F.explode(F.expr("sequence(0, outers - 1)")).alias("x"))
    outside = placed.where("outer")
    across = across.unionByName(outside.select("band", "node", "comp", "outer", F.lit(0).alias("kind"), F.col("own").alias("x"), F.explode(F.expr("sequence(0, inner - 1)")).alias("y")))
    many = outside.where("outers > 1").withColumn("other", F.explode(F.expr("sequence(0, outers - 1)"))).where("other <> own")
    across = across.unionByName(many.select("band", "node", "comp", "outer", F.lit(1).alias("kind"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))
    again = across.select(F.col("band").alias("a"), F.col("kind").alias("b"), F.col("x").alias("c"), F.col("y").alias("d"), "node", "comp", "outer")
    more, more_paths = linked(again)
    second = more.select(F.col("node").alias("root"), F.col("root").alias("next"))

    rooted = classes.select("k1", "k2", "node", "least", "row").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(second, "root", "left").select("k1", "k2", "least", "row", F.coalesce("next", "root").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("row").alias("top"))
    named, _ = shared.stash(rooted.select("k1", "k2", "root").join(lowest, "root").select("k1", "k2", "component_id", "top"), "named")
    shared.forget(spark, met_path, mine_path, rest_path, *first_paths, *more_paths)
    out = found.select("id", "digest", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    leads = F.col("id").eqNullSafe(F.col("top.id")) & (F.col("digest") == F.col("top.digest")) | F.col("k1").isNull()
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "digest", F.coalesce(leads, F.lit(True)).alias("first"))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    """The query: 3-word shingles, 85 of 100."""
    return near_duplicates(shared.table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("digest", "first")
