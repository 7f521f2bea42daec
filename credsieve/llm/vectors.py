"""Near-duplicate vectors: int8 tile products with error bounds, full precision where a pair may reach the threshold.

Equal vectors are one class with a weight. Classes are dealt into groups by a hash; a tile holds two groups, whose int8
products are exact in floating point. A unit vector u is s * q + e with int8 q and |e| <= eps known, so by Cauchy-Schwarz
the cosine of two is within |s q| eps' + eps |s' q'| + eps eps' of s s' (q . q'). A pair below the threshold by more than that
bound is no link, one above it by more is one, and neither needs full precision. Tiles get int8 values, a scale and an error
bound for each vector; only vectors with a pair in between are sent there in double precision, for a second pass that
computes just these pairs. Tiles return counts and a forest of links, never the pairs. Every vector meets every other, so
products and bytes shuffled grow with the square of the number of distinct vectors: some 90 * n / GROUP bytes a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import components
from .words import mix

#: Classes of a group; a tile holds two groups.
GROUP = 8192
_ROWS, _PAIRS = 1024, 1 << 16

_PROFILE = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("vec", pa.binary()), ("q", pa.binary()), ("scale", pa.float64()), ("eps", pa.float64())])
_PROFILE_DDL = "id long, k1 long, k2 long, vec binary, q binary, scale double, eps double"


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Binary values of one length as rows."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(len(column), -1)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, the scale of each row, and an upper bound of the norm of what the int8 values leave out."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - q * scale[:, None]
    return q, scale, np.sqrt(np.einsum("ij,ij->i", rest, rest)) * (1 + 1e-9) + 1e-12


def _bound(eps: np.ndarray, eta: np.ndarray | float) -> np.ndarray:
    """Of the error of a product: |s q| <= 1 + eps; the last term covers the rounding of the two scalings."""
    return (1 + eps) * eta + eps * (1 + eta) + eps * eta + 1e-6


def _candidates(left: tuple, right: tuple, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of left and right (q, scale, eps) that may reach the threshold, and whether they surely do."""
    (q, s, eps), (p, t, eta) = left, right
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    p, most = p.astype(kind), float(eta.max())
    for a in range(0, len(q), _ROWS):
        z = min(a + _ROWS, len(q))
        low = a if same else 0
        found = (q[a:z].astype(kind) @ p[low:].T) * t[low:].astype(kind)
        i, j = np.nonzero(found >= ((threshold - _bound(eps[a:z], most)) / s[a:z])[:, None].astype(kind) - kind(1e-6))
        # What a pair is depends on its two vectors alone, so both passes say the same of it.
        about, off = found[i, j].astype(np.float64) * s[a:z][i], _bound(eps[a:z][i], eta[low:][j])
        i, j, keep, sure = i + a, j + low, about >= threshold - off, about >= threshold + off
        if same:
            keep &= j > i
        i, j, sure = i[keep], j[keep], sure[keep]
        for k in range(0, len(i), _PAIRS):
            yield i[k : k + _PAIRS], j[k : k + _PAIRS], sure[k : k + _PAIRS]


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the labels of pairs, in place; labels are places of representatives."""
    while len(i):
        a, b = label[i], label[j]
        off = a != b
        i, j, a, b = i[off], j[off], a[off], b[off]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _sides(t: pa.Table, same: bool) -> Iterator[list[np.ndarray]]:
    """Rows of a tile that meet, by the length of their vectors: one array for a group with itself, else one for each group."""
    side, widths = np.asarray(t["own"]), np.asarray(pa.compute.binary_length(t["q"]))
    for width in np.unique(widths):
        mine = np.flatnonzero(widths == width)
        parts = [mine] if same else [mine[side[mine] == k] for k in np.unique(side)]
        if len(parts) == 2 - same and all(map(len, parts)):
            yield parts


def _tile(t: pa.Table, threshold: float, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: links found, the place of the row that stands for those it is linked with, and whether it is in a pair that
    the int8 values leave open. exact: of the pairs left open, from vec; else of the others, from q, scale and eps alone."""
    same, n = t["x"][0].as_py() == t["y"][0].as_py(), len(t)
    node, weight = np.asarray(t["node"]), np.asarray(t["weight"])
    links, label, open_pairs = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
    scale, eps = np.asarray(t["scale"]), np.asarray(t["eps"])
    for parts in _sides(t, same):
        ready = [(_matrix(t["q"].take(pa.array(p)), np.int8), scale[p], eps[p]) for p in parts]
        units = [_units(_matrix(t["vec"].take(pa.array(p)), np.float64)) for p in parts] if exact else []
        for i, j, sure in _candidates(ready[0], ready[-1], same, threshold):
            right = sure
            if exact:
                i, j = i[~sure], j[~sure]
                right = np.einsum("ij,ij->i", units[0][i], units[-1][j]) >= threshold
            else:
                open_pairs[parts[0][i[~sure]]] = open_pairs[parts[-1][j[~sure]]] = True
            i, j = parts[0][i[right]], parts[-1][j[right]]
            links += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
            _hook(label, i, j)
    return links, node[label], open_pairs


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: (id_col, n_links, component_id, kept).

    Two rows are linked where the cosine of their vectors, in double precision, is threshold or more; n_links counts the
    other rows linked with a row, component_id is the least id that links reach, its own included. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, and so do vectors of different lengths; such rows
    are kept. A cosine of just the threshold links. Rows that repeat an id are rows of their own. A null id takes part and gets
    its component's least id. An empty table gives no rows; other columns are ignored, whatever their names. Very long vectors are
    held whole: a tile takes GROUP times their length, twice.
    """
    spark = vectors.sparkSession
    shared.small_batches(spark)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values, ends = np.asarray(lists.values.fill_null(np.nan)), np.asarray(lists.offsets)
            sizes = np.where(np.asarray(lists.is_valid()), np.diff(ends), 0)
            rows: list[tuple] = [(None,) * 6] * len(lists)
            for width in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == width)
                x = values[ends[at][:, None] + np.arange(width)]
                fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
                at, x = at[fine], x[fine] + 0.0  # -0.0 as 0.0
                if not len(at):
                    continue
                h = mix(x.view(np.uint64) + mix(np.arange(width, dtype=np.uint64)))
                k1, k2 = (mix(k + np.uint64(width)).view(np.int64).tolist() for k in (h.sum(axis=1, dtype=np.uint64), mix(h + np.uint64(11)).sum(axis=1, dtype=np.uint64)))
                q, scale, eps = quantised(_units(x))
                for i, *row in zip(at.tolist(), k1, k2, map(bytes, x), map(bytes, q), scale.tolist(), eps.tolist()):
                    rows[i] = tuple(row)
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, list(_PROFILE)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], schema=_PROFILE)
        shared.give_back()

    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    found, found_path = shared.stash(found.mapInArrow(profile, _PROFILE_DDL), "vectors")
    firsts = (F.first(c).alias(c) for c in ("vec", "q", "scale", "eps"))
    classes = found.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("weight"), *firsts)
    classes, _ = shared.stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    groups = max(1, -(-classes.count() // GROUP))
    dealt = classes.select("node", "weight", "q", "scale", "eps", F.expr(f"cast(pmod(xxhash64(node), {groups}) as int)").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "weight", "q", "scale", "eps")
    out = pa.schema([("x", pa.int32()), ("y", pa.int32()), ("own", pa.int32()), ("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64()), ("open", pa.bool_())])

    def tile(exact: bool):
        def run(t: pa.Table) -> pa.Table:
            links, other, left = _tile(t, threshold, exact)
            t = t.select(["x", "y", "own", "node"])
            for name, values in (("other", other), ("links", links), ("open", left)):
                t = t.append_column(name, pa.array(values))
            return t.filter(pa.array((links > 0) | left)).cast(out)

        return run

    def tiles(rows: DataFrame):
        """By tile, dealt to a number of tasks of their own: tiles are few bytes and much work, so tasks must not be merged by size."""
        return rows.repartition(shared.buckets(spark), "x", "y").groupBy("x", "y")

    ddl = "x int, y int, own int, node long, other long, links long, open boolean"
    sure, _ = shared.stash(tiles(dealt).applyInArrow(tile(False), ddl), "links")
    left = sure.where("open").select("x", "y", "own", "node").join(classes.select("node", "weight", "vec", "q", "scale", "eps"), "node")
    more, _ = shared.stash(tiles(left).applyInArrow(tile(True), ddl), "links")
    links = sure.unionByName(more).where("links > 0")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("u"), F.col("other").alias("v")))
    rooted = classes.select("k1", "k2", "node", "least", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(lowest, "root").join(counts, "node", "left")
    rooted = rooted.select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    component = F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out_rows = found.select("id", "k1", "k2").join(rooted, ["k1", "k2"], "left")
    return out_rows.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op7_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(shared.table(spark, sf_dir, "embeddings"))
