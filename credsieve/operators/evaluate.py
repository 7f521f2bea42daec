"""Accuracy against ground truth: tolerant matching, metrics, error clusters, and training tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import any_of
from . import paths


def candidate_pairs(left: DataFrame, right: DataFrame, tolerance: int = 1) -> DataFrame:
    """Pairs of the same file whose lines differ by `tolerance` at most: an equi-join on file and line band."""
    band = F.floor(F.col("line") / (tolerance + 1))
    a = left.select(F.col("file"), F.col("line").alias("l_line"), F.col("kind").alias("l_kind"), F.explode(F.sequence(F.floor((F.col("line") - tolerance) / (tolerance + 1)), F.floor((F.col("line") + tolerance) / (tolerance + 1)))).alias("band"))
    b = right.select("file", F.col("line").alias("r_line"), F.col("kind").alias("r_kind"), band.alias("band"))
    return a.join(b, ["file", "band"]).where(F.abs(F.col("l_line") - F.col("r_line")) <= tolerance).drop("band").withColumn("distance", F.abs(F.col("l_line") - F.col("r_line")))


def greedy_match(left: DataFrame, right: DataFrame, tolerance: int = 1) -> DataFrame:
    """(file, side: both, left or right, l_line, l_kind, r_line, r_kind): each left row, in order of line and kind, takes the
    nearest right row of its file that is free. Findings of one file are few, so a file is one group."""
    both = left.select("file", "line", "kind", F.lit(0).alias("side")).unionByName(right.select("file", "line", "kind", F.lit(1).alias("side")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["side"], pdf["line"], pdf["kind"]))
        free = [(n, k) for s, n, k in rows if s == 1]
        name, out = pdf["file"].iloc[0], []
        for s, n, k in rows:
            if s == 0:
                near = min(((abs(n - m), m, j) for m, j in free if abs(n - m) <= tolerance), default=None)
                if near:
                    free.remove(near[1:])
                out.append((name, "both", n, k, near[1], near[2]) if near else (name, "left", n, k, None, None))
        out += [(name, "right", None, None, m, j) for m, j in free]
        return pd.DataFrame(out, columns=["file", "side", "l_line", "l_kind", "r_line", "r_kind"])

    return both.groupBy("file").applyInPandas(run, "file string, side string, l_line long, l_kind string, r_line long, r_kind string")


def metrics(matched: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of greedy_match(predictions, truth)."""
    c = matched.agg(F.count_if(F.col("side") == "both").alias("tp"), F.count_if(F.col("side") == "left").alias("fp"), F.count_if(F.col("side") == "right").alias("fn"))
    return with_scores(c)


def with_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 6))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def error_clusters(errors: DataFrame, top: int = 10) -> DataFrame:
    """The `top` most frequent of rule family, extension and place of the path. errors: (file, kind)."""
    g = errors.groupBy(paths.rule_family(F.col("kind")).alias("family"), paths.extension_bucket(F.col("file")).alias("extension"), paths.path_context(F.col("file")).alias("context")).agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), "family", "extension", "context").limit(top)


def compare_tools(left: DataFrame, right: DataFrame, tolerance: int = 1) -> DataFrame:
    """How many findings two tools share, and how many only one has."""
    return greedy_match(left, right, tolerance).agg(F.count_if(F.col("side") == "both").alias("shared"), F.count_if(F.col("side") == "left").alias("only_left"), F.count_if(F.col("side") == "right").alias("only_right"))


def truth_from_csv(rows: DataFrame) -> DataFrame:
    """Rows marked T of a metadata table, with any of the usual column names."""
    pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in rows.columns))
    return rows.where(F.col("GroundTruth") == "T").select(pick("FilePath", "file").alias("file"), pick("LineStart", "line").cast("long").alias("line"), F.coalesce(pick("Category", "kind"), F.lit("unknown")).alias("kind"))


def normal_path(path):
    """The part of a path below the data set's data folder, if it has one."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    return F.regexp_replace(p, r"(?i)^.*?(?:\./|creddata/|^)data/", "")


# The 64 characters of the model, in the order of their codes.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"


def trigram_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(trigram, n) over the 64 characters of the model; others are passed over.

    A task counts in a table of 64 ** 3 numbers, so no trigram leaves it more than once.
    """
    codes = np.full(256, 64, np.uint8)
    codes[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64**3, np.int64)
        for batch in batches:
            raw = batch.column(0).fill_null("").cast(pa.large_string())
            at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            found = codes[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
            place = np.flatnonzero(found < 64)
            c = found[place].astype(np.int32)
            # Each text's first kept character; a trigram must end before the next text's.
            after = np.searchsorted(place, at[1:] - at[0])
            whole = np.ones(max(len(c) - 2, 0), bool)
            for back in (1, 2):
                crossing = after - back
                whole[crossing[(crossing >= 0) & (crossing < len(whole))]] = False
            if len(whole):
                total += np.bincount((c[:-2] * 4096 + c[1:-1] * 64 + c[2:])[whole], minlength=64**3)
        some = np.flatnonzero(total)
        names = ["".join(ALPHABET[i >> s & 63] for s in (12, 6, 0)) for i in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total[some])], names=["trigram", "n"])

    return texts.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "trigram string, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def trigram_table(texts: DataFrame, text_col: str, k: float = 0.01) -> DataFrame:
    """(trigram, n, log2p) for all 64 ** 3 trigrams, seen or not: log2 probabilities with Laplace smoothing given the first two
    characters, kept within -20 and -1."""
    spark = texts.sparkSession
    letter = lambda i: F.substring(F.lit(ALPHABET), (F.floor(i) % 64 + 1).cast("int"), F.lit(1))
    i = F.col("id")
    grid = spark.range(64**3).select(F.concat(letter(i / 4096), letter(i / 64), letter(i)).alias("trigram"))
    # At most 64 ** 3 rows are on either side.
    c = grid.join(F.broadcast(trigram_counts(texts, text_col)), "trigram", "left").select("trigram", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.substring("trigram", 1, 2)))
    return c.select("trigram", "n", F.round(F.least(F.greatest(F.log2((F.col("n") + k) / (total + k * 64)), F.lit(-20.0)), F.lit(-1.0)), 6).alias("log2p"))


def split_samples(samples: DataFrame, seed: int = 7, most: int = 512) -> dict[str, DataFrame]:
    """Training, validation and test parts of 80, 10 and 10 %, by a hash of the text, so that copies stay together."""
    cut = samples.withColumn("text", F.substring("text", 1, most))
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(100))
    return {"train": cut.where(draw < 80), "validation": cut.where((draw >= 80) & (draw < 90)), "test": cut.where(draw >= 90)}


def looks_toxic(text):
    # Words of the demonstration's predictor.
    return any_of(F.lower(text), ["idiot", "stupid", "worthless", "pathetic"])
