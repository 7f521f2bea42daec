"""Entropy gate, proximity and three-stream decomposition, in the two variants of the pipeline.

A fragment is a row with an id, a path and its text or bytes. Both gates are conjunctive, so scan() tests proximity, which
is substring search in generated code, before it counts bytes; survivors are the same and far fewer bytes reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entropy import shannon_entropy, window_entropies

CHUNK, THRESHOLD, PROXIMITY, WIDEN, LEAST = 64, 3.5, 0.15, 96, 8

# Needles of the engine variant with weight and pattern, in order; a later needle wins a tie.
ENGINE_NEEDLES = [
    ("Authorization: Bearer ", 0.35, "HeaderValue"), ("Authorization: Token ", 0.35, "HeaderValue"), ("Bearer ", 0.28, "HeaderValue"),
    ("export ", 0.25, "Export"), ("ENV ", 0.20, "DockerEnv"), ("ARG ", 0.15, "DockerEnv"), ("Set ", 0.18, "EnvVar"),
    ("default = ", 0.22, "TerraformVar"), ("valueFrom:", 0.20, "K8sSecret"), ("stringData:", 0.20, "K8sSecret"),
    ('= "', 0.25, "Assignment"), ('="', 0.25, "Assignment"), ("= '", 0.25, "Assignment"), ("='", 0.25, "Assignment"),
    (': "', 0.22, "JsonKey"), (": '", 0.22, "YamlKey"), (":=", 0.18, "Assignment"), ("= ", 0.18, "Assignment"), (": ", 0.18, "JsonKey"),
]
# Keywords of the engine variant and the weights of the weak ones and the others.
ENGINE_KEYWORDS = ["apiKey", "api_key", "secret", "password", "passwd", "token", "credentials", "private_key", "access_key", "auth_token", "client_secret", "client_id", "oauth", "credential", "signing", "consumer", "session", "cookie", "refresh", "bearer", "key"]
WEAK, WEAK_WEIGHT, KEYWORD_WEIGHT, PEM, PEM_WEIGHT = {"key", "apiKey", "api_key"}, 0.08, 0.14, "-----BEGIN ", 0.24

# Needles of the stage variant, the first of the heaviest wins; those of letters and blanks match in any case.
STAGE_NEEDLES = [
    ('= "', 0.35, "Assignment"), ("='", 0.30, "Assignment"), ("= '", 0.30, "Assignment"), (': "', 0.25, "JsonKey"), (": '", 0.25, "YamlKey"),
    ("export ", 0.25, "Export"), ("ENV ", 0.20, "DockerEnv"), ("Bearer ", 0.30, "HeaderValue"), ("ARG ", 0.15, "DockerEnv"), ("= ", 0.20, "Assignment"), (": ", 0.20, "JsonKey"),
]
STAGE_KEYWORDS, STAGE_KEYWORD_WEIGHT, STAGE_CONTEXT = ["password", "secret", "token", "key", "api", "auth", "credential", "access", "private"], 0.20, 256

# Identifier scores of stream A, first hit in this order.
STREAM_A = [("password", 0.90), ("passwd", 0.90), ("secret", 0.90), ("credential", 0.80), ("token", 0.80), ("private", 0.70), ("key", 0.70), ("api", 0.60), ("auth", 0.60), ("access", 0.55)]


def window_count(n: Column, chunk: int = CHUNK, variant: str = "engine") -> Column:
    """Windows of a fragment of n bytes."""
    if variant == "engine":
        return F.when(n > chunk, F.floor((n - chunk) / (chunk // 2)) + 1).otherwise(1)
    if variant == "chunks":
        return F.ceil(n / chunk)
    stride = max(chunk // 2, 1)
    return F.when(n < LEAST, 0).when(n <= chunk, 1).otherwise(F.ceil((n - chunk) / stride) + 1)


def _counts(n: np.ndarray, chunk: int, variant: str) -> np.ndarray:
    """window_count() of many fragments."""
    if variant == "engine":
        return np.where(n > chunk, (n - chunk) // (chunk // 2) + 1, 1)
    if variant == "chunks":
        return -(-n // chunk)
    stride = max(chunk // 2, 1)
    return np.where(n < LEAST, 0, np.where(n <= chunk, 1, -(-(n - chunk) // stride) + 1))


def entropy_summary(fragments: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK, threshold: float = THRESHOLD, variant: str = "engine") -> DataFrame:
    """(id, n_windows, n_candidates, max_entropy) for each fragment; windows of a whole batch are counted at once and never leave
    the worker."""
    schema = pa.schema([(id_col, pa.int64()), ("n_windows", pa.int64()), ("n_candidates", pa.int64()), ("max_entropy", pa.float64())])
    stride = chunk if variant == "chunks" else max(chunk // 2, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).fill_null(b"").cast(pa.large_binary())
            at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data, at = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]
            count = _counts(np.diff(at), chunk, variant)
            upto = np.cumsum(count)
            nth = np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - count, count)
            e = window_entropies(data, np.repeat(at[:-1], count) + nth * stride, np.repeat(at[1:], count), chunk, variant == "chunks").round(9)
            found = np.concatenate([[0], np.cumsum(e > threshold if variant == "stage" else e >= threshold)])
            some = count > 0
            most = np.zeros(len(count))
            if some.any():
                most[some] = np.maximum.reduceat(e, (upto - count)[some])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(found[upto] - found[upto - count], pa.int64()), pa.array(most)], schema=schema)

    src = fragments.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("raw"))
    return src.mapInArrow(run, f"{id_col} long, n_windows long, n_candidates long, max_entropy double")


def windows(fragments: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK, variant: str = "engine") -> DataFrame:
    """One row per window: (id, offset, length, core: the window, raw: what the next stage sees).

    The engine variant widens raw by 96 bytes on either side, and offset and length are those of raw.
    """
    content = F.col(text_col).cast("binary")
    n = F.octet_length(content).cast("long")
    stride = chunk if variant == "chunks" else max(chunk // 2, 1)
    widen = WIDEN if variant == "engine" else 0

    def one(i: Column) -> Column:
        start = i * stride
        size = F.least(F.lit(chunk).cast("long"), n - start)
        low, high = F.greatest(start - widen, F.lit(0).cast("long")), F.least(start + size + widen, n)
        cut = lambda a, z: F.substring(content, (a + 1).cast("int"), (z - a).cast("int"))
        return F.struct(low.alias("offset"), (high - low).alias("length"), cut(start, start + size).alias("core"), cut(low, high).alias("raw"))

    count = window_count(n, chunk, variant).cast("long")
    # Built within the generator, so that what follows reads a window and not the fragment again.
    found = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), one))
    return fragments.select(F.col(id_col).alias(id_col), F.inline(found))


def proximity_engine(context: Column) -> Column:
    """Sum of the weights of what stands in the context, 1 at most."""
    total = F.lit(0.0)
    for needle, w, _ in ENGINE_NEEDLES:
        total = total + F.when(context.contains(needle), w).otherwise(0.0)
    for k in ENGINE_KEYWORDS:
        total = total + F.when(context.contains(k), WEAK_WEIGHT if k in WEAK else KEYWORD_WEIGHT).otherwise(0.0)
    total = total + F.when(context.contains(PEM), PEM_WEIGHT).otherwise(0.0)
    return F.least(F.round(total, 6), F.lit(1.0))


def pattern_engine(context: Column) -> Column:
    out = F.lit("Unknown")
    # Heaviest first; of equals, the last in the list.
    for needle, _, name in sorted(((n, w, p) for n, w, p in ENGINE_NEEDLES), key=lambda x: x[1]):
        out = F.when(context.contains(needle), name).otherwise(out)
    return out


def _stage_contains(context: Column, needle: str) -> Column:
    return F.lower(context).contains(needle.lower()) if needle.replace(" ", "").isalpha() else context.contains(needle)


def proximity_stage(context: Column) -> Column:
    total = F.lit(0.0)
    for needle, w, _ in STAGE_NEEDLES:
        total = total + F.when(_stage_contains(context, needle), w).otherwise(0.0)
    return F.round(total + F.regexp_count(F.lower(context), F.lit("|".join(STAGE_KEYWORDS))) * STAGE_KEYWORD_WEIGHT, 6)


def pattern_stage(context: Column) -> Column:
    out = F.lit("Unknown")
    order = sorted(range(len(STAGE_NEEDLES)), key=lambda i: (STAGE_NEEDLES[i][1], -i))
    for i in order:
        out = F.when(_stage_contains(context, STAGE_NEEDLES[i][0]), STAGE_NEEDLES[i][2]).otherwise(out)
    return out


def proximity_gpu(context: Column) -> Column:
    """Share of ten needles that stand in the context."""
    # Ten needles of the coarse variant.
    needles = ["apiKey", "api_key", "secret", "password", "token", "key", "credentials", '= "', "='", '="']
    total = F.lit(0)
    for n in needles:
        total = total + F.when(context.contains(n), 1).otherwise(0)
    return total / 10


def identifiers(context: Column) -> Column:
    return F.filter(F.regexp_extract_all(context, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda x: F.length(x) >= 2)


def literals(context: Column) -> Column:
    """Quoted strings (an open quote swallows the rest), then runs of 20 or more of the base64 alphabet."""
    quoted = F.regexp_extract_all(context, F.lit(r"""(?s)"[^"]*(?:"|\z)|'[^']*(?:'|\z)"""), F.lit(0))
    closed = F.filter(quoted, lambda q: (F.length(q) > 2) & (F.substring(q, 1, 1) == F.substring(q, -1, 1)))
    inner = F.transform(closed, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    return F.concat(inner, F.regexp_extract_all(context, F.lit("[A-Za-z0-9+/=]{20,}"), F.lit(0)))


def structure(context: Column) -> Column:
    n = F.octet_length(context)
    marks = n - F.octet_length(F.translate(context, "{}[]:=;,(", ""))
    return F.when(n == 0, 0.0).otherwise(F.least(marks / n, F.lit(1.0)))


def combined_engine(proximity: Column, structured: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * proximity + 0.5 * structured)


def stream_a(context: Column) -> Column:
    tokens = F.filter(F.regexp_extract_all(F.lower(context), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)), lambda t: F.length(t) >= 3)

    def score(t: Column) -> Column:
        out = F.lit(0.0)
        for word, w in reversed(STREAM_A):
            out = F.when(t.contains(word), w).otherwise(out)
        return out

    return F.coalesce(F.array_max(F.transform(tokens, score)), F.lit(0.0))


def stream_b(literal: Column) -> Column:
    """By the shape of the value: JWT, UUID, hexadecimal, base64, with special characters, other."""
    n = F.length(literal)
    share = lambda cls: (n - F.length(F.regexp_replace(literal, f"[{cls}]", ""))) / n
    jwt = literal.rlike(r"^[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+$")
    uuid = literal.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")
    b64, special = share("A-Za-z0-9+/=_-"), 1 - share("A-Za-z0-9")
    return F.when(n == 0, 0.0).when(jwt, 0.95).when(uuid, 0.65).when(share("0-9A-Fa-f") >= 0.95, 0.70).when(b64 >= 0.95, 0.75).when((special > 0.05) & (b64 < 1), 0.85).otherwise(0.60)


def stream_c(context: Column) -> Column:
    mark = lambda cond, w: F.when(cond, w).otherwise(0.0)
    total = mark(context.contains('"') | context.contains("'"), 0.30) + mark(context.contains("="), 0.20) + mark(context.contains(":"), 0.15) + mark(context.contains("export"), 0.30)
    return F.least(F.round(total, 6), F.lit(1.0))


def fuse_streams(a: Column, b: Column, c: Column) -> Column:
    return F.least(F.round(0.35 * a + 0.45 * b + 0.20 * c, 6), F.lit(1.0))


def scan(fragments: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, proximity: float = PROXIMITY) -> DataFrame:
    """Windows that pass both gates of the engine variant, with their streams.

    A window's proximity is at most that of its whole fragment, so fragments below the threshold are passed over at once.
    """
    found = windows(fragments.where(proximity_engine(F.col(text_col)) >= proximity), id_col, text_col).withColumn("context", F.make_valid_utf8(F.col("raw").cast("string")))
    found = found.withColumn("proximity", proximity_engine(F.col("context"))).where(F.col("proximity") >= proximity)
    found = found.withColumn("entropy", F.round(shannon_entropy("core"), 9)).where(F.col("entropy") >= threshold)
    found = found.withColumn("pattern", pattern_engine(F.col("context"))).withColumn("structure", structure(F.col("context")))
    return found.withColumn("identifiers", identifiers(F.col("context"))).withColumn("literals", literals(F.col("context"))).withColumn("combined", combined_engine(F.col("proximity"), F.col("structure"))).drop("core", "raw")
