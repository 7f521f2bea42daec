"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are the letters, pairs and triples of a word with its blanks, lower case, hashed to 65,535 buckets; the term
frequency is the share of a text's n-grams, the document frequency is counted over all training documents. Weights are
learned by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded sample, then a temperature
is fitted on a part of the sample that training has not seen, so that scores are calibrated probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import slices

BUCKETS = 1 << 16
UNKNOWN = "und"
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Training:
    """per_language: expected number of sampled texts of each language; their n-gram counts go to the driver."""

    per_language: int = 400
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.002
    held_back: float = 0.2


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each character (three rows; 0: none) and the first character of each text.

    A text begins with the blank before it. N-grams do not reach over a blank, so none reaches into the next text.
    """
    lower = [(t or "").lower() for t in texts]
    chars = np.frombuffer(("\n" + "\n".join(lower) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])
    word = _is_letter()[chars]
    c = np.where(word, chars, np.uint32(32))
    n = int(at[-1])
    a, b, d = c[:n], c[1 : n + 1], c[2 : n + 2]
    wa, wb = word[:n], word[1 : n + 1]
    one = a * np.uint32(0x9E3779B1)
    two = (one ^ b) * np.uint32(0x85EBCA77)
    three = ((two ^ (two >> np.uint32(15))) + d) * np.uint32(0xC2B2AE3D)
    out = np.empty((3, n), np.uint16)
    for k, (h, fine) in enumerate(((one, wa), (two, wa | wb), (three, wb))):
        bucket = (((h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.uint16)
        out[k] = np.where(fine, np.maximum(bucket, 1), 0)
    return out, at


def _counts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(rows.ravel(), minlength=BUCKETS)
    count[0] = 0
    at = np.flatnonzero(count)
    return at.astype(np.int32), count[at].astype(np.int32)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Of each bucket, over all texts (a column text); a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, z in slices(batch, 0):
                rows, at = grams(batch.column(0).slice(a, z - a).to_pylist())
                for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                    seen = np.zeros(BUCKETS, bool)
                    seen[rows[:, s:e]] = True
                    total[seen] += 1
        shared.give_back()
        total[0] = 0
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: weight times inverse document frequency
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, and whether it has letters."""
        rows, at = grams(texts)
        total = np.add.reduceat((rows != 0).sum(axis=0, dtype=np.int64), at[:-1])
        out = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            w = np.ascontiguousarray(self.table[:, k])
            out[:, k] = np.add.reduceat(w[rows[0]] + w[rows[1]] + w[rows[2]], at[:-1], dtype=np.float64)
        return out / np.maximum(total, 1)[:, None] + self.bias, total > 0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn(samples: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, how: Training) -> Model:
    """samples: (language, buckets, counts), in an order that is no order of languages."""
    languages = sorted({s[0] for s in samples})
    kinds = {name: k for k, name in enumerate(languages)}
    n_kinds = len(languages)
    z, n = np.zeros((BUCKETS + 1, n_kinds)), np.zeros((BUCKETS + 1, n_kinds))  # the last row is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        v = z[at]
        flat = np.sign(v) * np.maximum(np.abs(v) - how.l1, 0)
        return -flat / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)

    ready = []
    for name, at, count in samples:
        x = count / max(1, count.sum()) * idf[at]
        ready.append((kinds[name], np.append(at, BUCKETS), np.append(x, 1.0)))
    back = [s for k, s in enumerate(ready) if k % max(2, round(1 / how.held_back)) == 1]
    front = [s for k, s in enumerate(ready) if k % max(2, round(1 / how.held_back)) != 1]
    for _ in range(how.epochs):
        for kind, at, x in front:
            w = weights(at)
            g = _softmax(x @ w)
            g[kind] -= 1
            g = x[:, None] * g
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / how.alpha * w
    table = weights(np.arange(BUCKETS + 1))
    temperature, best = 1.0, math.inf
    if back:
        logits = np.stack([x @ table[at] for _, at, x in back])
        right = np.array([s[0] for s in back])
        for t in np.geomspace(0.05, 20, 121):
            loss = -np.log(_softmax(logits / t)[np.arange(len(right)), right] + 1e-300).mean()
            if loss < best - 1e-12:
                temperature, best = float(t), loss
    return Model(languages, (table[:-1] * idf[:, None]).astype(np.float32), table[-1], temperature)


def _remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(docs: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows whose id's CRC-32 is no multiple of 5 and whose id, text and language aren't null.

    Empty texts and very long ones count like all others; rows that repeat count each. No rows give a model of no language.
    """
    shared.small_batches(docs.sparkSession)
    rows = docs.where((_remainder(id_col) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    df = document_frequencies(rows.select("text"))
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1
    share = F.coalesce(*(F.when(F.col("lang") == name, F.lit(min(1.0, how.per_language / n))) for name, n in sizes.items()))
    draw = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1_000_000)) / 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang, order in zip(*(c.to_pylist() for c in batch.columns)):
                at, count = _counts(grams([text])[0])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([order]), pa.array([at.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], names=["lang", "ord", "places", "counts"])
        shared.give_back()

    chosen = rows.where(draw < share).select("text", "lang", F.xxhash64("id", F.lit("order")).alias("ord"))
    got = chosen.mapInArrow(run, "lang string, ord long, places binary, counts binary").collect()
    got = sorted(got, key=lambda r: (r.ord, r.lang, bytes(r.places)))
    return learn([(r.lang, np.frombuffer(r.places, np.int32), np.frombuffer(r.counts, np.int32)) for r in got], idf, how)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with columns lang_pred (a language of the model, or und) and score (its calibrated probability, 0 for und).

    und is what is said of texts that are null or without letters, and of all texts if the model knows no language. Ties
    go to the first language in order. Very long texts are read whole, a few MB of texts or one text at a time. Rows that repeat
    get the same answer each; an empty table gives no rows. All columns and rows of docs stay; columns named lang_pred or score,
    in any case of their letters, are replaced.
    """
    shared.small_batches(docs.sparkSession)
    names = shared.without(docs.columns, "lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_at = shared.place(names, text_col)
    typed = docs.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in batches:
            for a, z in slices(batch, text_at):
                rows = batch.slice(a, z - a)
                if m.languages:
                    logits, some = m.logits(rows.column(text_at).to_pylist())
                    chance = _softmax(logits / m.temperature)
                    best = chance.argmax(axis=1)
                    said = np.where(some, np.array(m.languages, dtype=object)[best], UNKNOWN)
                    score = np.where(some, np.clip(chance[np.arange(len(best)), best], 0, 1), 0.0)
                else:
                    said, score = np.full(z - a, UNKNOWN, dtype=object), np.zeros(z - a)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-2], pa.array(said.tolist(), pa.string()), pa.array(score)], names=rows.schema.names)
        shared.give_back()

    return typed.mapInArrow(run, typed.schema)


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    model = train(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
