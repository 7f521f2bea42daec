"""BPE encoding and decoding with a table of distinct words.

Texts are split into pre-tokens in blocks of a few MB. A block writes its texts as places in its list of distinct words, and
sends each of these words once to the bucket that owns the word (a hash decides). A bucket encodes every distinct word once,
whatever number of blocks hold it, and answers with ids. Blocks join the ids back by position and decode by a join of the
ids with the vocabulary's id-to-piece table, whose size is that of the vocabulary. A word as frequent as `the` travels once
per block, so no word is hot. Texts themselves are shuffled once at most, as places; blocks, buckets and what a worker
remembers of words are bounded.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of text in a block, or one text. A larger block names fewer words twice; a worker holds one at a time.
BLOCK_BYTES = 16 << 20
#: Words that a bucket remembers the ids of, some 100 bytes each. Beyond that it forgets them and encodes a word again that
#: comes again; results are the same. More shuffle partitions make more buckets.
MOST_WORDS = 400_000
#: Characters of a text that are split at a time, and words that are encoded at a time.
_SPLIT, _ENCODE = 1 << 20, 1 << 14

# The contraction endings that the public word-level pattern splits off, and that pattern in whole.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Texts of these characters alone are in NFC, have one-to-one lower case and the same classes in Python's re as in the tokenizers library.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e¡-±´-¸º»¿-įĲ-ſ–—‘’“”…€]*")
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

# Where a long text may be cut without a change of its words: between a blank and a letter.
_CUT = re.compile(r" (?=[a-zA-Z])")

_loaded: dict[str, Splitter] = {}


class Splitter:
    """A tokenizer file: its pre-tokens, its ids and its pieces."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("added tokens must be matched as they stand")
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.plain = bool(steps) and steps[0].get("pattern", {}).get("Regex") == WORD_PATTERN and kinds == ["NFC", "Replace", "Lowercase"]
        self.joined = spec.get("decoder") is None
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.pieces = np.array([self.lib.id_to_token(i) or "" for i in range(size)], dtype=object)
        self.wide = np.uint16 if size <= 1 << 16 else np.uint32

    def words(self, text: str) -> list[str]:
        if self.plain and "<|" not in text and _PLAIN.fullmatch(text):
            return _PLAIN_WORD.findall(text.lower())
        out: list[str] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(part)
            elif part:
                norm = self.lib.normalizer.normalize_str(part) if self.lib.normalizer else part
                out += [norm[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    def parts(self, text: str) -> Iterator[list[str]]:
        """words(), some of them at a time."""
        a = 0
        while len(text) - a > _SPLIT and (cut := _CUT.search(text, a + _SPLIT)):
            yield self.words(text[a : cut.end()])
            a = cut.end()
        yield self.words(text[a:] if a else text)

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch(words, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.pieces[ids].tolist()) if self.joined else self.lib.decode(ids.tolist(), skip_special_tokens=False)


def splitter(path: str) -> Splitter:
    if path not in _loaded:
        _loaded[path] = Splitter(path)
    return _loaded[path]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    body = b"".join([np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes(), *parts])
    return np.int64(len(body)).tobytes() + pa.Codec("zstd", compression_level=6).compress(body, asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, which compress better than whole numbers: ranks of frequent words differ in the low byte only."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _unpack(blob: bytes) -> list[bytes]:
    body = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(body[:8], np.int64)[0])
    at, out = 8 + 8 * n, []
    for size in np.frombuffer(body[8 : 8 + 8 * n], np.int64):
        out.append(body[at : at + int(size)])
        at += int(size)
    return out


_SPLIT_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("texts", pa.binary())])
_FLOW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
_FLOW_DDL = "bucket int, block long, payload binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Rows in order, cut after every BLOCK_BYTES of text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
        for i, text, n in zip(batch.column(0).to_pylist(), batch.column(1), sizes):
            ids.append(i)
            texts.append(text.as_py() or "")
            size += n
            if size >= BLOCK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, ids array<int>, decoded string), one for each row of docs, as the tokenizers library encodes the
    whole text (no special tokens added) and decodes the ids (none skipped).

    Null and empty texts give no ids and an empty string; an empty table gives no rows. Rows that repeat give as many rows; a
    null id stays null. Very long texts are whole, in a block of their own, split and encoded some of their words at a time.
    Equal words have equal ids, so there are no ties. id_col must be integral; other columns are ignored, whatever their
    names. The order of rows is not kept. The split texts are written to the shared folder, so that blocks stay the same when an
    executor is lost.
    """
    spark = docs.sparkSession
    n_buckets = shared.buckets(spark, 16)
    shared.small_batches(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, task = splitter(tokenizer_path), TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(_blocks(batches)):
            block = (task << 32) + k
            place: dict[str, int] = defaultdict()
            place.default_factory = place.__len__
            lens, codes = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)]
            for n, text in enumerate(texts):
                for found in tok.parts(text):
                    codes.append(np.fromiter(map(place.__getitem__, found), np.uint32, len(found)))
                    lens[n] += len(found)
            own: list[list[str]] = [[] for _ in range(n_buckets)]
            for w in sorted(place):
                own[zlib.crc32(w.encode()) % n_buckets].append(w)
            # Codes follow the order in which answers come back: bucket by bucket, sorted within.
            order = np.zeros(len(place), np.uint32)
            order[[place[w] for ws in own for w in ws]] = np.arange(len(place), dtype=np.uint32)
            coded = order[np.concatenate(codes)]
            # The most frequent words get the smallest numbers, which compress best.
            count = np.bincount(coded, minlength=len(place))
            by_use = np.argsort(-count, kind="stable")
            rank = np.empty(len(place), np.uint32)
            rank[by_use] = np.arange(len(place))
            known = np.array([i is not None for i in ids], dtype=np.uint8)
            rows = [(-1, block, None, _pack(np.array([i or 0 for i in ids], np.int64), known, lens, _planes(rank[coded]), _planes(by_use)))]
            for b, ws in enumerate(own):
                if ws:
                    raw = [w.encode() for w in ws]
                    rows.append((b, block, _pack(np.array(list(map(len, raw)), np.uint32), b"".join(raw)), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _SPLIT_ROWS)], schema=_SPLIT_ROWS)
            del place, codes, order, coded, count, by_use, rank, rows, own, texts, ids
        shared.give_back()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, bucket = splitter(tokenizer_path), None
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for b, block, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket or len(known) > MOST_WORDS:
                    known, bucket = {}, b
                sizes, raw = _unpack(payload)
                ends = np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
                words = [raw[a:z] for a, z in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                for a in range(0, len(new), _ENCODE):
                    some = new[a : a + _ENCODE]
                    known.update((w, np.array(i, tok.wide).tobytes()) for w, i in zip(some, tok.ids([w.decode() for w in some])))
                got = [known[w] for w in words]
                lens = np.array(list(map(len, got)), np.uint32) // np.dtype(tok.wide).itemsize
                row = [[b], [block], [_pack(_planes(lens), b"".join(got))]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _FLOW)], schema=_FLOW)
        known = {}
        shared.give_back()

    out_schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = splitter(tokenizer_path)
        block, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            doc_ids, known, lens, codes, by_use = _unpack(held.pop(-1))
            by_use, codes, lens = _unplaned(by_use), _unplaned(codes), np.frombuffer(lens, np.int64)
            answers = [_unpack(held.pop(p)) for p in sorted(held)]
            sizes = np.concatenate([_unplaned(a[0]) for a in answers] or [np.zeros(0, np.uint32)]).astype(np.int64)
            flat = np.concatenate([np.frombuffer(a[1], tok.wide) for a in answers] or [np.zeros(0, tok.wide)])
            starts = np.cumsum(sizes) - sizes
            ends, doc_ids = np.cumsum(lens), pa.array(np.frombuffer(doc_ids, np.int64), mask=np.frombuffer(known, np.uint8) == 0)
            n, a = len(lens), 0
            while a < n:  # some MB of words at a time
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 18))))
                low = int(ends[a - 1]) if a else 0
                word = by_use[codes[low : int(ends[z - 1])]]
                each = sizes[word]
                upto = np.cumsum(each)
                ids = flat[np.repeat(starts[word] - (upto - each), each) + np.arange(int(upto[-1]) if len(upto) else 0)]
                cut = np.concatenate([[0], upto])[np.concatenate([[0], ends[a:z] - low])]
                texts = [tok.decode(ids[x:y]) for x, y in zip(cut[:-1], cut[1:])]
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, z - a), lists, pa.array(texts, pa.string())], schema=out_schema)
                a = z

        for batch in batches:
            for part, b, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block and held:
                    yield from done()
                    held = {}
                block = b
                held[part] = payload
        if held:
            yield from done()
        held = {}
        shared.give_back()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    flow, _ = shared.stash(texts.mapInArrow(split, "bucket int, block long, words binary, texts binary"), "blocks")
    asked = flow.where("bucket >= 0").select("bucket", "block", F.col("words").alias("payload"))
    answered = asked.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(encode, _FLOW_DDL)
    placed = flow.where("bucket < 0").select("bucket", "block", F.col("texts").alias("payload"))
    whole = answered.unionByName(placed).repartition(n_buckets, "block").sortWithinPartitions("block").mapInArrow(assemble, "id long, ids array<int>, decoded string")
    return whole.withColumnRenamed("id", id_col)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """The query: digests of the operator's ids and decoded texts."""
    import public_tokenizers

    found = bpe_encode_decode(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
