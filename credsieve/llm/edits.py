"""Token counts that follow edits: a segment tree of pre-tokens for each document, kept as a table.

token_trees() splits and counts whole texts once; a row holds the text, how long each pre-token is, how many tokens it has, and
how many pre-tokens each leaf holds. edit_trees() takes such rows with edits and returns rows of the same kind, so a table of
trees can be kept and edited again and again. Leaves hold pre-tokens with their counts, split and merge as they grow and
shrink; inner nodes hold sums of characters and tokens. An edit finds its place by descending the character sums. Pre-tokens
are split anew from two before the place (no alternative of the pattern looks further ahead than the blanks after it and one
more character), until a new boundary falls on an old one behind the edit; from there on the text and so its pre-tokens are
the old ones. Only these are encoded again, and only the leaves that hold them and their ancestors get new sums.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import slices

LEAF = 64
_KNOWN_AT_MOST = 200_000
_loaded: dict[str, Counter] = {}


class Counter:
    """Tokens of pre-tokens, from a file of ranks and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        """Tokens of a pre-token. What short ones have is remembered, up to a bound."""
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= _KNOWN_AT_MOST:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n


def counter(path: str, pattern: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path, pattern)
    return _loaded[path]


def _leaf_sizes(n: int) -> list[int]:
    """Of n pre-tokens that nothing has edited yet."""
    return [LEAF] * (n // LEAF) + [n % LEAF]


class TokenTree:
    """pieces: pre-tokens; counts: their tokens; sizes: how many of them each leaf holds. encoded: how many pre-tokens had
    their tokens counted by edits."""

    def __init__(self, pieces: list[str], counts: list[int], tool: Counter, sizes: list[int] | None = None):
        self.tool, self.encoded = tool, 0
        self.leaves: list[list[str]] = []
        self.counts: list[list[int]] = []
        a = 0
        for n in sizes if sizes is not None else _leaf_sizes(len(pieces)):
            self.leaves.append(pieces[a : a + n])
            self.counts.append(counts[a : a + n])
            a += n
        self._build()

    @classmethod
    def of(cls, text: str, tool: Counter) -> TokenTree:
        pieces = tool.split.findall(text)
        return cls(pieces, list(map(tool.count, pieces)), tool)

    def _build(self) -> None:
        self.leaves, self.counts = self.leaves or [[]], self.counts or [[]]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i in range(len(self.leaves)):
            self._sum_leaf(i)
        for v in range(self.base - 1, 0, -1):
            self._sum(v)

    def _sum_leaf(self, i: int) -> None:
        self.chars[self.base + i] = sum(map(len, self.leaves[i]))
        self.tokens[self.base + i] = sum(self.counts[i])

    def _sum(self, v: int) -> None:
        self.chars[v] = self.chars[2 * v] + self.chars[2 * v + 1]
        self.tokens[v] = self.tokens[2 * v] + self.tokens[2 * v + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, place: int) -> tuple[int, int, int]:
        """Leaf, pre-token in it, and where that begins, of the pre-token that holds the character (the last one at the end)."""
        v, place, start = 1, min(place, max(0, self.chars[1] - 1)), 0
        while v < self.base:
            v *= 2
            if place - start >= self.chars[v]:
                start += self.chars[v]
                v += 1
        leaf, k = v - self.base, 0
        while k < len(self.leaves[leaf]) and start + len(self.leaves[leaf][k]) <= place:
            start += len(self.leaves[leaf][k])
            k += 1
        return leaf, k, start

    def _back(self, leaf: int, k: int) -> tuple[int, int] | None:
        """The pre-token before."""
        while not k:
            if not leaf:
                return None
            leaf -= 1
            k = len(self.leaves[leaf])
        return leaf, k - 1

    def _take(self, leaf: int, k: int, n: int) -> list[str]:
        """n pre-tokens from there on, or as many as there are."""
        out: list[str] = []
        while n > len(out) and leaf < len(self.leaves):
            out += self.leaves[leaf][k : k + n - len(out)]
            leaf, k = leaf + 1, 0
        return out

    def _fresh(self, old: list[str], ended: bool, start: int, end: int, new: str) -> tuple[list[str], int] | None:
        """New pre-tokens for the first pre-tokens of old, and how many these are; None if the old ones don't reach far enough."""
        raw = "".join(old)
        if len(raw) < end and not ended:
            return None
        fresh = self.tool.split.findall(raw[:start] + new + raw[end:])
        shift, at, bounds = len(new) - (end - start), 0, {}
        for i, p in enumerate(old):
            at += len(p)
            if at >= end:
                bounds.setdefault(at + shift, i + 1)
        at = 0
        for j, p in enumerate(fresh):
            at += len(p)
            # What ends a pre-token lies within the next two.
            if at >= start + len(new) and at in bounds and (ended or j < len(fresh) - 2):
                return fresh[: j + 1], bounds[at]
        return (fresh, len(old)) if ended else None

    def edit(self, start: int, length: int, new: str) -> None:
        """Puts new in the place of length characters from start on; what lies beyond the text is left out."""
        size = self.chars[1]
        start = min(max(0, start), size)
        end = min(size, start + max(0, length))
        leaf, k, at = self._find(start)
        for _ in range(3):  # the pre-token that holds the place may begin there: one more than two
            before = self._back(leaf, k)
            if not before:
                break
            leaf, k = before
            at -= len(self.leaves[leaf][k])
        n, done = 8, None
        while done is None:
            old = self._take(leaf, k, n)
            done = self._fresh(old, len(old) < n, start - at, end - at, new)
            n *= 2
        fresh, used = done
        # Fresh pre-tokens that are the old ones at either end keep their counts.
        old = self._take(leaf, k, used)
        same = 0
        while same < min(len(fresh), used) and fresh[same] == old[same]:
            same += 1
        tail = 0
        while tail < min(len(fresh), used) - same and fresh[-1 - tail] == old[-1 - tail]:
            tail += 1
        last, last_k = leaf, k
        while used > len(self.leaves[last]) - last_k:
            used -= len(self.leaves[last]) - last_k
            last, last_k = last + 1, 0
        had = [n for i in range(leaf, last + 1) for n in self.counts[i]][k : k + len(old)]
        new_counts = had[:same] + list(map(self.tool.count, fresh[same : len(fresh) - tail])) + had[len(had) - tail :]
        self.encoded += len(fresh) - same - tail
        whole = self.leaves[leaf][:k] + fresh + self.leaves[last][last_k + used :]
        counts = self.counts[leaf][:k] + new_counts + self.counts[last][last_k + used :]
        self._put(leaf, last, whole, counts)

    def _put(self, leaf: int, last: int, whole: list[str], counts: list[int]) -> None:
        """Puts pre-tokens in the place of leaves; leaves above twice or below a quarter of LEAF are split or merged."""
        n_old = last - leaf + 1
        if len(whole) < LEAF // 4 and len(self.leaves) > n_old:
            if last + 1 < len(self.leaves):
                last += 1
                whole, counts = whole + self.leaves[last], counts + self.counts[last]
            else:
                leaf -= 1
                whole, counts = self.leaves[leaf] + whole, self.counts[leaf] + counts
            n_old = last - leaf + 1
        n_new = n_old if LEAF // 4 * n_old <= len(whole) <= 2 * LEAF * n_old else max(1, -(-len(whole) // LEAF))
        cuts = [len(whole) * i // n_new for i in range(n_new + 1)]
        self.leaves[leaf : last + 1] = [whole[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        self.counts[leaf : last + 1] = [counts[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        if n_new != n_old:  # the inner nodes stand over other leaves now; their sums need no token counted
            self._build()
            return
        touched = set()
        for i in range(leaf, last + 1):
            self._sum_leaf(i)
            touched.add((self.base + i) // 2)
        while touched := touched - {0}:
            for v in touched:
                self._sum(v)
            touched = {v // 2 for v in touched}

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


_TREE = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("leaves", pa.list_(pa.int32()))])
_TREE_DDL = "id long, text string, n_tokens long, lengths array<int>, counts array<int>, leaves array<int>"
_EDITED = [pa.field("n_tokens_before", pa.int64()), pa.field("n_pretokens_before", pa.int64()), pa.field("n_encoded_again", pa.int64())]
_EDITED_DDL = ", n_tokens_before long, n_pretokens_before long, n_encoded_again long"


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))


def _arrays(column: pa.ListArray) -> list[list[int]]:
    """Lists of numbers, by way of their buffer."""
    values, ends = np.asarray(column.values), column.offsets.to_pylist()
    return [values[a:z].tolist() for a, z in zip(ends[:-1], ends[1:])]


def _row(i: int | None, tree: TokenTree) -> tuple:
    flat = lambda parts: [x for p in parts for x in p]
    return i, tree.text(), tree.n_tokens, [len(p) for p in flat(tree.leaves)], flat(tree.counts), list(map(len, tree.leaves))


_EDITS_DDL = "array<struct<start: bigint, length: bigint, replacement: string>>"
_EDITS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("replacement", pa.string())]))


def token_trees(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """One row per row of docs, a tree to keep: (id_col, text, n_tokens, lengths and counts: characters and tokens of each
    pre-token, leaves: pre-tokens of each leaf), and edits if edits_col is given, for edit_trees().

    A null text is an empty one, with no pre-tokens. Very long texts are one tree; a pre-token is counted whole whatever its
    length. Equal texts have equal trees. Rows that repeat have a tree each, a null id stays; other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    shared.small_batches(docs.sparkSession)
    out = pa.schema([*_TREE, pa.field("edits", _EDITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path, pattern)
        for batch in batches:
            for a, z in slices(batch, 1):
                texts = batch.column(1).slice(a, z - a).fill_null("")
                lengths, counts, leaves = [], [], []
                for text in texts.to_pylist():
                    pieces = tool.split.findall(text)
                    lengths.append(np.fromiter(map(len, pieces), np.int32, len(pieces)))
                    counts.append(np.fromiter(map(tool.count, pieces), np.int32, len(pieces)))
                    leaves.append(np.array(_leaf_sizes(len(pieces)), np.int32))
                total = pa.array([int(c.sum()) for c in counts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), texts, total, *map(_lists, (lengths, counts, leaves)), batch.column(2).slice(a, z - a).cast(_EDITS)], schema=out)
        shared.give_back()

    edits = (F.col(edits_col) if edits_col else F.lit(None)).cast(_EDITS_DDL).alias("edits")
    trees = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), edits).mapInArrow(run, f"{_TREE_DDL}, edits {_EDITS_DDL}")
    return (trees if edits_col else trees.drop("edits")).withColumnRenamed("id", id_col)


def edit_trees(trees: DataFrame, path: str, pattern: str, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """Rows of token_trees() with edits, as rows of the same kind after all edits, and (n_tokens_before, n_pretokens_before,
    n_encoded_again: pre-tokens whose tokens the edits had counted).

    edits_col: array<struct<start, length, replacement>>, applied in order, each to the text that the one before left; places
    count characters from 0, and what lies outside the text is cut to it. Null edits are none, and a null in an edit is 0 or
    empty. Edits of one place take effect in their order. Texts without edits are passed on as they are. Other columns are ignored.
    """
    return _edited(trees, path, pattern, id_col, edits_col, True)


def _edited(trees: DataFrame, path: str, pattern: str, id_col: str, edits_col: str, whole: bool) -> DataFrame:
    """edit_trees(), or without the edited trees themselves if whole is false."""
    shared.small_batches(trees.sparkSession)
    kept = list(_TREE) if whole else [_TREE.field("id"), _TREE.field("n_tokens")]
    out = pa.schema([*kept, *_EDITED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path, pattern)
        for batch in batches:
            for a, z in slices(batch, 1):
                rows = []
                part = batch.slice(a, z - a)
                columns = [*(part.column(c).to_pylist() for c in (0, 1, 2)), *(_arrays(part.column(c)) for c in (3, 4, 5)), part.column(6).to_pylist()]
                for i, text, n, lengths, counts, leaves, edits in zip(*columns):
                    if not any(edits or []):
                        rows.append((i, text, n, lengths, counts, leaves, n, len(lengths), 0) if whole else (i, n, n, len(lengths), 0))
                        continue
                    ends = list(accumulate(lengths, initial=0))
                    pieces = [text[x:y] for x, y in zip(ends, ends[1:])]
                    tree = TokenTree(pieces, counts, tool, leaves)
                    for e in edits:
                        if e:
                            tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                    rows.append((*(_row(i, tree) if whole else (i, tree.n_tokens)), n, len(lengths), tree.encoded))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
        shared.give_back()

    edits = F.col(edits_col).cast(_EDITS_DDL).alias("edits")
    ddl = (_TREE_DDL if whole else "id long, n_tokens long") + _EDITED_DDL
    return trees.select(F.col(id_col).cast("long").alias("id"), *_TREE.names[1:], edits).mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def counts_after_edits(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """One row per row of docs: (id_col, n_tokens before and n_tokens_after all edits, n_pretokens before, n_encoded_again).

    token_trees() written to the shared folder, then edit_trees() over what was written; see there.
    """
    trees, _ = shared.stash(token_trees(docs, path, pattern, id_col, text_col, edits_col).withColumnRenamed(id_col, "id"), "trees")
    done = _edited(trees, path, pattern, "id", "edits", False)
    return done.select(F.col("id").alias(id_col), F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), F.col("n_pretokens_before").alias("n_pretokens"), "n_encoded_again")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every whole document under three edits: a span masked, the first characters repeated at the end, a span deleted.

    The places follow from the id and the length alone.
    """
    import public_tokenizers

    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    place = F.pmod(F.xxhash64("doc_id"), n + 1)
    edit = lambda start, length, new: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), new.alias("replacement"))
    edits = F.array(edit(place, 20, F.lit("[masked]")), edit(n, 0, F.coalesce(F.substring("text", 1, 40), F.lit(""))), edit(F.floor(n / 3), 11, F.lit("")))
    return counts_after_edits(docs.withColumn("edits", edits), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
