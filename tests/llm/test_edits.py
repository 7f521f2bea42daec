"""Counts after edits against counting the edited text anew."""

import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from credsieve.llm import edits as edits_module
from credsieve.llm.edits import LEAF, TokenTree, counter, counts_after_edits, edit_trees, token_trees

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
texts = st.text(alphabet="ab'st  \n\t1é!x", max_size=400)


@pytest.fixture(params=[4, 64])
def leaf(request, monkeypatch):
    monkeypatch.setattr(edits_module, "LEAF", request.param)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts, st.lists(st.tuples(st.integers(0, 420), st.integers(0, 60), st.text(alphabet="ab's \n1é!", max_size=30)), max_size=5))
def test_tree_follows_edits(leaf, text, edits):
    tool = counter(PATH, PATTERN)
    tree = TokenTree.of(text * 3, tool)
    now = text * 3
    for start, length, new in edits:
        tree.edit(start, length, new)
        now = now[:start] + new + now[start + length :]
        assert tree.text() == now
        assert [p for leaf in tree.leaves for p in leaf] == tool.split.findall(now)
        assert tree.n_tokens == len(tool.encoding.encode_ordinary(now))
        assert all(list(map(tool.count, leaf)) == counts for leaf, counts in zip(tree.leaves, tree.counts))


class Counting:
    """A Counter that says how often it was asked."""

    def __init__(self, tool):
        self.tool, self.split, self.asked = tool, tool.split, 0

    def count(self, piece):
        self.asked += 1
        return self.tool.count(piece)


def test_only_the_region_is_encoded_again():
    tool = Counting(counter(PATH, PATTERN))
    tree = TokenTree.of("word and more " * 5000 + "x" * 100, tool)
    before = tool.asked
    tree.edit(30000, 3, "new words here")
    assert tool.asked - before == tree.encoded < 20
    tree.edit(30000, 0, "")
    assert tool.asked - before == tree.encoded < 20


def test_leaves_split_and_merge():
    tree = TokenTree.of("one two three", counter(PATH, PATTERN))
    for _ in range(200):
        tree.edit(4, 0, "some more of these words so that the leaf grows ")
    assert len(tree.leaves) > 20 and max(map(len, tree.leaves)) <= 2 * LEAF
    tree.edit(0, len(tree.text()) - 6, "")
    assert tree.text() == " three" and tree.n_tokens == 1 and len(tree.leaves) < 3
    long = TokenTree.of("", counter(PATH, PATTERN))
    long.edit(0, 0, "word and more " * 5000)
    assert max(map(len, long.leaves)) <= 2 * LEAF and len(long.leaves) > 100


def test_trees_are_kept_as_a_table(spark, tmp_path):
    rows = [(1, "to be or not to be " * 100), (2, None), (3, "")]
    path = str(tmp_path / "trees")
    token_trees(spark.createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN).write.parquet(path)
    for turn, new in enumerate(("that is", "the question")):
        done = edit_trees(spark.read.parquet(path).selectExpr("*", f"array(named_struct('start', 30L, 'length', 6L, 'replacement', ' {new} ')) as edits"), PATH, PATTERN)
        path = str(tmp_path / f"trees{turn}")
        done.write.parquet(path)
    tool = counter(PATH, PATTERN)
    for r in spark.read.parquet(path).collect():
        fresh = TokenTree.of(r.text, tool)
        assert r.n_tokens == fresh.n_tokens and "the question" in r.text and r.lengths == [len(p) for leaf in fresh.leaves for p in leaf]
        assert r.n_encoded_again < 12 and sum(r.leaves) == len(r.counts)


def test_nulls_long_texts_and_repeated_rows(spark):
    rows = [(1, None, None), (2, "", [(0, 5, "x")]), (3, "a b c", [(99, 9, " d")]), (3, "a b c", [(99, 9, " d")]), (None, "x", [None]), (4, "long " * 50000, [(7, None, None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,length:long,replacement:string>>").selectExpr("*", "1 as n_tokens", "2 as id")
    got = sorted((tuple(r)[:3] for r in counts_after_edits(df, PATH, PATTERN).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == [(1, 0, 0), (2, 0, 1), (3, 3, 4), (3, 3, 4), (4, 50001, 50001), (None, 1, 1)]
    assert counts_after_edits(df.where("false"), PATH, PATTERN).collect() == []


def test_query_against_a_full_count(spark, tiny):
    import pyspark.sql.functions as F

    from credsieve.llm.edits import op3_token_counts

    got = {r.doc_id: r for r in op3_token_counts(spark, tiny).collect()}
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.length("text") + 1).alias("p")).collect()
    enc = counter(PATH, PATTERN).encoding
    assert len(got) == len(rows)
    for r in rows:
        n, t = len(r.text), r.text
        t = t[: r.p] + "[masked]" + t[r.p + 20 :]
        t = t[:n] + r.text[:40] + t[n:]
        t = t[: n // 3] + t[n // 3 + 11 :]
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_tokens_after) == (len(enc.encode_ordinary(r.text)), len(enc.encode_ordinary(t)))
