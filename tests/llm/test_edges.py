"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from credsieve.llm.bpe import bpe_encode_decode
from credsieve.llm.decontamination import contamination
from credsieve.llm.language import Model, identify, train
from credsieve.llm.licenses import scan_licenses
from credsieve.llm.minhash import near_duplicates
from credsieve.llm.pii import pseudonymise
from credsieve.llm.sharding import shard_documents
from credsieve.llm.urls import judge
from credsieve.llm.vectors import near_vectors

WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog " * 20000
ROWS = [
    (1, None, "en", None, None), (2, "", None, "s", 0), (3, "one two three four five six", "en", "s", 1), (3, "one two three four five six", "en", "s", 1), (4, "one two three four five six", None, "s", 1),
    (None, "one two three four five six", "fr", None, None), (5, LONG, "en", "s", 9), (6, "  \t ", "en", "s", 4), (7, "ünïcödé ſtraße Σ 42 mail a.b@c.de", "de", "s", 4),
]
CLASHING = ["id", "k1", "node", "bands", "items", "pii", "size", "key", "shard", "lang_pred", "score", "n_words", "block", "bucket", "component_id", "kept", "n_tokens", "_hits"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING))


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


ALL = [1, 2, 3, 3, 4, 5, 6, 7, None]


def test_bpe(docs):
    from tokenizers import Tokenizer

    got = bpe_encode_decode(docs, WORD).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is None, x or 0)) == ALL
    lib = Tokenizer.from_file(WORD)
    want = {r[0]: lib.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS}
    assert all(r.ids == want[r.doc_id] and r.decoded == lib.decode(want[r.doc_id], skip_special_tokens=False) for r in got)
    assert bpe_encode_decode(docs.where("false"), WORD).collect() == []


def test_minhash(docs):
    got = near_duplicates(docs, 3, 85).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}
    assert {(1, 0, 1, True), (2, 0, 2, True), (6, 0, 6, True), (3, 4, 3, True), (4, 4, 3, False), (None, 4, 3, False)} <= by
    assert near_duplicates(docs.where("false"), 3, 85).collect() == []
    assert near_duplicates(docs.where("doc_id = 1"), 3, 85).collect()[0].kept


def test_language(docs):
    model = train(docs)
    got = identify(docs, model).collect()
    assert len(got) == len(ROWS)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in got)
    none = train(docs.where("false"))
    assert isinstance(none, Model) and {r.lang_pred for r in identify(docs, none).collect()} == {"und"}
    assert identify(docs.where("false"), model).collect() == []


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "three four five six seven one two"), (2, None), (3, ""), (4, "two three"), (4, "two three"), (None, "lazy dog the quick brown fox jumps")], "item_id long, text string")
    got = contamination(docs, bench).collect()
    assert len(got) == len(ROWS)
    four = next(r for r in got if r.doc_id == 4)
    assert [(i["item_id"], round(i["coverage"], 3)) for i in four["items"]] == [(4, 1.0), (4, 1.0)]
    long = next(r for r in got if r.doc_id == 5)
    assert [(i["item_id"], i["coverage"]) for i in long["items"]] == [(None, 1.0)]
    assert [r["items"] for r in contamination(docs, bench.where("false")).collect()] == [[]] * len(ROWS)
    assert contamination(docs.where("false"), bench).collect() == []
    # In parts, the result is the same.
    parts = contamination(docs, bench, part_chars=20).collect()
    assert sorted(map(str, (r["items"] for r in parts))) == sorted(map(str, (r["items"] for r in got)))


def test_reordered_passages_are_caught(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    doc = "noise zeta eta theta iota kappa lambda mu more alpha beta gamma delta epsilon end"
    got = contamination(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).first()["items"]
    assert [(i["item_id"], i["coverage"], i["tiles"]) for i in got] == [(9, 1.0, 2)]


def test_licenses(spark, docs):
    got = scan_licenses(docs).collect()
    assert len(got) == len(ROWS) and all(not r.base for r in got)
    rows = [(1, "MIT\nLicense, mit license; xMIT license"), (2, "Relased under teh MIT Licence."), (3, "licensed under the apache license version 2.0" + " word" * 50000), (4, "mit"), (5, "license mit")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x["word"] for x in got[1].base] == [0, 2] and got[1].n_words == 6
    assert not got[2].base and got[2].notices == [] or got[2].notices[0]["label"] == "mit"
    assert got[3].notices[0]["label"] == "apache" and got[3].notices[0]["errors"] == 0
    assert not got[4].base and not got[5].base
    one = scan_licenses(spark.createDataFrame([(1, "Released undr the MIT License today")], "doc_id long, text string")).first()
    assert [(n["label"], n["first_word"], n["last_word"], n["errors"]) for n in one.notices] == [("mit", 0, 4, 1)]
    assert scan_licenses(docs.where("false")).collect() == []


def test_pii(docs):
    got = pseudonymise(docs, "k")
    assert got.columns == [*(c for c in docs.columns if c != "pii"), "pii"]
    rows = got.collect()
    assert ids(got) == ALL
    want = {r[0]: r[1] for r in ROWS}
    assert all(r.text == want[r.doc_id] for r in rows if r.doc_id != 7)
    seven = next(r for r in rows if r.doc_id == 7)
    assert seven.text != want[7] and seven.text.endswith("@c.de") and seven.pii[0]["kind"] == "email"
    assert pseudonymise(docs.where("false"), "k").collect() == []


def test_columns_that_clash_in_another_case(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de one two three four five six")], "Doc_ID long, Text string")
    df = df.select("*", *(F.lit("x").alias(c) for c in ("Items", "Score", "LANG_PRED", "PII", "_PII_found", "_pii_KEY", "Size", "Node", "Words", "Block", "Counts", "Edits")))
    kept = lambda out, *gone: [c for c in df.columns if c not in gone] == out.columns[: len(df.columns) - len(gone)]
    model = Model(["de", "en"], np.ones((65536, 2), np.float32), np.zeros(2), 1.0)
    said = identify(df, model, "text")
    # Equal chances are a tie: the first language in order.
    assert kept(said, "Score", "LANG_PRED") and (said.first().lang_pred, said.first().score) == ("de", 0.5)
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    found = contamination(df, bench, id_col="doc_id", text_col="text")
    assert kept(found, "Items") and [i["item_id"] for i in found.first()["items"]] == [1]
    safe = pseudonymise(df, "k", "text")
    assert kept(safe, "PII") and "a.b@c.de" not in safe.first()["Text"]
    assert bpe_encode_decode(df, WORD).count() == near_duplicates(df).count() == scan_licenses(df).count() == shard_documents(df).count() == 1


def test_very_long_texts_with_hits(spark):
    n = 4000
    long = " ".join(f"call +1 (212) 555-{k:04d} or mail somename{k:05d}@h.org under the mit license now" for k in range(n))
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    out = pseudonymise(df, "k").first()
    assert len(out.pii) == 2 * n and len(out.text) == len(long)
    assert re.sub(r"555-|[a-z0-9]+@|\d", "", re.sub(r"\(\d+\) \d+-", "() -", out.text)) == re.sub(r"555-|[a-z0-9]+@|\d", "", re.sub(r"\(\d+\) \d+-", "() -", long))
    row = scan_licenses(df).first()
    assert len(row.base) == n and len(row.notices) == 0 or all(x["label"] in ("mit", "gpl") for x in row.notices)


def test_the_key_is_in_no_plan(spark, docs, capsys):
    out = pseudonymise(docs, "the-very-secret-key")
    out.explain("extended")
    out.explain("formatted")
    assert "the-very-secret-key" not in capsys.readouterr().out and "the-very-secret-key" not in out._jdf.queryExecution().toString()


def test_sharding_of_null_and_empty_texts(spark):
    rows = {r.doc_id: r for r in shard_documents(spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id long, text string"), 2).collect()}
    assert [rows[k].text_crc32 for k in (1, 2, 3)] == [None, 0, None] and rows[1].shard == rows[3].shard and {r.size for r in rows.values()} == {8}


def test_sharding(docs):
    rows = shard_documents(docs, 3).collect()
    assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x or 0)) == ALL
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows if r.doc_id in (3, 4, None)}) == 1 and {r.size for r in rows if r.doc_id == 1} == {8}
    assert shard_documents(docs.where("false")).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1e300, 1e298]), (9, [1.0, 0.0, 0.0]), (None, [2.0, 0.1]), (10, [-0.0, 1.0]), (11, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as node", "3 as n_links")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()), key=str)
    assert got == sorted([*((i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)), (7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (None, 3, 7, False), (10, 1, 10, True), (11, 1, 10, False)], key=str)
    assert near_vectors(df.where("false")).collect() == []


def test_vectors_at_the_threshold(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    # Cosines: 24/25 between the first two, 4/5 and 3/5 with the third.
    assert {r.vec_id: r.n_links for r in near_vectors(df, 0.5).collect()} == {1: 2, 2: 2, 3: 2}
    assert {r.vec_id: r.n_links for r in near_vectors(df, 0.8).collect()} == {1: 2, 2: 1, 3: 1}
    assert {r.vec_id: r.n_links for r in near_vectors(df, 0.97).collect()} == {1: 0, 2: 0, 3: 0}


def test_urls(spark):
    entries = spark.createDataFrame(
        [("Spam.example.", "spam", "add", "2024-01-01"), ("spam.example", "spam", "remove", "2024-02-01"), ("spam.example", "spam", "add", "2024-03-01"), ("b.org/bad/", "adult", "add", "2024-01-01"), (None, "x", "add", "2024-01-01"), ("c.org", "x", "other", "2024-01-01"), ("d.org", "x", "add", "2024-01-01"), ("d.org", "x", "remove", "2024-01-01")],
        "pattern string, category string, action string, at string",
    ).withColumn("at", F.to_date("at"))
    rows = [(1, "http://a.spam.example/x", "2024-01-15"), (2, "http://a.spam.example/x", "2024-02-15"), (3, "http://spam.example:80/", "2024-03-01"), (4, "https://u@B.org/bad/p?q", "2024-05-05"), (5, "https://b.org/good", "2024-05-05"), (6, None, "2024-05-05"), (7, "nonsense", "2024-05-05"), (8, "http://spam.example/", None), (1, "http://a.spam.example/x", "2024-01-15"), (9, "http://notspam.example/", "2024-05-05"), (10, "http://d.org/", "2024-05-05")]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_date("fetched_at")).selectExpr("*", "'x' as pattern", "'y' as since", "'z' as entry")
    got = judge(caps, entries).collect()
    assert sorted(r.page_id for r in got if r.blocked) == [1, 1, 3, 4] and len(got) == len(rows)
    assert next(r.entry for r in got if r.page_id == 4) == "b.org/bad"
    assert not any(r.blocked for r in judge(caps, entries.where("false")).collect()) and judge(caps.where("false"), entries).collect() == []


def test_urls_with_clashing_columns_and_long_urls(spark):
    entries = spark.createDataFrame([("b.org", "spam", "add", "2024-01-01"), ("a.b.org/x", "adult", "add", "2024-01-01"), ("b.org/y", "x", "add", "2024-06-01")], "pattern string, category string, action string, at string").withColumn("at", F.to_date("at"))
    rows = [(1, "http://a.b.org/x/" + "p/" * 20000, "2024-05-05"), (2, "http://" + "s." * 3000 + "b.org/", "2024-01-01"), (3, "", "2024-05-05"), (4, "http://b.org/y", "2023-12-31")]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_date("fetched_at"))
    caps = caps.select("*", *(F.lit("x").alias(c) for c in ("_url", "_at", "_Entry", "Entry", "HOST", "at", "since")))
    got = {r.page_id: r for r in judge(caps, entries).collect()}
    assert {i: (r.entry, r.categories) for i, r in got.items()} == {1: ("a.b.org/x", ["adult", "spam"]), 2: ("b.org", ["spam"]), 3: (None, []), 4: (None, [])}
    assert got[1]._url == "x" and got[1]["at"] == "x" and got[3].host is None


def test_urls_by_entries_of_any_depth(spark):
    deep = "e.org/" + "/".join(f"p{i}" for i in range(12))
    entries = spark.createDataFrame([("b.org/a/b/c/", "spam", "add", "2024-01-01"), (deep, "adult", "add", "2024-01-01")], "pattern string, category string, action string, at string").withColumn("at", F.to_date("at"))
    rows = [(1, "http://x.b.org/a/b/c/d/e?q", "2024-05-05"), (2, "http://b.org/a/b/cc", "2024-05-05"), (3, f"http://{deep}/more", "2024-05-05"), (4, "http://b.org/a/b", "2024-05-05"), (5, f"http://{deep[:-1]}", "2024-05-05")]
    got = {r.page_id: r.entry for r in judge(spark.createDataFrame(rows, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_date("fetched_at")), entries).collect()}
    assert got == {1: "b.org/a/b/c", 2: None, 3: deep, 4: None, 5: None}


def test_stages_keep_columns_and_stand_any_rows(spark, docs, tiny):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (plain, plain.where("false")):
            out = stage(spark, rows, tiny)
            if name != "tokens":
                assert out.columns == plain.columns
            out.collect()
    kept = corpus_pipeline.near_dedup(spark, plain, tiny)
    # One row of each group stays, one without an id only where none has one, or where it is in no group.
    assert ids(kept) == [1, 2, 3, 5, 6, 7]
    unnamed = plain.unionByName(plain.where("doc_id = 5").selectExpr("null as doc_id", "'quite another text' as text", "lang", "source", "n_chars"))
    assert ids(corpus_pipeline.near_dedup(spark, unnamed, tiny)) == [1, 2, 3, 5, 6, 7, None]
    twice = plain.where("doc_id = 3").selectExpr("doc_id", "text", "lang", "'a' as source", "n_chars").unionByName(plain.where("doc_id = 3"))
    assert [r.source for r in corpus_pipeline.near_dedup(spark, twice, tiny).collect()] == ["a"]
