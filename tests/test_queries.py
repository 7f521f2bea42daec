"""Every query against DuckDB where it has SQL, else that it runs; and what entry() returns."""

import hashlib
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracle  # noqa: E402

import __spark_entry__  # noqa: E402
from credsieve.functions.entropy import entropy_of  # noqa: E402
from credsieve.plans import catalogue, stage_queries  # noqa: E402


@pytest.fixture(scope="module")
def con(tiny):
    return oracle.connect(tiny)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tiny, con, name):
    df = catalogue.QUERIES[name](spark, tiny)
    if name in catalogue.ORACLE_SQL:
        assert oracle.compare(df, con, catalogue.ORACLE_SQL[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 200 and df.columns[0] == "doc_id"


def test_the_library_stands_without_the_optional_parts(tmp_path):
    """In a copy of the repository with both llm folders deleted, with the pipeline and without it."""
    root = Path(__file__).parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json", "*.txt"))
    for folder in ("credsieve/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    show = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", show], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
        assert json.loads(done.stdout.splitlines()[-1]) == [sorted(catalogue.QUERIES), sorted(catalogue.ORACLE_SQL)]
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


@pytest.fixture(scope="module")
def meeting(spark, tmp_path_factory):
    """Tables whose parts have the numbers of customers' strings: 1,000,000 on, as from 50 times sf0.1 on."""
    d = str(tmp_path_factory.mktemp("meeting"))
    parts = [(1_000_000, "large ring"), (1_000_001, "x"), (1_000_002, "Hot-Bolt_9"), (1_000_004, ""), (1_000_005, "deadbeef"), (2_000_003, "blue ring"), (7, "4a")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(k, f"Customer#{k}") for k in range(12)], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{d}/customer.parquet")
    return d


@pytest.mark.parametrize("name", ["decode_hex_step", "markov_heuristic"])
def test_numbers_that_meet(spark, meeting, name):
    assert oracle.compare(catalogue.QUERIES[name](spark, meeting), oracle.connect(meeting), catalogue.ORACLE_SQL[name]) is None


def test_tokens_of_numbers_that_meet(spark, meeting):
    """The SQL leaves open which of two strings is first at a place; here it is the part's, in every run."""
    rows = catalogue.QUERIES["tokenize_chars"](spark, meeting).collect()
    want = oracle.connect(meeting).sql(catalogue.ORACLE_SQL["tokenize_chars"]).fetchall()

    def by_place(ids):
        at = list(map(int, ids.split()))
        return [sorted(at[i : i + len(at) // 24]) for i in range(0, len(at), len(at) // 24)]

    assert len(rows) == len(want) == 25 and {r.n: by_place(r.ids) for r in rows} == {n: by_place(ids) for n, ids in want}
    got = {r.n: list(map(int, r.ids.split())) for r in rows}
    assert got[1_000_004][0::2] == [0] * 24 and got[1_000_004][1::2][:12] == [ord(c) - 97 for c in "correcthorse"]
    assert got[1_000_000][:4] == [ord("l") - 97, ord("y") - 97, 0, ord("o") - 97] and len(got[7]) == 24


def test_tokens_of_few_different_digits_are_found(spark, tmp_path):
    """Paths whose MD5 has less than three bits a digit."""
    digits = lambda i: hashlib.md5(f"web/doc_{i}.txt".encode()).digest().hex()
    low = [i for i in range(20_000) if entropy_of(digits(i).encode()) < 3]
    assert len(low) > 1
    d = str(tmp_path)
    spark.createDataFrame([(i, "web", "") for i in [*low, 1]], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    assert oracle.compare(catalogue.QUERIES["decoded_findings"](spark, d), oracle.connect(d), catalogue.ORACLE_SQL["decoded_findings"]) is None
    # Not even an MD5 of one digit alone falls below the threshold with what follows it.
    assert entropy_of(b"0" * 32 + stage_queries._PAD.encode()) > 3
