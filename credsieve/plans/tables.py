"""Rows that several queries share: fragments, synthetic findings, paths and values, each with its SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text) of the documents, each source a folder."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


FRAGMENTS = "select doc_id, source || '/doc_' || doc_id::varchar || '.txt' as path, text from documents"

# Paths of the demonstrations; %d is a number.
PATH_FORMS = ["app/src/mod_%d.py", "deploy/docker-compose.yml", "config/settings_%d.yaml", "svc/.env", "tests/fixtures/f_%d.json", "/repo/test/x_%d.txt", "docs/readme_%d.md", "pkg/.env.example", "lib/y_test.go", "Cargo.lock", "/srv/secrets/k_%d.txt", "k8s/manifest_%d.yml"]


def path_of(n) -> object:
    """A path by a number, as an expression."""
    i = F.pmod(n, F.lit(len(PATH_FORMS)))
    out = F.lit("")
    for k, form in enumerate(PATH_FORMS):
        out = F.when(i == k, F.format_string(form, F.pmod(n, F.lit(97)).cast("long")) if "%d" in form else F.lit(form)).otherwise(out)
    return out


def path_sql(n: str) -> str:
    return sql.case([(f"({n}) % {len(PATH_FORMS)} = {k}", "replace(" + sql.lit(form) + f", '%d', (({n}) % 97)::varchar)") for k, form in enumerate(PATH_FORMS)], "''")


SEVERITY = ["info", "low", "medium", "high", "critical"]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic findings, one per event."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    sev = F.element_at(F.array(*map(F.lit, SEVERITY)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        F.md5(F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("rule-"), "event_type").alias("rule_id"), F.md5(F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string"))).alias("secret_hash"),
        path_of(F.col("user_id")).alias("path"), sev.alias("severity"), ((F.col("event_id") * 7919 % 1000) / 1000).alias("confidence"), (F.col("event_id") % 7).cast("int").alias("rank"),
        (F.col("event_id") % 200 + 1).alias("line_no"), (F.col("event_id") * 31 % 5000).alias("start"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("VAR_"), (F.col("user_id") % 25).cast("string"))).alias("variable"),
        F.concat(F.lit("found, "), "event_type").alias("description"), F.repeat(F.lit("*"), 8).alias("secret_redacted"), F.concat(F.lit('say "rotate", then '), "event_type").alias("remediation"),
    )


FINDINGS = f"""
select md5(event_id::varchar) as id, 'rule-' || event_type as rule_id, md5('s' || (user_id % 40)::varchar) as secret_hash, {path_sql("user_id")} as path,
  {sql.case([(f"event_id % 5 = {k}", sql.lit(s)) for k, s in enumerate(SEVERITY)], "null")} as severity, (event_id * 7919 % 1000) / 1000 as confidence, (event_id % 7)::int as rank,
  event_id % 200 + 1 as line_no, event_id * 31 % 5000 as start, case when event_id % 3 <> 0 then 'VAR_' || (user_id % 25)::varchar end as variable,
  'found, ' || event_type as description, '********' as secret_redacted, 'say "rotate", then ' || event_type as remediation
from events"""


def strings(spark: SparkSession, sf_dir: str, leg: str | None = None) -> DataFrame:
    """(n, s): names, digests and placeholders; with leg, a column of that name with the place in the union, from 0. Numbers of parts
    and of customers meet from a million parts on."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("s"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    made = F.when(k % 6 == 0, F.concat(F.lit("your_key_"), k.cast("string"))).when(k % 6 == 1, F.repeat(F.lit("z"), 20)).when(k % 6 == 2, F.lpad((k * 7654321).cast("string"), 12, "7")).when(k % 6 == 3, F.lit("changeme!")).when(k % 6 == 4, F.lit("correcthorse")).otherwise(F.md5("c_name"))
    legs = [p, c.select((k + 1_000_000).alias("n"), made.alias("s")), c.select((k + 2_000_000).alias("n"), F.concat(F.upper(F.substring(F.md5("c_name"), 1, 10)), F.lit("-_"), F.col("c_name")).alias("s"))]
    return reduce(DataFrame.unionByName, [x.withColumn(leg, F.lit(i)) for i, x in enumerate(legs)] if leg else legs)


STRINGS = """
select p_partkey as n, p_name as s from part union all
select c_custkey + 1000000, case when c_custkey % 6 = 0 then 'your_key_' || c_custkey::varchar when c_custkey % 6 = 1 then repeat('z', 20) when c_custkey % 6 = 2 then lpad((c_custkey * 7654321)::varchar, 12, '7')
  when c_custkey % 6 = 3 then 'changeme!' when c_custkey % 6 = 4 then 'correcthorse' else md5(c_name) end from customer union all
select c_custkey + 2000000, upper(substr(md5(c_name), 1, 10)) || '-_' || c_name from customer"""
