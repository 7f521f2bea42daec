"""Queries of deduplication, order, chains, baselines, reports, sources, evaluation and stateful parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import content_hash, finding_hash
from ..operators import evaluate, findings as ops, report, rules
from ..sources import text as src
from ..streaming import jobs
from . import sql
from .tables import FINDINGS, FRAGMENTS, SEVERITY, findings, fragments, path_of, path_sql, table

_RANK = "(" + sql.case([(f"severity = {sql.lit(s)}", str(i)) for i, s in enumerate(SEVERITY)], "null") + ")"


def dedup_best(spark, d) -> DataFrame:
    return ops.dedup_best(findings(spark, d)).select("id", "secret_hash", "path", "rank", "confidence")


DEDUP_BEST = f"select id, secret_hash, path, rank, confidence from ({FINDINGS}) qualify row_number() over (partition by secret_hash, path order by rank desc, confidence desc, start, rule_id) = 1"


def dedup_first(spark, d) -> DataFrame:
    return ops.dedup_first(findings(spark, d)).groupBy("rule_id", "secret_hash", "path").agg(F.min("start").alias("start"))


DEDUP_FIRST = f"select rule_id, secret_hash, path, min(start) as start from ({FINDINGS}) group by all"


def severity_summary(spark, d) -> DataFrame:
    return ops.severity_summary(findings(spark, d))


def severity_filter(spark, d) -> DataFrame:
    return ops.least_severity(findings(spark, d), "high").where("confidence >= 0.5").select("id", "severity", "confidence")


def findings_sorted(spark, d) -> DataFrame:
    """The 100 most severe, as a report shows them."""
    return ops.in_order(findings(spark, d)).limit(100).select("id", "severity", "confidence", "path", "start", "rule_id")


SORTED = f"select id, severity, confidence, path, start, rule_id from ({FINDINGS}) order by {_RANK} desc, confidence desc, path, start, rule_id limit 100"


def findings_sorted_all(spark, d) -> DataFrame:
    """All findings in the order of a report."""
    return ops.in_order(findings(spark, d)).select("id", "severity", "confidence", "path", "start", "rule_id")


SORTED_ALL = f"select id, severity, confidence, path, start, rule_id from ({FINDINGS}) order by {_RANK} desc, confidence desc, path, start, rule_id"


def chains_by_variable(spark, d) -> DataFrame:
    c = ops.variable_chains(findings(spark, d))
    return c.select("variable_name", "origin_id", F.size("propagation_ids").alias("n_propagation"), F.size("usage_ids").alias("n_usage"), "chain_confidence")


_P = "(ends_with(lower(path), '.yml') or ends_with(lower(path), '.yaml') or contains(lower(path), 'compose') or contains(lower(path), 'manifest') or contains(lower(path), 'deployment'))"
_VARS = f"""f as ({FINDINGS}), g as (select *, row_number() over (partition by variable order by path, line_no, start, id) as k, {_P} as p from f where variable is not null),
v as (select variable, max(case when k = 1 then id end) as origin_id, count(*) filter (k > 1 and p) as np, count(*) filter (k > 1 and not p) as nu, count(distinct path) as paths from g group by variable)"""
CHAIN_VARS = f"with {_VARS} select variable as variable_name, origin_id, np::int as n_propagation, nu::int as n_usage, 0.2::double as chain_confidence from v where paths >= 2"


def chains_by_value(spark, d) -> DataFrame:
    """Secrets of findings without a variable, and of documents' content that recurs under another source."""
    f = findings(spark, d).where("variable is null")
    c = ops.value_chains(f)
    return c.select("variable_name", "origin_id", F.size("usage_ids").alias("n_usage"))


CHAIN_VALUES = f"""with f as (select * from ({FINDINGS}) where variable is null), g as (select *, row_number() over (partition by secret_hash order by start, path, id) as k from f)
select substr(secret_hash, 1, 8) as variable_name, max(case when k = 1 then id end) as origin_id, (count(*) - 1)::int as n_usage from g group by secret_hash having count(distinct path) >= 2"""


def chains_applied(spark, d) -> DataFrame:
    f = findings(spark, d)
    by_var = ops.variable_chains(f)
    return ops.apply_chains(f, by_var.drop("hashes").unionByName(ops.value_chains(f.where("variable is null")))).select("id", "confidence", "chain")


CHAIN_APPLIED = f"""with {_VARS},
w as (select secret_hash from f where variable is null group by secret_hash having count(distinct path) >= 2),
b as (select id, 0.2::double as boost, variable as name from f join (select variable from v where paths >= 2) using (variable) union all select f.id, 0.2::double, substr(f.secret_hash, 1, 8) from f join w using (secret_hash) where f.variable is null),
s as (select id, sum(boost) as boost, max(name) as name from b group by id)
select f.id, least(1.0, round(f.confidence + coalesce(s.boost, 0), 6))::double as confidence, s.name as chain from f left join s using (id)"""


def baseline_new_findings(spark, d) -> DataFrame:
    f = findings(spark, d)
    known = f.where("start % 3 = 0").select(finding_hash(F.col("rule_id"), F.col("secret_hash"), F.col("path")).alias("finding_hash")).distinct()
    muted = f.where("start % 7 = 0").select(finding_hash(F.col("rule_id"), F.col("secret_hash"), F.col("path")).alias("finding_hash")).distinct()
    return ops.new_findings(f, known, muted).select("id", "finding_hash")


BASELINE = f"with f as (select *, sha256(rule_id || ':' || secret_hash || ':' || path) as h from ({FINDINGS})) select id, h as finding_hash from f where h not in (select h from f where start % 3 = 0) and h not in (select h from f where start % 7 = 0)"


def _files(spark, d) -> DataFrame:
    return fragments(spark, d).select("path", content_hash(F.col("text")).alias("content_hash"))


def baseline_changed_files(spark, d) -> DataFrame:
    f = _files(spark, d)
    n = F.conv(F.substring("content_hash", 1, 2), 16, 10).cast("int")
    state = f.where(n % 4 != 0).withColumn("content_hash", F.when(n % 4 == 1, F.lit("old")).otherwise(F.col("content_hash")))
    return ops.changed_files(f, state)


CHANGED = f"with f as (select path, sha256(text) as content_hash from ({FRAGMENTS})) select path, content_hash from f where ('0x' || substr(content_hash, 1, 2))::int % 4 in (0, 1)"


def baseline_state(spark, d) -> DataFrame:
    """The next state: the old one pruned to files that exist, merged with the new hashes."""
    f = _files(spark, d)
    old = f.select(F.concat("path", F.when(F.length("path") % 2 == 0, F.lit("")).otherwise(F.lit("~"))).alias("path"), F.lit("old").alias("content_hash"))
    return ops.merge_state(ops.prune_state(old, f), f)


STATE = f"with f as (select path, sha256(text) as content_hash from ({FRAGMENTS})) select path, 'old' as content_hash from f where length(path) % 2 = 0 union select path, content_hash from f"


def _rules(spark) -> DataFrame:
    return rules.load_rules(spark)


_MORE = """
[[rules]]
id = "jwt-token"
description = "Our own"
regex = 'eyJ[a-z]+'
severity = "low"

[[rules]]
id = "local-rule"
title = "Local"
regex = 'local_[0-9a-f]{32}'
keywords = ["local_"]
severity = "high"
allowlist = { regexes = ["0{32}"] }
"""


def rule_override(spark, d) -> DataFrame:
    later = spark.createDataFrame([(r.id, r.description, r.severity) for r in rules.parse_rules(_MORE)[0]], "id string, description string, severity string")
    return rules.override(_rules(spark).select("id", "description", "severity"), later)


def _rule_values() -> str:
    return ", ".join(f"({sql.lit(r.id)}, {sql.lit(r.description)}, {sql.lit(r.severity)}, {sql.lit(r.category)}, {sql.lit(' '.join(r.keywords).lower())})" for r in rules.parse_rules(rules.BUILTIN.read_text(encoding="utf-8"))[0])


OVERRIDE = f"""with r(id, description, severity, category, k) as (values {_rule_values()}), m(id, description, severity) as (values ('jwt-token', 'Our own', 'low'), ('local-rule', 'Local', 'high'))
select id, description, severity from r where id not in (select id from m) union all select * from m"""


def rule_buckets(spark, d) -> DataFrame:
    return rules.rule_buckets(_rules(spark))


_BUCKETS = {
    "api_key": (["api-key", "secret-key", "access-key", "client-secret", "client-id", "oauth", "webhook", "hmac", "signing-key", "session-secret"], ["x-api-key", "api-key", "access key"]), "password": (["password", "smtp"], ["password", "passwd"]),
    "token": (["token", "secret", "oauth", "jwt", "bearer", "session-secret", "webhook", "hmac"], ["token", "secret"]), "auth_header": (["bearer", "jwt", "auth", "header", "cookie", "session"], ["bearer", "authorization", "cookie"]),
    "code_assignments": (["generic", "assignment", "password", "token", "api-key", "secret", "oauth", "client", "access-key"], []), "config_assignments": (["generic", "assignment", "password", "token", "env", "config", "url", "credential"], []),
    "url_credentials": (["url", "database-url", "credentials"], []), "private_key": (["private-key", "pem", "signing-key"], []), "nonce_like": (["nonce"], []),
}
BUCKETS = f"with r(id, description, severity, category, k) as (values {_rule_values()}) " + " union all ".join(f"select id, {sql.lit(b)} as bucket from r where {sql.any_of('id', i)}" + (f" or {sql.any_of('k', k)}" if k else "") for b, (i, k) in _BUCKETS.items()) + " union all select id, 'keywordless' from r where k = ''"


def rules_listed(spark, d) -> DataFrame:
    return rules.list_rules(_rules(spark), "cloud", "high").select("id", "severity")


LISTED = f"with r(id, description, severity, category, k) as (values {_rule_values()}) select id, severity from r where category = 'cloud' and severity in ('high', 'critical')"


def db_cells(spark, d) -> DataFrame:
    return src.table_cells(table(spark, d, "customer"), "customer", F.col("c_custkey")).select("path", "text", F.col("attributes")["column"].alias("column"), "size")


_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def db_cells_text(spark, d) -> DataFrame:
    return db_cells(spark, d).where(F.col("column").isin(_COLUMNS))


CELLS = " union all ".join(f"select 'db://db:0/customer/row' || c_custkey::varchar || '/{c}' as path, {c}::varchar as text, '{c}' as \"column\", strlen({c}::varchar)::bigint as size from customer where {c} is not null" for c in _COLUMNS)


def diff_added_lines(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("--- a\n+++ b\n@@ -1 +1 @@\n-old\n+status="), "o_orderstatus", F.lit("\n same\n+prio="), "o_orderpriority").alias("diff"))
    return o.select("o_orderkey", src.added_lines(F.col("diff")).alias("added"))


ADDED = "select o_orderkey, 'status=' || o_orderstatus || chr(10) || 'prio=' || o_orderpriority as added from orders"


def git_patches(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("sha"), F.lit("a").alias("author"), F.lit("2024").alias("date"), F.col("o_orderpriority").alias("message"), path_of(F.col("o_custkey")).alias("file"), F.concat(F.lit("+++ b\n+x="), "o_orderstatus", F.lit("\n keep\n-gone")).alias("diff"))
    return src.git_patches(o).select("path", "text", F.col("attributes")["message"].alias("message"))


PATCHES = f"select {path_sql('o_custkey')} || '@' || substr(md5(o_orderkey::varchar), 1, 8) as path, 'x=' || o_orderstatus || chr(10) || 'keep' as text, o_orderpriority as message from orders"


def dotenv_parse(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("# c\nexport STATUS=\""), "o_orderstatus", F.lit("\"\n\nPRIO='"), "o_orderpriority", F.lit("'\nLONG=a\\\n  b"), F.lit("\nKEY="), F.md5(F.col("o_orderkey").cast("string")), F.lit("=="), F.lit("\nnothing")).alias("t"))
    return src.dotenv(o, F.concat(F.lit("f"), F.col("o_orderkey").cast("string")), F.col("t")).select("path", "text")


DOTENV = " union all ".join(f"select 'f' || o_orderkey::varchar || ':{k}' as path, '{k}=' || {v} as text from orders" for k, v in [("STATUS", "o_orderstatus"), ("PRIO", "o_orderpriority"), ("LONG", "'ab'"), ("KEY", "md5(o_orderkey::varchar) || '=='")])


def json_leaves(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", F.struct(F.array(F.col("props"), F.col("event_type")).alias("list")).alias("inner"), F.col("user_id").alias("n"))).alias("j"))
    return src.flatten_json(e, ["event_id"], F.col("j"))


LEAVES = "select event_id, 'event_type' as key, event_type as value from events union all select event_id, 'inner.list[0]', props from events where props is not null union all select event_id, 'inner.list[1]', event_type from events"


def notebook_cells(spark, d) -> DataFrame:
    cell = F.struct(F.lit("code").alias("cell_type"), F.array(F.lit("x = 1\n"), F.col("o_orderstatus")).alias("source"), F.array(F.struct(F.array(F.col("o_orderpriority")).alias("text"))).alias("outputs"))
    note = F.struct(F.lit("markdown").alias("cell_type"), F.array(F.lit("text"), F.lit("")).alias("source"), F.array(F.struct(F.array(F.lit("")).alias("text"))).alias("outputs"))
    o = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.array(note, cell).alias("cells"))).alias("j"))
    return src.notebook(o, F.concat(F.lit("nb"), F.col("o_orderkey").cast("string")), F.col("j")).select("path", "text")


CELLS_NB = "select 'notebook://nb' || o_orderkey::varchar || ':cell[1]' as path, 'x = 1' || chr(10) || o_orderstatus || chr(10) || o_orderpriority as text from orders"


def chat_messages(spark, d) -> DataFrame:
    return src.messages(table(spark, d, "conversations"), "slack", ["role", "conv_id", "turn"], "text").select("path", F.md5(F.col("text").cast("binary")).alias("digest"), "size")


CHAT = "select 'slack://' || role || '/' || conv_id::varchar || '/' || turn::varchar as path, md5(text) as digest, strlen(text)::bigint as size from conversations where text <> ''"


def csv_report(spark, d) -> DataFrame:
    return report.csv_lines(findings(spark, d))


CSV = f"""with f as ({FINDINGS}) select rule_id || ',' || severity || ',' || printf('%.4f', confidence::double) || ',' || path || ',' || line_no::varchar || ',0,' || secret_redacted || ',"' || replace(remediation, '"', '""') || '"' as line from f"""


def sarif_results(spark, d) -> DataFrame:
    r = report.sarif_results(findings(spark, d))
    get = lambda p: F.get_json_object("result", p)
    return r.select(get("$.ruleId").alias("rule"), get("$.level").alias("level"), get("$.message.text").alias("message"), get("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"), get("$.locations[0].physicalLocation.region.startLine").alias("line"))


SARIF = f"""select rule_id as rule, case when severity in ('critical', 'high') then 'error' when severity = 'medium' then 'warning' else 'note' end as level, description || ' — Confidence: ' || printf('%.0f', confidence::double * 100) || '%' as message, path as uri, line_no::varchar as line from ({FINDINGS})"""


def json_report(spark, d) -> DataFrame:
    """One row per rule: a JSON document of its findings' counts, as a consumer would read it back."""
    j = report.json_rows(findings(spark, d))
    return j.select(F.get_json_object("json", "$.rule_id").alias("rule_id"), F.get_json_object("json", "$.severity").alias("severity")).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def scan_stats(spark, d) -> DataFrame:
    f = findings(spark, d)
    return ops.scan_stats(table(spark, d, "documents"), f, ops.least_severity(f, "medium"))


STATS = f"with f as ({FINDINGS}) select (select count(*) from documents) as fragments, (select sum(strlen(text))::bigint from documents) as bytes, count(*) as matches, count(distinct rule_id) as rules_hit, count(*) filter (severity in ('medium', 'high', 'critical')) as findings, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high from f"


def prf1_metrics(spark, d) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", evaluate.looks_toxic(F.col("text")).alias("said")), "doc_id")
    return evaluate.with_scores(j.agg(F.count_if(F.col("said") & (F.col("toxic") == 1)).alias("tp"), F.count_if(F.col("said") & (F.col("toxic") == 0)).alias("fp"), F.count_if(~F.col("said") & (F.col("toxic") == 1)).alias("fn")))


PRF1 = f"""with j as (select {sql.any_of('lower(text)', ['idiot', 'stupid', 'worthless', 'pathetic'])} as said, toxic from labels join documents using (doc_id)),
c as (select count(*) filter (said and toxic = 1) as tp, count(*) filter (said and toxic = 0) as fp, count(*) filter (not said and toxic = 1) as fn from j)
select *, case when tp + fp = 0 then 0 else round(tp / (tp + fp), 6) end::double as "precision", case when tp + fn = 0 then 0 else round(tp / (tp + fn), 6) end::double as recall, case when 2 * tp + fp + fn = 0 then 0 else round(2 * tp / (2 * tp + fp + fn), 6) end::double as f1 from c"""


def error_clusters(spark, d) -> DataFrame:
    return evaluate.error_clusters(findings(spark, d).select(F.col("path").alias("file"), F.concat("rule_id", F.when(F.col("rank") < 2, "-api-key").when(F.col("rank") < 4, "-password").otherwise("")).alias("kind")), 1000)


def _clusters() -> str:
    from .value_queries import _CONTEXTS

    lo = "lower(path)"
    ext = f"regexp_extract(string_split({lo}, '/')[-1], '^.+(\\.[^.]+)$', 1)"
    return f"""with f as (select path, rule_id || case when rank < 2 then '-api-key' when rank < 4 then '-password' else '' end as kind from ({FINDINGS}))
select case when contains(kind, 'password') then 'password' when contains(kind, 'api') and contains(kind, 'key') then 'api_key' else 'other' end as family, case when {ext} = '' then '<none>' else {ext} end as extension,
  {sql.case([(f"list_has_any(string_split({lo}, '/'), {[*names.split('|')]})", sql.lit(k)) for k, names in _CONTEXTS.items()], "'other'")} as context, count(*) as n from f group by all"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    f = findings(spark, d).select(F.col("path").alias("file"), F.col("line_no").alias("line"), F.col("rule_id").alias("kind"), "start")
    return f.where("start % 2 = 0").select("file", "line", "kind").distinct(), f.where("start % 3 = 0").select("file", (F.col("line") + 1).alias("line"), "kind").distinct()


def line_tolerance_join(spark, d) -> DataFrame:
    return evaluate.candidate_pairs(*_sides(spark, d), 1)


TOLERANCE = f"""with f as ({FINDINGS}), l as (select distinct path as file, line_no as line, rule_id as kind from f where start % 2 = 0), r as (select distinct path as file, line_no + 1 as line, rule_id as kind from f where start % 3 = 0)
select l.file, l.line as l_line, l.kind as l_kind, r.line as r_line, r.kind as r_kind, abs(l.line - r.line) as distance from l join r on l.file = r.file and abs(l.line - r.line) <= 1"""


def greedy_match(spark, d) -> DataFrame:
    return evaluate.metrics(evaluate.greedy_match(*_sides(spark, d)))


def tool_comparison(spark, d) -> DataFrame:
    return evaluate.compare_tools(*_sides(spark, d))


def markov_trigram_table(spark, d) -> DataFrame:
    return evaluate.trigram_table(table(spark, d, "documents"), "text")


TRIGRAMS = """with k as (select regexp_replace(text, '[^A-Za-z0-9_-]', '', 'g') as x from documents), g as (select substr(x, i::bigint, 3) as trigram from k, unnest(range(1, length(x) - 1)) as r(i) where length(x) >= 3),
a as (select substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-', i, 1) as l from range(1, 65) as r(i)), whole as (select x.l || y.l || z.l as trigram from a x, a y, a z),
seen as (select trigram, count(*) as n from g group by trigram), c as (select trigram, coalesce(n, 0) as n from whole left join seen using (trigram)), p as (select substr(trigram, 1, 2) as pair, sum(n) as total from c group by 1)
select trigram, n, round(least(greatest(log2((n + 0.01)::double / (total + 0.01 * 64)::double), -20), -1), 6) as log2p from c join p on p.pair = substr(c.trigram, 1, 2)"""


def _attempts(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("provider"), "ts", (F.col("event_id") % 4 == 0).alias("ok"))


def breaker(spark, d) -> DataFrame:
    return jobs.breaker_batch(_attempts(spark, d)).groupBy("provider", "state").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


def rate_limit(spark, d) -> DataFrame:
    return jobs.limit_batch(_attempts(spark, d).drop("ok"), 0.001, 3).groupBy("provider").agg(F.count_if("allowed").alias("n_allowed"), F.count("*").alias("n"))


def event_windows(spark, d) -> DataFrame:
    c = jobs.event_counts(table(spark, d, "events"))
    return c.select(F.col("window.start").alias("begins"), "event_type", "n")


QUERIES = {
    "dedup_best": dedup_best, "dedup_first": dedup_first, "severity_summary": severity_summary, "severity_filter": severity_filter, "findings_sorted": findings_sorted, "findings_sorted_all": findings_sorted_all, "chains_by_variable": chains_by_variable, "chains_by_value": chains_by_value, "chains_applied": chains_applied,
    "baseline_new_findings": baseline_new_findings, "baseline_changed_files": baseline_changed_files, "baseline_state": baseline_state, "rule_override": rule_override, "rule_buckets": rule_buckets, "rules_listed": rules_listed, "db_cells_to_fragments": db_cells_text, "db_cells_all": db_cells,
    "diff_added_lines": diff_added_lines, "git_patches": git_patches, "dotenv_parse": dotenv_parse, "json_leaves": json_leaves, "notebook_cells": notebook_cells, "chat_messages": chat_messages, "csv_report": csv_report, "sarif_results": sarif_results, "json_report": json_report,
    "scan_stats": scan_stats, "prf1_metrics": prf1_metrics, "error_clusters": error_clusters, "line_tolerance_join": line_tolerance_join, "greedy_match": greedy_match, "tool_comparison": tool_comparison, "markov_trigram_table": markov_trigram_table,
    "circuit_breaker": breaker, "rate_limit": rate_limit, "event_windows": event_windows,
}
ORACLE_SQL = {
    "dedup_best": DEDUP_BEST, "dedup_first": DEDUP_FIRST, "severity_summary": f"select severity, count(*) as n, max(confidence) as max_confidence from ({FINDINGS}) group by severity",
    "severity_filter": f"select id, severity, confidence from ({FINDINGS}) where severity in ('high', 'critical') and confidence >= 0.5", "findings_sorted": SORTED, "findings_sorted_all": SORTED_ALL, "chains_by_variable": CHAIN_VARS, "chains_by_value": CHAIN_VALUES, "chains_applied": CHAIN_APPLIED,
    "baseline_new_findings": BASELINE, "baseline_changed_files": CHANGED, "baseline_state": STATE, "rule_override": OVERRIDE, "rule_buckets": BUCKETS, "rules_listed": LISTED, "db_cells_to_fragments": CELLS, "diff_added_lines": ADDED, "git_patches": PATCHES, "dotenv_parse": DOTENV,
    "json_leaves": LEAVES, "notebook_cells": CELLS_NB, "chat_messages": CHAT, "csv_report": CSV, "sarif_results": SARIF, "json_report": f"select rule_id, severity, count(*) as n from ({FINDINGS}) group by all", "scan_stats": STATS, "prf1_metrics": PRF1, "error_clusters": _clusters(),
    "line_tolerance_join": TOLERANCE, "markov_trigram_table": TRIGRAMS, "event_windows": "select date_trunc('hour', ts) as begins, event_type, count(*) as n from events group by all",
}
