"""From matches to findings: scoring, suppression, redaction, deduplication, order, chains, baselines, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markov import markov_score
from ..functions.scalar import finding_hash, finding_id, hmac_sha256, provider_of, redact, remediation_of, severity_rank, variable_name
from . import discovery, paths, scoring

# Precedence of kinds; a catch-all has 1 at most.
KIND_RANK = {"PrivateKey": 6, "ApiKeyAssignment": 5, "PasswordAssignment": 5, "UrlCredentials": 4, "TokenAssignment": 4, "BearerAuth": 3, "Jwt": 3, "NonceLike": 2, "Catchall": 1, "Unknown": 0}
CHAIN_BOOST = 0.20


def kind_rank(kind: Column, catchall: Column) -> Column:
    out = F.lit(0)
    for name, r in KIND_RANK.items():
        out = F.when(kind == name, r).otherwise(out)
    return F.when(catchall, F.least(out, F.lit(1))).otherwise(out)


def infer_kind(rule_id: Column, secret: Column, line: Column) -> Column:
    """Of a direct match, from the rule's name, else from the line."""
    r = F.lower(rule_id)
    identifier = F.coalesce(variable_name(line), F.lit(""))
    return (
        F.when(r.contains("private-key"), "PrivateKey").when(r.contains("jwt"), "Jwt").when(r.contains("bearer") | r.contains("auth-header"), "BearerAuth").when(r.contains("url"), "UrlCredentials")
        .when(r.contains("password"), "PasswordAssignment").when(r.contains("key"), "ApiKeyAssignment").when(r.contains("token"), "TokenAssignment").otherwise(discovery.match_kind(identifier, secret, line))
    )


def score_matches(matches: DataFrame, rules: DataFrame, path_col: str = "path", key: bytes = b"credsieve", threshold: float = 0.5) -> DataFrame:
    """Findings: matches joined with their rule, scored, without hard negatives and those under the threshold. The secret
    itself is gone; its keyed hash and its redacted form stay.

    Matches of routed candidates bring the candidate's evidence, scores and context in columns of their own (see match_routed);
    for direct ones, evidence follows from the rule and the line, and the rule's weight stands for streams and pattern.
    """
    dims = F.broadcast(rules.select(F.col("id").alias("rule_id"), "description", "severity", "category", "remediation", F.coalesce("confidence_weight", F.lit(1.0)).alias("weight")))
    m = matches.join(dims, "rule_id")
    line, secret, path, weight = F.col("line"), F.col("secret"), F.col(path_col), F.col("weight")
    brought = lambda name, otherwise: F.coalesce(F.col(name), otherwise) if name in matches.columns else otherwise
    m = m.withColumn("kind", brought("routed_kind", infer_kind(F.col("rule_id"), secret, line))).withColumn("variable", brought("identifier", variable_name(line)))
    assigned = line.contains("=") | line.contains(":")
    # Columns of their own, as the expressions below name them often.
    held = {
        "_assigned": assigned, "_typed": brought("typed", F.col("variable").isNotNull() & assigned), "_secret_identifier": brought("has_secret_identifier", F.coalesce(discovery.looks_secret(F.col("variable")), F.lit(False))),
        "_secondary": brought("secondary_context", discovery.secondary_context(line)), "_multiline": brought("multiline", secret.contains("\n")),
        "_auth": brought("has_auth_context", F.lower(line).rlike("authorization|bearer|x-api-key|cookie")), "_catchall": F.lower("rule_id").contains("catchall"),
    }
    m = m.withColumns(held).withColumn("markov", F.round(markov_score(secret), 6))
    e = {
        "typed": F.col("_typed"), "has_assignment": F.col("_assigned"), "has_secret_identifier": F.col("_secret_identifier"), "secondary_context": F.col("_secondary"), "private_key_like": F.col("kind") == "PrivateKey",
        "multiline": F.col("_multiline"), "has_auth_context": F.col("_auth"), "generic_catchall": F.col("_catchall"), "kind": F.col("kind"), "value_entropy": F.col("entropy"), "pattern": brought("pattern", F.lit("Assignment")),
    }
    nothing = F.lit(0.0)
    streams = brought("tristream", weight)
    base = scoring.fuse(brought("candidate_entropy", nothing), brought("proximity", nothing), streams, F.col("markov"), weight)
    identifiers = F.when(F.col("variable").isNotNull(), F.array("variable"))
    # The lesser of what the value and its context say; direct matches have no context.
    context = F.coalesce(F.col("snippet"), F.lit("")) if "snippet" in matches.columns else F.lit("")
    m = m.withColumns({"_fused": scoring.adjust(base, path, identifiers, scoring.evidence_adjustment(path, e)), "penalty": F.least(scoring.hard_negative_penalty(secret), scoring.hard_negative_penalty(context))})
    strong = e["has_secret_identifier"] | e["secondary_context"].isNotNull() | e["multiline"] | e["has_auth_context"] | F.col("kind").isin("PrivateKey", "Jwt", "BearerAuth", "UrlCredentials")
    m = m.withColumn("confidence", F.round(scoring.hard_negative_decision(F.col("_fused"), F.col("penalty"), e["typed"], strong, e["generic_catchall"], path), 6))
    # Exploded and not filtered: a filter is pushed below the join, and all the expressions above go along, written out at each use.
    m = m.select("*", F.explode(F.when(F.col("confidence") >= threshold, F.array(F.lit(True)))).alias("_kept"))
    m = m.withColumn("secret_hash", hmac_sha256(secret, key)).withColumn("secret_redacted", redact(secret)).withColumn("secret_length", F.length("secret"))
    m = m.withColumn("id", finding_id(F.col("rule_id"), F.col("secret_hash"), path, F.col("start"))).withColumn("rank", kind_rank(F.col("kind"), e["generic_catchall"]))
    m = m.withColumn("remediation", F.coalesce("remediation", remediation_of(F.col("rule_id")))).withColumn("provider", provider_of(F.col("rule_id")))
    return m.withColumn("line_span", F.length("line") - F.length(F.replace("line", F.lit("\n"), F.lit("")))).drop("secret", "line", "snippet", "value", "weight", *held, "_fused", "_kept")


def _by_id(findings: DataFrame) -> list[Column]:
    """Last in an order, so that equal findings do not come as partitions happen to; nothing where there are no ids."""
    return [F.col("id")] if "id" in findings.columns else []


def dedup_best(findings: DataFrame, path_col: str = "path") -> DataFrame:
    """One finding for each secret and path: of the highest precedence, then confidence, then over the fewest lines, then the
    first, then the least id. line_span: lines beyond the first that the match touches; one line each if there is no such column."""
    span = F.col("line_span") if "line_span" in findings.columns else F.lit(0)
    order = [F.col("rank").desc(), F.col("confidence").desc(), span, F.col("start"), F.col("rule_id"), *_by_id(findings)]
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy("secret_hash", path_col).orderBy(*order))).where("_n = 1").drop("_n")


def dedup_first(findings: DataFrame, path_col: str = "path") -> DataFrame:
    """The first finding of each rule, secret and path."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id", "secret_hash", path_col).orderBy("start"))).where("_n = 1").drop("_n")


def in_order(findings: DataFrame, path_col: str = "path") -> DataFrame:
    """The most severe first, then the surest, then by path, place, rule and id."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), path_col, "start", "rule_id", *_by_id(findings))


def least_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(severity)))


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"), F.max("confidence").alias("max_confidence"))


def variable_chains(findings: DataFrame, path_col: str = "path") -> DataFrame:
    """Variables found under two paths or more: origin (first by path, line, place), what propagates it and what uses it."""
    ref = F.struct(F.col(path_col).alias("path"), F.col("line_no").alias("line"), F.col("start").alias("start"), F.col("id").alias("id"), paths.propagates(F.col(path_col)).alias("p"), F.col("secret_hash").alias("h"))
    g = findings.where("variable is not null").groupBy("variable").agg(F.array_sort(F.collect_list(ref)).alias("refs"), F.count_distinct(path_col).alias("n_paths")).where("n_paths >= 2")
    rest = F.slice("refs", 2, 1_000_000_000)
    pick = lambda yes: F.transform(F.filter(rest, lambda r: r["p"] == yes), lambda r: r["id"])
    return g.select(F.col("variable").alias("variable_name"), F.col("refs")[0]["id"].alias("origin_id"), pick(True).alias("propagation_ids"), pick(False).alias("usage_ids"), F.lit(CHAIN_BOOST).alias("chain_confidence"), F.transform("refs", lambda r: r["h"]).alias("hashes"))


def value_chains(findings: DataFrame, by_variable: DataFrame | None = None, path_col: str = "path") -> DataFrame:
    """Secrets found under two paths or more that are in no variable chain."""
    if by_variable is not None:
        findings = findings.join(by_variable.select(F.explode("hashes").alias("secret_hash")).distinct(), "secret_hash", "left_anti")
    ref = F.struct(F.col("start").alias("start"), F.col(path_col).alias("path"), F.col("id").alias("id"))
    g = findings.groupBy("secret_hash").agg(F.array_sort(F.collect_list(ref)).alias("refs"), F.count_distinct(path_col).alias("n_paths")).where("n_paths >= 2")
    return g.select(F.substring("secret_hash", 1, 8).alias("variable_name"), F.col("refs")[0]["id"].alias("origin_id"), F.array().cast("array<string>").alias("propagation_ids"), F.transform(F.slice("refs", 2, 1_000_000_000), lambda r: r["id"]).alias("usage_ids"), F.lit(CHAIN_BOOST).alias("chain_confidence"))


def apply_chains(findings: DataFrame, chains: DataFrame) -> DataFrame:
    """Findings with the boosts of all chains they are in and the name of the last one."""
    members = chains.select("variable_name", "chain_confidence", F.explode(F.array_distinct(F.concat(F.array("origin_id"), "propagation_ids", "usage_ids"))).alias("id"))
    boost = members.groupBy("id").agg(F.sum("chain_confidence").alias("_boost"), F.max("variable_name").alias("chain"))
    return findings.join(boost, "id", "left").withColumn("confidence", F.least(F.lit(1.0), F.round(F.col("confidence") + F.coalesce("_boost", F.lit(0.0)), 6))).drop("_boost")


def new_findings(findings: DataFrame, known: DataFrame, suppressed: DataFrame | None = None, path_col: str = "path") -> DataFrame:
    """Findings whose hash is neither known nor suppressed; both are tables of finding_hash."""
    out = findings.withColumn("finding_hash", finding_hash(F.col("rule_id"), F.col("secret_hash"), F.col(path_col))).join(known.select("finding_hash"), "finding_hash", "left_anti")
    return out if suppressed is None else out.join(suppressed.select("finding_hash"), "finding_hash", "left_anti")


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, content_hash) that the state lacks or has with another hash."""
    return files.join(state, ["path", "content_hash"], "left_anti")


def prune_state(state: DataFrame, files: DataFrame) -> DataFrame:
    return state.join(files.select("path"), "path", "left_semi")


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def scan_stats(fragments: DataFrame, matches: DataFrame, findings: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of totals."""
    a = fragments.agg(F.count("*").alias("fragments"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("long").alias("bytes"))
    b = matches.agg(F.count("*").alias("matches"), F.count_distinct("rule_id").alias("rules_hit"))
    c = findings.agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return a.crossJoin(b).crossJoin(c)


def exit_code(findings: DataFrame, fail_on: str) -> int:
    return 0 if least_severity(findings, fail_on).isEmpty() else 1
