"""Reports: JSON, CSV, SARIF and a table for people. None has a column for the secret itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import confidence_bar, csv_escape, sarif_level, severity_rank

CSV_HEADER = "rule_id,severity,confidence,path,line,column,match,remediation"
TOOL = "credsieve"


def csv_lines(findings: DataFrame, path_col: str = "path") -> DataFrame:
    """(line) for each finding, without the header."""
    cells = [F.col("rule_id"), F.col("severity"), F.format_string("%.4f", "confidence"), F.col(path_col), F.col("line_no").cast("string"), F.lit("0"), F.col("secret_redacted"), F.coalesce("remediation", F.lit(""))]
    return findings.select(F.concat_ws(",", *(csv_escape(c) for c in cells)).alias("line"))


def json_rows(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))


def json_report(findings: DataFrame) -> DataFrame:
    """One row with the whole report, for results that fit one; json_rows() is what scales."""
    return findings.agg(F.to_json(F.struct(F.collect_list(F.struct(*findings.columns)).alias("findings"), F.count("*").alias("count"))).alias("json"))


def sarif_results(findings: DataFrame, path_col: str = "path") -> DataFrame:
    """A row per result of a SARIF 2.1.0 run: the result as JSON, with what it is sorted by."""
    place = F.struct(F.struct(F.struct(F.replace(F.col(path_col), F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine"), F.lit(1).alias("startColumn")).alias("region")).alias("physicalLocation"))
    message = F.concat(F.col("description"), F.lit(" — Confidence: "), F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%"))
    result = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(message.alias("text")).alias("message"), F.array(place).alias("locations"), F.create_map(F.lit("secret-hash/v1"), F.col("secret_hash")).alias("partialFingerprints"))
    return findings.select("rule_id", path_col, "line_no", F.to_json(result).alias("result"))


def sarif_rules(findings: DataFrame, path_col: str = "path") -> DataFrame:
    """Distinct rules with the description and level of the first finding by path, place and severity."""
    first = F.min(F.struct(F.col(path_col), F.col("line_no"), F.col("severity"), F.col("description")))
    return findings.groupBy("rule_id").agg(first.alias("first")).select("rule_id", F.col("first.description").alias("description"), sarif_level(F.col("first.severity")).alias("level"))


def sarif_report(findings: DataFrame) -> DataFrame:
    """One row with the whole document."""
    body = sarif_results(findings).agg(F.array_join(F.array_sort(F.collect_list("result")), ",").alias("r"))
    rules = sarif_rules(findings).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription"))))).alias("rules"))
    return body.crossJoin(rules).select(F.concat(F.lit('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"' + TOOL + '","rules":'), "rules", F.lit('}},"results":['), "r", F.lit("]}]}")).alias("json"))


def table_rows(findings: DataFrame, path_col: str = "path") -> DataFrame:
    return findings.select(
        severity_rank(F.col("severity")).alias("rank"), F.upper("severity").alias("severity"), confidence_bar(F.col("confidence")).alias("bar"), F.format_string("%.0f%%", F.col("confidence") * 100).alias("percent"),
        "rule_id", F.concat_ws(":", path_col, F.col("line_no").cast("string")).alias("place"), "secret_redacted", "remediation",
    )
