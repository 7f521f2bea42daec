"""Rules: loading, checking, overriding, and the bridge from rules to buckets."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalar import SEVERITIES, any_of, severity_rank

BUILTIN = Path(__file__).parent.parent / "rules" / "builtin.toml"
_SCHEMA = "id string, description string, regex string, secret_group_regex string, keywords array<string>, severity string, category string, tags array<string>, allowlist array<string>, entropy_threshold double, confidence_weight double, validation_provider string, remediation string, ord int"


@dataclass
class Rule:
    id: str
    description: str
    regex: str
    secret_group_regex: str | None = None
    keywords: list[str] = field(default_factory=list)
    severity: str = "medium"
    category: str = "generic"
    tags: list[str] = field(default_factory=list)
    allowlist: list[str] = field(default_factory=list)
    entropy_threshold: float | None = None
    confidence_weight: float | None = None
    validation_provider: str | None = None
    remediation: str | None = None


def rule_format(text: str) -> str:
    """native, gitleaks or betterleaks, by what stands in the file."""
    return "native" if "gpu_hint" in text or "markov_threshold" in text else "gitleaks" if re.search(r"(?m)^\s*title\s*=", text) else "betterleaks"


def parse_rules(text: str) -> tuple[list[Rule], list[str]]:
    """Rules of a TOML file in any of the formats, and what is wrong with the others. Unknown keys are passed over."""
    spec, rules, errors = tomllib.loads(text), [], []
    for n, raw in enumerate(spec.get("rules", [])):
        allow = raw.get("allowlist", [])
        if isinstance(allow, dict):
            allow = allow.get("regexes", [])
        entropy = raw.get("entropy_threshold", raw.get("entropy"))
        try:
            rule = Rule(
                raw["id"], raw.get("description") or raw.get("title") or "", raw["regex"], raw.get("secret_group_regex"), list(raw.get("keywords", [])), raw.get("severity", "medium").lower(), raw.get("category", "generic"),
                list(raw.get("tags", [])), list(allow), float(entropy) if entropy is not None else None, raw.get("confidence_weight"), raw.get("validation_provider"), raw.get("remediation"),
            )
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            errors.append(f"rule {n}: {e!r}")
            continue
        problem = rule_problem(rule)
        (errors.append(f"{rule.id}: {problem}") if problem else rules.append(rule))
    return rules, errors


def rule_problem(rule: Rule) -> str | None:
    if rule.severity not in SEVERITIES:
        return f"severity {rule.severity}"
    for pattern in [rule.regex, *([rule.secret_group_regex] if rule.secret_group_regex else []), *rule.allowlist]:
        if nested_quantifier(pattern):
            return "a quantified group repeats within itself"
        try:
            compiled(pattern)
        except Exception as e:
            return f"pattern does not compile: {e}"
    return None


def nested_quantifier(pattern: str) -> bool:
    """Whether a group that is itself repeated holds an unbounded repeat at its own level, a shape that can backtrack without end."""
    unbounded, i, in_class = [False], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] in ("]", "^"):
                i += 2 if pattern[i + 1 : i + 3] == "^]" else 1
        elif c == "(":
            unbounded.append(False)
        elif c == ")" and len(unbounded) > 1:
            if unbounded.pop() and pattern[i + 1 : i + 2] in ("+", "*", "?", "{"):
                return pattern[i + 1] != "?" or pattern[i + 2 : i + 3] in ("+", "*")
        elif c in "+*":
            unbounded[-1] = True
        i += 1
    return False


def compiled(pattern: str):
    """The pattern, with flags inside it moved to where they hold. Under `re`, or under `regex` where `re` lacks something."""
    p = pattern.replace(r"\z", r"\Z")
    for m in reversed([m for m in re.finditer(r"(?<!\\)\(\?([imsx]+)\)", p) if m.start() > 0]):
        p = p[: m.start()] + f"(?{m[1]}:" + p[m.end() :] + ")"
    if "[:" not in p:
        try:
            return re.compile(p)
        except re.error:
            pass
    import regex

    return regex.compile(p)


def to_java(pattern: str) -> str:
    """The pattern for Spark's rlike and regexp functions."""
    names = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "xdigit": r"\p{XDigit}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\p{Space}", "punct": r"\p{Punct}"}
    p = re.sub(r"\[:(\w+):\]", lambda m: names.get(m[1], m[0]), pattern)
    return p.replace("(?P<", "(?<")


def load_rules(spark: SparkSession, *texts: str, builtin: bool = True) -> DataFrame:
    """All rules as a table, in order; a later file's rule takes the place of an earlier one with its id."""
    files = [BUILTIN.read_text(encoding="utf-8")] if builtin else []
    by_id: dict[str, Rule] = {}
    for text in [*files, *texts]:
        for rule in parse_rules(text)[0]:
            by_id.pop(rule.id, None)
            by_id[rule.id] = rule
    # From Arrow, so that the table is part of the plan and reading it takes no job.
    return spark.createDataFrame(pa.Table.from_pylist([asdict(r) | {"ord": k} for k, r in enumerate(by_id.values())], to_arrow_schema(StructType.fromDDL(_SCHEMA))))


def rule_texts(path: str | Path) -> list[str]:
    """The text of a rule file, or of all TOML files in a folder and those below it, by path."""
    path = Path(path)
    return [f.read_text(encoding="utf-8") for f in (sorted(path.rglob("*.toml")) if path.is_dir() else [path])]


def override(rules: DataFrame, later: DataFrame) -> DataFrame:
    """rules with those of `later` in the place of the same ids."""
    return rules.join(later.select("id"), "id", "left_anti").unionByName(later)


def list_rules(rules: DataFrame, category: str | None = None, least_severity: str | None = None) -> DataFrame:
    if category:
        rules = rules.where(F.col("category") == category)
    if least_severity:
        rules = rules.where(severity_rank(F.col("severity")) >= SEVERITIES.index(least_severity))
    return rules


def rule_buckets(rules: DataFrame) -> DataFrame:
    """(bucket, id): buckets of each rule, by words of its id and keywords; a rule is in as many as fit."""
    i, k = F.lower("id"), F.lower(F.array_join("keywords", " "))
    # Words of ids and of keywords for each bucket.
    tests = {
        "api_key": any_of(i, ["api-key", "secret-key", "access-key", "client-secret", "client-id", "oauth", "webhook", "hmac", "signing-key", "session-secret"]) | any_of(k, ["x-api-key", "api-key", "access key"]),
        "password": any_of(i, ["password", "smtp"]) | any_of(k, ["password", "passwd"]),
        "token": any_of(i, ["token", "secret", "oauth", "jwt", "bearer", "session-secret", "webhook", "hmac"]) | any_of(k, ["token", "secret"]),
        "auth_header": any_of(i, ["bearer", "jwt", "auth", "header", "cookie", "session"]) | any_of(k, ["bearer", "authorization", "cookie"]),
        "code_assignments": any_of(i, ["generic", "assignment", "password", "token", "api-key", "secret", "oauth", "client", "access-key"]),
        "config_assignments": any_of(i, ["generic", "assignment", "password", "token", "env", "config", "url", "credential"]),
        "url_credentials": any_of(i, ["url", "database-url", "credentials"]),
        "private_key": any_of(i, ["private-key", "pem", "signing-key"]),
        "nonce_like": i.contains("nonce"),
        "keywordless": F.size("keywords") == 0,
    }
    names = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in tests.items())), lambda b: b.isNotNull())
    return rules.select("id", F.explode(names).alias("bucket"))


def as_json(rules: DataFrame) -> str:
    """Rules for the matcher; the table is bounded by what people write."""
    return json.dumps([r.asDict() for r in sorted(rules.collect(), key=lambda r: r["ord"])])
