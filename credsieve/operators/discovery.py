"""Typed candidates: assignments, headers, URLs with credentials and key blocks found in lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.entropy import shannon_entropy
from ..functions.scalar import any_of, contains_any, starts_with_any
from . import paths

_IDENT = r"[A-Za-z_][A-Za-z0-9_.-]{1,80}"

# What each extractor looks for in a line, with the groups of identifier and value and the pattern's name, in order of emission.
EXTRACTORS = [
    ("assignment", rf"(?i)\b({_IDENT})\b\s*(=|:=)\s*[\"']?([^\s\"'`#;]{{6,256}})[\"']?", 1, 3, "Assignment"),
    ("export", rf"(?i)\bexport\s+({_IDENT})\b\s*=\s*[\"']?([^\s\"'`#;]{{6,256}})[\"']?", 1, 2, "Export"),
    ("docker_env", rf"(?i)\b(?:env|arg|set)\s+({_IDENT})\b\s*[=:]\s*[\"']?([^\s\"'`#;]{{6,256}})[\"']?", 1, 2, "DockerEnv"),
    ("key_value", rf"(?i)[\"']?({_IDENT})[\"']?\s*:\s*[\"']?([^\"'#,}}\]\s][^\"'#,}}\]]{{5,256}})[\"']?", 1, 2, None),
    ("argument", rf"(?i)\b({_IDENT})\b\s*=\s*[\"']?([A-Za-z0-9_./+=:@-]{{6,256}})[\"']?\s*[,)\]}}]", 1, 2, "FunctionArg"),
    ("setenv", rf"(?i)\b(?:setenv|set_env|putenv|setproperty|set_property)\s*\(\s*[\"']({_IDENT})[\"']\s*,\s*[\"']([^\"'`]{{6,256}})[\"']\s*\)", 1, 2, "FunctionArg"),
    ("header", r"(?i)\b(authorization|x-api-key|x-auth-token|x-access-token|cookie|set-cookie)\b\s*[:=]\s*[\"']?([^\"'`]{8,512})[\"']?", 1, 2, "HeaderValue"),
]
# URLs with credentials, key blocks, bearer headers and here-documents.
URL_CREDENTIALS = r"(?i)((?:postgres(?:ql)?|mysql|mariadb|mssql|mongodb|redis|amqp|rabbitmq|https?)://[A-Za-z0-9_.~-]{1,64}:([^@\s'\"`]{4,128})@[A-Za-z0-9._:/-]{1,253})"
PEM = r"(?s)-----BEGIN [A-Z0-9 ]+PRIVATE KEY-----.*?-----END [A-Z0-9 ]+PRIVATE KEY-----"
BEARER = r"(?is)(authorization\s*:\s*bearer\s+[A-Za-z0-9._=-]{12,512})"
HEREDOC = r"(?s)([A-Za-z_][A-Za-z0-9_]{1,80})=<<[-~]?([A-Za-z_]{1,32})[^\n]*\n(.*?)\n\2"

# Words and value starts that make a line worth a closer look.
SECRETISH = ["password", "passwd", "pwd", "secret", "token", "credential", "client_id", "clientid", "oauth", "auth", "signing", "consumer", "refresh", "session", "cookie", "x-api-key", "x-auth-token", "set-cookie", "header", "license", "api_key", "apikey", "access_key", "client_secret", "session_secret", "private_key", "database_url", "webhook", "hmac", "jwt", "bearer", "nonce", "app_secret", "privatekey"]
HIGH_SIGNAL = ["ghp_", "ghs_", "glpat-", "xoxb-", "xoxp-", "xoxa-2-", "xoxr-", "sk_live_", "sk_test_", "github_pat_", "sg.", "ya29.", "akia", "asia", "aiza", "authorization: bearer", "begin private key", "://"]
CALLS = ["setenv(", "set_env(", "putenv(", "setproperty(", "set_property("]
# Values that are no secret, and their starts.
NO_SECRET = ["true", "false", "null", "undefined", "changeme", "password", "secret", "token"]
NO_SECRET_STARTS = ["${", "$(", "<", "{{", "your_", "example", "placeholder"]
# The ladder from identifier to kind, and starts of values of known kinds.
API_KEYS = ["apikey", "clientsecret", "secretkey", "accesskey", "clientid", "consumerkey", "signingsecret", "licensekey", "publickey", "apikeyid", "privatekeyid", "webhooksecret", "hmacsecret", "signingkey", "appsecret"]
TOKENS = ["token", "secret", "sessionsecret", "oauth", "oidc", "credential", "auth", "sessionid", "cookie", "refresh"]
TOKEN_STARTS = ["ghp_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-2-", "xoxr-", "sg.", "sq0atp-", "ya29."]
KEY_STARTS = ["sk_live_", "sk_test_", "rk_live_"]
CLOUD_STARTS = ["AKIA", "ASIA", "A3T", "AIza"]
SECRET_IDENTIFIERS = ["password", "passwd", "pwd", "secret", "token", "apikey", "accesskey", "clientsecret", "clientid", "credential", "auth", "consumer", "signing", "license", "session", "cookie", "refresh", "header", "webhook", "privatekey", "nonce"]
CONTEXTS = ["oauth", "github", "gitlab", "stripe", "slack", "database", "jwt", "bearer", "private key", "x-api-key", "authorization", "cookie", "session", "webhook"]


def normal_identifier(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))


def line_prefilter(line: Column) -> Column:
    low = F.lower(line)
    shape = line.contains("=") | line.contains(":") | contains_any(low, CALLS)
    return (F.octet_length(line) <= 512) & shape & (contains_any(low, SECRETISH) | contains_any(low, HIGH_SIGNAL))


def plausible(value: Column) -> Column:
    low = F.lower(value)
    return (F.length(value) >= 6) & ~low.isin(NO_SECRET) & ~starts_with_any(low, NO_SECRET_STARTS)


def looks_secret(identifier: Column) -> Column:
    return any_of(normal_identifier(identifier), SECRET_IDENTIFIERS)


def is_jwt(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{8,}$")


def value_kind(value: Column, line: Column) -> Column:
    v, low = F.lower(value), F.lower(line)
    return (
        F.when(starts_with_any(v, KEY_STARTS), "ApiKeyAssignment").when(starts_with_any(v, TOKEN_STARTS), "TokenAssignment").when(starts_with_any(value, CLOUD_STARTS), "ApiKeyAssignment").when(is_jwt(value), "Jwt")
        .when(value.contains("://") & value.contains("@"), "UrlCredentials").when(low.contains("authorization: bearer") | v.startswith("bearer "), "BearerAuth")
        .when(low.contains("begin private key") | v.contains("begin private key"), "PrivateKey").otherwise("Unknown")
    )


def match_kind(identifier: Column, value: Column, line: Column) -> Column:
    n, low, v = normal_identifier(identifier), F.lower(line), F.lower(value)
    return (
        F.when(n.contains("privatekey") | low.contains("begin private key"), "PrivateKey").when(n.contains("nonce"), "NonceLike")
        .when(low.contains("://") & low.contains("@"), "UrlCredentials").when(n.contains("bearer") | low.contains("authorization: bearer"), "BearerAuth")
        .when(any_of(n, ["xapikey", "apikeyheader", "accesskeyid"]), "ApiKeyAssignment").when(n.contains("cookie"), "TokenAssignment").when(n.contains("jwt"), "Jwt")
        .when(any_of(n, ["password", "passwd"]) | n.endswith("pwd"), "PasswordAssignment").when(any_of(n, API_KEYS), "ApiKeyAssignment")
        .when(any_of(n, TOKENS) | starts_with_any(v, ["ghp_", "ghs_", "xoxb-"]), "TokenAssignment").otherwise(value_kind(value, line))
    )


def secondary_context(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(c), c) for c in CONTEXTS))


def _pairs(line: Column, pattern: str, ident: int, value: int, name: str | None, order: int) -> Column:
    tag = F.lit(name) if name else F.when(F.ltrim(line).startswith("{") | line.contains('"'), "JsonKey").otherwise("YamlKey")
    both = F.arrays_zip(F.regexp_extract_all(line, F.lit(pattern), F.lit(ident)).alias("i"), F.regexp_extract_all(line, F.lit(pattern), F.lit(value)).alias("v"))
    return F.transform(both, lambda p, k: F.struct(F.lit(order).alias("extractor"), k.alias("seq"), p["i"].alias("identifier"), p["v"].alias("value"), tag.alias("pattern"), line.alias("snippet")))


def lines_of(fragments: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """Lines that pass the prefilter, with number (from 0) and character offset; others are dropped before they are exploded."""
    numbered = F.transform(F.split(F.col(text_col), "\n"), lambda line, i: F.struct(i.alias("n"), line.alias("line")))
    found = fragments.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("_text"), F.explode(F.filter(numbered, lambda x: line_prefilter(x["line"]))).alias("x"))
    before = F.expr("case when x.n = 0 then 0 else length(substring_index(_text, '\n', x.n)) + 1 end")
    return found.select("id", "path", F.col("x.n").alias("line_no"), before.cast("long").alias("offset"), F.col("x.line").alias("line"))


def typed_candidates(fragments: DataFrame, id_col: str, text_col: str, path_col: str, cap: bool = True) -> DataFrame:
    """Candidates of all extractors with kind, scores and evidence; at most candidate_cap(path) of them for each fragment, and
    whole lines, in the order of line, extractor and place.
    """
    lines = lines_of(fragments, id_col, text_col, path_col)
    line = F.col("line")
    arrays = [_pairs(line, pattern, i, v, name, k) for k, (_, pattern, i, v, name) in enumerate(EXTRACTORS)]
    url = F.arrays_zip(F.regexp_extract_all(line, F.lit(URL_CREDENTIALS), F.lit(1)).alias("u"), F.regexp_extract_all(line, F.lit(URL_CREDENTIALS), F.lit(2)).alias("v"))
    arrays.append(F.transform(url, lambda p, k: F.struct(F.lit(len(EXTRACTORS)).alias("extractor"), k.alias("seq"), F.lit("database_url").alias("identifier"), p["v"].alias("value"), F.lit("Assignment").alias("pattern"), p["u"].alias("snippet"))))
    found = lines.select("id", "path", "line_no", "offset", "line", F.explode(F.concat(*arrays)).alias("c")).select("id", "path", "line_no", "offset", "line", "c.*")
    found = found.withColumn("value", F.regexp_replace("value", "^[\"']+|[\"']+$", "")).where(plausible(F.col("value")))
    kind = F.when(F.col("extractor") == len(EXTRACTORS), "UrlCredentials").otherwise(match_kind(F.col("identifier"), F.col("value"), line))
    found = found.withColumn("kind", kind).where(~F.col("kind").isin("Unknown", "Catchall"))
    if cap:
        # Before the line's first candidate; a line that begins under the cap is taken whole.
        w = Window.partitionBy("id").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("_before", F.coalesce(F.count("*").over(w), F.lit(0))).where(F.col("_before") < paths.candidate_cap(F.col("path"))).drop("_before")
    secret = looks_secret(F.col("identifier"))
    return found.select(
        "id", "path", "line_no", "offset", "extractor", "seq", "identifier", "value", "pattern", "snippet", "kind", secret.alias("has_secret_identifier"), F.lit(True).alias("typed"), F.lit(False).alias("multiline"),
        F.when(secret, 0.9).otherwise(0.75).alias("proximity"), F.when(F.col("pattern").isin("JsonKey", "YamlKey"), 0.85).otherwise(0.75).alias("structure"),
        secondary_context(line).alias("secondary_context"), any_of(F.lower(line), ["authorization", "bearer", "x-api-key", "cookie"]).alias("has_auth_context"),
    )


def block_candidates(fragments: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """Key blocks, bearer headers and here-documents over several lines, with the evidence that route() reads; offset is the
    place where such a value stands first in the text."""
    text = F.col(text_col)
    rows = lambda hits, kind, pattern, prox, struct: F.transform(hits, lambda h, k: F.struct(k.alias("seq"), F.lit("").alias("identifier"), h.alias("value"), F.lit(pattern).alias("pattern"), F.lit(kind).alias("kind"), F.lit(prox).alias("proximity"), F.lit(struct).alias("structure")))
    pem = rows(F.regexp_extract_all(text, F.lit(PEM), F.lit(0)), "PrivateKey", "Unknown", 0.95, 0.95)
    bearer = rows(F.regexp_extract_all(text, F.lit(BEARER), F.lit(1)), "BearerAuth", "HeaderValue", 0.92, 0.88)
    docs = F.arrays_zip(F.regexp_extract_all(text, F.lit(HEREDOC), F.lit(1)).alias("i"), F.regexp_extract_all(text, F.lit(HEREDOC), F.lit(3)).alias("v"))
    here = F.transform(docs, lambda d, k: F.struct(k.alias("seq"), d["i"].alias("identifier"), F.trim(d["v"]).alias("value"), F.lit("Assignment").alias("pattern"), match_kind(d["i"], d["v"], d["i"]).alias("kind"), F.lit(0.9).alias("proximity"), F.lit(0.75).alias("structure")))
    here = F.filter(here, lambda h: F.octet_length(h["value"]).between(12, 2048))
    some = text.contains("-----BEGIN ") | F.lower(text).contains("authorization") | text.contains("<<")
    found = fragments.where(some).select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), text.alias("_text"), F.explode(F.concat(pem, bearer, here)).alias("c")).select("id", "path", "_text", "c.*")
    value = F.col("value")
    return found.select(
        "id", "path", F.lit(0).alias("line_no"), F.greatest(F.expr("instr(_text, value)") - 1, F.lit(0)).cast("long").alias("offset"), F.lit(len(EXTRACTORS) + 1).alias("extractor"), "seq", "identifier", "value", "pattern", value.alias("snippet"), "kind",
        looks_secret(F.col("identifier")).alias("has_secret_identifier"), F.lit(True).alias("typed"), (F.col("kind") != "BearerAuth").alias("multiline"), "proximity", "structure",
        secondary_context(value).alias("secondary_context"), (F.col("kind") == "BearerAuth").alias("has_auth_context"),
    )


def candidates(fragments: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """Candidates in lines, without a cap, and over several lines."""
    return typed_candidates(fragments, id_col, text_col, path_col, cap=False).unionByName(block_candidates(fragments, id_col, text_col, path_col))


def route(candidates: DataFrame, entropy_threshold: float = 3.5) -> DataFrame:
    """Adds entropy, path_score, route and bucket, and drops candidates of low signal."""
    found = candidates.withColumn("entropy", F.round(shannon_entropy(F.col("value").cast("binary")), 9)).withColumn("path_score", paths.path_score(F.col("path")))
    low = (F.col("entropy") < 0.75 * entropy_threshold) & ~F.col("typed") & ~F.col("has_secret_identifier") & ~F.col("has_auth_context") & ~F.col("multiline") & (F.col("path_score") < 0.55)
    found = found.where(~low)
    return found.withColumn("route", route_of(found)).withColumn("bucket", bucket_of(F.col("path")))


def route_of(c) -> Column:
    by_kind = {"ApiKeyAssignment": "ApiKey", "PasswordAssignment": "Password", "TokenAssignment": "Token", "BearerAuth": "AuthHeader", "Jwt": "AuthHeader", "UrlCredentials": "UrlCredential", "PrivateKey": "PrivateKey", "NonceLike": "Token"}
    out = F.when(F.col("has_auth_context") | (F.col("pattern") == "HeaderValue"), "AuthHeader").when(paths.is_config(F.col("path")) | (F.col("path_score") > 0.7), "Config").otherwise("Generic")
    for kind, name in by_kind.items():
        out = F.when(F.col("kind") == kind, name).otherwise(out)
    return out


def bucket_of(path: Column) -> Column:
    p, kind, r = F.col("pattern"), F.col("kind"), F.col("route")
    header = F.when(kind == "ApiKeyAssignment", "api_key").when(kind.isin("BearerAuth", "Jwt", "TokenAssignment"), "auth_header").otherwise("code_assignments")
    by_route = F.when(r == "ApiKey", "api_key").when(r == "Password", "password").when(r == "Token", "token").when(r == "AuthHeader", "auth_header").when(r == "UrlCredential", "url_credentials").when(r == "PrivateKey", "private_key").otherwise("code_assignments")
    return (
        F.when(p.isin("Assignment", "FunctionArg") & ~F.col("multiline") & F.col("has_secret_identifier"), "code_assignments").when(p == "HeaderValue", header)
        .when(p.isin("JsonKey", "YamlKey", "Export", "DockerEnv", "EnvVar", "TerraformVar"), "config_assignments").when(paths.is_config(path), "config_assignments").otherwise(by_route)
    )
