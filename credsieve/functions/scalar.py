"""Redaction, hashing, severity and text helpers; all native expressions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from least to most.
SEVERITIES = ["info", "low", "medium", "high", "critical"]


def contains_any(text: Column, needles: list[str]) -> Column:
    """Whether the text contains any of the needles: one substring search each, which is fastest on long texts."""
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def any_of(text: Column, needles: list[str]) -> Column:
    """As contains_any, in one pattern: a small plan, for short strings."""
    return text.rlike("|".join(map(re.escape, needles)))


def starts_with_any(text: Column, starts: list[str]) -> Column:
    return text.rlike("^(?:" + "|".join(map(re.escape, starts)) + ")")


def ends_with_any(text: Column, ends: list[str]) -> Column:
    return text.rlike("(?:" + "|".join(map(re.escape, ends)) + r")\z")


def redact(secret: Column) -> Column:
    """First and last characters with stars between, at most 40 % of the value visible; three characters or less are all stars."""
    n = F.length(secret)
    head = F.when(n <= 8, 2).when(n <= 32, 4).otherwise(6)
    tail = F.when(n <= 8, 0).when(n <= 16, 2).when(n <= 32, 4).otherwise(6)
    most = F.floor(n * 4 / 10).cast("int")
    less = F.floor(most / 2).cast("int")
    over = head + tail > most
    h = F.when(over, F.greatest(less, F.lit(1))).otherwise(head)
    t = F.when(over, less).otherwise(tail)
    stars = F.repeat(F.lit("*"), F.least(n - h - t, F.lit(8)).cast("int"))
    shown = F.concat(F.substring(secret, F.lit(1), h), stars, F.when(t > 0, F.substring(secret, n - t + 1, t)).otherwise(""))
    return F.when(n <= 3, F.repeat(F.lit("*"), n)).otherwise(shown)


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Hexadecimal HMAC-SHA256 of the value's UTF-8 bytes. The key is a setting, so hashes agree between runs."""
    inner, outer = hmac_pads(key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), value.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def finding_hash(rule_id: Column, secret_hash: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws(":", rule_id, secret_hash, path), 256)


def finding_id(rule_id: Column, secret_hash: Column, path: Column, offset: Column) -> Column:
    """The same for the same finding, whatever the plan or attempt."""
    return F.sha2(F.concat_ws(":", rule_id, secret_hash, path, offset.cast("string")), 256)


def line_number(text: Column, offset: Column) -> Column:
    """Line, from 1, of a character offset from 0."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES):
        out = F.when(F.lower(severity) == s, i).otherwise(out)
    return out


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def csv_escape(x: Column) -> Column:
    return F.when(x.rlike("[,\"\n\r]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def confidence_bar(confidence: Column) -> Column:
    full = F.least(F.greatest(F.round(confidence * 10).cast("int"), F.lit(0)), F.lit(10))
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 10 - full))


def variable_name(line: Column) -> Column:
    """The identifier before the first = or : that has a good one, in upper case; none if nothing stands before the first."""
    parts = F.split(line, "[=:]")
    last = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.try_element_at(F.regexp_extract_all(p, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lit(-1)))
    good = F.filter(last, lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]+$"))
    return F.when(F.get(last, F.lit(0)).isNotNull(), F.upper(F.get(good, F.lit(0))))


def strip_quotes(x: Column) -> Column:
    return F.when(x.rlike("^(?s)(\".*\"|'.*')$") & (F.length(x) >= 2), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)


def encode_path(path: Column, every_byte: bool = False) -> Column:
    """Percent-encoding of a path: slash, blank, # and ? alone, or each segment by the rules of URLs."""
    if every_byte:
        return F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")
    for raw, code in ((" ", "%20"), ("#", "%23"), ("?", "%3F"), ("/", "%2F")):
        path = F.replace(path, F.lit(raw), F.lit(code))
    return path


def token_ids(text: Column, length: int) -> Column:
    """Character ids for a classifier: classes of ASCII in turn, 99 for anything else, 0 to fill up to the length."""

    def one(i: Column) -> Column:
        raw = F.conv(F.substring(F.hex(text.cast("binary")), i * 2 - 1, F.lit(2)), 16, 10).cast("int")
        return F.element_at(F.transform(F.array(raw), _char_id), 1)

    n = F.octet_length(text)
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= n, one(i)).otherwise(0))


def _char_id(c: Column) -> Column:
    # First and last code of a class, and the id of its first character.
    classes = [(97, 122, 0), (65, 90, 26), (48, 57, 52), (32, 32, 86), (33, 47, 62), (58, 64, 77), (91, 96, 84), (123, 126, 90)]
    out = F.lit(99)
    for low, high, first in classes:
        out = F.when(c.between(low, high), c - low + first).otherwise(out)
    return out


def blast_radius(permissions: Column) -> Column:
    """Risk of a credential with these permissions."""
    # Words of a permission that make it critical or high.
    critical = ["admin", "root", "write", "delete", "destroy", "full", "unrestricted", "superuser", "put"]
    high = ["create", "update", "post", "push"]
    low = F.transform(permissions, lambda p: F.lower(p))
    return (
        F.when(F.exists(low, lambda p: (p == "*") | p.endswith(":*") | any_of(p, critical)), "critical")
        .when(F.exists(low, lambda p: p.endswith("*") | any_of(p, high)), "high")
        .when(F.size(permissions) > 2, "medium")
        .otherwise("low")
    )


# Providers by the start of a rule id, first match first.
PROVIDERS = [("aws", "aws"), ("github", "github"), ("gitlab", "gitlab"), ("slack", "slack"), ("stripe", "stripe"), ("openai", "openai"), ("anthropic", "anthropic"), ("huggingface", "huggingface"), ("hf-", "huggingface")]


def provider_of(rule_id: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, name in reversed(PROVIDERS):
        out = F.when(F.lower(rule_id).startswith(prefix), name).otherwise(out)
    return out


def remediation_of(rule_id: Column) -> Column:
    """What to do about a finding of a known provider."""
    steps = {"aws": "Deactivate the key in IAM and issue a new one.", "github": "Revoke the token in the developer settings.", "gitlab": "Revoke the token in the access token settings.", "slack": "Regenerate the token in the app settings.", "stripe": "Roll the key in the dashboard.", "openai": "Delete the key in the account's key list.", "anthropic": "Delete the key in the console.", "huggingface": "Invalidate the token in the settings."}
    out = F.lit("Revoke the credential and rotate it.")
    for name, text in steps.items():
        out = F.when(provider_of(rule_id) == name, text).otherwise(out)
    return out


def validation_status(provider: Column, status: Column, body: Column) -> Column:
    """Status of a recorded response to a check with the credential."""
    ok = F.lower(F.regexp_extract(body, r'"ok"\s*:\s*(true|false)', 1))
    aws = F.when(body.rlike("AuthFailure|InvalidSignatureException"), "active").when(body.rlike("InvalidClientTokenId|ExpiredTokenException"), "inactive").otherwise("needs_validation")
    slack = F.when(ok == "true", "active").when(ok == "false", "inactive").otherwise("error")
    strict = F.when(status == 200, "active").when(status.isin(401, 403), "inactive").otherwise("error")
    only_401 = F.when(status == 200, "active").when(status == 401, "inactive").otherwise("error")
    return F.when(provider == "aws", aws).when(provider == "slack", slack).when(provider.isin("github", "gitlab", "anthropic"), strict).when(provider.isin("stripe", "openai", "huggingface"), only_401).otherwise("unsupported")
