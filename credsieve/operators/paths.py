"""What a path says: configuration, source, test, example."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import any_of, ends_with_any

# Ends and parts of paths of each class.
CONFIG_ENDS = [".env", ".env.example", ".env.sample", ".env.local", ".json", ".yaml", ".yml", ".toml", ".ini", ".conf", ".config", ".properties", ".tfvars", ".example"]
CONFIG_PARTS = ["/config", "\\config", "/conf/", "\\conf\\", "settings"]
CODE_ENDS = [".py", ".go", ".rs", ".js", ".ts", ".java", ".cs", ".rb", ".php", ".c", ".cpp", ".sh", ".bash", ".zsh", ".ps1", ".envrc"]
CODE_PARTS = ["/src/", "\\src\\", "/test/", "\\test\\", "/tests/", "\\tests\\", "/setting/", "\\setting\\"]
TEST_PARTS = ["/test/", "\\test\\", "/tests/", "\\tests\\", "/fixture", "\\fixture", "/example", "\\example"]
FIXTURE_PARTS = ["/test/", "/tests/", "/fixture/", "/fixtures/", "\\test\\", "\\tests\\", "\\fixture\\", "\\fixtures\\"]
EXAMPLE_ENDS = [".example", ".sample", ".template", ".example.env", ".env.example", ".env.sample"]
ENV_ENDS = [".env", ".env.local", ".env.production", ".env.development"]
TEST_ENDS = ["_test.go", "_test.rs", ".test.js", ".test.ts", ".spec.js", ".spec.ts", "_spec.rb", "_test.py"]
DOC_ENDS = [".md", ".txt", ".rst", ".adoc"]
LOCK_ENDS = [".lock", "-lock.json"]
MUTED_PARTS = ["/test/", "/tests/", "/fixtures/", "/fixture/", "/mock/", "/mocks/", "/fake/", "/stubs/", "/stub/", "/__tests__/", "/testdata/"]
RAISED_PARTS = ["/secret", "/credential", "/private", "/creds", "/vault"]


def is_config(path: Column) -> Column:
    p = F.lower(path)
    return ends_with_any(p, CONFIG_ENDS) | any_of(p, CONFIG_PARTS)


def is_typed(path: Column) -> Column:
    p = F.lower(path)
    return is_config(path) | ends_with_any(p, CODE_ENDS) | any_of(p, CODE_PARTS)


def candidate_cap(path: Column) -> Column:
    return F.when(is_config(path), 128).when(is_typed(path), 64).otherwise(32)


def path_score(path: Column) -> Column:
    p = F.lower(path)
    total = F.when(is_config(path), 0.45).otherwise(0.0) + F.when(any_of(p, TEST_PARTS), 0.25).otherwise(0.0) + F.when(any_of(p, ["/src/", "\\src\\"]), 0.15).otherwise(0.0)
    return F.least(F.round(total, 6), F.lit(1.0))


def extension_adjustment(path: Column) -> Column:
    p = F.lower(path)
    return F.when(ends_with_any(p, ENV_ENDS), 0.20).when(ends_with_any(p, EXAMPLE_ENDS), -0.10).when(ends_with_any(p, TEST_ENDS), -0.30).when(ends_with_any(p, DOC_ENDS), -0.10).when(ends_with_any(p, LOCK_ENDS), -0.20).otherwise(0.0)


def path_adjustment(path: Column) -> Column:
    p = F.lower(path)
    return F.when(any_of(p, MUTED_PARTS), -0.20).otherwise(0.0) + F.when(any_of(p, RAISED_PARTS), 0.10).otherwise(0.0)


def propagates(path: Column) -> Column:
    p = F.lower(path)
    return ends_with_any(p, [".yml", ".yaml"]) | any_of(p, ["compose", "manifest", "deployment"])


def path_context(path: Column) -> Column:
    """test, source, config, docs, example, ci or other, by the first class that has a part of the path."""
    # Directory names of each class.
    kinds = {
        "test": ["test", "tests", "testdata", "__tests__", "fixture", "fixtures"], "source": ["src", "lib", "pkg", "app", "cmd"], "config": ["config", "conf", "settings"],
        "docs": ["docs", "doc"], "example": ["example", "examples", "sample", "samples"], "ci": ["ci", ".github", ".gitlab", ".circleci"],
    }
    parts = F.split(F.lower(path), r"[\\/]+")
    out = F.lit("other")
    for name in reversed(kinds):
        out = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, kinds[name]))), name).otherwise(out)
    return out


def extension_bucket(path: Column) -> Column:
    name = F.element_at(F.split(F.lower(path), r"[\\/]"), -1)
    found = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(found == "", "<none>").otherwise(found)


def rule_family(kind: Column) -> Column:
    k = F.lower(kind)
    return (
        F.when(any_of(k, ["private", "pem"]), "private_key").when(any_of(k, ["jwt", "bearer"]), "auth_token").when(any_of(k, ["url", "credential", "dsn"]), "url_credentials")
        .when(any_of(k, ["password", "passwd"]), "password").when(k.contains("api") & k.contains("key"), "api_key").when(any_of(k, ["token", "secret", "oauth"]), "token").when(k.contains("nonce"), "nonce").otherwise("other")
    )
