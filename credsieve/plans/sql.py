"""Pieces of DuckDB SQL built from the same fixed values as the expressions."""

from __future__ import annotations


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(x: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def ends(x: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"ends_with({x}, {lit(n)})" for n in needles) + ")"


def starts(x: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"starts_with({x}, {lit(n)})" for n in needles) + ")"


def case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {otherwise} end"


def values(*strings: str) -> str:
    return "(" + ", ".join(map(lit, strings)) + ")"


def is_config(p: str) -> str:
    from ..operators import paths

    return f"({ends(p, paths.CONFIG_ENDS)} or {any_of(p, paths.CONFIG_PARTS)})"


def entropy_of_bytes(pairs: str) -> str:
    """Of a subquery of (k, b, n): count n of byte b for key k; gives (k, e)."""
    return f"select k, -sum(p * log2(p)) as e from (select k, n / sum(n) over (partition by k) as p from ({pairs})) group by k"
