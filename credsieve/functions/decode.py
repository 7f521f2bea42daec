"""Decoding of encoded literals: single steps as expressions, chains of steps in an Arrow UDF."""

from __future__ import annotations

import base64
import binascii

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_step(x: Column) -> Column:
    """Text of a canonical base64 string (padded, length a multiple of 4); null for anything else."""
    fine = x.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(x) % 4 == 0) & (F.length(x) > 0)
    raw = F.try_to_binary(x, F.lit("BASE64"))
    return F.when(fine & (F.base64(raw) == x), F.make_valid_utf8(raw.cast("string")))


def hex_step(x: Column) -> Column:
    return F.when(x.rlike("^([0-9A-Fa-f]{2})+$"), F.make_valid_utf8(F.unhex(x).cast("string")))


def url_step(x: Column) -> Column:
    """Null without a % or with a broken escape; + is a blank."""
    return F.when(x.contains("%"), F.try_url_decode(x))


def _steps(raw: bytes) -> list[tuple[str, bytes]]:
    out = []
    if raw and len(raw) % 4 == 0:
        try:
            got = base64.b64decode(raw, validate=True)
            if base64.b64encode(got) == raw:
                out.append(("base64", got))
        except (binascii.Error, ValueError):
            pass
    if raw and len(raw) % 2 == 0:
        try:
            out.append(("hex", binascii.unhexlify(raw)))
        except (binascii.Error, ValueError):
            pass
    if b"%" in raw:
        got, i, fine = bytearray(), 0, True
        while i < len(raw):
            if raw[i] == 0x25 and i + 2 < len(raw):
                try:
                    got.append(int(raw[i + 1 : i + 3], 16))
                except ValueError:
                    fine = False
                    break
                i += 3
            else:
                got.append(0x20 if raw[i] == 0x2B else raw[i])
                i += 1
        if fine:
            out.append(("url", bytes(got)))
    return out


def deep_decode(raw: bytes, depth: int = 4) -> list[tuple[bytes, list[str]]]:
    """All that can be decoded from raw in up to `depth` steps, breadth first, with the steps; nothing twice, nothing empty."""
    seen, out, level = {raw}, [], [(raw, [])]
    for _ in range(depth):
        following = []
        for data, chain in level:
            for name, got in _steps(data):
                if got and got not in seen:
                    seen.add(got)
                    following.append((got, [*chain, name]))
        out += following
        level = following
    return out


def deep_decode_udf(depth: int = 4):
    @F.pandas_udf("array<struct<data: string, chain: array<string>>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [] if v is None else [{"data": d.decode("utf-8", "replace"), "chain": c} for d, c in deep_decode(v.encode(), depth)])

    return run
