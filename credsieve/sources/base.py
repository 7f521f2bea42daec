"""The shape of a fragment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAGMENT = "path string, source_type string, size long, attributes map<string,string>, text string"


def as_fragments(df: DataFrame, path: Column, source_type: str, text: Column, attributes: dict[str, Column] | None = None) -> DataFrame:
    pairs = [x for k, v in (attributes or {}).items() for x in (F.lit(k), v.cast("string"))]
    held = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(path.alias("path"), F.lit(source_type).alias("source_type"), F.octet_length(text).cast("long").alias("size"), held.alias("attributes"), text.alias("text"))
