"""Ignore files of repositories: their patterns become a table by folder, which paths are joined with by the folders above them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE_FILE = ".gitignore"


def to_regex(glob: str) -> str:
    """A pattern as a regular expression for a whole path relative to the pattern's folder; the same for Java and Python."""
    out, i = "", 0
    while i < len(glob):
        c, begins = glob[i], i == 0 or glob[i - 1] == "/"
        end = glob.find("]", i + 3 if glob[i + 1 : i + 2] in ("!", "^") else i + 2) if c == "[" else -1
        if begins and glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif begins and i > 0 and glob[i:] == "**":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + len(re.match(r"\*+", glob[i:])[0])
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif end > 0:
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            out, i = out + "(?!/)[" + "^" * negated + re.sub(r"([\\\[\]&~^])", r"\\\1", body[negated:]) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def parse_line(line: str) -> tuple[str, bool, bool] | None:
    """(regex, whether it takes files back in, whether it holds for folders alone) of a line; nothing for blank lines and comments."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:]
    folders = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    return r"(?s)^" + ("" if anchored else "(?:.*/)?") + to_regex(line.removeprefix("/")) + r"\z", back, folders


def patterns(files: DataFrame) -> DataFrame:
    """(folder, rules) of the ignore files among files (path, content); the rules of a file stay in its order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                parsed = [p for p in map(parse_line, bytes(raw or b"").decode("utf-8", "replace").split("\n")) if p]
                rows.append((path.rsplit("/", 1)[0], [{"regex": r, "back": b, "folders": f} for r, b, f in parsed]))
            yield pd.DataFrame(rows, columns=["folder", "rules"])

    named = files.where(F.substring_index("path", "/", -1) == IGNORE_FILE).select("path", "content")
    return named.mapInPandas(run, "folder string, rules array<struct<regex: string, back: boolean, folders: boolean>>").where(F.size("rules") > 0)


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path, ...) but those that rules (folder, rules) leave out.

    For a path and for each folder above it, the last fitting rule of the deepest folder counts; what lies in a folder that is
    left out cannot come back. Only paths are joined with rules and grouped, by path, so no group grows beyond a path's depth;
    the content moves only if the paths left out are too many to be broadcast.
    """
    parts = F.split("path", "/")
    upper = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    by_path = files.select("path").distinct().select("path", F.explode(upper).alias("folder")).join(rules, "folder")
    ordered = by_path.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.length("folder").alias("n"), F.col("rules").alias("rules")))).alias("held"))
    flat = F.flatten(F.transform("held", lambda h: F.transform(h["rules"], lambda r: F.struct(h["n"].alias("n"), r["regex"].alias("regex"), r["back"].alias("back"), r["folders"].alias("folders")))))
    places = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("place"), (k < F.size(parts)).alias("folder")))
    rows = ordered.select("path", flat.alias("all"), places.alias("places"))

    def fits(place, r):
        return (F.length(place["place"]) > r["n"] + 1) & (place["folder"] | ~r["folders"]) & F.rlike(F.substr(place["place"], r["n"] + 2), r["regex"])

    out = F.exists("places", lambda p: F.coalesce(~F.try_element_at(F.filter("all", lambda r: fits(p, r)), F.lit(-1))["back"], F.lit(False)))
    return files.join(rows.where(out).select("path"), "path", "left_anti")


def in_repository(spark: SparkSession, path: str) -> bool:
    """Whether the folder or one above it holds a repository."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = store.makeQualified(at)
    while at is not None:
        if store.exists(jvm.org.apache.hadoop.fs.Path(at, ".git")):
            return True
        at = at.getParent()
    return False
