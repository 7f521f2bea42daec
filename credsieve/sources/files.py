"""Fragments from files: directories, archives, images, objects in a store."""

from __future__ import annotations

import fnmatch
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import as_fragments
from .ignored import IGNORE_FILE, in_repository, patterns, without_ignored

MOST_BYTES, MOST_RATIO, OBJECT_BYTES = 50 << 20, 100, 10 << 20
# Ends of files that are no text.
BINARY_ENDS = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz", ".bz2", ".xz", ".whl", ".so", ".dll", ".dylib", ".exe", ".class", ".jar", ".pyc", ".woff", ".woff2", ".ttf", ".mp3", ".mp4")


def hidden(spark: SparkSession, path: str, depth: int = 8) -> list[str]:
    """Files and folders below path whose names begin with a dot, but .git: Spark's listing leaves them out unless they are named."""
    jvm, found = spark.sparkContext._jvm, []
    for k in range(depth):
        glob = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/*" * k + "/.*")
        for status in glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []:
            name = status.getPath().toString()
            if not re.search(r"/\.git(/|$)|\.crc$", name):
                found.append(name)
    return found


def binary_files(spark: SparkSession, path: str, pattern: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, content) of files up to a size; the size is pushed down to the listing. Works on any store Spark reads (s3a:// as well)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    seen = reader.load(path).select("path", "length", "content")
    named = [p for p in hidden(spark, path) if pattern is None or fnmatch.fnmatch(p.rsplit("/", 1)[1], pattern)]
    if named:
        rows = spark.createDataFrame([(p,) for p in named], "path string").repartition(min(len(named), 64))
        seen = seen.unionByName(rows.mapInPandas(_read, "path string, length long, content binary"))
    return seen.where(F.col("length") <= most_bytes)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Content of named files, and of all files in named folders; Spark's readers pass over names with a dot in front."""
    from pyarrow import fs

    for pdf in batches:
        out = []
        for uri in pdf["path"]:
            store, name = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))
            info = store.get_file_info(name)
            inner = [info] if info.is_file else store.get_file_info(fs.FileSelector(name, recursive=True))
            for f in inner:
                if f.is_file and (f.size or 0) <= MOST_BYTES:
                    with store.open_input_file(f.path) as src:
                        raw = src.read()
                    out.append((uri + f.path[len(name) :], len(raw), raw))
        yield pd.DataFrame(out, columns=["path", "length", "content"])


def is_binary(content, probe: int = 512):
    """Whether there is a zero byte near the start."""
    return F.hex(F.substring(content, 1, probe)).rlike("^(?:..)*?00")


def directory(spark: SparkSession, path: str, ignore: list[str] | None = None, most_bytes: int = MOST_BYTES, gitignore: bool | None = None) -> DataFrame:
    """Text files below a directory; .git and ignored globs are left out, binary files skipped.

    gitignore: whether the .gitignore files below the directory hold; None: if it is part of a repository.
    """
    files = binary_files(spark, path, None, most_bytes).where(~F.col("path").rlike(r"/\.git/"))
    if in_repository(spark, path) if gitignore is None else gitignore:
        named = binary_files(spark, path, IGNORE_FILE, most_bytes).where(~F.col("path").rlike(r"/\.git/"))
        files = without_ignored(files, patterns(named))
    for glob in ignore or []:
        files = files.where(~F.col("path").rlike(r"(^|/)" + fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")))
    files = files.where(~is_binary(F.col("content")))
    return as_fragments(files, F.col("path"), "dir", F.make_valid_utf8(F.col("content").cast("string")), {"file_size": F.col("length")})


def terraform_files(spark: SparkSession, path: str) -> DataFrame:
    files = directory(spark, path).where(F.col("path").rlike(r"\.(tf|tfvars|tfvars\.json)$") & ~F.col("path").rlike(r"/\.[^/]*$"))
    return files.withColumn("source_type", F.lit("terraform"))


def safe_path(root: str, name: str) -> str:
    """A path below root; absolute ones, drive letters, shares and parents are refused."""
    if name.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", name) or ".." in PurePosixPath(name.replace("\\", "/")).parts:
        raise ValueError(f"not a relative path within the folder: {name}")
    return f"{root.rstrip('/')}/{name}"


def single_file(spark: SparkSession, root: str, name: str) -> DataFrame:
    return directory(spark, safe_path(root, name))


def _members(name: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info) if info.file_size <= MOST_BYTES else b""
    else:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
            for info in t:
                if info.isfile():
                    got = t.extractfile(info) if info.size <= MOST_BYTES else None
                    yield info.name, got.read() if got else b""


def archives(files: DataFrame, source_type: str = "archive", scheme: str = "", probe: int = 512) -> DataFrame:
    """files: (path, content) of ZIP and TAR archives, compressed or not. Text members as `archive:member`; an archive whose
    members grow beyond 100 times its size ends with a row that has the attribute error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                total = 0
                try:
                    for name, data in _members(path, bytes(raw)):
                        total += len(data)
                        if total > MOST_RATIO * max(1, len(raw)):
                            rows.append((f"{scheme}{path}", "", path, f"expands more than {MOST_RATIO} times"))
                            break
                        if data and b"\0" not in data[:probe] and not name.lower().endswith(BINARY_ENDS):
                            rows.append((f"{scheme}{path}:{name}", data.decode("utf-8", "replace"), path, None))
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError) as e:
                    rows.append((f"{scheme}{path}", "", path, f"not readable: {e}"))
            yield pd.DataFrame(rows, columns=["p", "t", "a", "e"])

    found = files.select("path", "content").mapInPandas(run, "p string, t string, a string, e string")
    return as_fragments(found, F.col("p"), source_type, F.col("t"), {"archive_path": F.col("a"), "error": F.col("e")})


def packages(files: DataFrame, registry: str) -> DataFrame:
    """Members of package tarballs (npm, PyPI); as archives(), with a longer look for binary content."""
    return archives(files, registry, f"{registry}://", 8192)


def ci_logs(files: DataFrame) -> DataFrame:
    """Log archives of CI runs."""
    return archives(files, "ci_logs", "ci://")
