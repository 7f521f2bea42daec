"""Fragments from text held in columns: inline text, diffs, dotenv files, notebooks, JSON, messages, table cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import as_fragments

#: Bytes of inline text that are taken.
INLINE_CAP = 1 << 20


def scan_text(spark: SparkSession, text: str, path: str = "<inline>") -> DataFrame:
    return as_fragments(spark.createDataFrame([(text[:INLINE_CAP],)], "t string"), F.lit(path), "text", F.col("t"))


def stdin_fragment(spark: SparkSession, raw: bytes) -> DataFrame:
    return as_fragments(spark.createDataFrame([(raw.decode("utf-8", "replace"),)], "t string"), F.lit("<stdin>"), "stdin", F.col("t"))


def added_lines(diff: Column) -> Column:
    """The lines that a unified diff adds, without their sign."""
    return F.array_join(F.transform(F.filter(F.split(diff, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")


def git_patches(commits: DataFrame) -> DataFrame:
    """commits: (sha, author, date, message, file, diff), one row per changed file; additions and context are kept."""
    kept = F.array_join(F.transform(F.filter(F.split("diff", "\n"), lambda x: (x.startswith("+") & ~x.startswith("+++")) | x.startswith(" ")), lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")
    return as_fragments(commits, F.concat("file", F.lit("@"), F.substring("sha", 1, 8)), "git", kept, {"commit_hash": F.col("sha"), "author": F.col("author"), "date": F.col("date"), "message": F.substring("message", 1, 72)})


def dotenv(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """One fragment `KEY=value` for each assignment; comments and blanks are skipped, `export` is dropped, a backslash at the end
    of a line joins the next, one pair of quotes is taken off."""
    joined = F.regexp_replace(text, r"\\\n\s*", "")
    lines = df.select(path.alias("_p"), F.explode(F.split(joined, "\n")).alias("_l")).withColumn("_l", F.regexp_replace(F.trim("_l"), r"^export\s+", ""))
    lines = lines.where("_l <> '' and not startswith(_l, '#') and instr(_l, '=') > 0")
    key = F.trim(F.substring_index("_l", "=", 1))
    raw = F.trim(F.expr("substring(_l, instr(_l, '=') + 1)"))
    quoted = raw.rlike(r'^(?s)(".*"|\'.*\')$') & (F.length(raw) >= 2)
    value = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    lines = lines.select("_p", key.alias("_k"), value.alias("_v")).where("_k <> ''")
    return as_fragments(lines, F.concat_ws(":", "_p", "_k"), "dotenv", F.concat_ws("=", "_k", "_v"), {"key": F.col("_k")})


_NOTEBOOK = "cells array<struct<cell_type: string, source: string, outputs: array<struct<text: string, data: map<string,string>>>>>"


def _joined(raw: Column) -> Column:
    """A JSON string, or an array of them joined."""
    return F.coalesce(F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), "")), raw)


def notebook(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """Code cells with their outputs' text."""
    cells = df.select(path.alias("_p"), F.posexplode(F.from_json(text, _NOTEBOOK)["cells"]).alias("_i", "_c")).where("_c.cell_type = 'code'")
    out = F.flatten(F.transform(F.coalesce("_c.outputs", F.array()), lambda o: F.array(_joined(o["text"]), _joined(o["data"]["text/plain"]))))
    parts = F.filter(F.concat(F.array(_joined(F.col("_c.source"))), out), lambda x: x.isNotNull() & (x != ""))
    cells = cells.select("_p", "_i", F.array_join(parts, "\n").alias("_t")).where("_t <> ''")
    return as_fragments(cells, F.concat(F.lit("notebook://"), "_p", F.lit(":cell["), F.col("_i").cast("string"), F.lit("]")), "notebook", F.col("_t"), {"notebook": F.col("_p"), "cell_index": F.col("_i")})


def flatten_json(df: DataFrame, keep: list[str], json: Column, depth: int = 20) -> DataFrame:
    """(keep, key, value) of all string leaves of JSON texts, keys as dotted and indexed paths; level by level on variants."""
    level = df.select(*keep, F.try_parse_json(json).alias("_v"), F.lit("").alias("key")).where("_v is not null")
    found = []
    for _ in range(depth):
        kind = F.schema_of_variant("_v")
        found.append(level.where(kind == "STRING").select(*keep, "key", F.expr("variant_get(_v, '$', 'string')").alias("value")))
        inner = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        if inner.isEmpty():
            break
        inner = inner.select(*keep, F.col("key").alias("_up"), "_v")
        view = f"_flat_{id(inner)}"
        inner.createOrReplaceTempView(view)
        level = df.sparkSession.sql(f"select t.*, e.pos, e.key as _k, e.value as _n from {view} t, lateral variant_explode(t._v) e")
        df.sparkSession.catalog.dropTempView(view)
        name = F.when(F.col("_k").isNull(), F.concat("_up", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("_up") == "", F.col("_k")).otherwise(F.concat_ws(".", "_up", "_k"))
        level = level.select(*keep, F.col("_n").alias("_v"), name.alias("key"))
    return reduce(DataFrame.unionByName, found)


def terraform_state(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """String leaves of a state file as `key = "value"`, elements of arrays bare; one fragment per file."""
    leaves = flatten_json(df.select(path.alias("_p"), text.alias("_t")), ["_p"], F.col("_t"))
    line = F.when(F.col("key").endswith("]"), F.col("value")).otherwise(F.concat(F.element_at(F.split("key", r"\."), -1), F.lit(' = "'), "value", F.lit('"')))
    files = leaves.select("_p", F.struct("key", line.alias("line")).alias("x")).groupBy("_p").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("_t"))
    return as_fragments(files, F.col("_p"), "terraform", F.col("_t"))


def postman(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """String values of a collection, each under its place."""
    leaves = flatten_json(df.select(path.alias("_p"), text.alias("_t")), ["_p"], F.col("_t")).where("key like 'item%' or key like 'variable%'")
    leaves = leaves.where(r"key rlike '(\\.value|body\\.raw|url\\.raw|\\.url)$' and value <> ''")
    return as_fragments(leaves, F.concat(F.lit("postman://"), "_p", F.lit("/"), "key"), "postman", F.col("value"), {"collection": F.col("_p"), "field": F.col("key")})


def elasticsearch_hits(hits: DataFrame) -> DataFrame:
    """hits: (_index, _id, _source as JSON text). Leaves of eight bytes and more."""
    leaves = flatten_json(hits.select("_index", "_id", "_source"), ["_index", "_id"], F.col("_source")).where("octet_length(value) >= 8")
    return as_fragments(leaves, F.concat(F.lit("es://"), F.concat_ws("/", "_index", "_id", "key")), "elasticsearch", F.col("value"), {"index": F.col("_index"), "id": F.col("_id")})


def ansible(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """YAML files; of an encrypted one only the header and a notice."""
    vault = F.startswith(text, F.lit("$ANSIBLE_VAULT;"))
    shown = F.when(vault, F.concat(F.substring_index(text, "\n", 1), F.lit("\n# encrypted content is not scanned"))).otherwise(text)
    return as_fragments(df.where(path.rlike(r"\.ya?ml$")), path, "ansible", shown, {"vault": F.when(vault, "true")})


def kubernetes(objects: DataFrame) -> DataFrame:
    """objects: (json) of single secrets, config maps and pods. Secret data is decoded; system namespaces are skipped."""
    schema = "kind string, metadata struct<name: string, namespace: string>, data map<string,string>, stringData map<string,string>, spec struct<containers: array<struct<name: string, env: array<struct<name: string, value: string>>>>, initContainers: array<struct<name: string, env: array<struct<name: string, value: string>>>>>"
    o = objects.select(F.from_json("json", schema).alias("o")).select("o.*").where("metadata.namespace is null or metadata.namespace not in ('kube-system', 'kube-public', 'kube-node-lease')")
    line = lambda k, v: F.concat(k, F.lit(' = "'), v, F.lit('"'))
    plain = lambda m: F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: line(e["key"], e["value"]))
    decoded = F.transform(F.map_entries(F.coalesce("data", F.create_map().cast("map<string,string>"))), lambda e: line(e["key"], F.make_valid_utf8(F.coalesce(F.try_to_binary(F.translate(e["value"], "-_", "+/"), F.lit("base64")), e["value"].cast("binary")).cast("string"))))
    boxes = F.concat(F.coalesce("spec.containers", F.array()), F.coalesce("spec.initContainers", F.array()))
    env = F.flatten(F.transform(boxes, lambda c: F.transform(F.filter(F.coalesce(c["env"], F.array()), lambda v: v["value"].isNotNull()), lambda v: line(v["name"], v["value"]))))
    lines = F.when(F.col("kind") == "Secret", F.concat(decoded, plain(F.col("stringData")))).when(F.col("kind") == "ConfigMap", plain(F.col("data"))).otherwise(env)
    o = o.withColumn("_t", F.array_join(lines, "\n")).where("_t <> ''")
    return as_fragments(o, F.concat(F.lit("k8s://"), F.concat_ws("/", F.coalesce("metadata.namespace", F.lit("default")), F.lower("kind"), "metadata.name")), "kubernetes", F.col("_t"), {"kind": F.col("kind")})


def docker_inspect(images: DataFrame) -> DataFrame:
    """images: (image, json as `docker inspect` gives for one). Environment, labels and history that sets variables."""
    i = images.select("image", F.from_json("json", "Config struct<Env: array<string>, Labels: map<string,string>>, History array<struct<created_by: string>>").alias("j"))
    env = F.transform(F.coalesce("j.Config.Env", F.array()), lambda e: F.concat(F.lit("export "), e))
    labels = F.transform(F.map_entries(F.coalesce("j.Config.Labels", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    steps = F.filter(F.transform(F.coalesce("j.History", F.array()), lambda h: h["created_by"]), lambda h: h.rlike(r"\b(ENV|ARG|RUN)\b"))
    parts = i.select("image", F.explode(F.array(F.struct(F.lit("env").alias("k"), env.alias("l")), F.struct(F.lit("labels").alias("k"), labels.alias("l")), F.struct(F.lit("history").alias("k"), steps.alias("l")))).alias("p"))
    parts = parts.select("image", "p.k", F.array_join("p.l", "\n").alias("_t")).where("_t <> ''")
    return as_fragments(parts, F.concat(F.lit("docker://"), "image", F.lit("/"), "k"), "docker", F.col("_t"), {"image": F.col("image")})


def messages(df: DataFrame, scheme: str, place: list[str], text: str) -> DataFrame:
    """Chat messages (Slack, Discord and the like); empty ones are dropped."""
    return as_fragments(df.where(F.col(text).isNotNull() & (F.col(text) != "")), F.concat(F.lit(f"{scheme}://"), F.concat_ws("/", *(F.col(c).cast("string") for c in place))), scheme, F.col(text))


def repository_files(files: DataFrame, scheme: str, owner: str = "owner", repo: str = "repo", most: int = 1 << 20) -> DataFrame:
    """Recorded file listings of a code host: (owner, repo, file, sha, content in base64)."""
    text = F.make_valid_utf8(F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64")).cast("string"))
    f = files.withColumn("_t", text).where(F.col("_t").isNotNull() & (F.octet_length("_t") <= most))
    return as_fragments(f, F.concat(F.lit(f"{scheme}://"), F.concat_ws("/", owner, repo, "file")), scheme, F.col("_t"), {"owner": F.col(owner), "repo": F.col(repo), "sha": F.col("sha")})


def table_cells(df: DataFrame, table: str, key: Column, source: str = "db", port: str = "0") -> DataFrame:
    """One fragment per cell of a table that isn't null: `db://source:port/table/row/column`."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns))
    rows = df.select(key.cast("string").alias("_r"), F.explode(cells).alias("c")).select("_r", "c.*").where("value is not null")
    return as_fragments(rows, F.concat(F.lit(f"db://{source}:{port}/{table}/row"), "_r", F.lit("/"), "column"), "database", F.col("value"), {"table": F.lit(table), "column": F.col("column"), "row_index": F.col("_r")})


def dialect(uri: Column) -> Column:
    """The database dialect of a connection URI."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z+]+):", 1))
    return F.when(scheme.isin("postgres", "postgresql"), "postgres").when(scheme.isin("mysql", "mariadb"), "mysql").when(scheme.isin("mssql", "sqlserver"), "mssql").when(scheme.startswith("mongodb"), "mongodb").when(scheme == "sqlite", "sqlite").otherwise("unknown")


def schema_of_fragments() -> T.StructType:
    return T._parse_datatype_string("path string, source_type string, size long, attributes map<string,string>, text string")
