"""Rules against fragments: one pass of an automaton over all keywords, then the regexes of those rules whose keyword occurs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decode import deep_decode, deep_decode_udf
from ..functions.entropy import entropy_of
from . import discovery
from .rules import as_json, compiled, rule_buckets
from .stages import literals

#: Characters of lines that go on at once; each match brings its whole line, however long.
BATCH = 8_000_000
_loaded: dict[tuple[str, str], Matcher] = {}

_DDL = "rule_id string, start long, end long, secret string, line_no long, line string, entropy double, path_rank int"


class Matcher:
    def __init__(self, rules: list[dict], keyword_mode: str):
        self.rules = [(r["id"], compiled(r["regex"]), compiled(r["secret_group_regex"]) if r["secret_group_regex"] else None, [compiled(a) for a in r["allowlist"] or []], r["entropy_threshold"]) for r in rules]
        self.mode, self.bare, by_word = keyword_mode, [], {}
        for n, r in enumerate(rules):
            words = {k.lower() for k in r["keywords"] or [] if k}
            if not words:
                self.bare.append(n)
            for k in words:
                by_word.setdefault(k, []).append(n)
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k, ns in by_word.items():
                self.automaton.add_word(k, (len(k), ns))
            if by_word:
                self.automaton.make_automaton()
            self.any_word = None
        except ImportError:
            import re

            self.automaton, self.by_word = None, by_word
            self.any_word = re.compile("(?=(" + "|".join(map(re.escape, sorted(by_word, key=len, reverse=True))) + "))") if by_word else None
        self.some = bool(by_word)

    def hits(self, low: str) -> Iterator[tuple[int, int, list[int]]]:
        if not self.some:
            return
        if self.automaton is None:
            for m in self.any_word.finditer(low):
                yield m.start(), m.start() + len(m[1]), self.by_word[m[1]]
        elif self.mode == "leftmost_first":
            after, found = 0, sorted(((end + 1 - n, end + 1, ns[:1]) for end, (n, ns) in self.automaton.iter(low)), key=lambda h: (h[0], h[2]))
            for a, z, ns in found:
                if a >= after:
                    after = z
                    yield a, z, ns
        else:
            for end, (n, ns) in self.automaton.iter(low):
                yield end + 1 - n, end + 1, ns

    def spans(self, text: str, window: int | None) -> dict[int, list[list[int]]]:
        """Where to look for each rule: around its keywords, windows that overlap as one."""
        out: dict[int, list[list[int]]] = {n: [[0, len(text)]] for n in self.bare}
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for a, z, ns in sorted(self.hits(low), key=lambda h: h[0]):
            a, z = (0, len(text)) if window is None else (max(0, a - window), min(len(text), z + window))
            for n in ns:
                own = out.setdefault(n, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], z)
                else:
                    own.append([a, z])
        return out

    def find(self, text: str, window: int | None) -> Iterator[tuple[str, int, int, str, float]]:
        for n, spans in sorted(self.spans(text, window).items()):
            for a, z in spans:
                yield from self.tried(n, text, a, z)

    def tried(self, n: int, text: str, a: int, z: int) -> Iterator[tuple[str, int, int, str, float]]:
        """Matches of a rule between two places."""
        name, shape, group, allow, least = self.rules[n]
        for m in shape.finditer(text, a, z):
            secret = m[1] if shape.groups and m[1] is not None else m[0]
            if group and (g := group.search(m[0])) and group.groups and g[1] is not None:
                secret = g[1]
            entropy = entropy_of(secret.encode("utf-8", "replace"))
            if not any(p.search(secret) for p in allow) and (least is None or entropy >= least):
                yield name, m.start(), m.end(), secret, round(entropy, 9)


def _matcher(spec: str, mode: str) -> Matcher:
    if (spec, mode) not in _loaded:
        _loaded[spec, mode] = Matcher(json.loads(spec), mode)
    return _loaded[spec, mode]


def match_rules(fragments: DataFrame, rules: DataFrame, id_col: str, text_col: str, window: int | None = None, keyword_mode: str = "all", cap: int | None = None) -> DataFrame:
    """One row per match: all columns of fragments but the text, rule_id, start and end (characters, from 0), secret, line_no
    (from 1), line (all lines that the match touches, whole) and entropy. The rules are broadcast with the task; fragments are not shuffled.

    keyword_mode: `all` tries each rule one of whose keywords occurs; `leftmost_first` lets a keyword hide later ones.
    window: a rule is tried only within so many characters on either side of its keywords, which cuts longer matches; in the
    whole text if None. cap: only so many first characters of a text are looked at, all if None.
    """
    spec = as_json(rules)
    kept = [c for c in fragments.columns if c != text_col]
    schema = fragments.select(*kept).limit(0).selectExpr("*", "cast(null as string) rule_id", "0L start", "0L end", "cast(null as string) secret", "0L line_no", "cast(null as string) line", "0D entropy").schema

    def pack(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)]
        places = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(places) for c in range(len(kept))), *cols], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _matcher(spec, keyword_mode)
        for batch in batches:
            at, rows, size = [], [], 0
            for i, text in enumerate(batch.column(len(kept)).to_pylist()):
                text = (text or "") if cap is None else (text or "")[:cap]
                seen, line_no, counted = set(), 1, 0
                for name, a, z, secret, entropy in tool.find(text, window):
                    if (name, a) not in seen:
                        seen.add((name, a))
                        begin = text.rfind("\n", 0, a) + 1
                        end = text.find("\n", z)
                        if a < counted:
                            line_no, counted = 1, 0
                        line_no, counted = line_no + text.count("\n", counted, a), a
                        at.append(i)
                        rows.append((name, a, z, secret, line_no, text[begin : end if end >= 0 else len(text)], entropy))
                        size += len(rows[-1][5])
                        if size > BATCH:
                            yield pack(batch, at, rows)
                            at, rows, size = [], [], 0
            yield pack(batch, at, rows)

    return fragments.select(*kept, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def match_decoded(fragments: DataFrame, rules: DataFrame, id_col: str, text_col: str, depth: int = 4) -> DataFrame:
    """As match_rules, over what quoted and long literals decode to; adds encoding_chain. Places are within the decoded text."""
    some = fragments.withColumn("_literal", F.explode(F.array_distinct(literals(F.col(text_col))))).where(F.octet_length("_literal") >= 16).drop(text_col)
    decoded = some.withColumn("_d", F.explode(deep_decode_udf(depth)("_literal"))).select("*", F.col("_d.data").alias(text_col), F.array_join("_d.chain", ">").alias("encoding_chain")).drop("_d", "_literal")
    return match_rules(decoded, rules, id_col, text_col)


def merged_kind(rule_id: Column, kind: Column) -> Column:
    """The kind that a rule's name says, else the candidate's."""
    r = F.lower(rule_id)
    return (
        F.when(r.contains("jwt"), "Jwt").when(r.contains("bearer"), "BearerAuth").when(r.contains("private-key") | r.contains("pem"), "PrivateKey").when(r.contains("url") & r.contains("credential"), "UrlCredentials")
        .when(r.contains("api-key"), "ApiKeyAssignment").when(r.contains("password"), "PasswordAssignment").when(r.contains("token"), "TokenAssignment").otherwise(kind)
    )


#: What match_routed adds to a match from its candidate, beside what all matches have.
ROUTED = ["identifier", "snippet", "pattern", "typed", "multiline", "secondary_context", "has_secret_identifier", "has_auth_context", "proximity", "routed_kind", "tristream", "candidate_entropy", "encoding_chain"]


def match_routed(candidates: DataFrame, rules: DataFrame, id_col: str, depth: int = 4) -> DataFrame:
    """Matches of routed candidates: each is tried by the rules of its bucket alone, in its snippet and in what the literals of the
    snippet decode to. Columns as those of match_rules, and ROUTED.

    A candidate whose bucket has no rule is dropped; one for authorization headers is tried by rules for tokens then. Places are
    those of the snippet in the text, or within the decoded text if there is an encoding_chain. Rules are broadcast with the
    task, candidates are not shuffled.
    """
    by_bucket: dict[str, list[str]] = {}
    for r in rule_buckets(rules).orderBy("bucket", "id").collect():
        by_bucket.setdefault(r.bucket, []).append(r.id)
    by_bucket.setdefault("auth_header", by_bucket.get("token", []))
    spec = as_json(rules)
    held = candidates.select(
        F.col("id").alias(id_col), "path", F.nullif("identifier", F.lit("")).alias("identifier"), "snippet", "pattern", "typed", "multiline", "secondary_context", "has_secret_identifier", "has_auth_context", "proximity",
        F.col("kind").alias("routed_kind"), F.least((F.col("proximity") + F.col("structure")) / 2, F.lit(1.0)).alias("tristream"), F.col("entropy").alias("candidate_entropy"), (F.col("line_no") + 1).cast("long").alias("line_no"),
        F.col("offset").alias("_offset"), F.col("bucket").alias("_bucket"), literals(F.col("snippet")).alias("_literals"),
    )
    n_kept = len(held.columns) - 3
    names = held.columns[:n_kept]
    found = pa.schema([("rule_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("line", pa.string()), ("match_entropy", pa.float64()), ("encoding_chain", pa.string())])
    schema = held.select(*names).selectExpr("*", "cast(null as string) rule_id", "0L start", "0L end", "cast(null as string) secret", "cast(null as string) line", "0D match_entropy", "cast(null as string) encoding_chain").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _matcher(spec, "all")
        place = {rule[0]: n for n, rule in enumerate(tool.rules)}
        wanted = {b: [place[i] for i in ids] for b, ids in by_bucket.items()}
        for batch in batches:
            at, rows = [], []
            columns = zip(*(batch.column(c).to_pylist() for c in (names.index("snippet"), n_kept, n_kept + 1, n_kept + 2)))
            for i, (snippet, offset, bucket, words) in enumerate(columns):
                if not wanted.get(bucket):
                    continue
                texts = [(snippet, None)]
                for word in words or []:
                    texts += [(data.decode("utf-8", "replace"), ">".join(chain)) for data, chain in deep_decode(word.encode(), depth)]
                for text, chain in texts:
                    for n in wanted.get(bucket, ()):
                        for name, a, z, secret, entropy in tool.tried(n, text, 0, len(text)):
                            at.append(i)
                            low = offset if chain is None else 0
                            rows.append((name, a + low, z + low, secret, snippet, entropy, chain))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(found), found)]
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(places) for c in range(n_kept)), *cols], names=schema.names)

    return held.mapInArrow(run, schema).withColumn("routed_kind", merged_kind(F.col("rule_id"), F.col("routed_kind"))).withColumnRenamed("match_entropy", "entropy")


def merge_matches(direct: DataFrame, routed: DataFrame, id_col: str) -> DataFrame:
    """The union, of which one match stays for each fragment, rule and start: the direct one first."""
    both = direct.withColumn("path_rank", F.lit(0)).unionByName(routed.withColumn("path_rank", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(id_col, "rule_id", "start").orderBy("path_rank", "end", "secret"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n")


def match_all(fragments: DataFrame, rules: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """Both passes: all rules over whole texts, and the rules of their buckets over the candidates found in the texts."""
    direct = match_rules(fragments, rules, id_col, text_col)
    return merge_matches(direct, match_routed(discovery.route(discovery.candidates(fragments, id_col, text_col, path_col)), rules, id_col), id_col)


def keyword_prefilter(fragments: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rule_id) for every rule one of whose keywords the text contains in any case: one pass of the automaton over a text,
    however many rules there are; rules without keywords are not listed. Fragments are not shuffled."""
    spec = as_json(rules)
    some = fragments.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = some.select(id_col).withColumn("rule_id", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _matcher(spec, "all")
        for batch in batches:
            at, names = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n in sorted({n for _, _, ns in tool.hits((text or "").lower()) for n in ns}):
                    at.append(i)
                    names.append(tool.rules[n][0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string())], names=schema.names)

    return some.mapInArrow(run, schema)
