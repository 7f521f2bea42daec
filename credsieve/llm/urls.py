"""URL filters against lists that change: dated entries become validity intervals, an as-of join judges each capture.

An entry is a host (which stands for its subdomains, too) or a host and the first parts of a path; at its date it is added to a
category or taken off. A capture offers all its host suffixes, bare and with path prefixes as deep as the list's deepest entry, as keys; it is judged by the entries
whose interval holds the time of the fetch. Captures are judged once per URL and time, so a host's many captures are
spread over its URLs and times; lists up to a checked size are broadcast, longer ones joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Intervals that may be broadcast, some 100 bytes each.
MOST_INTERVALS = 500_000

# What of a URL is the host, and what the path.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)"


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, category, since, until) from (pattern, category, action: add or remove, at): an entry is valid from an add
    to the next event of the same pattern and category; until is null while there is none.

    Patterns are compared in lower case, without a dot at the end or a slash at either. Of events at the same time the remove counts.
    Events with a null anywhere or another action are left out.
    """
    pattern = F.regexp_replace(F.regexp_replace(F.lower("pattern"), "^/+|/+$", ""), r"\.$", "")
    events = entries.where("pattern is not null and category is not null and at is not null and action in ('add', 'remove')")
    events = events.select(pattern.alias("pattern"), "category", "at", F.col("action").alias("action"))
    events = events.groupBy("pattern", "category", "at").agg(F.max("action").alias("action"))
    later = F.lead("at").over(Window.partitionBy("pattern", "category").orderBy("at"))
    return events.select("pattern", "category", "action", F.col("at").alias("since"), later.alias("until")).where("action = 'add'").drop("action")


def keys(url: Column, depth: Column, labels_of_entries: list[int]) -> Column:
    """What entries of up to `depth` path parts and hosts of so many labels can match the URL; null for none that has a host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    labels = F.split(host, r"\.")
    sizes = F.filter(F.array(*map(F.lit, labels_of_entries)).cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(sizes, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    parts = F.filter(F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/"), lambda p: p != "")
    starts = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), depth)), lambda i: F.array_join(F.concat(F.array(F.lit("")), F.slice(parts, F.lit(1), i)), "/"))
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p)))))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with host, categories (of all entries that were valid at the time, sorted), entry (the longest of them, the
    first in order if several) and blocked.

    A null, empty or malformed URL has a null host and isn't blocked; nor is a capture without a time. Very long URLs are judged
    whole, by as many of their parts as the list's entries have. Rows that repeat are all judged and stay. An empty list blocks
    nothing, an empty table gives no rows. Other columns stay; columns with the new names, in any case of their letters, are
    replaced.
    """
    spark = captures.sparkSession
    names = shared.without(captures.columns, "host", "categories", "entry", "blocked")
    rows = captures.select(*names)
    url, at = F.col(url_col), F.col(time_col)
    intervals, _ = shared.stash(validity(entries), "intervals")
    # Distinct URLs and times, by names that no column of captures has.
    own = shared.fresh(names, "url", "at", "categories", "entry")
    judged = rows.where(url.isNotNull() & at.isNotNull()).select(url.alias("url"), at.alias("at")).distinct()
    labels = F.size(F.split(F.substring_index("pattern", "/", 1), r"\."))
    n, depth, sizes = intervals.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)), F.array_sort(F.collect_set(labels))).first()
    # Suffixes of as many labels as no entry has, such as bare top-level domains, are not offered.
    offered = judged.select("url", "at", F.explode(F.array_distinct(keys(F.col("url"), F.lit(depth), sizes))).alias("pattern"))
    side = F.broadcast(intervals) if n <= MOST_INTERVALS else intervals
    valid = (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    hits = offered.join(side, "pattern").where(valid)
    longest = F.min(F.struct((-F.length("pattern")).alias("l"), F.col("pattern").alias("p")))["p"]
    found = hits.groupBy("url", "at").agg(F.array_sort(F.collect_set("category")).alias("categories"), longest.alias("entry")).toDF(*own)
    out = rows.join(found, (url == F.col(own[0])) & (at == F.col(own[1])), "left")
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return out.select(
        *names,
        F.when(host != "", host).alias("host"),
        F.coalesce(own[2], F.array().cast("array<string>")).alias("categories"),
        F.col(own[3]).alias("entry"),
        F.col(own[3]).isNotNull().alias("blocked"),
    )


def _number(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long")


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts of the pages and their paths, which grows with them; its dates follow from digests.

    A third of the hosts is added in one of two categories and some are taken off again; so is a fifth of the first path parts.
    """
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    host = F.lower(F.regexp_extract("url", HOST, 1))
    part = F.lower(F.element_at(F.split(F.regexp_extract("url", PATH, 1), "/"), 1))
    hosts = pages.select(host.alias("pattern")).where("pattern <> ''").distinct().where(_number(F.col("pattern")) % 3 == 0)
    paths = pages.where((host != "") & (part != "")).select(F.concat_ws("/", host, part).alias("pattern")).distinct().where(_number(F.col("pattern")) % 5 == 0)
    both = hosts.unionByName(paths)
    n, m = _number(F.col("pattern")), _number(F.concat(F.col("pattern"), F.lit("#")))
    category = F.when(m % 2 == 0, "spam").otherwise("adult")
    added = both.select("pattern", category.alias("category"), F.lit("add").alias("action"), day(n % 1000).alias("at"))
    gone = both.where(m % 3 != 0).select("pattern", category.alias("category"), F.lit("remove").alias("action"), day(n % 1000 + 30 + m % 400).alias("at"))
    return added.unionByName(gone)


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    """All pages, fetched on days that follow from a digest of id and URL, against the list of sample_list()."""
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2020-01-01").cast("date"), (_number(F.concat_ws("|", F.col("page_id").cast("string"), "url")) % 1400).cast("int"))
    found = judge(pages.withColumn("fetched_at", fetched), sample_list(pages))
    return found.select("page_id", "host", "fetched_at", F.array_join("categories", ",").alias("categories"), "entry", "blocked")


ORACLE = r"""
with p as (
  select page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) as host,
         string_split(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)', 1)), '/') as segs,
         date '2020-01-01' + ((('0x' || substr(md5(page_id::varchar || '|' || url), 1, 7))::bigint % 1400)::int) as fetched_at
  from pages),
pats as (
  select distinct host as pattern, 3 as every from p where host <> ''
  union select distinct host || '/' || segs[1], 5 from p where host <> '' and segs[1] <> ''),
nums as (
  select pattern, ('0x' || substr(md5(pattern), 1, 7))::bigint as n, ('0x' || substr(md5(pattern || '#'), 1, 7))::bigint as m, every from pats),
iv as (
  select pattern, case when m % 2 = 0 then 'spam' else 'adult' end as category, date '2020-01-01' + ((n % 1000)::int) as since,
         case when m % 3 <> 0 then date '2020-01-01' + ((n % 1000 + 30 + m % 400)::int) end as until
  from nums where n % every = 0),
labelled as (select *, string_split(regexp_replace(host, '\.$', ''), '.') as labels, list_filter(segs, lambda x: x <> '') as parts from p),
offered as (
  select distinct page_id, url, fetched_at, array_to_string(labels[i:], '.') || case when j = 0 then '' else '/' || array_to_string(parts[1:j], '/') end as pattern
  from labelled, unnest(range(1, len(labels) + 1)) as a(i), unnest(range(0, 3)) as b(j) where host <> '' and j <= len(parts)),
hits as (
  select o.page_id, o.url, o.fetched_at, iv.pattern, iv.category from offered o join iv on o.pattern = iv.pattern
  where o.fetched_at >= iv.since and (iv.until is null or o.fetched_at < iv.until)),
best as (
  select page_id, url, fetched_at, array_to_string(list_sort(list_distinct(list(category))), ',') as categories,
         (list(pattern order by -length(pattern), pattern))[1] as entry from hits group by all)
select p.page_id, case when p.host <> '' then regexp_replace(p.host, '\.$', '') end as host, p.fetched_at, coalesce(b.categories, '') as categories,
       b.entry, b.entry is not null as blocked
from p left join best b on p.page_id = b.page_id and p.url = b.url and p.fetched_at = b.fetched_at
"""
