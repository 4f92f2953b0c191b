"""URL filters by a temporal list join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessergraph.llm.common import attach

#: Lists of at most so many intervals in all are broadcast (some 30 MB); longer ones are joined by a shuffle.
BROADCAST_INTERVALS = 200_000


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if the URL has no authority part."""
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\\s]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def url_keys(url: Column) -> Column:
    """All list entries that would cover a URL: its host, every parent domain, and the host with each leading part of the
    path. An address of digits has no parent domains."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.when(host.rlike(r"^[\d.]+$|^\["), F.lit(1)).otherwise(F.size(labels))
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\\s]*/([^?#\s]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    prefixes = F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def validity_intervals(changes: DataFrame) -> DataFrame:
    """``(entry, list_name, verdict, since, until)`` from dated list changes ``(entry, list_name, verdict, action, at)``.

    An ``add`` holds from its time to the next change of the same entry in the same list, exclusive, or without end;
    a ``remove`` ends it. At equal times adds win over removes, among adds the verdict ``block`` wins, and one of
    several equal rows counts. Rows with a null field, or an action or verdict other than these, are ignored.
    """
    c = changes.select(F.lower(F.trim("entry")).alias("entry"), "list_name", "verdict", "action", "at").dropna()
    c = c.filter("action in ('add', 'remove') and verdict in ('block', 'allow') and entry <> ''")
    # One change for each time: the window below then never sees a tie.
    rank = F.struct((F.col("action") == "add").cast("int").alias("a"), (F.col("verdict") == "block").cast("int").alias("v"))
    c = c.groupBy("entry", "list_name", "at").agg(F.max(rank).alias("r"))
    until = F.lead("at").over(Window.partitionBy("entry", "list_name").orderBy("at"))
    c = c.withColumn("until", until).filter("r.a = 1")
    return c.select("entry", "list_name", F.when(F.col("r.v") == 1, "block").otherwise("allow").alias("verdict"), F.col("at").alias("since"), "until")


def temporal_url_filter(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """Judge each capture ``(page_id, url, fetched_at)`` by the list entries that were active when it was fetched.

    Returns one row for each capture: ``(page_id, url, fetched_at, host, verdict, entry, list_name, since)``. Of the
    active entries that cover the URL the longest decides, at equal length ``block`` before ``allow``, then the
    smallest list name; ``verdict`` is ``none`` and the last three columns are null where none is active. ``changes``
    as in :func:`validity_intervals`; ``at`` and ``fetched_at`` must have comparable types.

    All intervals of an entry travel as one array, so a capture joins at most one row for each of its keys, however
    often the entry changed; the interval is picked inside that array. Null ids and repeated rows are kept, row for row.
    A null or malformed URL and a null fetch time have the verdict ``none``. URLs of any length are judged whole. Other
    columns are ignored. Empty tables are allowed on either side.
    """
    c = captures.select("page_id", "url", "fetched_at", url_host(F.col("url")).alias("host"), url_keys(F.col("url")).alias("keys"))
    spans = F.collect_list(F.struct("since", "until", "verdict", "list_name")).alias("spans")
    entries = validity_intervals(changes).groupBy("entry").agg(spans)
    size = entries.agg(F.sum(F.size("spans")).alias("n")).first()["n"] or 0
    wide = c.withColumn("key", F.explode_outer("keys")).withColumn("n", F.greatest(F.size("keys"), F.lit(1))).drop("keys")
    if size <= BROADCAST_INTERVALS:
        hit = wide.join(F.broadcast(entries), wide.key == entries.entry, "left")
    else:
        # Top domains are keys of a large share of the captures; rows without key need no join.
        keyed = wide.filter("key is not null")
        keyed = attach(keyed, entries.select(F.col("entry").alias("key"), "spans"), "key", keyed.count(), "left")
        hit = keyed.unionByName(wide.filter("key is null"), allowMissingColumns=True).withColumn("entry", F.when(F.col("spans").isNotNull(), F.col("key")))
    active = F.filter("spans", lambda s: (s["since"] <= F.col("fetched_at")) & (s["until"].isNull() | (F.col("fetched_at") < s["until"])))
    # array_min of (verdict is allow, list name, ...) is the winner among the lists that hold this entry.
    ranked = F.transform(active, lambda s: F.struct((s["verdict"] == "allow").cast("int").alias("allow"), s["list_name"].alias("list_name"), s["since"].alias("since")))
    hit = hit.withColumn("w", F.array_min(ranked))
    best = F.when(F.col("w").isNotNull(), F.struct((-F.length("entry")).alias("short"), F.col("w.allow").alias("allow"), F.col("w.list_name").alias("list_name"), "entry", F.col("w.since").alias("since")))
    # Equal captures have equal answers: they are judged together and given back one by one.
    out = hit.groupBy("page_id", "url", "fetched_at", "host").agg(F.min(best).alias("b"), F.count("*").alias("rows"), F.max("n").alias("n"))
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.expr("cast(rows div n as int)"))))
    verdict = F.when(F.col("b").isNull(), "none").when(F.col("b.allow") == 1, "allow").otherwise("block")
    return out.select("page_id", "url", "fetched_at", "host", verdict.alias("verdict"), "b.entry", "b.list_name", "b.since")


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times; they follow from the id: seconds since 1970 within 2024."""
    return pages.select("page_id", "url", (F.lit(1704067200) + F.pmod(F.col("page_id") * 37, F.lit(366)) * 86400 + F.pmod(F.col("page_id") * 7919, F.lit(86400))).alias("fetched_at"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """List changes made from the pages' own sites, as there is no list table: hashes decide which hosts, domains and
    first path parts are listed, and when they are added, removed and added again."""
    host = url_host(F.col("url"))
    hosts = pages.select(host.alias("h"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]+)", 1).alias("p")).filter("h is not null").distinct()
    names = hosts.select(F.explode(F.array("h", F.regexp_extract("h", r"([^.]+\.[^.]+\.[^.]+)$", 1), F.when(F.col("p") != "", F.concat_ws("/", "h", "p")))).alias("entry"))
    d = names.filter("entry is not null and entry <> ''").distinct().withColumn("m", F.md5("entry"))
    num = lambda a, n: F.conv(F.substring("m", a, n), 16, 10).cast("long")
    d = d.withColumn("k", num(1, 1)).filter("k < 5").withColumn("verdict", F.when(F.col("k") == 4, "allow").otherwise("block"))
    d = d.withColumn("t", F.lit(1704067200) + num(2, 3) % 200 * 86400).withColumn("gone", F.col("t") + (1 + num(6, 3) % 100) * 86400)
    first = F.struct(F.lit("add").alias("action"), F.col("t").alias("at"))
    second = F.when(num(5, 1) % 2 == 0, F.struct(F.lit("remove").alias("action"), F.col("gone").alias("at")))
    third = F.when((num(5, 1) % 2 == 0) & (num(9, 1) < 8), F.struct(F.lit("add").alias("action"), (F.col("gone") + 30 * 86400).alias("at")))
    d = d.withColumn("c", F.explode(F.filter(F.array(first, second, third), lambda x: x.isNotNull())))
    return d.select("entry", F.when(num(10, 1) < 8, "abuse").otherwise("adult").alias("list_name"), "verdict", "c.action", "c.at")


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return temporal_url_filter(dated_captures(pages), dated_lists(pages))


ORACLE = r"""
with c as (
  select page_id, url, 1704067200 + (page_id * 37 % 366) * 86400 + page_id * 7919 % 86400 as fetched_at,
    nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\\s]*)', 1)), '^.*@', ''), ':\d*$', ''), '\.$', ''), '') as host,
    list_filter(string_split(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\\s]*/([^?#\s]*)', 1), '/'), lambda x: x <> '') as parts
  from pages
), n as (
  select host as entry from c where host is not null
  union select regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) from c where host is not null
  union select host || '/' || regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1) from c where host is not null and regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1) <> ''
), m as (
  select entry, md5(entry) as m from n where entry <> ''
), d as (
  select entry, case when ('0x' || substr(m, 1, 1))::int = 4 then 'allow' else 'block' end as verdict,
    1704067200 + ('0x' || substr(m, 2, 3))::int % 200 * 86400 as t, ('0x' || substr(m, 5, 1))::int % 2 = 0 as ends,
    (1 + ('0x' || substr(m, 6, 3))::int % 100) * 86400 as lasts, ('0x' || substr(m, 9, 1))::int < 8 as again,
    case when ('0x' || substr(m, 10, 1))::int < 8 then 'abuse' else 'adult' end as list_name
  from m where ('0x' || substr(m, 1, 1))::int < 5
), i as (
  select entry, list_name, verdict, t as since, case when ends then t + lasts end as until from d
  union all select entry, list_name, verdict, t + lasts + 30 * 86400, null from d where ends and again
), k as (
  select page_id, url, fetched_at, host, unnest(list_distinct(list_concat(
    list_transform(range(1, case when regexp_matches(host, '^[\d.]+$|^\[') then 2 else len(string_split(host, '.')) + 1 end), lambda x: array_to_string(string_split(host, '.')[x:], '.')),
    list_transform(range(1, len(parts) + 1), lambda x: host || '/' || array_to_string(parts[1:x], '/'))))) as key
  from c where host is not null
), b as (
  select page_id, verdict, entry, list_name, since, row_number() over (partition by page_id order by length(entry) desc, verdict desc, list_name, since) as r
  from k join i on key = entry and since <= fetched_at and (until is null or fetched_at < until)
)
select c.page_id, c.url, c.fetched_at, c.host, coalesce(b.verdict, 'none') as verdict, b.entry, b.list_name, b.since
from c left join b on c.page_id = b.page_id and b.r = 1
"""
