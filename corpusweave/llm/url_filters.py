"""URL filters by a temporal list join: DataFrame functions only.

Dated list entries (list, pattern, action add/remove, at) become validity intervals: an entry's state holds from its time
until the next entry of the same list and pattern. Every capture is matched as of its fetch time against the intervals of
its patterns: its host, every parent domain of two labels or more, and host plus first path segment. Matching is an
equi-join on the pattern with the interval as a further condition, so a hot pattern is split by adaptive execution and no
capture meets an entry of another pattern. The join isn't forced to broadcast: Spark does that only where the measured
size of the intervals is below its threshold.

Defined cases: patterns are compared in lower case, without surrounding spaces; entries with a null list, pattern, time or
an action other than add/remove are void; at equal
times add wins over remove; repeated entries change nothing. A host is cut to the numbers of labels that listed patterns have, so a host of any
length has no more candidates than that. Repeated captures (same id, url and time) are one capture. A
null url, one without a host, or a null fetch time is on no list. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
SEGMENT = r"^[a-z][a-z0-9+.\-]*://[^/?#]+/([^/?#]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, begin, end (null: open): the spans in which an entry is active."""
    clean = entries.select(F.col("list").cast("string").alias("list"), F.lower(F.trim(F.col("pattern").cast("string"))).alias("pattern"), F.col("action").cast("string").alias("action"), F.col("at").alias("begin"))
    clean = clean.where(F.col("list").isNotNull() & F.col("begin").isNotNull() & F.col("action").isin("add", "remove"))
    states = clean.groupBy("list", "pattern", "begin").agg(F.max(F.col("action") == "add").alias("active"))
    w = Window.partitionBy("list", "pattern").orderBy("begin")
    return states.withColumn("end", F.lead("begin").over(w)).where("active").drop("active")


def patterns(counts: list[int], url: str = "url") -> F.Column:
    """All patterns that can match a url. counts: the numbers of labels that domains on the lists have."""
    low = F.lower(F.trim(F.col(url)))
    host = F.regexp_extract(low, HOST, 1)
    labels = F.reverse(F.split(host, r"\."))
    domains = F.transform(F.filter(F.lit(counts).cast("array<int>"), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.reverse(F.slice(labels, 1, n)), "."))
    segment = F.regexp_extract(low, SEGMENT, 1)
    more = F.when(segment != "", F.array(host, F.concat(host, F.lit("/"), segment))).otherwise(F.array(host))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, more)))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at and lists (sorted array of the lists that hold the capture) of every distinct capture."""
    caps = captures.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "fetched_at")
    spans = c.staged(intervals(entries), "intervals")
    lengths = spans.where(~F.contains("pattern", F.lit("/"))).select(F.size(F.split("pattern", r"\.")).alias("n")).where("n >= 2").distinct()
    counts = sorted(r.n for r in lengths.collect())  # no more than the longest pattern has labels
    keyed = caps.select("*", F.explode_outer(patterns(counts)).alias("pattern"))
    hit = keyed.join(spans, (keyed.pattern == spans.pattern) & (keyed.fetched_at >= spans.begin) & (spans.end.isNull() | (keyed.fetched_at < spans.end)), "left")
    return hit.groupBy("page_id", "url", "fetched_at").agg(F.array_sort(F.collect_set("list")).alias("lists"))


# ---------------------------------------------------------------- the query: lists and fetch times derived from pages

ORIGIN, SPAN = 1_672_531_200, 63_072_000
LISTS = ("adult", "malware", "spam")


def _number(of: str) -> F.Column:
    return F.conv(F.substring(F.md5(F.col(of).cast("binary")), 1, 8), 16, 10).cast("bigint")


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch time (epoch seconds) spread over two years by the id."""
    return pages.select("page_id", "url", (F.lit(ORIGIN) + F.pmod(F.col("page_id") * 86_413, F.lit(SPAN))).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Entries for hosts, two-label domains and first path segments of pages: added, for some removed, for some added again."""
    low = F.lower(F.trim(F.col("url")))
    host, segment = F.regexp_extract(low, HOST, 1), F.regexp_extract(low, SEGMENT, 1)
    both = pages.select(host.alias("host"), segment.alias("segment")).distinct()
    hosts = both.select(F.col("host").alias("pattern"))
    domains = both.select(F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".").alias("pattern")).where("pattern like '%.%'")
    paths = both.where("segment != ''").select(F.concat("host", F.lit("/"), "segment").alias("pattern"))
    keys = hosts.union(domains).union(paths).where("pattern != ''").distinct().withColumn("x", _number("pattern"))
    lists = F.element_at(F.array(*map(F.lit, LISTS)), (F.col("x") % 3 + 1).cast("int"))
    begin = F.lit(ORIGIN) + F.col("x") % 40_000_000
    stop = begin + 5_000_000 + F.col("x") % 7_000_000
    event = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    steps = F.concat(F.array(event("add", begin)), F.when(F.col("x") % 2 == 0, F.array(event("remove", stop))).otherwise(F.array().cast("array<struct<action:string,at:bigint>>")), F.when(F.col("x") % 4 == 0, F.array(event("add", stop + 3_000_000))).otherwise(F.array().cast("array<struct<action:string,at:bigint>>")))
    return keys.select(lists.alias("list"), "pattern", F.inline(steps))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the lists that hold every page at its fetch time."""
    pages = c.read(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(captures_of(pages), entries_of(pages))
    return out.select("page_id", "url", "fetched_at", F.array_join("lists", ",").alias("lists"), F.size("lists").cast("bigint").alias("n_lists"), (F.size("lists") > 0).alias("blocked"))


SQL = r"""
with p as (select page_id, url, 1672531200 + ((page_id * 86413) % 63072000) as fetched_at, lower(trim(url)) as low from pages),
q as (select *, regexp_extract(low, '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) as host, regexp_extract(low, '^[a-z][a-z0-9+.\-]*://[^/?#]+/([^/?#]+)', 1) as segment from p),
k as (select host as pattern from q where host <> '' union
      select array_to_string(string_split(host, '.')[-2:], '.') from q where host like '%.%' union
      select host || '/' || segment from q where host <> '' and segment <> ''),
x as (select pattern, ('0x' || substr(md5(pattern), 1, 8))::bigint as x from k),
e as (select pattern, list_value('adult', 'malware', 'spam')[1 + x % 3] as list, 'add' as action, 1672531200 + x % 40000000 as since from x
      union all select pattern, list_value('adult', 'malware', 'spam')[1 + x % 3], 'remove', 1672531200 + x % 40000000 + 5000000 + x % 7000000 from x where x % 2 = 0
      union all select pattern, list_value('adult', 'malware', 'spam')[1 + x % 3], 'add', 1672531200 + x % 40000000 + 5000000 + x % 7000000 + 3000000 from x where x % 4 = 0),
i as (select *, lead(since) over (partition by list, pattern order by since) as ends from e),
m as (select distinct q.page_id, q.url, q.fetched_at, i.list from q join i on i.action = 'add' and q.fetched_at >= i.since and (i.ends is null or q.fetched_at < i.ends)
      and (i.pattern = q.host or q.host like '%.' || i.pattern and i.pattern like '%.%' or i.pattern = q.host || '/' || q.segment and q.segment <> ''))
select q.page_id, q.url, q.fetched_at, coalesce(string_agg(m.list, ',' order by m.list), '') as lists, count(m.list) as n_lists, count(m.list) > 0 as blocked
from (select distinct page_id, url, fetched_at from q) q left join m using (page_id, url, fetched_at) group by all
"""
