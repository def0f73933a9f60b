"""The crawl state machine as DataFrame stages: versions, rate slots, budget, cooldown, counters, dead letters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff_ceiling

BLOCKS, WINDOW_MS, COOLDOWN_MS = 3, 60_000, 120_000
ATTEMPTS = 4


def versions(fetches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """page, fetched_at, seq, content_hash, version_no: a version wherever the hash differs from the latest stored one.

    fetches: page, fetched_at, seq (breaks ties), content_hash. known: page, version_no, content_hash of the latest versions.
    A, B, A makes three versions.
    """
    w = Window.partitionBy("page").orderBy("fetched_at", "seq")
    if known is None:
        rows = fetches.withColumn("latest", F.lit(None).cast("string")).withColumn("base", F.lit(0))
    else:
        rows = fetches.join(known.select("page", F.col("content_hash").alias("latest"), F.col("version_no").alias("base")), "page", "left").withColumn("base", F.coalesce("base", F.lit(0)))
    rows = rows.withColumn("before", F.coalesce(F.lag("content_hash").over(w), "latest"))
    rows = rows.withColumn("new", (~F.col("content_hash").eqNullSafe(F.col("before"))).cast("int"))
    rows = rows.withColumn("version_no", (F.col("base") + F.sum("new").over(w)).cast("bigint"))
    return rows.where("new = 1").select("page", "fetched_at", "seq", "content_hash", "version_no")


def rate_slots(arrivals: DataFrame, delay: str = "delay") -> DataFrame:
    """Adds slot and wait (microseconds): slot_i = i * delay + max over j <= i of (now_j - j * delay) within a domain.

    arrivals: domain, now_us, seq, delay (microseconds, constant in a domain). A running maximum, no state.
    """
    w = Window.partitionBy("domain").orderBy("now_us", "seq")
    i = F.row_number().over(w) - 1
    d = F.col(delay)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = arrivals.withColumn("_i", i).withColumn("slot", F.col("_i") * d + F.max(F.col("now_us") - F.col("_i") * d).over(run))
    return rows.withColumn("wait", F.col("slot") - F.col("now_us")).drop("_i")


def budget(links: DataFrame, counted: DataFrame) -> DataFrame:
    """Adds outcome to new links (session, parent, place, url): enqueued while the session's count stays within max_pages; the
    first link of a parent beyond it is stored as skipped, the parent's later ones are dropped. counted: session, prior, max_pages.
    """
    order = Window.partitionBy("session").orderBy("parent", "place")
    over = Window.partitionBy("session", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = links.join(F.broadcast(counted), "session", "left").withColumn("count", F.coalesce("prior", F.lit(0)) + F.row_number().over(order))
    rows = rows.withColumn("beyond", F.coalesce(F.col("count") > F.col("max_pages"), F.lit(False)))
    earlier = F.coalesce(F.sum(F.col("beyond").cast("int")).over(over), F.lit(0))
    return rows.withColumn("outcome", F.when(~F.col("beyond"), "enqueued").when(earlier == 0, "skipped").otherwise("dropped")).drop("beyond", "prior", "max_pages", "count")


def frontier(links: DataFrame, known: DataFrame, max_depth: int) -> DataFrame:
    """New addresses one level deeper: links (url, depth of the page they stand on) minus known, each once, least depth."""
    new = links.where(F.col("depth") < max_depth).groupBy("url").agg((F.min("depth") + 1).alias("depth"))
    return new.join(known.select("url"), "url", "left_anti")


def cooldown_fold(times: list[int], blocked: list[bool], state: tuple[int, int, int] = (0, 0, 0)) -> tuple[list[bool], tuple[int, int, int]]:
    """For each event in time order whether it meets a cooldown; state is (blocks, window end, cooldown end) in ms.

    The window is anchored at its first block; BLOCKS of them start a cooldown and clear the count.
    """
    count, window, until = state
    out = []
    for now, block in zip(times, blocked):
        cold = now < until
        out.append(cold)
        if cold or not block:
            continue
        if now >= window:
            count = 0
        count += 1
        if count == 1:
            window = now + WINDOW_MS
        if count >= BLOCKS:
            until, count, window = now + COOLDOWN_MS, 0, 0
    return out, (count, window, until)


def cooldown(events: DataFrame) -> DataFrame:
    """Adds in_cooldown to events (domain, now_ms, seq, blocked). One ordered fold a domain, whose events fit a politeness budget."""

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), (0, 0, 0)
        for pdf in batches:  # rows of a domain are together and in time order
            parts = []
            for domain, own in pdf.groupby("domain", sort=False, dropna=False):
                if domain != last:
                    last, state = domain, (0, 0, 0)
                cold, state = cooldown_fold(own.now_ms.tolist(), own.blocked.tolist(), state)
                parts.append(own.assign(in_cooldown=cold))
            if parts:
                yield pd.concat(parts)

    rows = events.select("domain", "now_ms", "seq", "blocked").repartition("domain").sortWithinPartitions("domain", "now_ms", "seq")
    return rows.mapInPandas(streamed, "domain string, now_ms bigint, seq bigint, blocked boolean, in_cooldown boolean")


def session_counters(log: DataFrame) -> DataFrame:
    """pages_crawled, pages_skipped (unchanged ones too) and pages_failed of each session. log: session, outcome."""
    n = lambda *xs: F.count(F.when(F.col("outcome").isin(*xs), 1))
    return log.groupBy("session").agg(n("crawled").alias("pages_crawled"), n("skipped", "unchanged").alias("pages_skipped"), n("failed").alias("pages_failed"))


def limits(jobs: DataFrame, sessions: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds max_depth and max_pages: the session's, else the site's."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("max_depth").alias("s_depth"), F.col("max_pages").alias("s_pages"))
    t = sites.select(F.col("id").alias("site_id"), F.col("max_depth").alias("t_depth"), F.col("max_pages").alias("t_pages"))
    return jobs.join(s, "session_id", "left").join(t, "site_id", "left").withColumn("max_depth", F.coalesce("s_depth", "t_depth")).withColumn("max_pages", F.coalesce("s_pages", "t_pages")).drop("s_depth", "t_depth", "s_pages", "t_pages")


def retry(jobs: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Adds what becomes of failed jobs (attempts_made): again, with bounds of the wait, or dead."""
    top = backoff_ceiling(F.col("attempts_made"))
    again = F.col("attempts_made") < attempts
    return jobs.withColumn("fate", F.when(again, "retry").otherwise("dead")).withColumn("least_wait", F.when(again, top / 2)).withColumn("most_wait", F.when(again, top))


def dead_letters(jobs: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Rows for failed_jobs with the id of their copy in the dead-letter queue. jobs: queue, job_id, attempts_made and payload columns."""
    return jobs.where(F.col("attempts_made") >= attempts).withColumn("dlq_id", F.concat_ws(":", F.lit("dlq"), "queue", "job_id"))


def outcome(site_known, allowed, robots_ok, cold, status, changed):
    """The outcome of one crawl step as a Column, in the order of the checks."""
    return (
        F.when(~site_known, "error")
        .when(~allowed, "skipped")
        .when(~robots_ok, "skipped")
        .when(cold, "retry")
        .when(status <= 0, "retry")  # no answer
        .when((status == 429) | status.between(500, 599), "retry")
        .when(status == 403, "retry")
        .when(status >= 400, "failed")
        .when(changed, "crawled")
        .otherwise("unchanged")
    )
