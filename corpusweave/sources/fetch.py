"""Page fetchers behind one interface, and robots rules. Offline default: a table of stored pages."""

from __future__ import annotations

import re
import time
from http.client import HTTPException
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT, TIMEOUT_S = "corpusweave", 20
#: Bytes of a body that are read, so that one server can't fill a worker. A longer one isn't stored as if it were whole: its page fails with TOO_LARGE.
BODY_BYTES = 32 << 20
TOO_LARGE = 413
RESULT = "url string, status int, html string, final_url string"


class FixtureFetcher:
    """Joins addresses with stored pages (url, html and, if there, status): found ones have status 200, others 404."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def fetch(self, urls: DataFrame) -> DataFrame:
        p = self.pages.select(F.col("url").alias("_url"), "html", (F.col("status") if "status" in self.pages.columns else F.lit(200)).cast("int").alias("status"))
        return urls.join(p, urls.url == p._url, "left").select(*[urls[c] for c in urls.columns], F.coalesce("status", F.lit(404)).alias("status"), "html", F.col("url").alias("final_url"))


class HttpFetcher:
    """Plain HTTP, redirects followed; a network error is status 0, to be tried again. A browser can stand in for it.

    Where addresses have a wait_ms (after the start of the fetch), a host's are asked for one after the other in one task,
    none before its time; after three blocks (403, 429) in a minute the host's others are left (status -1).
    """

    def __init__(self, agent: str = AGENT, timeout: float = TIMEOUT_S, most: int = BODY_BYTES):
        self.agent, self.timeout, self.most = agent, timeout, most

    def get(self, url: str) -> tuple[int, str | None, str]:
        """(status, text of at most ``most`` bytes, final address)."""
        return self._get(url)[:3]

    def _get(self, url: str) -> tuple[int, str | None, str, bool]:
        """As get, and whether the body is longer than what was read."""
        try:
            with urlopen(Request(url, headers={"User-Agent": self.agent, "Accept": "text/html,application/xhtml+xml"}), timeout=self.timeout) as r:
                body, charset = r.read(self.most), r.headers.get_content_charset() or "utf-8"
                try:
                    text = body.decode(charset, "replace")
                except LookupError:  # a charset that nobody knows
                    text = body.decode("utf-8", "replace")
                return r.status, text, r.geturl(), len(body) == self.most and bool(r.read(1))
        except HTTPError as e:
            return e.code, None, url, False
        except (OSError, ValueError, HTTPException):
            return 0, None, url, False

    def page(self, url: str) -> tuple[int, str | None, str]:
        """As get; a body that is too long is no page."""
        *got, cut = self._get(url)
        return (TOO_LARGE, None, got[2]) if cut else tuple(got)

    def fetch(self, urls: DataFrame) -> DataFrame:
        def run(batches):
            from ..operators.crawl import cooldown_fold

            start, states = time.time() * 1000, {}
            for pdf in batches:
                rows = []
                for url, wait in zip(pdf.url, pdf.wait_ms):
                    host, now = urlsplit(url).netloc, time.time() * 1000
                    if start + wait > now:
                        time.sleep((start + wait - now) / 1000)
                    (cold,), state = cooldown_fold([int(time.time() * 1000)], [False], states.get(host, (0, 0, 0)))
                    got = (-1, None, url) if cold else self.page(url)
                    states[host] = cooldown_fold([int(time.time() * 1000)], [got[0] in (403, 429)], state)[1]
                    rows.append((url, *got))
                yield pd.DataFrame(rows, columns=["url", "status", "html", "final_url"])

        asked = urls.select("url", (F.col("wait_ms") if "wait_ms" in urls.columns else F.lit(0)).cast("double").alias("wait_ms")).groupBy("url").agg(F.min("wait_ms").alias("wait_ms"))
        by_host = asked.withColumn("host", F.try_parse_url("url", F.lit("HOST"))).repartition("host").sortWithinPartitions("wait_ms", "url")
        return urls.join(by_host.select("url", "wait_ms").mapInPandas(run, RESULT), "url")


def robots_rules(origins: DataFrame, fetcher) -> DataFrame:
    """origin, robots_txt of distinct origins; what can't be fetched is the empty text, which allows everything."""
    asked = origins.select("origin").distinct().withColumn("url", F.concat("origin", F.lit("/robots.txt")))
    got = fetcher.fetch(asked)
    return got.select("origin", F.when(F.col("status").between(200, 299), F.coalesce("html", F.lit(""))).otherwise("").alias("robots_txt"))


def by_mode(urls: DataFrame, static, js) -> DataFrame:
    """Each address by its render_mode's fetcher."""
    return static.fetch(urls.where("render_mode <> 'js'")).unionByName(js.fetch(urls.where("render_mode = 'js'")))


class Robots:
    """Rules of one robots.txt: the group of the longest matching agent, and in it the longest matching path; ties allow."""

    def __init__(self, text: str | None):
        self.groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
        fresh = False
        for line in (text or "").splitlines():
            key, _, value = line.partition("#")[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if key == "user-agent":
                if not fresh:
                    self.groups.append(([], [], []))
                self.groups[-1][0].append(value.lower())
                fresh = True
            elif self.groups and key in ("allow", "disallow", "crawl-delay"):
                fresh = False
                if key == "crawl-delay":
                    if re.fullmatch(r"[0-9]+(\.[0-9]+)?", value):
                        self.groups[-1][2].append(float(value))
                elif value:
                    self.groups[-1][1].append((key == "allow", value))

    def _group(self, agent: str):
        agent = agent.lower()
        best = [(len(a), g) for g in self.groups for a in g[0] if a != "*" and a in agent] or [(0, g) for g in self.groups if "*" in g[0]]
        top = max((n for n, _ in best), default=0)
        mine = [g for n, g in best if n == top]
        return [r for g in mine for r in g[1]], [d for g in mine for d in g[2]]

    def allowed(self, url: str, agent: str = AGENT) -> bool:
        path = re.sub(r"^[a-z]+://[^/?#]*", "", url) or "/"
        verdict = (-1, True)
        for allow, rule in self._group(agent)[0]:
            pattern = "".join(".*" if x == "*" else re.escape(x) for x in rule.removesuffix("$")) + ("$" if rule.endswith("$") else "")
            if re.match(pattern, path):
                verdict = max(verdict, (len(rule), allow))
        return verdict[1]

    def delay(self, agent: str = AGENT) -> float | None:
        return next(iter(self._group(agent)[1]), None)


def with_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds robots_ok and robots_delay (seconds). rules: origin, robots_txt; an origin without rules allows everything."""

    def run(batches):
        for pdf in batches:
            parsed = {t: Robots(t) for t in pdf.robots_txt.unique()}
            yield pdf.assign(robots_ok=[parsed[t].allowed(u) for t, u in zip(pdf.robots_txt, pdf.url)], robots_delay=[parsed[t].delay() for t in pdf.robots_txt])

    origin = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    joined = urls.withColumn("origin", origin).join(rules.select("origin", "robots_txt"), "origin", "left")
    from pyspark.sql import types as T

    schema = T.StructType([*joined.schema, T.StructField("robots_ok", T.BooleanType()), T.StructField("robots_delay", T.DoubleType())])
    return joined.mapInPandas(run, schema).drop("robots_txt", "origin")
