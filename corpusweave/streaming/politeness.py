"""The crawl's manners as one stateful stream: slots, cooldowns, retries and dead letters of every domain, driven by event-time timers.

Input rows are jobs (an address to be fetched) and answers (the status that a fetch had). A domain keeps an agenda of what is still to come, in
order of time; a timer stands at each entry's time, and fires when the watermark has passed it, so entries are taken in order whatever the order in
which rows arrived, and results don't depend on how the stream is cut into batches or where it was restarted. A job takes
the next slot of its domain; when that is due, the job is emitted (``due``), or, in a cooldown, tried again later. An answer that blocks
counts towards a cooldown; one that is transient is tried again with backoff, at most ATTEMPTS times in all, then it's ``dead``; any other is ``done``.
A domain whose agenda is empty for IDLE_MS forgets its state.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.crawl import ATTEMPTS, cooldown_fold

IDLE_MS = 3_600_000
RANKS = {"answer": 0, "job": 1, "due": 2}  # at one time an answer counts before a job takes its slot, and that before one is due
INPUT = "domain string, at timestamp, seq bigint, kind string, url string, attempt int, status int, delay_ms bigint"
OUTPUT = "domain string, at_ms bigint, url string, attempt int, event string, in_cooldown boolean"
_AGENDA = "at long, rank int, seq long, url string, attempt int, status int, delay long"


def backoff_ms(attempt: int) -> int:
    return min(1000 * 2 ** (attempt - 1), 30_000)


def transient(status: int) -> bool:
    return status <= 0 or status in (403, 429) or 500 <= status <= 599


def advance(state: tuple[int, int, int, int], agenda: list[tuple], until: int) -> tuple[tuple[int, int, int, int], list[tuple], list[tuple]]:
    """Takes all entries of an agenda up to a time: (state, the entries left, what is emitted: at, url, attempt, event, in_cooldown).

    state: the next free slot; blocks, end of their window and end of the cooldown, as in cooldown_fold.
    """
    following, *cold_state = state
    cold_state, heap, out = tuple(cold_state), list(agenda), []
    heapq.heapify(heap)
    while heap and heap[0][0] <= until:
        at, rank, seq, url, attempt, status, delay = heapq.heappop(heap)
        if rank == RANKS["job"]:
            slot = max(at, following)
            following = slot + delay
            heapq.heappush(heap, (slot, RANKS["due"], seq, url, attempt, 0, delay))
            continue
        (cold,), cold_state = cooldown_fold([at], [rank == RANKS["answer"] and status in (403, 429)], cold_state)
        again = rank == RANKS["answer"] and transient(status) or rank == RANKS["due"] and cold
        if rank == RANKS["due"] and not cold:
            out.append((at, url, attempt, "due", False))
        elif again and attempt < ATTEMPTS:
            heapq.heappush(heap, (at + backoff_ms(attempt), RANKS["job"], seq, url, attempt + 1, 0, delay))
        else:
            out.append((at, url, attempt, "dead" if again else "done", cold))
    return (following, *cold_state), sorted(heap), out


class Politeness(StatefulProcessor):
    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "following long, blocks long, window long, until long, last long")
        self.agenda = handle.getListState("agenda", _AGENDA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(r.at.value // 1_000_000), RANKS[r.kind], int(r.seq), r.url, int(r.attempt), int(r.status), int(r.delay_ms)) for pdf in rows for r in pdf.itertuples(index=False)]
        self.agenda.appendList(new)
        for at in {x[0] for x in new}:
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)  # all rows before the watermark are here
        held = tuple(self.state.get()) if self.state.exists() else (0, 0, 0, 0, 0)
        agenda = [tuple(x) for x in self.agenda.get()] if self.agenda.exists() else []
        if not agenda:
            if held[4] + self.idle_ms <= now:
                self.state.clear()
            return
        known = {x[0] for x in agenda}
        state, left, out = advance(held[:4], agenda, now)
        last = max([held[4], *(x[0] for x in agenda if x[0] <= now), *(x[0] for x in out)])
        self.state.update((*state, last))
        if left:
            self.agenda.put(left)
            for at in {x[0] for x in left} - known:
                self.handle.registerTimer(at)
        else:
            self.agenda.clear()
            self.handle.registerTimer(last + self.idle_ms)
        if out:
            at, url, attempt, event, cold = zip(*out)
            yield pd.DataFrame({"domain": key[0], "at_ms": at, "url": url, "attempt": attempt, "event": event, "in_cooldown": cold})

    def close(self) -> None:
        pass


def politeness_stream(events: DataFrame, late: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """What becomes of a stream of jobs and answers (INPUT). late: how far out of order rows may come."""
    return events.withWatermark("at", late).groupBy("domain").transformWithStateInPandas(statefulProcessor=Politeness(idle_ms), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")


def politeness(events: DataFrame) -> DataFrame:
    """The same over a table: one ordered fold a domain, whose events fit a politeness budget; rows stream through in order of time."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, agenda, state = None, [], (0, 0, 0, 0)

        def take(until: int) -> list[tuple]:
            nonlocal agenda, state
            state, agenda, out = advance(state, agenda, until)
            return [(domain, *x) for x in out]

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.domain != domain:
                    out += take(1 << 62)
                    domain, agenda, state = r.domain, [], (0, 0, 0, 0)
                if agenda and agenda[0][0] < r.at_ms and len(agenda) > 1000:
                    out += take(r.at_ms - 1)
                heapq.heappush(agenda, (int(r.at_ms), RANKS[r.kind], int(r.seq), r.url, int(r.attempt), int(r.status), int(r.delay_ms)))
            yield pd.DataFrame(out, columns=["domain", "at_ms", "url", "attempt", "event", "in_cooldown"])
        yield pd.DataFrame(take(1 << 62), columns=["domain", "at_ms", "url", "attempt", "event", "in_cooldown"])

    rows = events.select("domain", F.unix_millis("at").alias("at_ms"), "seq", "kind", "url", "attempt", "status", "delay_ms")
    return rows.repartition("domain").sortWithinPartitions("domain", "at_ms").mapInPandas(fold, OUTPUT)
