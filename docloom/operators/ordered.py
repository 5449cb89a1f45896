"""Machines over the ordered rows of a key: what the next row means depends on all before it.

Rows are dealt by key and sorted within their partitions, and each key's rows stream through one machine in batches. A machine keeps
what its state is made of (a window's start, a cache of a few entries), never the rows, so a key may have any number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def in_order(df: DataFrame, keys: list[str], order: list[str], machine: Callable[[], object], schema: str) -> DataFrame:
    """What machine().rows(pdf) makes of each key's rows, in the given order. A new machine starts with each key; its rows may come in
    several calls, and what it has at the end, if it has a method close, follows them. Rows with equal order come in any order, so
    `order` should end in something unique."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            values = [pdf[k].to_numpy() for k in keys]
            new = np.ones(len(pdf), bool)
            new[1:] = False
            for v in values:
                gone = pd.isna(v)
                new[1:] |= (gone[1:] != gone[:-1]) | (~gone[1:] & ~gone[:-1] & (v[1:] != v[:-1]))
            starts = [*np.flatnonzero(new), len(pdf)]
            for a, e in zip(starts, starts[1:], strict=False):
                key = tuple(None if pd.isna(v[a]) else v[a] for v in values)
                if own is None or key != last:
                    if hasattr(own, "close"):
                        yield own.close()
                    last, own = key, machine()
                yield own.rows(pdf.iloc[a:e])
        if hasattr(own, "close"):
            yield own.close()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(work, schema)


class FixedWindow:
    """Requests by time against a limit; a window opens with the first request at or after the end of the one before. Refused
    requests count."""

    def __init__(self, key: str, ts: str, limit: int, width: int):
        self.key, self.ts, self.limit, self.width = key, ts, limit, width
        self.start, self.n = None, 0

    def allowed(self, t: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(t), bool), 0
        while at < len(t):
            if self.start is None or t[at] - self.start >= self.width:
                self.start, self.n = int(t[at]), 0
            end = int(np.searchsorted(t, self.start + self.width, "left"))
            count = self.n + np.arange(1, end - at + 1)
            out[at:end] = (count <= self.limit) | (count == 1)
            self.n, at = self.n + end - at, end
        return out

    def rows(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({self.key: pdf[self.key], self.ts: pdf[self.ts], "allowed": self.allowed(pdf[self.ts].to_numpy())})


class Cache:
    """A cache of one scope with jobs in flight.

    Entries expire, and the least recently used go while there are too many or they weigh too much. A request for what is being
    made shares that job. A purge starts a new generation: nothing of before is given out, shared or stored any more. What fails, or
    weighs more than the whole cache, is never stored. A job that all of its users have left is dropped, and one without an end is forgotten
    after job_us."""

    def __init__(self, max_entries: int, max_weight: int, ttl_us: int, job_us: int):
        self.max_entries, self.max_weight, self.ttl_us, self.job_us = max_entries, max_weight, ttl_us, job_us
        self.generation = 0
        self.held: dict[str, tuple[int, int]] = {}  # key: expiry, weight; in order of use
        self.jobs: dict[int, dict] = {}  # owner: key, name, generation, since, users, open

    def prune(self, now: int) -> None:
        self.held = {k: e for k, e in self.held.items() if e[0] > now}
        weight = sum(w for _, w in self.held.values())
        while self.held and (len(self.held) > self.max_entries or weight > self.max_weight):
            weight -= self.held.pop(next(iter(self.held)))[1]
        self.jobs = {o: j for o, j in self.jobs.items() if j["since"] + self.job_us > now}

    def step(self, kind: str, now: int, request: int, key: str, name: str, expected: int | None, weight: int | None) -> list[tuple[int, str, bool]]:
        """(request, outcome, cache_hit) of every request that this event answers."""
        self.prune(now)
        if kind == "purge":
            self.generation += 1
            self.held.clear()
            for j in self.jobs.values():
                j["open"] = False
        elif kind == "cancel":
            for owner, j in list(self.jobs.items()):
                if request in j["users"]:
                    j["users"].remove(request)
                    if not j["users"]:
                        del self.jobs[owner]
        elif kind in ("done", "failed"):
            j = self.jobs.pop(request, None)
            if j is None:
                return []
            good = kind == "done"
            if good and j["stored"] and j["generation"] == self.generation and (weight or 0) <= self.max_weight:
                self.held.pop(j["key"], None)
                self.held[j["key"]] = (now + self.ttl_us, weight or 0)
                self.prune(now)
            return [(u, "ok" if good else "failed", good and u != request) for u in j["users"]]
        elif expected is not None and expected != self.generation:
            self.jobs[request] = {"key": key, "name": name, "generation": expected, "since": now, "users": [request], "open": False, "stored": False}
        elif key in self.held:
            self.held[key] = self.held.pop(key)
            return [(request, "ok", True)]
        else:
            for j in self.jobs.values():
                if j["open"] and j["key"] == key and j["name"] == name and j["generation"] == self.generation:
                    j["users"].append(request)
                    return []
            self.jobs[request] = {"key": key, "name": name, "generation": self.generation, "since": now, "users": [request], "open": True, "stored": True}
        return []


#: Events of a cache: kind is get, done, failed (both of the request that started the job), cancel or purge; name separates jobs that
#: may not be shared; expected is the generation that a request belongs to, if it belongs to one.
CACHE_EVENT = "scope string, pos bigint, ts_us bigint, kind string, request_id bigint, key string, name string, expected bigint, weight bigint"
CACHE_ANSWER = "scope string, request_id bigint, outcome string, cache_hit boolean"


def cache_answers(cache: Cache, pdf: pd.DataFrame) -> pd.DataFrame:
    """The answers to events of one scope, in their order."""
    null = lambda x: None if pd.isna(x) else int(x)
    out = []
    for e in pdf.itertuples(index=False):
        name = "" if pd.isna(e.name) else e.name
        out += [(e.scope, *a) for a in cache.step(e.kind, int(e.ts_us), null(e.request_id), e.key, name, null(e.expected), null(e.weight))]
    return pd.DataFrame(out, columns=["scope", "request_id", "outcome", "cache_hit"])


def cache_trace(events: DataFrame, max_entries: int = 8, max_weight: int = 1_000_000, ttl_us: int = 600_000_000, job_us: int = 120_000_000) -> DataFrame:
    """CACHE_ANSWER of events (CACHE_EVENT), by time and pos within each scope. Requests without an end have no answer."""

    class Machine:
        def __init__(self):
            self.cache = Cache(max_entries, max_weight, ttl_us, job_us)

        def rows(self, pdf: pd.DataFrame) -> pd.DataFrame:
            return cache_answers(self.cache, pdf)

    return in_order(events.select(*[c.split()[0] for c in CACHE_EVENT.split(", ")]), ["scope"], ["ts_us", "pos"], Machine, CACHE_ANSWER)
