"""Stores that live in a stream: scan sessions with caps and a time to live, and a cache whose values are read back until they expire.

What an owner's store does at an event is one small class, which a stream runs over kept state (transformWithState, with timers for what expires
between events) and a batch over sorted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Minutes that a session may stay untouched, running sessions and sessions of all kinds an owner may have.
SESSION_MINUTES, MAX_ACTIVE, MAX_KEPT = 30, 3, 16
# Minutes that an entry lives, and entries that an owner may have.
CACHE_MINUTES, MAX_ENTRIES = 60, 6
SESSION_SCHEMA = "active boolean, started long, touched long"
TOLD = "owner long, at long, session long, outcome string"
READ = "owner long, at long, event long, key string, value string, stored long, expires_in long"


@dataclass
class Sessions:
    """The sessions of one owner: id -> (active, started, touched). Times are milliseconds.

    start: refused while max_active sessions run; else, if max_kept are there, finished ones go, longest untouched first, running ones never.
    touch, finish and cancel act on a session that is there; finish does not touch it. Whatever an event does, sessions untouched for more than ttl are gone before it.
    """

    ttl: int = SESSION_MINUTES * 60_000
    max_active: int = MAX_ACTIVE
    max_kept: int = MAX_KEPT

    def __post_init__(self) -> None:
        self.held: dict[int, tuple[bool, int, int]] = {}

    def expire(self, at: int) -> list[tuple[int, str]]:
        gone = sorted(s for s, (_, _, touched) in self.held.items() if touched < at - self.ttl)
        for s in gone:
            del self.held[s]
        return [(s, "expired") for s in gone]

    def apply(self, at: int, action: str, session: int) -> list[tuple[int, str]]:
        """What happens to which session at an event, in order."""
        told = self.expire(at)
        known = self.held.get(session)
        if action == "start":
            if known is not None:
                return [*told, (session, "known")]
            if sum(active for active, _, _ in self.held.values()) >= self.max_active:
                return [*told, (session, "refused")]
            finished = sorted((touched, started, s) for s, (active, started, touched) in self.held.items() if not active)
            for _, _, s in finished[: max(0, len(self.held) - self.max_kept + 1)]:
                del self.held[s]
                told.append((s, "evicted"))
            self.held[session] = (True, at, at)
            return [*told, (session, "started")]
        if known is None:
            return [*told, (session, "unknown")]
        if action == "cancel":
            del self.held[session]
            return [*told, (session, "cancelled")]
        active, started, touched = known
        self.held[session] = (False, started, touched) if action == "finish" else (active, started, at)
        return [*told, (session, "finished" if action == "finish" else "touched")]


@dataclass
class Cache:
    """The entries of one owner: key -> (stored, value). A write drops what has expired and keeps the max_entries stored last."""

    ttl: int = CACHE_MINUTES * 60_000
    max_entries: int = MAX_ENTRIES

    def __post_init__(self) -> None:
        self.held: dict[str, tuple[int, str]] = {}

    def expire(self, at: int) -> None:
        self.held = {k: e for k, e in self.held.items() if at - e[0] < self.ttl}

    def write(self, at: int, key: str, value: str) -> None:
        self.expire(at)
        self.held.pop(key, None)
        self.held = dict([(key, (at, value)), *self.held.items()][: self.max_entries])

    def read(self, at: int, key: str) -> tuple[str, int, int] | None:
        """(value, stored, milliseconds left), or None; an entry that has expired is dropped."""
        self.expire(at)
        if key not in self.held:
            return None
        stored, value = self.held[key]
        return value, stored, self.ttl - (at - stored)


def _millis(column: str) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


class _SessionProcessor(StatefulProcessor):
    """Sessions of a key in map state; a timer for each session ends it when nothing else does."""

    def __init__(self, ttl: int, max_active: int, max_kept: int) -> None:
        self.limits = (ttl, max_active, max_kept)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("sessions", "session long", SESSION_SCHEMA)

    def _loaded(self) -> Sessions:
        store = Sessions(*self.limits)
        store.held = {k[0]: tuple(v) for k, v in self.state.iterator()}
        return store

    def _kept(self, before: dict[int, tuple], store: Sessions) -> None:
        for s in before.keys() - store.held.keys():
            self.state.removeKey((s,))
        for s, v in store.held.items():
            if before.get(s) != v:
                self.state.updateValue((s,), v)
                self.handle.registerTimer(v[2] + store.ttl + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        store = self._loaded()
        before = dict(store.held)
        events = pd.concat(list(rows)).sort_values(["at", "event"])
        told = [(key[0], at, s, o) for at, action, session in zip(events["at"].tolist(), events["action"], events["session"].tolist()) for s, o in store.apply(at, action, session)]
        self._kept(before, store)
        yield pd.DataFrame(told, columns=["owner", "at", "session", "outcome"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        store = self._loaded()
        before, at = dict(store.held), expiredTimerInfo.getExpiryTimeInMs()
        told = [(key[0], at, s, o) for s, o in store.expire(at)]
        self._kept(before, store)
        yield pd.DataFrame(told, columns=["owner", "at", "session", "outcome"])

    def close(self) -> None:
        pass


class _CacheProcessor(StatefulProcessor):
    """Entries of a key in map state, for a batch of writes and reads in order of time; a timer drops an entry that nobody reads again."""

    def __init__(self, ttl: int, max_entries: int) -> None:
        self.limits = (ttl, max_entries)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("entries", "key string", "stored long, value string")

    def _loaded(self) -> Cache:
        store = Cache(*self.limits)
        entries = sorted(((v[0], k[0], v[1]) for k, v in self.state.iterator()), reverse=True)
        store.held = {k: (stored, value) for stored, k, value in entries}
        return store

    def _kept(self, before: dict[str, tuple], store: Cache) -> None:
        for k in before.keys() - store.held.keys():
            self.state.removeKey((k,))
        for k, v in store.held.items():
            if before.get(k) != v:
                self.state.updateValue((k,), v)
                self.handle.registerTimer(v[0] + store.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        store = self._loaded()
        before = dict(store.held)
        events = pd.concat(list(rows)).sort_values(["at", "event"])
        told = list(_reads(store, key[0], events))
        self._kept(before, store)
        yield _read_frame(told)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        store = self._loaded()
        before = dict(store.held)
        store.expire(expiredTimerInfo.getExpiryTimeInMs())
        self._kept(before, store)
        yield _read_frame([])

    def close(self) -> None:
        pass


def _reads(store: Cache, owner: int, events: pd.DataFrame) -> Iterator[tuple]:
    """A row for each read among events (at, event, key, value); an event with a value writes it."""
    for at, event, k, value in zip(events["at"].tolist(), events["event"].tolist(), events["key"], events["value"]):
        if value is not None and value == value:
            store.write(at, k, value)
        else:
            hit = store.read(at, k)
            yield (owner, at, event, k, *(hit or (None, None, None)))


def _read_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["owner", "at", "event", "key", "value", "stored", "expires_in"])
    return frame.astype({"stored": "Int64", "expires_in": "Int64"})


def session_stream(events: DataFrame, late: str = "1 hour", ttl: int = SESSION_MINUTES * 60_000, max_active: int = MAX_ACTIVE, max_kept: int = MAX_KEPT) -> DataFrame:
    """(owner, at, session, outcome) of a stream of events (owner, ts, event, action, session).

    Events of a batch are taken in order of time; a batch's events should not be older than those of the one before by more than `late`, which the watermark drops.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("owner", "ts", _millis("ts").alias("at"), "event", "action", "session")
    return rows.groupBy("owner").transformWithStateInPandas(_SessionProcessor(ttl, max_active, max_kept), TOLD, "append", "eventTime")


def cache_stream(events: DataFrame, late: str = "1 hour", ttl: int = CACHE_MINUTES * 60_000, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(owner, at, event, key, value, stored, expires_in) for every read of a stream of events (owner, ts, event, key, value); value, stored and expires_in are null on a miss."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("owner", "ts", _millis("ts").alias("at"), "event", "key", "value")
    return rows.groupBy("owner").transformWithStateInPandas(_CacheProcessor(ttl, max_entries), READ, "append", "eventTime")


def _folded(events: DataFrame, columns: list[str], fold: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """fold over events sorted by owner, time and number: what it holds is one owner's store, however many events the owner has."""
    rows = events.filter("owner IS NOT NULL").select("owner", _millis("ts").alias("at"), "event", *columns)
    return rows.repartition("owner").sortWithinPartitions("owner", "at", "event").mapInPandas(fold, schema)


def sessions_left(events: DataFrame, ttl: int = SESSION_MINUTES * 60_000, max_active: int = MAX_ACTIVE, max_kept: int = MAX_KEPT) -> DataFrame:
    """(owner, session, active, started, touched): what session_stream holds after all events; sessions expire by the owner's own last event."""

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, store = None, Sessions(ttl, max_active, max_kept)
        rows = lambda: pd.DataFrame([(owner, s, *v) for s, v in store.held.items()], columns=["owner", "session", "active", "started", "touched"])
        for b in batches:
            for o, at, action, session in zip(b["owner"].tolist(), b["at"].tolist(), b["action"], b["session"].tolist()):
                if o != owner:
                    if owner is not None:
                        yield rows()
                    owner, store = o, Sessions(ttl, max_active, max_kept)
                store.apply(at, action, session)
        if owner is not None:
            yield rows()

    return _folded(events.filter("session IS NOT NULL"), ["action", "session"], fold, "owner long, session long, " + SESSION_SCHEMA)


def cache_reads(events: DataFrame, ttl: int = CACHE_MINUTES * 60_000, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """What cache_stream tells of all events."""

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, store = None, Cache(ttl, max_entries)
        for b in batches:
            told = []
            for o, part in b.groupby("owner", sort=False):
                if o != owner:
                    owner, store = o, Cache(ttl, max_entries)
                told += _reads(store, int(o), part)
            yield _read_frame(told)

    return _folded(events.filter("key IS NOT NULL"), ["key", "value"], fold, READ)
