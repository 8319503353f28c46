"""Stores in streams against their plain state machines."""

from __future__ import annotations

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest

from brindle.streaming import stores

SESSION_EVENTS = "owner long, ts timestamp, event long, action string, session long"
CACHE_EVENTS = "owner long, ts timestamp, event long, key string, value string"
START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def replayed(spark, folder, rows, schema, run, name, batches=4):
    """Rows of a stream that reads the events in several batches."""
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/in/b{k}")
        time.sleep(1.05)  # files are taken by age, in seconds
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    q = run(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def plain_sessions(events, ttl, max_active, max_kept):
    """The rules again, over a list of sessions."""
    held, told = {}, []
    for owner, ts, _, action, session in events:
        at = round((ts - START).total_seconds() * 1000)
        mine = held.setdefault(owner, [])
        for s in [s for s in mine if s["touched"] + ttl < at]:
            mine.remove(s)
            told.append((owner, s["id"], "expired"))
        known = next((s for s in mine if s["id"] == session), None)
        if action == "start":
            if sum(s["active"] for s in mine) == max_active:
                told.append((owner, session, "refused"))
                continue
            while len(mine) >= max_kept and (done := [s for s in mine if not s["active"]]):
                oldest = min(done, key=lambda s: s["touched"])
                mine.remove(oldest)
                told.append((owner, oldest["id"], "evicted"))
            mine.append({"id": session, "active": True, "touched": at})
            told.append((owner, session, "started"))
        elif known is None:
            told.append((owner, session, "unknown"))
        elif action == "cancel":
            mine.remove(known)
            told.append((owner, session, "cancelled"))
        elif action == "finish":
            known["active"] = False
            told.append((owner, session, "finished"))
        else:
            known["touched"] = at
            told.append((owner, session, "touched"))
    return held, told


def session_rows(n, seed):
    rnd, rows, starts = random.Random(seed), [], {}
    for i in range(n):
        owner, action = rnd.randrange(3), rnd.choices(["start", "touch", "finish", "cancel"], [4, 2, 5, 1])[0]
        mine = starts.setdefault(owner, [])
        if action == "start":
            mine.append(i)
        rows.append((owner, START + timedelta(seconds=30 * i), i, action, i if action == "start" else rnd.choice(mine[-4:] or [-1])))
    return rows


def test_sessions_of_a_stream(rocks, tmp_path):
    rows, limits = session_rows(400, 5), (40 * 60_000, 3, 7)
    held, told = plain_sessions(rows, *limits)
    assert {"evicted", "refused", "expired", "unknown", "cancelled"} <= {o for _, _, o in told}
    got = replayed(rocks, tmp_path, rows, SESSION_EVENTS, lambda s: stores.session_stream(s, "1 minute", *limits), "sessions_told")
    # What no event of its owner ends, a timer does; those that are left at the end may have gone by it.
    left = {(o, s["id"]) for o, mine in held.items() for s in mine}
    expected = Counter(told)
    found = Counter((r["owner"], r["session"], r["outcome"]) for r in got if not (r["outcome"] == "expired" and (r["owner"], r["session"]) in left))
    assert found == expected
    batch = stores.sessions_left(rocks.createDataFrame(rows, SESSION_EVENTS), *limits).collect()
    assert {(r["owner"], r["session"], r["active"]) for r in batch} == {(o, s["id"], s["active"]) for o, mine in held.items() for s in mine}


def test_timers_end_sessions_that_nobody_touches(rocks, tmp_path):
    """Another owner's events move time on: a timer ends the session, without an event of its own."""
    rows = [(1, START, 0, "start", 0)] + [(2, START + timedelta(minutes=10 * k), k, "start" if k == 1 else "touch", 1) for k in range(1, 9)]
    got = replayed(rocks, tmp_path, rows, SESSION_EVENTS, lambda s: stores.session_stream(s, "1 minute"), "timers_told")
    assert [(r["session"], r["outcome"], r["at"] - int(START.timestamp()) * 1000) for r in got if r["owner"] == 1] == [(0, "started", 0), (0, "expired", 30 * 60_000 + 1)]


def test_cache_of_a_stream(rocks, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.randrange(2), START + timedelta(seconds=50 * i), i, f"k{rnd.randrange(5)}", f"v{i}" if rnd.random() < 0.4 else None) for i in range(300)]
    ttl, most, held, want = 10 * 60_000, 3, {}, []
    for owner, ts, i, key, value in rows:
        at = int(ts.timestamp() * 1000)
        live = [e for e in held.get(owner, []) if at - e[0] < ttl]
        if value:
            live = sorted([e for e in live if e[1] != key] + [(at, key, value)], reverse=True)[:most]
        else:
            hit = next((e for e in live if e[1] == key), None)
            want.append((owner, i, key, *((hit[2], hit[0], ttl - at + hit[0]) if hit else (None, None, None))))
        held[owner] = live
    assert any(w[3] for w in want) and not all(w[3] for w in want)
    pick = lambda rs: sorted((r["owner"], r["event"], r["key"], r["value"], r["stored"], r["expires_in"]) for r in rs)
    got = replayed(rocks, tmp_path, rows, CACHE_EVENTS, lambda s: stores.cache_stream(s, "1 minute", ttl, most), "cache_told")
    assert pick(got) == sorted(want)
    assert pick(stores.cache_reads(rocks.createDataFrame(rows, CACHE_EVENTS), ttl, most).collect()) == sorted(want)


def test_stores_of_odd_rows(spark):
    rows = [(None, START, 0, "start", 0), (1, START, 1, "start", None), (1, START, 2, "touch", 9), (1, START, 3, "start", 5), (1, START, 3, "start", 5)]
    assert [(r["owner"], r["session"]) for r in stores.sessions_left(spark.createDataFrame(rows, SESSION_EVENTS)).collect()] == [(1, 5)]
    assert stores.sessions_left(spark.createDataFrame([], SESSION_EVENTS)).count() == 0
    assert stores.cache_reads(spark.createDataFrame([], CACHE_EVENTS)).count() == 0
    assert [tuple(r)[3:] for r in stores.cache_reads(spark.createDataFrame([(1, START, 0, None, "v"), (1, START, 1, "k", None)], CACHE_EVENTS)).collect()] == [("k", None, None, None)]
