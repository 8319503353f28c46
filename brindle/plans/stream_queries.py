"""Queries over stores that live in a stream, folded over the events of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.session import shared_folder
from brindle.streaming import keyed, stores
from brindle.tables import table

_DAY = 86_400_000
SESSION_TTL, CACHE_TTL = 20 * _DAY, 5 * _DAY


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, ts, event, action, session): sign-ups and clicks of a user start a session, other events act on one of the user's last three starts."""
    kind = F.col("event_type")
    action = F.when(kind.isin("signup", "click"), "start").when(kind == "purchase", "finish").when((kind == "error") & (F.col("event_id") % 4 == 0), "cancel").otherwise("touch")
    before = Window.partitionBy("owner").orderBy("ts", "event").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), "ts", F.col("event_id").alias("event"), action.alias("action"))
    rows = rows.withColumn("_n", F.count(F.when(F.col("action") == "start", 1)).over(before))
    starts = rows.filter("action = 'start'").select("owner", F.col("_n").alias("_of"), F.col("event").alias("_session"))
    of = F.when(F.col("action") == "start", F.col("_n")).otherwise(F.col("_n") - F.col("event") % 3)
    return rows.withColumn("_of", of).join(starts.hint("merge"), ["owner", "_of"], "left").select("owner", "ts", "event", "action", F.coalesce("_session", F.lit(-1)).alias("session"))


def cache_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, ts, event, key, value): sign-ups and clicks write one of nine keys of their user, other events read it."""
    value = F.when(F.col("event_type").isin("signup", "click"), F.concat(F.lit("v"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), "ts", F.col("event_id").alias("event"), F.concat(F.lit("k"), (F.col("event_id") % 9).cast("string")).alias("key"), value.alias("value"))


def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.sessions_left(session_events(spark, sf_dir), SESSION_TTL)


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.cache_reads(cache_events(spark, sf_dir), CACHE_TTL)


def upserted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and kind, as a stored table holds it that takes in all events in three batches, the second one twice."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("stored"), "event_id")
    store = keyed.KeyedTable(spark, f"{shared_folder(spark)}/upserted-{uuid.uuid4().hex}", rows.schema, ["user_id", "event_type"], "stored", buckets=16)
    for number, part in enumerate((0, 1, 1, 2)):
        store.upsert(rows.filter(F.col("event_id") % 3 == part), None if number == 2 else number)
    return store.read()


QUERIES = {"session_store": session_store, "cache_hits": cache_hits, "upserted_events": upserted_events}

ORACLE_SQL = {
    "upserted_events": "WITH e AS (SELECT user_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS stored, event_id FROM events) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY stored DESC, event_id DESC) = 1",
    "session_store": f"""WITH RECURSIVE a AS (SELECT user_id AS owner, epoch_us(ts) // 1000 AS "at", ts, event_id AS event, CASE WHEN event_type IN ('signup', 'click') THEN 'start' WHEN event_type = 'purchase' THEN 'finish' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'cancel' ELSE 'touch' END AS action FROM events),
        n AS (SELECT *, count(*) FILTER (WHERE action = 'start') OVER (PARTITION BY owner ORDER BY ts, event ROWS UNBOUNDED PRECEDING) AS n FROM a),
        e AS (SELECT n.owner, n."at", n.action, coalesce(s.event, -1) AS session, row_number() OVER (PARTITION BY n.owner ORDER BY n."at", n.event) AS i
              FROM n LEFT JOIN n s ON s.owner = n.owner AND s.action = 'start' AND s.n = CASE WHEN n.action = 'start' THEN n.n ELSE n.n - n.event % 3 END),
        w AS (SELECT owner, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(touched BIGINT, started BIGINT, session BIGINT, active BOOLEAN)[]) AS held FROM e WHERE e.i = 1
          UNION ALL
          SELECT owner, i, CASE
            WHEN action = 'start' AND (len(list_filter(live, lambda x: x.active)) >= {stores.MAX_ACTIVE} OR known) THEN live
            WHEN action = 'start' THEN list_append(room, {{'touched': "at", 'started': "at", 'session': session, 'active': true}})
            WHEN action = 'cancel' THEN list_filter(live, lambda x: x.session <> session)
            WHEN action = 'finish' THEN list_transform(live, lambda x: CASE WHEN x.session = session THEN {{'touched': x.touched, 'started': x.started, 'session': x.session, 'active': false}} ELSE x END)
            ELSE list_transform(live, lambda x: CASE WHEN x.session = session THEN {{'touched': "at", 'started': x.started, 'session': x.session, 'active': x.active}} ELSE x END) END
          FROM (SELECT *, list_sort(list_filter(live, lambda y: NOT y.active))[1:greatest(len(live) - {stores.MAX_KEPT - 1}, 0)] AS old, list_filter(live, lambda x: NOT list_contains(old, x)) AS room FROM (SELECT e.*, list_filter(w.held, lambda x: x.touched >= e."at" - {SESSION_TTL}) AS live, len(list_filter(w.held, lambda x: x.session = e.session AND x.touched >= e."at" - {SESSION_TTL})) > 0 AS known FROM w JOIN e ON e.owner = w.owner AND e.i = w.i + 1) z2) z1)
        SELECT owner, h.session, h.active, h.started, h.touched FROM (SELECT owner, unnest(held) AS h FROM w QUALIFY row_number() OVER (PARTITION BY owner ORDER BY i DESC) = 1)""",
    "cache_hits": f"""WITH e AS (SELECT user_id AS owner, epoch_us(ts) // 1000 AS "at", event_id AS event, 'k' || (event_id % 9) AS key, CASE WHEN event_type IN ('signup', 'click') THEN 'v' || event_id END AS value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
        r AS (SELECT r.owner, r."at", r.event, r.key, r.i, w.value, w."at" AS stored, w.i AS wi FROM e r LEFT JOIN e w ON w.owner = r.owner AND w.key = r.key AND w.value IS NOT NULL AND w.i < r.i WHERE r.value IS NULL QUALIFY row_number() OVER (PARTITION BY r.event ORDER BY w.i DESC NULLS LAST) = 1),
        h AS (SELECT r.*, coalesce(r."at" - r.stored < {CACHE_TTL}, false) AND (SELECT count(DISTINCT o.key) FROM e o WHERE o.owner = r.owner AND o.value IS NOT NULL AND o.i > r.wi AND o.i < r.i) < {stores.MAX_ENTRIES} AS hit FROM r)
        SELECT owner, "at", event, key, CASE WHEN hit THEN value END AS value, CASE WHEN hit THEN stored END AS stored, CASE WHEN hit THEN {CACHE_TTL} - ("at" - stored) END AS expires_in FROM h""",
}
