"""Queries of keyed state, retention, bursts and streams over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gradients, memory, places
from ..sources.documents import table
from ..streaming import debounce, streams
from ..streaming.store import VersionedStore


def _changes(spark, d):
    return table(spark, d, "events").select(
        "user_id", "ts", "event_id", (F.col("event_id") % 500).cast("int").alias("page"), (F.col("event_type") != "error").alias("set_page"),
        F.when(F.col("event_type") != "purchase", F.col("props")).alias("settings"), F.col("event_type").isin("click", "purchase").alias("set_settings"),
    )


def _state(spark, d):
    return memory.latest(_changes(spark, d), "user_id", ["ts", "event_id"], ["page", "settings"])


def lru_memory(spark, d):
    return _state(spark, d).select("user_id", F.coalesce("page", F.lit(-1)).alias("page"), F.coalesce("settings", F.lit("")).alias("settings"), F.col("at.event_id").alias("last"))


def inherit_settings(spark, d):
    return memory.inherited(_state(spark, d), "settings")


def retain_newest(spark, d):
    return memory.newest(table(spark, d, "events").select("event_type", "event_id", "ts"), "event_type", [F.desc("ts"), F.desc("event_id")], memory.KEEP["documents"]).select("event_type", "event_id")


def tolerant_memory(spark, d):
    """Stored entries, every third of them spoilt."""
    page = F.when(F.col("event_id") % 3 == 0, F.lit("oops")).otherwise(F.concat(F.lit('{"pos":{"page":'), F.col("value").cast("string"), F.lit(',"y":'), F.when(F.col("event_id") % 2 == 0, "12.5").otherwise("null"), F.lit("}}")))
    rows = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("url:"), F.col("event_id")).alias("key"), page.alias("json"))
    kept = memory.tolerant(rows, "key", "json")
    return kept.select("key", "page", F.coalesce("y", F.lit(-1.0)).alias("y"))


def current_results(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("generation"))
    return memory.current_generation(rows, "user_id").select("event_id", "user_id")


def settle_points(spark, d):
    return memory.settle(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "90 minutes").select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("settled").alias("settled"), "n")


def throttle_commits(spark, d):
    return streams.throttle(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 90 * 60 * 1000).select("user_id", F.unix_micros(F.col("opened").cast("timestamp")).alias("opened"), "n")


def payload_offsets(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"))
    return memory.running_offset(rows, "page_id", "bytes", 64).withColumn("offset", F.col("offset").cast("long"))


def timing_median(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.median("value").alias("median"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))


def progress_counts(spark, d):
    done = F.count_if(F.col("event_type").isin("purchase", "signup"))
    return table(spark, d, "events").groupBy("user_id").agg(done.alias("done"), F.count(F.lit(1)).alias("total"))


def stream_latest(spark, d):
    """The latest value of each user, from a stream over the events."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", streams.SLICE).option("pathGlobFilter", "*.parquet").parquet(f"{d}/[e]vents.parquet")
    return streams.remember(spark, events, "user_id", "event_id", "value")


def stored_latest(spark, d):
    """The latest event of each user, kept in a store that each third of the events updates."""
    events = table(spark, d, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    store = VersionedStore(spark, f"{streams.fresh_folder(spark)}/store")
    step = (high - low) // 3 + 1 if low is not None else 1
    for k in range(3):
        own = events.where((F.col("event_id") >= (low or 0) + k * step) & (F.col("event_id") < (low or 0) + (k + 1) * step)).select("user_id", "event_id", "value")
        store.update(lambda old, own=own: (own if old is None else old.unionByName(own)).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value")))
    return store.current()


def place_history(spark, d):
    """Views and clicks as jumps, purchases as steps back, errors as steps forward, sign-ups as another document."""
    kind = F.when(F.col("event_type").isin("view", "click"), "jump").when(F.col("event_type") == "purchase", "back").when(F.col("event_type") == "error", "forward").when(F.col("event_type") == "signup", "open")
    moves = table(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("kind"), F.col("event_id").alias("place"), (-F.col("event_id")).alias("left"))
    found = places.history(moves, "user_id", ["ts", "event_id"], 8)
    return found.select("user_id", "n", F.coalesce("shown", F.lit(0)).alias("shown"), "at", "size")


def gradient_stops(spark, d):
    """A ramp for each user: colours that drift with the events' numbers and jump with their values."""
    n = F.col("event_id")
    samples = table(spark, d, "events").select("user_id", n.alias("at"), F.abs(F.floor(n / 40) % 256 - 128).cast("int").alias("r"), (F.floor(F.col("value") / 60) % 256).cast("int").alias("g"), F.floor(n / 100 % 200).cast("int").alias("b"))
    return gradients.stops(samples, "user_id", "at", ["r", "g", "b"])


WAIT_MINUTES = 90


def debounced_queries(spark, d):
    """Views and clicks type a query, a purchase sends one, errors and sign-ups drop what waits."""
    schema = table(spark, d, "events").schema
    kind = F.when(F.col("event_type").isin("view", "click"), "type").when(F.col("event_type") == "purchase", "enter").otherwise("escape")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/[e]vents.parquet")
    events = stream.select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("n"), kind.alias("kind"), F.col("event_id").cast("string").alias("text"))
    sent, root = debounce.sent_queries(spark, events, WAIT_MINUTES * 60_000)
    return sent.unionByName(debounce.pending(spark, root))


QUERIES = [debounced_queries, stored_latest, place_history, gradient_stops, lru_memory, inherit_settings, retain_newest, tolerant_memory, current_results, settle_points, throttle_commits, payload_offsets, timing_median, progress_counts, stream_latest]
STATE = """c AS (SELECT user_id, ts, event_id, cast(event_id % 500 AS INTEGER) AS page, event_type <> 'error' AS sp, CASE WHEN event_type <> 'purchase' THEN props END AS settings, event_type IN ('click', 'purchase') AS ss FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, row_number() OVER (PARTITION BY user_id, sp ORDER BY ts DESC, event_id DESC) AS np, row_number() OVER (PARTITION BY user_id, ss ORDER BY ts DESC, event_id DESC) AS ns FROM c),
s AS (SELECT user_id, max(CASE WHEN sp AND np = 1 THEN page END) AS page, max(CASE WHEN ss AND ns = 1 THEN settings END) AS settings, max(CASE WHEN n = 1 THEN ts END) AS ts, max(CASE WHEN n = 1 THEN event_id END) AS last FROM r GROUP BY user_id ORDER BY ts DESC, last DESC LIMIT 100)"""
SQL = {
    "debounced_queries": f"""WITH e AS (SELECT cast(user_id AS VARCHAR) AS key, cast(event_id AS VARCHAR) AS text, epoch_us(ts) AS t, event_type, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events)
      SELECT key, text, t + {WAIT_MINUTES * 60_000_000} AS sent, 'wait' AS cause FROM e WHERE event_type IN ('view', 'click') AND (later IS NULL OR later >= t + {WAIT_MINUTES * 60_000_000})
      UNION ALL SELECT key, text, t AS sent, 'enter' AS cause FROM e WHERE event_type = 'purchase'""",
    "stored_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "place_history": """WITH RECURSIVE m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id AS place,
        CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS kind FROM events),
      w AS (SELECT user_id, cast(0 AS BIGINT) AS i, [cast(NULL AS BIGINT)] AS held, [cast(0 AS BIGINT)] AS docs, 1 AS spot, cast(0 AS BIGINT) AS doc, cast(NULL AS BIGINT) AS shown FROM (SELECT DISTINCT user_id FROM m)
        UNION ALL SELECT user_id, i, CASE WHEN len(h) > 8 THEN h[2:] ELSE h END, CASE WHEN len(h) > 8 THEN g[2:] ELSE g END, CASE WHEN len(h) > 8 THEN a - 1 ELSE a END, CASE WHEN kind = 4 THEN doc + 1 ELSE doc END,
          CASE WHEN kind = 1 THEN place WHEN kind IN (2, 3) AND a <> spot AND g[a] = doc THEN h[a] END
        FROM (SELECT w.user_id, m.i, m.kind, m.place, w.doc, w.spot,
          CASE WHEN m.kind = 1 THEN list_concat(w.held[1:w.spot - 1], [-m.place, m.place]) ELSE w.held END AS h, CASE WHEN m.kind = 1 THEN list_concat(w.docs[1:w.spot - 1], [w.doc, w.doc]) ELSE w.docs END AS g,
          CASE WHEN m.kind = 1 THEN w.spot + 1 WHEN m.kind = 2 AND w.spot > 1 THEN w.spot - 1 WHEN m.kind = 3 AND w.spot < len(w.held) THEN w.spot + 1 ELSE w.spot END AS a
          FROM w JOIN m ON w.user_id = m.user_id AND m.i = w.i + 1))
      SELECT user_id, i - 1 AS n, coalesce(shown, 0) AS shown, cast(spot - 1 AS INTEGER) AS "at", cast(len(held) AS INTEGER) AS size FROM w WHERE i > 0""",
    "lru_memory": f"WITH {STATE} SELECT user_id, coalesce(page, -1) AS page, coalesce(settings, '') AS settings, last FROM s",
    "inherit_settings": f"WITH {STATE} SELECT arg_max(settings, ts) AS settings FROM s WHERE settings IS NOT NULL",
    "retain_newest": "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_type, event_id FROM r WHERE n <= 8",
    "tolerant_memory": "SELECT 'url:' || event_id AS key, cast(greatest(1, floor(value + 0.5)) AS INTEGER) AS page, CASE WHEN event_id % 2 = 0 THEN 12.5 ELSE -1.0 END::DOUBLE AS y FROM events WHERE event_id % 3 <> 0 ORDER BY event_id LIMIT 100",
    "current_results": "WITH m AS (SELECT user_id, max(cast(ts AS DATE)) AS g FROM events GROUP BY user_id) SELECT event_id, events.user_id FROM events JOIN m ON events.user_id = m.user_id AND cast(ts AS DATE) = g",
    "settle_points": """WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
      i AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS settled, count(*) AS n FROM i GROUP BY user_id, island""",
    "payload_offsets": "SELECT page_id, cast(strlen(html) AS BIGINT) AS bytes, cast(coalesce(sum(strlen(html)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM pages",
    "throttle_commits": """WITH RECURSIVE o(user_id, opened) AS (SELECT user_id, min(ts) FROM events GROUP BY user_id
        UNION ALL SELECT o.user_id, min(e.ts) FROM o JOIN events e ON e.user_id = o.user_id AND e.ts > o.opened + INTERVAL 90 MINUTE GROUP BY o.user_id),
      b AS (SELECT user_id, opened, lead(opened) OVER (PARTITION BY user_id ORDER BY opened) AS closed FROM o)
      SELECT b.user_id, epoch_us(b.opened) AS opened, count(*) AS n FROM b JOIN events e ON e.user_id = b.user_id AND e.ts >= b.opened AND (b.closed IS NULL OR e.ts < b.closed) GROUP BY 1, 2""",
    "timing_median": "SELECT event_type, median(value) AS median, max(value) AS most, count(*) AS n FROM events GROUP BY event_type",
    "progress_counts": "SELECT user_id, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS done, count(*) AS total FROM events GROUP BY user_id",
    "stream_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
}
