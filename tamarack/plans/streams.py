"""Event windows, as tables and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.plans.base import Plans
from tamarack.session import checkpoint_dir
from tamarack.session import table as t
from tamarack.streaming import events as e

P = Plans()
S = SparkSession


@P.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def tumbling_window(s: S, d: str) -> DataFrame:
    """Tumbling windows over the event table."""
    x = e.tumbling(t(s, d, "events"), ts="ts", keys=["event_type"], value="value", width="1 hour")
    return x.select("window_start", "event_type", "n", F.col("total").cast("double").alias("total"))


@P.query("SELECT w AS window_start, event_type, count(*) AS n FROM events, LATERAL (SELECT time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS w FROM range(0, 3) g(i)) GROUP BY 1, 2")
def sliding_window(s: S, d: str) -> DataFrame:
    """Sliding windows of three hours each hour."""
    return e.tumbling(t(s, d, "events"), ts="ts", keys=["event_type"], value="value", width="3 hours", slide="1 hour").select("window_start", "event_type", "n")


@P.query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    h AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 4 HOUR AS session_end, count(*) AS n FROM h GROUP BY user_id, k""")
def session_windows(s: S, d: str) -> DataFrame:
    """Sessions by user."""
    return e.sessions(t(s, d, "events"), ts="ts", keys=["user_id"], gap="4 hours")


@P.query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)")
def streaming_windows(s: S, d: str) -> DataFrame:
    """The same windows over a stream with a watermark; the windows that the watermark has closed."""
    folder = f"{checkpoint_dir(s).rstrip('/')}/stream-{uuid.uuid4().hex}"
    static = t(s, d, "events")
    # A source of its own file: a stream reads folders.
    stream = s.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    e.run_to_table(e.tumbling(stream, ts="ts", keys=["user_id"], value="value", width="1 day", late="0 seconds"), f"{folder}/out", f"{folder}/state")
    return s.read.parquet(f"{folder}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")
