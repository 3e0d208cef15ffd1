"""Queries that drain streams over `events`, whose files come out of order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.plans.boxes_queries import r6
from boxwise.plans.registry import query
from boxwise.plans.views import table
from boxwise.session import shared_folder
from boxwise.streaming import event_time as E

#: Days of events to a span, and how late a row may be: spans come in the order 1, 0, 3, 2 ...
DAYS, DELAY = 4, "9 days"
#: Rows of a file, about, so that files are written and read by more tasks as the table grows.
FILE = 1 << 18
SCHEMA = "user_id long, ts timestamp, event_id long, event_type string, value double"


def out_of_order(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The events as a stream of files, every two spans of them swapped, the files of a span a batch; a last row of no user moves the watermark past all others."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    first, last, n = events.agg(F.min("ts"), F.max("ts"), F.count("ts")).first()
    spans = (last - first).days // DAYS + 1 if first else 0
    day = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / (DAYS * 86_400_000_000)) if first else F.lit(0)
    files = max(1, -(-n // (FILE * max(1, spans))))  # a span of fewer rows than these has fewer; a batch then goes on into the next, which makes no row late
    # The events are dealt to their spans in one pass, so that the files of a span are made from its own rows alone.
    events.withColumn("span", day.cast("int")).write.partitionBy("span").parquet(f"{folder}/spans")
    dealt = spark.read.schema(f"{SCHEMA}, span int").parquet(f"{folder}/spans")
    for k in range(spans + spans % 2):
        own = dealt.where(F.col("span") == (k ^ 1)).drop("span")
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(f"{folder}/in")
    end = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.to_timestamp(F.lit("2200-01-01")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit(0.0).alias("value"))
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def drained(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:  # noqa: ANN001
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df = make(out_of_order(spark, sf_dir, folder))
    E.drain(df, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


ROLL = "PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "r2_event_order_meter",
    f"""SELECT user_id, event_id, round(quantile_disc(value, 0.5) OVER w, 6) AS median, round(avg(value) OVER w, 9) AS avg, round(max(value) OVER w, 6) AS max, round(value, 6) AS value_now, round(avg(value) OVER ({ROLL} ROWS UNBOUNDED PRECEDING), 9) AS global_avg
        FROM events WINDOW w AS ({ROLL} ROWS 19 PRECEDING)""",
)
def r2_event_order_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling meter over a stream whose rows come out of order (R2)."""
    m = drained(spark, sf_dir, "meter", lambda s: E.rolling(s, "user_id", "ts", "event_id", "value", DELAY)).where("key is not null")
    return m.select(F.col("key").alias("user_id"), F.col("event").alias("event_id"), *(r6(F.col(c)).alias(c) for c in ("median", "max", "value_now")), *(F.round(c, 9).alias(c) for c in ("avg", "global_avg")))


@query(
    "r4_event_order_ema",
    f"""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER ({ROLL}) - 1 AS t FROM events),
        f(user_id, event_id, t, v) AS (SELECT user_id, event_id, t, value FROM o WHERE t = 0 UNION ALL SELECT o.user_id, o.event_id, o.t, f.v * (0.99 * (1 - exp(-o.t / 10.0::DOUBLE))) + (1 - 0.99 * (1 - exp(-o.t / 10.0::DOUBLE))) * o.value FROM f JOIN o ON o.user_id = f.user_id AND o.t = f.t + 1)
        SELECT user_id, event_id, t + 1 AS n, round(v, 6) AS ema FROM f""",
)
def r4_event_order_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving average with its state, in the order of events."""
    m = drained(spark, sf_dir, "ema", lambda s: E.ema(s, "user_id", "ts", "event_id", "value", DELAY, 0.99, 10.0)).where("key is not null")
    return m.select(F.col("key").alias("user_id"), F.col("event").alias("event_id"), "n", r6(F.col("ema")).alias("ema"))


@query(
    "r6_tumbling_windows",
    "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total, round(max(value), 6) AS largest FROM events GROUP BY 1, 2",
)
def r6_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = drained(spark, sf_dir, "tumbling", lambda s: E.windows(s.where("user_id is not null or event_id = -1"), "ts", DELAY, "6 hours", ["event_type"], "value")).where("event_type is not null")
    return w.select(F.unix_micros("start").alias("start_us"), "event_type", "n", r6(F.col("total")).alias("total"), r6(F.col("largest")).alias("largest"))


@query(
    "r7_sliding_windows",
    """WITH s AS (SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 4 HOUR, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01'), INTERVAL 2 HOUR)) AS start FROM events)
       SELECT epoch_us(start) AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total, round(max(value), 6) AS largest FROM s GROUP BY 1, 2""",
)
def r7_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours, one every two."""
    w = drained(spark, sf_dir, "sliding", lambda s: E.windows(s, "ts", DELAY, "6 hours", ["event_type"], "value", "2 hours")).where("event_type is not null")
    return w.select(F.unix_micros("start").alias("start_us"), "event_type", "n", r6(F.col("total")).alias("total"), r6(F.col("largest")).alias("largest"))


@query(
    "r8_session_windows",
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 5 HOUR THEN 0 ELSE 1 END AS new FROM events),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
       SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 5 HOUR) AS end_us, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""",
)
def r8_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events that follow each other within five hours."""
    w = drained(spark, sf_dir, "sessions", lambda s: E.sessions(s, "ts", DELAY, "5 hours", ["user_id"], "value")).where("user_id is not null")
    return w.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", r6(F.col("total")).alias("total"))


@query(
    "r9_followed_events",
    """SELECT a.event_id AS first_id, b.event_id AS second_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR""",
)
def r9_followed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and the purchases of the same user within twelve hours, as a join of two streams."""

    def make(s: DataFrame) -> DataFrame:
        side = lambda kind, name: s.where(F.col("event_type").eqNullSafe(kind) | (F.col("event_id") == -1)).select("user_id", "ts", F.col("event_id").alias(name))
        return E.followed(side("view", "first_id"), side("purchase", "second_id"), "user_id", "ts", DELAY, "12 hours").select("first_id", "second_id", "user_id")

    return drained(spark, sf_dir, "followed", make)
