"""Queries that write a table and read it back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import replaced
from ..streaming import events
from .registry import query, table


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one in local mode where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or tempfile.mkdtemp(prefix='sparkloom-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query(
    "snk1_guarded_replacement",
    """WITH b AS (SELECT doc_id, doc_id % 97 AS document_id, 1 + (doc_id % 97) % 3 AS revision, lang FROM documents)
SELECT doc_id, document_id, revision, lang FROM b WHERE NOT (document_id % 4 = 0 AND revision <= 2)
UNION ALL SELECT doc_id, document_id, 2, upper(lang) FROM b WHERE document_id % 4 = 0 AND revision <= 2 AND doc_id % 2 = 0""",
)
def snk1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of revisions 1 to 3, then revision 2 of every fourth document with half its chunks: refused where revision 3 is stored."""
    path = scratch(spark, "chunks")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 97).alias("document_id"), (1 + F.col("doc_id") % 97 % 3).alias("revision"), "lang")
    replaced.replace(spark, path, rows.select("document_id", "revision"), rows, "document_id", "revision", 16)
    asked = rows.where("document_id % 4 = 0").select("document_id", F.lit(2).cast("long").alias("revision")).distinct()
    new = rows.where("document_id % 4 = 0 and doc_id % 2 = 0").withColumns({"revision": F.lit(2).cast("long"), "lang": F.upper("lang")})
    replaced.replace(spark, path, asked, new, "document_id", "revision")
    return replaced.read(spark, path)


@query(
    "stw1_closed_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM n GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stw1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions from the events as a stream, worked off once: those that the watermark, an hour behind the last event, has closed."""
    path = scratch(spark, "sessions")
    events.run_once(events.sessions(events.source(spark, f"{sf_dir}/event[s].parquet", "*")), f"{path}/out", f"{path}/checkpoint")
    out = spark.read.schema("user_id long, start timestamp, stop timestamp, n long").parquet(f"{path}/out")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query(
    "stw1_sliding_windows",
    """WITH h AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM h GROUP BY 1, 2 HAVING start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stw1_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of a day's windows that begin every twelve hours, as far as they are closed."""
    path = scratch(spark, "windows")
    stream = events.source(spark, f"{sf_dir}/event[s].parquet", "*")
    events.run_once(events.windowed(stream, "24 hours", "12 hours"), f"{path}/out", f"{path}/checkpoint")
    out = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{path}/out")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
