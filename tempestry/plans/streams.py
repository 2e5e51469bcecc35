"""Queries that run a stream over the event table to its end, checked against the same figures in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.operators.tables import shared_path
from tempestry.plans.registry import Tables, query
from tempestry.streaming import flows


def _run(t: Tables, flow, mode: str = "append", **options) -> DataFrame:
    folder = shared_path(t.spark, "streams")
    flows.to_parquet(flow(flows.events(t.spark, t.sf_dir), **options), f"{folder}/out", f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out").drop("batch")


@query("""WITH m AS (SELECT max(ts) FILTER (event_type = 'click') - INTERVAL 12 HOUR AS mark FROM events)
SELECT CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS start_s, count(*) AS n FROM events, m WHERE event_type = 'click' AND floor(epoch(ts) / 600) * 600 + 600 <= epoch(m.mark) GROUP BY 1""")
def stream_flash_density(t: Tables) -> DataFrame:
    """Tumbling windows of lightning that the watermark has closed."""
    return _run(t, flows.flash_density).select(F.unix_seconds("start").alias("start_s"), "n")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), f AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT p.event_id AS pass_id, f.event_id AS fix_id, p.user_id AS storm_id FROM p JOIN f ON p.user_id = f.user_id AND f.ts <= p.ts AND f.ts >= p.ts - INTERVAL 12 HOUR""")
def stream_passes_near_fixes(t: Tables) -> DataFrame:
    """Stream-stream interval join of passes and fixes."""
    return _run(t, flows.passes_near_fixes)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_deduplicated(t: Tables) -> DataFrame:
    """Events counted after duplicates within the watermark are dropped."""
    return _run(t, flows.deduplicated).groupBy("event_type").agg(F.count("*").alias("n"))
