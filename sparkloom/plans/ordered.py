"""Ordered computations over keys that may hold most rows: ranks, tiles, running values, patterns of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import scan
from sparkloom.operators.patterns import match_events
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query(
    "ranking_split",
    """
    SELECT o_orderkey, o_orderstatus, rank() OVER w AS r, dense_rank() OVER w AS d,
           round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)""",
)
def ranking_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys, each of a third of all rows and with many ties, dealt over all tasks."""
    rows = scan.ranks(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderstatus"], ["o_orderdate"])
    return rows.select("o_orderkey", "o_orderstatus", F.col("rank").alias("r"), F.col("dense_rank").alias("d"), F.round("percent_rank", 9).alias("pr"), F.round("cume_dist", 9).alias("cd"))


@query(
    "tiles_split",
    """
    SELECT o_orderkey, ntile(100) OVER w AS percentile, first_value(o_orderkey) OVER w AS first_key,
           nth_value(o_orderkey, 2) OVER w AS second_key, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)""",
)
def tiles_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles, values at a place and neighbours of such keys. (A value at the second place is null on the first row, as the frame ends there.)"""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows = scan.in_order(orders, ["o_orderstatus"], ["o_totalprice", "o_orderkey"]).scan(no=scan.count(), rows=scan.count("all"), before=scan.latest("o_orderkey", "before"), after=scan.latest("o_orderkey", "after"))
    at = lambda n: F.when(F.col("no") == n, F.col("o_orderkey"))
    rows = rows.scan(first_key=scan.greatest(at(1)), second_key=scan.greatest(at(2)))
    return rows.result().select("o_orderkey", scan.tile(F.col("no"), F.col("rows"), 100).alias("percentile"), "first_key", "second_key", "before", "after")


@query(
    "running_split",
    """
    SELECT event_id, round(sum(value) OVER w, 6) AS so_far, count(*) FILTER (event_type = 'error') OVER w AS errors,
           max(value) OVER w AS most, date_diff('microsecond', lag(ts) OVER (ORDER BY ts, event_id), ts) AS gap,
           round(value / sum(value) OVER (), 12) AS share
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values over a whole table: one order, no key, all tasks."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    is_error = (F.col("event_type") == "error").cast("long")
    rows = scan.in_order(events, [], ["at", "event_id"]).scan(so_far=scan.total("value"), errors=scan.total(is_error), most=scan.greatest("value"), prior=scan.latest("at", "before"), all=scan.total("value", "all"))
    return rows.result().select("event_id", F.round("so_far", 6).alias("so_far"), "errors", "most", (F.col("at") - F.col("prior")).alias("gap"), F.round(F.col("value") / F.col("all"), 12).alias("share"))


@query(
    "event_patterns",
    """
    WITH s AS (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM events)),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS no FROM s),
    c AS (SELECT user_id, session, string_agg(event_type[1], '' ORDER BY ts, event_id) AS codes FROM s GROUP BY ALL),
    m AS (
      SELECT user_id, session, unnest(regexp_extract_all(codes, '[v]+[ce]{0,3}[p]')) AS hit, unnest(list_resize(string_split_regex(codes, '[v]+[ce]{0,3}[p]'), len(regexp_extract_all(codes, '[v]+[ce]{0,3}[p]')))) AS before,
             unnest(range(len(regexp_extract_all(codes, '[v]+[ce]{0,3}[p]')))) AS i FROM c),
    p AS (SELECT *, sum(length(before) + length(hit)) OVER (PARTITION BY user_id, session ORDER BY i) AS upto FROM m)
    SELECT p.user_id, a.event_id AS first, b.event_id AS last, a.ts AS began, b.ts AS ended, length(hit)::BIGINT AS n,
           length(regexp_extract(hit, '^v+'))::BIGINT AS views, length(regexp_extract(hit, '[ce]+'))::BIGINT AS others
    FROM p JOIN n a ON a.user_id = p.user_id AND a.session = p.session AND a.no = upto - length(hit) + 1
    JOIN n b ON b.user_id = p.user_id AND b.session = p.session AND b.no = upto""",
)
def event_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, then up to three clicks or errors, then a purchase, with no more than two days between any two of them."""
    rows = match_events(table(spark, sf_dir, "events"), "view+ click|error{0,3} purchase", key="user_id", at="ts", symbol="event_type", tie="event_id", gap="2 DAYS")
    return rows.select("user_id", "first", "last", "began", "ended", "n", F.col("steps")[0].alias("views"), F.col("steps")[1].alias("others"))
