"""Deterministic road networks and traces derived from the general-purpose tables.

The tables hold no roads and no positions, so every operator is exercised through these views. Each is
SQL that both Spark and DuckDB run, from the tables and the views it names in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("supplier", "events", "lineitem", "orders", "customer", "part", "nation", "region")

VIEWS = {
    # directed roads of a grid: node n, direction k (0 east, 1 west, 2 north, 3 south)
    "edges": """
SELECT 4 * n + k AS road_id, n AS from_node, to_node, CAST((n + k) % 7 AS INT) AS level, n, k FROM (
  SELECT s_suppkey AS n, k, s_suppkey % 10 AS cx, CASE k WHEN 0 THEN s_suppkey + 1 WHEN 1 THEN s_suppkey - 1 WHEN 2 THEN s_suppkey + 10 ELSE s_suppkey - 10 END AS to_node
  FROM {supplier} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) AS ks) AS e
WHERE to_node >= 0 AND to_node < (SELECT count(*) FROM {supplier}) AND NOT (k = 0 AND cx = 9) AND NOT (k = 1 AND cx = 0)""",
    # their points: ends and two between, moved sideways
    "points": """
SELECT road_id, pos, flat + (tlat - flat) * pos / 3.0E0 + CASE WHEN pos IN (1, 2) AND k < 2 THEN off ELSE 0.0E0 END AS lat,
  flon + (tlon - flon) * pos / 3.0E0 + CASE WHEN pos IN (1, 2) AND k >= 2 THEN off ELSE 0.0E0 END AS lon
FROM (SELECT road_id, k, 41.10E0 + 0.004E0 * floor(n / 10E0) AS flat, -8.70E0 + 0.004E0 * (n % 10) AS flon,
    41.10E0 + 0.004E0 * floor(to_node / 10E0) AS tlat, -8.70E0 + 0.004E0 * (to_node % 10) AS tlon, 0.0002E0 * ((n + k) % 3 - 1) AS off FROM {edges}) AS e
CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 AS pos UNION ALL SELECT 2 AS pos UNION ALL SELECT 3 AS pos) AS ps""",
    # dense traces: a point each 15 s for every user
    "traces": """
SELECT user_id AS traj_id, CAST(seq AS INT) AS seq, 1704067200 + 15 * seq AS ts,
  41.10E0 + 0.004E0 * (user_id % 10) + 0.00001E0 * ((event_id * 7919) % 21 - 10) + CASE WHEN event_id % 37 = 0 THEN 0.01E0 ELSE 0.0E0 END AS lat,
  -8.70E0 + 0.0009E0 * (CASE WHEN seq % 80 < 40 THEN seq % 80 ELSE 80 - seq % 80 END) AS lon
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM {events}) AS e""",
    # sparse traces: a point a minute
    "sparse": "SELECT traj_id, CAST(seq / 4 AS INT) AS seq, ts, lat, lon FROM {traces} WHERE seq % 4 = 0",
    # the same without the points that jump off the lane, of lanes that the network has
    "calm": """
SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS INT) AS seq, ts, lat, lon FROM {sparse} WHERE lat - 41.10E0 - 0.004E0 * (traj_id % 10) < 0.005E0 AND 10 * (traj_id % 10) < (SELECT count(*) FROM {supplier})""",
    # rows as preprocessing writes them: second of the day, distance left to the node, next road, elapsed seconds
    "trips": """
SELECT traj_id, seq, road_id, coalesce(nxt, road_id) AS to_road, CAST(ts % 86400 AS DOUBLE) AS t, to_node,
  CAST(coalesce(lead(ts) OVER (PARTITION BY traj_id ORDER BY seq) - ts, 0) AS DOUBLE) AS elapsed
FROM (SELECT *, max(later) OVER (PARTITION BY traj_id, run) AS nxt
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY traj_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, CASE WHEN lag(road_id) OVER (PARTITION BY traj_id ORDER BY seq) = road_id THEN 0 ELSE 1 END AS fresh,
        CASE WHEN lead(road_id) OVER (PARTITION BY traj_id ORDER BY seq) <> road_id THEN lead(road_id) OVER (PARTITION BY traj_id ORDER BY seq) END AS later
      FROM {placed}) AS a) AS b) AS c""",
    # where a dense trace is on the grid: road and distance to its end
    "placed": """
SELECT traj_id, seq, ts, CASE WHEN ahead THEN 4 * (10 * lane + cell) ELSE 4 * (10 * lane + cell + 1) + 1 END AS road_id,
  335.0E0 * (CASE WHEN ahead THEN cell + 1 - along ELSE along - cell END) + CASE WHEN seq % 7 = 0 THEN 0.5E0 ELSE 0.0E0 END AS to_node
FROM (SELECT traj_id, seq, ts, lane, along, ahead, CAST(least(floor(along), 8) AS BIGINT) AS cell
  FROM (SELECT traj_id, seq, ts, traj_id % 10 AS lane, seq % 80 < 40 AS ahead, (CASE WHEN seq % 80 < 40 THEN seq % 80 ELSE 80 - seq % 80 END) * 9 / 40.0E0 AS along FROM {traces}) AS a) AS b""",
    # two sequences of road ids for each order: the truth, and a recovery that drops and reorders
    "sequences": """
SELECT l_orderkey AS traj_id, r, l_suppkey AS road_id, l_partkey % 5 <> 0 AS kept, r + CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 0 END AS place
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS r FROM {lineitem}) AS l""",
}


def needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table, as a DataFrame."""
    if name in TABLES:
        return read(spark, sf_dir, name)
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needs(name)})


def ctes(*names: str) -> str:
    """The views and what they need as common table expressions, for SQL that goes on after a comma or SELECT."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in needs(name):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n])})" for n in order)
