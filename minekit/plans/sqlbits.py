"""Common table expressions of the DuckDB twins."""

LAPS = """
e AS (SELECT event_id AS id, user_id AS driver, event_type AS compound, value, ts, CAST(CASE WHEN day(ts) > 15 THEN 2023 ELSE 2022 END AS BIGINT) AS year, CAST(day(ts) % 5 AS BIGINT) AS race FROM events),
s AS (SELECT *, row_number() OVER g AS lap, count(*) OVER (PARTITION BY driver, race, year) AS laps,
  CAST(coalesce(sum(CASE WHEN compound = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY driver, race, year ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS stint,
  value - lag(value) OVER g AS delta, CAST(CASE WHEN lead(compound) OVER g = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS target
  FROM e WINDOW g AS (PARTITION BY driver, race, year ORDER BY ts, id)),
laps AS (SELECT *, row_number() OVER (PARTITION BY driver, race, year, stint ORDER BY lap) AS tyre_life,
  sum(value) OVER (PARTITION BY driver, race, year, stint ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS degradation, CAST(lap AS DOUBLE) / laps AS progress FROM s)
"""
#: Scores from figures of a row: the same in both engines.
SCORED = LAPS + """,
scored AS (SELECT *, round(1 / (1 + exp(-(0.02 * (value - 40) + 0.1 * (tyre_life % 7) - 1.0))), 9) AS p1, round(1 / (1 + exp(-(0.3 * (lap % 5) - 1.2 + 0.01 * (id % 13)))), 9) AS p2, round(1 / (1 + exp(-(0.05 * (id % 17) - 0.9 + 0.2 * target))), 9) AS p3 FROM laps)
"""
BASKETS = """
baskets AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
EDGES = """
pairs AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem),
edges AS (SELECT DISTINCT a.s AS u, b.s AS v FROM pairs a JOIN pairs b ON a.k = b.k AND a.s < b.s)
"""
IRRIGATION = """
irr AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS soil, 20 + 200 * l_tax AS temp, 150 + l_extendedprice / 250 AS rain, 100 * l_discount + 5 AS wind,
  CASE l_orderkey % 4 WHEN 0 THEN 'Flowering' WHEN 1 THEN 'Harvest' WHEN 2 THEN 'Sowing' ELSE 'Vegetative' END AS stage, CASE WHEN l_returnflag = 'N' THEN 'No' ELSE 'Yes' END AS mulch,
  CASE WHEN l_quantity < 17 THEN 'High' WHEN l_quantity < 34 THEN 'Medium' ELSE 'Low' END AS y FROM lineitem)
"""
