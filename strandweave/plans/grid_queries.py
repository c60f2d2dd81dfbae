"""Problem 2: readings onto a minute grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators.gridding import regular_grid, slots_without_value
from strandweave.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return slots_without_value(regular_grid(table(spark, d, "observations")))


def p2_minute_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "observations")).withColumn("value", F.round(F.col("value") + 1e-9, 6))


QUERIES = {"p2_found": p2_found, "p2_minute_grid": p2_minute_grid}

_ONCE = """
WITH r AS (
  SELECT subject_id, obs_idx, epoch_us(try_cast(datetime AS timestamptz)) AS us,
         max(iob) FILTER (WHERE isfinite(iob)) AS iob, max(cob) FILTER (WHERE isfinite(cob)) AS cob, max(ig) FILTER (WHERE isfinite(ig)) AS ig
  FROM observations WHERE try_cast(datetime AS timestamptz) IS NOT NULL AND subject_id IS NOT NULL GROUP BY ALL
), long AS (
  SELECT subject_id, us, us // 60000000 * 60 AS slot, u.variate, u.v
  FROM r, LATERAL (SELECT unnest(['iob','cob','ig']) AS variate, unnest([iob,cob,ig]) AS v) u
), days AS (
  SELECT subject_id, slot // 86400 AS day, min(slot) AS lo, max(slot) AS hi FROM long GROUP BY ALL
), grid AS (
  SELECT subject_id, unnest(generate_series(lo, hi, 60)) AS slot FROM days
), cells AS (
  SELECT g.subject_id, v.variate, g.slot FROM grid g, (VALUES ('iob'),('cob'),('ig')) v(variate)
), seen AS (
  SELECT subject_id, variate, slot, count(v) AS n, avg(v) AS m FROM long GROUP BY ALL
)
"""
ORACLES = {
    "p2_found": _ONCE + """
SELECT c.subject_id, c.variate, c.slot FROM cells c LEFT JOIN seen s USING (subject_id, variate, slot) WHERE coalesce(s.n, 0) = 0
""",
    "p2_minute_grid": _ONCE + """
, fin AS (SELECT subject_id, variate, us, max(v) AS v FROM long WHERE v IS NOT NULL GROUP BY ALL)
, todo AS (
  SELECT c.subject_id, c.variate, c.slot, coalesce(s.n, 0) AS n, s.m FROM cells c LEFT JOIN seen s USING (subject_id, variate, slot)
), p AS (
  SELECT t.*, f.us AS pu, f.v AS pv FROM todo t ASOF LEFT JOIN fin f ON t.subject_id = f.subject_id AND t.variate = f.variate AND t.slot * 1000000 > f.us
), q AS (
  SELECT p.*, f.us AS qu, f.v AS qv FROM p ASOF LEFT JOIN fin f ON p.subject_id = f.subject_id AND p.variate = f.variate AND (p.slot + 60) * 1000000 <= f.us
)
SELECT subject_id, variate, slot,
  round((CASE WHEN n > 0 THEN m WHEN qu - pu <= 1800000000 THEN pv + (qv - pv) * (((slot + 30) * 1000000.0::DOUBLE - pu) / (qu - pu)) END) + 1e-9, 6) AS value,
  CASE WHEN n > 0 THEN 'observed' WHEN qu - pu <= 1800000000 THEN 'filled' ELSE 'missing' END AS status,
  n AS n_readings
FROM q
""",
}
