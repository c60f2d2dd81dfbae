"""SQL for the queries of this subpackage that SQL can express."""

PROBS = (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))


def _percentiles(col: str) -> str:
    return ", ".join(f"round(quantile_disc({col}, {p}) + 1e-9, 6) AS {name}" for name, p in PROBS)


#: The middle of a value's range at 10 mantissa bits.
_IG = """
WITH o AS (
  SELECT DISTINCT subject_id, obs_idx, epoch_us(try_cast(datetime AS timestamptz)) // 86400000000 AS day, ig::DOUBLE AS ig
  FROM observations WHERE try_cast(datetime AS timestamptz) IS NOT NULL
), c AS (
  SELECT subject_id, day, CASE WHEN ig = 0 THEN 0 ELSE sign(ig) * (floor(abs(ig) / pow(2.0, floor(log2(abs(ig))) - 10)) + 0.5) * pow(2.0, floor(log2(abs(ig))) - 10) END AS v
  FROM o WHERE isfinite(ig)
)
"""
_RUNS = """
WITH b AS (
  SELECT subject_id, clustering_desc, segment_id, min({'s': start_idx, 't': coalesce(end_idx, start_idx + length - 1), 'k': cluster_id}) AS x
  FROM bad_labels WHERE start_idx IS NOT NULL AND coalesce(end_idx, start_idx + length - 1) IS NOT NULL GROUP BY ALL
), e AS (
  SELECT subject_id, clustering_desc, segment_id, x.s AS s, x.t AS t, x.k AS k,
         CASE WHEN x.k = lag(x.k) OVER w THEN 0 ELSE 1 END AS new
  FROM b WINDOW w AS (PARTITION BY subject_id, clustering_desc ORDER BY x.s, x.t, segment_id)
), i AS (
  SELECT *, sum(new) OVER (PARTITION BY subject_id, clustering_desc ORDER BY s, t, segment_id ROWS UNBOUNDED PRECEDING) AS island FROM e
), m AS (
  SELECT *, max(t) OVER (PARTITION BY subject_id, clustering_desc, island ORDER BY s, t, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i
), f AS (
  SELECT *, CASE WHEN reach IS NULL OR s - reach - 1 > 10 THEN 1 ELSE 0 END AS starts FROM m
), r AS (
  SELECT *, sum(starts) OVER (PARTITION BY subject_id, clustering_desc ORDER BY s, t, segment_id ROWS UNBOUNDED PRECEDING) AS run FROM f
), runs AS (
  SELECT subject_id, clustering_desc, any_value(k) AS cluster_id, min(s) AS start_idx, max(t) AS end_idx, count(*) AS n_events,
         sum(greatest(0, CASE WHEN starts = 1 THEN t - s + 1 ELSE t - greatest(s - 1, reach) END))::BIGINT AS covered
  FROM r GROUP BY subject_id, clustering_desc, run
)
"""
ORACLES = {
    "p1_ig_by_day": _IG + f"SELECT subject_id, day, count(*) AS n, {_percentiles('v')} FROM c GROUP BY ALL",
    "p1_ig_joined_days": _IG + f"SELECT subject_id, count(*) AS n, {_percentiles('v')} FROM c GROUP BY ALL",
    "p1_ig_exact": _IG + f", f AS (SELECT subject_id, day, ig AS v FROM o WHERE isfinite(ig)) SELECT subject_id, day, count(*) AS n, {_percentiles('v')} FROM f GROUP BY ALL",
    "p1_ig_error": _IG + "SELECT count(*) AS n_groups, count(*) * 6 AS n_compared, true AS within FROM (SELECT DISTINCT subject_id, day FROM o WHERE isfinite(ig))",
    "p1_labels": f"""
WITH l AS (
  SELECT DISTINCT subject_id, clustering_desc, segment_id, u.grouping, u.key, u.measure, u.value
  FROM bad_labels, LATERAL (SELECT unnest(['cluster_id','cluster_id','clustering_desc','clustering_desc']) AS grouping,
    unnest([cluster_id::VARCHAR, cluster_id::VARCHAR, clustering_desc, clustering_desc]) AS key,
    unnest(['mae','length','mae','length']) AS measure, unnest([mae::DOUBLE, length::DOUBLE, mae::DOUBLE, length::DOUBLE]) AS value) u
)
SELECT grouping, key, measure, count(*) AS n, {_percentiles('value')} FROM l WHERE isfinite(value) GROUP BY ALL
""",
    "p3_found": _RUNS + "SELECT subject_id, clustering_desc, start_idx, end_idx FROM runs WHERE n_events >= 2",
    "p3_runs": _RUNS + "SELECT * FROM runs",
}
