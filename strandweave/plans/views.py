"""SQL of the cleaned views, for use in WITH lists."""

VEC = "list_transform(string_split(regexp_replace({c}, '[\\[\\]() ]', '', 'g'), ','), lambda x: CAST(x AS DOUBLE))"
FLAG = "list_transform(string_split(lower(regexp_replace({c}, '[\\[\\]() ]', '', 'g')), ','), lambda x: CAST(x AS BOOLEAN))"


def vec(c: str) -> str:
    return VEC.format(c=c)


def r6(x: str, digits: int = 6) -> str:
    return f"round(({x}) + 1e-9, {digits})"


#: Keys once each, values that are not finite as nulls; `_F` is the part with all three values.
OBS = """obs AS (
  SELECT subject_id, obs_idx, max(epoch_us(try_cast(datetime AS timestamptz))) AS us, max(iob) FILTER (WHERE isfinite(iob)) AS iob, max(cob) FILTER (WHERE isfinite(cob)) AS cob, max(ig) FILTER (WHERE isfinite(ig)) AS ig
  FROM observations WHERE subject_id IS NOT NULL AND obs_idx IS NOT NULL GROUP BY subject_id, obs_idx
)"""
OBS_F = OBS + ", obsf AS (SELECT * FROM obs WHERE iob IS NOT NULL AND cob IS NOT NULL AND ig IS NOT NULL)"
_NUM = "CASE WHEN {c}::VARCHAR <> 'nan' THEN round({c}::DOUBLE, 6) END AS {c}"
SEG = f"""seg AS (
  SELECT subject_id, segment_id, start_idx, end_idx, length, cluster_id, {vec('correlation_to_model')} AS model, {vec('correlation_achieved')} AS achieved,
    {FLAG.format(c='correlation_achieved_with_tolerance')} AS within, {_NUM.format(c='mae')}, {_NUM.format(c='relaxed_mae')}
  FROM (SELECT DISTINCT * FROM segment_labels)
)"""
BAD = f"""bad AS (
  SELECT subject_id, clustering_desc, segment_id, start_idx, e AS end_idx, length, cluster_id, {vec('correlation_achieved')} AS achieved, {FLAG.format(c='correlation_achieved_with_tolerance')} AS within,
    {_NUM.format(c='mae')}, {_NUM.format(c='relaxed_mae')}
  FROM (SELECT *, coalesce(end_idx, start_idx + length - 1) AS e FROM bad_labels)
  QUALIFY row_number() OVER (PARTITION BY subject_id, clustering_desc, segment_id ORDER BY start_idx NULLS FIRST, e NULLS FIRST, length NULLS FIRST, cluster_id NULLS FIRST, mae NULLS FIRST, relaxed_mae NULLS FIRST,
    correlation_achieved NULLS FIRST, correlation_to_model NULLS FIRST, correlation_achieved_with_tolerance NULLS FIRST) = 1
)"""
PAT = f"""pat AS (SELECT pattern_id, {vec('canonical_pattern')} AS canonical, {vec('relaxed_pattern')} AS relaxed, regularisation, is_ideal = 'Yes' AS ideal FROM pattern_catalogue)"""


def with_(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


def describe(v: str, digits: int = 6) -> str:
    """The statistics of a double that may be null."""
    q = ", ".join(f"{r6(f'quantile_cont({v}, {p})', digits)} AS {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    return f"count({v}) AS count, {r6(f'avg({v})', digits)} AS mean, {r6(f'stddev_samp({v})', digits)} AS std, {r6(f'min({v})', digits)} AS min, {q}, {r6(f'max({v})', digits)} AS max"


def lp(a: str, b: str, p: float) -> str:
    d = f"list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))"
    if p == 1:
        return f"list_sum({d})"
    if p == float("inf"):
        return f"list_max({d})"
    return f"(CASE WHEN list_max({d}) = 0 THEN 0 ELSE pow(list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(abs(z[1] - z[2]), {p}::DOUBLE))), 1.0::DOUBLE / {p}) END)"


def ref(a: str) -> str:
    return f"list_transform({a}, lambda z: 1.0::DOUBLE / sqrt(len({a})))"


def dotted(a: str) -> str:
    return f"list_append({a}, (list_sum({a}) / sqrt(len({a})) + 1) / 2)"


def measure(name: str, a: str, b: str) -> str:
    if name == "cosine":
        return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"
    n, _, kind = name.partition("_")
    p = float(n[1:])
    if kind == "ref":
        return f"({lp(a, b, p)} * ({lp(a, ref(a), p)} + {lp(b, ref(b), p)}))"
    return lp(dotted(a), dotted(b), p) if kind == "dot" else lp(a, b, p)


def spearman(source: str, by: str) -> str:
    """CTEs that end in `corr(<by>, n, a, b, c)` of a relation with iob, cob, ig."""
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE AS {c}"
    return f"rk AS (SELECT {by}, {rank('iob')}, {rank('cob')}, {rank('ig')} FROM {source}), {pearson('rk', by)}"


def pearson(source: str, by: str) -> str:
    c = lambda a, b: f"CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})) ELSE 'nan'::DOUBLE END"
    return f"corr AS (SELECT {by}, count(*) AS n, {c('iob', 'cob')} AS a, {c('iob', 'ig')} AS b, {c('cob', 'ig')} AS c FROM {source} GROUP BY {by})"


def trunc3(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN {x} ELSE sign(round({x}, 9)) * floor(round(abs(round({x}, 9)) * 1000, 6)) / 1000 END"


CORR = f"[{trunc3('a')}, {trunc3('b')}, {trunc3('c')}]"


def half_even(x: str) -> str:
    """Half-even to three decimals."""
    k = f"(round({x}, 9) * 1000)"
    return f"CASE WHEN abs({k} - floor({k}) - 0.5) < 1e-5 THEN 2 * round({k} / 2) ELSE round({k}) END / 1000"


def t_two_sided(t: str, df: str) -> str:
    """Two-sided p of Student's t with whole degrees of freedom, by the finite series of the angle atan(t / sqrt(df))."""
    angle = f"atan(abs({t}) / sqrt({df}::DOUBLE))"
    even = f"sin({angle}) * coalesce(list_sum(list_transform(range(0, ({df} // 2)::BIGINT), lambda j: coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2 * i - 1) / (2.0::DOUBLE * i))), 1) * pow(cos({angle}), 2 * j))), 0)"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, (({df} - 1) // 2)::BIGINT), lambda j: coalesce(list_product(list_transform(range(1, j + 1), lambda i: 2 * i / (2.0::DOUBLE * i + 1))), 1) * pow(cos({angle}), 2 * j + 1))), 0))"
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"
