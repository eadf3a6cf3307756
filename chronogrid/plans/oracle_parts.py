"""Pieces of DuckDB SQL that several oracles start from.

They are written apart from the engine: relations in long form, self-joins for
pairs and lags, and closed forms by lgamma, where the engine works on arrays.
"""

from __future__ import annotations

SUPPLIERS = """obs AS (
  SELECT l_suppkey AS pixel_id, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t,
    round(avg(l_discount) * 10, 9) AS x, round(sum(l_quantity), 6) AS r
  FROM lineitem GROUP BY 1, 2
), s AS (
  SELECT p.pixel_id, w.t, x, r FROM (SELECT DISTINCT pixel_id FROM obs WHERE t BETWEEN 0 AND 82) p
  CROSS JOIN (SELECT unnest(range(83)) AS t) w LEFT JOIN obs ON obs.pixel_id = p.pixel_id AND obs.t = w.t
)"""

USERS = """obs AS (
  SELECT user_id AS pixel_id, datediff('day', DATE '2024-01-01', ts::DATE) AS t,
    round(avg(value) / 487.3, 12) AS x, count(*)::DOUBLE AS r
  FROM events GROUP BY 1, 2
), s AS (
  SELECT p.pixel_id, w.t, x, r FROM (SELECT DISTINCT pixel_id FROM obs WHERE t BETWEEN 0 AND 29) p
  CROSS JOIN (SELECT unnest(range(30)) AS t) w LEFT JOIN obs ON obs.pixel_id = p.pixel_id AND obs.t = w.t
)"""


def r6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def normal_p(z: str) -> str:
    """Two-sided normal p by the closed-form terms z^(2n+1) / (2n+1)!!."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) > 8 THEN 0.0 ELSE greatest(0.0, 1 - 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: {term}))) END"


def student_p(t: str, df: str) -> str:
    """Two-sided t p for whole degrees of freedom, terms by lgamma."""
    c = f"({df} / ({df} + {t} * {t}))"
    a = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({a}) * list_sum(list_transform(range(0, greatest({df}::BIGINT // 2, 1)), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2)) * power({c}, k)))"
    odd = f"2 / pi() * ({a} + CASE WHEN {df} = 1 THEN 0 ELSE sin({a}) * cos({a}) * list_sum(list_transform(range(0, greatest(({df}::BIGINT - 1) // 2, 1)), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * power({c}, k))) END)"
    return f"CASE WHEN {t} IS NULL THEN NULL ELSE greatest(0.0, 1 - CASE WHEN {df}::BIGINT % 2 = 0 THEN {even} ELSE {odd} END) END"


#: After ``s``: pairs, Mann-Kendall and Sen by self-join.
MK = f"""pairs AS (
  SELECT a.pixel_id, (b.x - a.x) / (b.t - a.t) AS slope FROM s a JOIN s b ON a.pixel_id = b.pixel_id AND a.t < b.t
  WHERE a.x IS NOT NULL AND b.x IS NOT NULL
), ps AS (
  SELECT pixel_id, sum(sign(slope))::DOUBLE AS s, median(slope) AS med FROM pairs GROUP BY pixel_id
), cnt AS (
  SELECT pixel_id, count(x)::DOUBLE AS n FROM s GROUP BY pixel_id
), tied AS (
  SELECT pixel_id, sum(c * (c - 1) * (2 * c + 5))::DOUBLE AS ties FROM (SELECT pixel_id, x, count(*) AS c FROM s WHERE x IS NOT NULL GROUP BY 1, 2) GROUP BY 1
), mk0 AS (
  SELECT cnt.pixel_id, n, coalesce(s, 0) AS s, med, coalesce(ties, 0) AS ties FROM cnt LEFT JOIN ps USING (pixel_id) LEFT JOIN tied USING (pixel_id)
), mk1 AS (
  SELECT *, CASE WHEN n < 10 OR (n * (n - 1) * (2 * n + 5) - ties) / 18 <= 0 THEN NULL ELSE (n * (n - 1) * (2 * n + 5) - ties) / 18 END AS var,
    CASE WHEN n >= 10 THEN med END AS sen FROM mk0
), mk AS (
  SELECT *, CASE WHEN n < 10 THEN NULL WHEN s > 0 THEN (s - 1) / sqrt(var) WHEN s < 0 THEN (s + 1) / sqrt(var) ELSE 0 END AS z,
    CASE WHEN n < 10 THEN NULL ELSE s / (0.5 * n * (n - 1)) END AS tau FROM mk1
)"""

#: After ``MK``: the variance ratio for autocorrelated ranks.
HR = """det AS (
  SELECT pixel_id, t, row_number() OVER (PARTITION BY pixel_id ORDER BY x - med * t, t) AS rk, n FROM s JOIN mk USING (pixel_id) WHERE x IS NOT NULL
), dev AS (
  SELECT pixel_id, t, rk - (n + 1) / 2 AS c, n FROM det
), den AS (
  SELECT pixel_id, sum(c * c) AS d FROM dev GROUP BY 1
), lag0 AS (
  SELECT a.pixel_id, b.t - a.t AS lag, sum(a.c * b.c) AS num, any_value(a.n) AS n FROM dev a JOIN dev b ON a.pixel_id = b.pixel_id AND b.t > a.t
  WHERE b.t - a.t <= {last} GROUP BY 1, 2
), fac AS (
  SELECT pixel_id, sum(CASE WHEN n - lag > 2 AND abs(num / d) > 1.959963984540054 / sqrt(n - lag)
    THEN (n - lag) * (n - lag - 1) * (n - lag - 2) * num / d ELSE 0 END) AS f FROM lag0 JOIN den USING (pixel_id) WHERE d > 0 GROUP BY 1
), hr AS (
  SELECT mk.*, least(20.0, greatest(0.05, 1 + CASE WHEN n > 2 THEN 2 / (n * (n - 1) * (n - 2)) * coalesce(f, 0) ELSE 0 END)) AS ratio FROM mk LEFT JOIN fac USING (pixel_id)
), hrz AS (
  SELECT *, CASE WHEN var IS NULL THEN NULL WHEN s > 0 THEN (s - 1) / sqrt(var * ratio) WHEN s < 0 THEN (s + 1) / sqrt(var * ratio) ELSE 0 END AS hz FROM hr
)"""

#: After ``s``: sums over steps where both are observed, and the joint fit.
RESTREND = f"""c AS (
  SELECT pixel_id, count(*)::DOUBLE AS n, var_pop(r) * count(*) AS yy, var_pop(t) * count(*) AS tt, covar_pop(t, r) * count(*) AS yt,
    covar_pop(r, x) * count(*) AS yx, covar_pop(t, x) * count(*) AS tx, var_pop(x) * count(*) AS xx
  FROM s WHERE x IS NOT NULL AND r IS NOT NULL GROUP BY 1
), j0 AS (
  SELECT *, yy * tt - yt * yt AS det, greatest(n - 3, 1) AS df FROM c
), j1 AS (
  SELECT *, CASE WHEN det > 0 THEN (tt * yx - yt * tx) / det END AS beta, CASE WHEN det > 0 THEN (yy * tx - yt * yx) / det END AS slope FROM j0
), j2 AS (
  SELECT *, xx + beta * beta * yy + slope * slope * tt - 2 * beta * yx - 2 * slope * tx + 2 * beta * slope * yt AS sse FROM j1
), j3 AS (
  SELECT *, CASE WHEN xx - tx * tx / tt > 0 THEN 1 - sse / (xx - tx * tx / tt) END AS r2,
    CASE WHEN sse > 0 THEN beta / sqrt(sse / df * tt / det) END AS tb, CASE WHEN sse > 0 THEN slope / sqrt(sse / df * yy / det) END AS ts FROM j2
), j4 AS (
  SELECT *, {student_p('tb', 'df')} AS pb, {student_p('ts', 'df')} AS p FROM j3
), joint AS (
  SELECT pixel_id, n::INTEGER AS n, CASE WHEN n >= 10 THEN slope END AS slope, CASE WHEN n >= 10 THEN p END AS p, CASE WHEN n >= 10 THEN r2 END AS r2,
    CASE WHEN n >= 10 THEN beta END AS beta, CASE WHEN n >= 10 THEN pb END AS beta_p,
    coalesce(n >= 10 AND r2 >= 0.10 AND pb < 0.05 AND beta > 0, false) AS valid FROM j4
)"""


def spectrum(n_time: int) -> str:
    """After ``s``: power by harmonic, with gaps at the mean and detrended."""
    return f"""m AS (SELECT pixel_id, avg(x) AS m, count(x) AS n FROM s GROUP BY 1
), f AS (SELECT pixel_id, t, coalesce(x, m, 0) AS x, n FROM s JOIN m USING (pixel_id)
), lin AS (SELECT pixel_id, avg(x) AS mx, covar_pop(t, x) / var_pop(t) AS b, avg(t) AS mt FROM f GROUP BY 1
), d AS (SELECT pixel_id, t, x - mx - b * (t - mt) AS e, n FROM f JOIN lin USING (pixel_id)
), pw AS (SELECT pixel_id, k, any_value(n) AS n, power(sum(e * cos(2 * pi() * k * t / {n_time})), 2) + power(sum(e * sin(2 * pi() * k * t / {n_time})), 2) AS p
  FROM d CROSS JOIN (SELECT unnest(range(1, {n_time // 2 + 1})) AS k) GROUP BY 1, 2
), inb AS (SELECT *, k * (1.0::DOUBLE / {n_time}) BETWEEN 1.0::DOUBLE / 12 AND 1.0::DOUBLE / 4 AS inside FROM pw
), cyc0 AS (SELECT pixel_id, any_value(n) AS n, sum(p) FILTER (inside) AS band, sum(p) AS total, count(*) FILTER (inside) / count(*)::DOUBLE AS share,
  arg_max(k, p) FILTER (inside) AS peak FROM inb GROUP BY 1
), cyc AS (SELECT pixel_id, CASE WHEN n >= 12 AND total > 1e-12 THEN band / total END AS score,
  CASE WHEN n >= 12 AND total > 1e-12 THEN band / total / share END AS enrichment,
  CASE WHEN n >= 12 AND total > 1e-12 THEN 1 / (peak * (1.0::DOUBLE / {n_time})) END AS period,
  CASE WHEN n >= 12 AND total > 1e-12 THEN band END AS band_power, CASE WHEN n >= 12 AND total > 1e-12 THEN total END AS total_power FROM cyc0)"""


def breaks(n_time: int) -> str:
    """After ``s``: two-line fits at every position by regression aggregates."""
    return f"""ks AS (SELECT unnest(range(4, {n_time - 4})) AS k
), seg AS (
  SELECT pixel_id, k, t >= k AS side, count(*) AS n, greatest(0.0, count(*) * (var_pop(x) - CASE WHEN var_pop(t) > 0 THEN covar_pop(t, x) * covar_pop(t, x) / var_pop(t) ELSE 0 END)) AS sse,
    CASE WHEN var_pop(t) > 0 THEN covar_pop(t, x) / var_pop(t) ELSE 0 END AS slope
  FROM s CROSS JOIN ks WHERE x IS NOT NULL GROUP BY 1, 2, 3
), two AS (
  SELECT a.pixel_id, a.k, a.sse + b.sse AS sse, b.slope - a.slope AS d FROM seg a JOIN seg b ON a.pixel_id = b.pixel_id AND a.k = b.k AND NOT a.side AND b.side
  WHERE a.n >= 4 AND b.n >= 4
), one AS (
  SELECT pixel_id, count(x) AS n, count(x) * var_pop(x) AS v, greatest(0.0, count(x) * (var_pop(x) - covar_pop(t, x) * covar_pop(t, x) / nullif(var_pop(t), 0))) AS sse1
  FROM s WHERE x IS NOT NULL GROUP BY 1
), rel AS (
  SELECT two.*, round(sse / CASE WHEN sse1 > 0 THEN sse1 ELSE 1 END, 10) AS r FROM two JOIN one USING (pixel_id)
), best AS (
  SELECT pixel_id, arg_min(k, (r, k)) AS k, arg_min(sse, (r, k)) AS sse, arg_min(d, (r, k)) AS d FROM rel GROUP BY 1
), b0 AS (
  SELECT p.pixel_id, k, sse, d, n, sse1, coalesce(k IS NOT NULL AND sse1 > 1e-10 * greatest(v, 1e-30), false) AS ok
  FROM (SELECT DISTINCT pixel_id FROM s) p LEFT JOIN best USING (pixel_id) LEFT JOIN one USING (pixel_id)
), b1 AS (
  SELECT *, CASE WHEN ok THEN 1 - sse / sse1 END AS gain, CASE WHEN ok AND sse > 0 AND n > 4 THEN (sse1 - sse) / 2 / (sse / (n - 4)) END AS f FROM b0
), b2 AS (SELECT *, power(1 + 2 * f / (n - 4), -(n - 4) / 2.0) AS p FROM b1
), brk AS (
  SELECT pixel_id, coalesce(k, -1)::INTEGER AS k, d, gain, f, p, least(p * {max(n_time - 8, 1)}, 1.0) AS padj,
    coalesce(gain >= 0.05 AND least(p * {max(n_time - 8, 1)}, 1.0) < 0.05, false) AS significant FROM b2)"""


#: After ``breaks``: the ladder of what followed.
RECOVERY = """kk AS (SELECT pixel_id, CASE WHEN k >= 0 THEN k END AS k FROM brk
), lv AS (
  SELECT kk.pixel_id, any_value(k) AS k, avg(x) FILTER (t >= k - 3 AND t < k) AS pre, count(x) FILTER (t >= k) AS npost,
    min({'x': x, 't': t}) FILTER (t >= k AND x IS NOT NULL) AS low FROM kk JOIN s USING (pixel_id) GROUP BY 1
), lo AS (
  SELECT pixel_id, k, pre, CASE WHEN pre IS NOT NULL AND npost >= 2 THEN low.x END AS tx, CASE WHEN pre IS NOT NULL AND npost >= 2 THEN low.t END AS tt FROM lv
), tl AS (
  SELECT lo.pixel_id, count(x) AS n, arg_max(x, t) FILTER (x IS NOT NULL) AS last, regr_slope(x, t) AS slope,
    min(t) FILTER (x >= 0.8 * pre) AS hit FROM lo JOIN s ON s.pixel_id = lo.pixel_id AND t >= tt GROUP BY 1
), rec AS (
  SELECT lo.pixel_id, pre, tx, tt, pre - tx AS mag, CASE WHEN pre - tx >= 0.05 AND n >= 3 THEN last - tx END AS back,
    CASE WHEN pre - tx >= 0.05 AND n >= 3 THEN greatest((last - tx) / (pre - tx), 0) END AS frac,
    CASE WHEN pre - tx >= 0.05 AND n >= 3 THEN (hit - tt)::DOUBLE END AS dur, CASE WHEN pre - tx >= 0.05 AND n >= 3 THEN slope END AS slope,
    CASE WHEN k IS NULL THEN 0 WHEN pre IS NULL OR tx IS NULL THEN 4 WHEN pre - tx < 0.05 THEN 0 WHEN n < 3 THEN 4
      WHEN hit IS NOT NULL THEN 1 WHEN slope > 0 THEN 2 ELSE 3 END AS status
  FROM lo LEFT JOIN tl USING (pixel_id))"""
