"""Shared parts of the DuckDB SQL, in the order in which they build on each other."""

BARS = """
bars AS (SELECT ts::DATE AS session, extract(hour FROM ts)::INT AS bar, event_type AS symbol, avg(value) AS close, count(*)::BIGINT AS volume FROM events GROUP BY 1, 2, 3),
cal AS (SELECT DISTINCT ts::DATE AS session, 0 AS open_bar, 24 AS close_bar, 24 AS expected_bars FROM events),
grid AS (SELECT c.session, c.bar, s.symbol FROM (SELECT session, unnest(range(0, 24))::INT AS bar FROM cal) c, (SELECT DISTINCT event_type AS symbol FROM events) s),
panel AS (SELECT g.*, b.close, b.volume, b.close IS NULL AS missing FROM grid g LEFT JOIN bars b USING (session, bar, symbol))"""

FILLED = BARS + """,
filled AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY bar ROWS UNBOUNDED PRECEDING) AS filled FROM panel)"""

RETURNS = FILLED + """,
returns AS (SELECT *, CASE WHEN filled > 0 AND lag(filled) OVER w > 0 AND bar - lag(bar) OVER w = 1 THEN ln(filled) - ln(lag(filled) OVER w) END AS ret,
  missing OR coalesce(lag(missing) OVER w, false) AS contaminated FROM filled WINDOW w AS (PARTITION BY symbol, session ORDER BY bar)),
cleaned AS (SELECT *, CASE WHEN session <> DATE '2024-01-16' AND NOT contaminated THEN ret END AS clean FROM returns)"""

BINS = RETURNS + """,
whole AS (SELECT * FROM (SELECT *, count(ret) OVER (PARTITION BY session, bar) AS k FROM returns) WHERE k = 5),
seen AS (SELECT session, (bar // 4)::INT AS bin, count(*) AS n, count(DISTINCT bar) AS d FROM (SELECT DISTINCT session, bar FROM whole) GROUP BY 1, 2),
bins AS (SELECT c.session, c.bin, coalesce(s.n, 0)::BIGINT AS n_bars, coalesce(s.n, 0) = 4 AND coalesce(s.d, 0) = 4 AS valid
  FROM (SELECT session, unnest(range(0, 6))::INT AS bin FROM cal) c LEFT JOIN seen s USING (session, bin)),
diag AS (SELECT session, 24::BIGINT AS expected_bars, sum(n_bars)::BIGINT AS observed_bars, count(*) AS n_candidate, sum(valid::INT)::BIGINT AS n_valid, (count(*) - sum(valid::INT))::BIGINT AS n_invalid, round(sum(valid::INT) * 4 / 24.0::DOUBLE, 8) AS valid_bar_fraction FROM bins GROUP BY 1),
rv AS (SELECT session, symbol, sum(r * r) AS rv FROM (SELECT whole.session, symbol, (bar // 4)::INT AS bin, sum(ret) AS r FROM whole JOIN (SELECT session, bin FROM bins WHERE valid) b ON whole.session = b.session AND whole.bar // 4 = b.bin GROUP BY ALL) GROUP BY 1, 2)"""

DAYS = """
levels AS (SELECT l_shipdate::DATE AS day, l_returnflag || l_linestatus AS symbol, avg(l_extendedprice) AS level FROM lineitem GROUP BY 1, 2),
days AS (SELECT day, row_number() OVER (ORDER BY day)::INT AS session_no FROM (SELECT DISTINCT day FROM levels)),
names AS (SELECT unnest(['AF', 'AO', 'NF', 'NO', 'RF', 'RO']) AS symbol),
panel AS (SELECT d.session_no, d.day, n.symbol, l.level, CASE WHEN l.level > 0 THEN ln(l.level) END AS y FROM days d CROSS JOIN names n LEFT JOIN levels l ON l.day = d.day AND l.symbol = n.symbol)"""

HAR = DAYS + """,
design AS (SELECT * FROM (SELECT symbol, session_no, day, y, y AS d,
  CASE WHEN count(y) OVER w5 = 5 THEN avg(y) OVER w5 END AS w, CASE WHEN count(y) OVER w22 = 22 THEN avg(y) OVER w22 END AS m,
  lead(y) OVER s AS response, lead(session_no) OVER s AS target_no, lead(day) OVER s AS target_day FROM panel
  WINDOW s AS (PARTITION BY symbol ORDER BY session_no), w5 AS (PARTITION BY symbol ORDER BY session_no ROWS 4 PRECEDING), w22 AS (PARTITION BY symbol ORDER BY session_no ROWS 21 PRECEDING)) WHERE session_no >= 22),
counts AS (SELECT symbol, session_no, day, coalesce(sum(ok) OVER (PARTITION BY symbol ORDER BY session_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_expanding,
  coalesce(sum(ok) OVER (PARTITION BY symbol ORDER BY session_no ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_rolling, has_features
  FROM (SELECT *, (d IS NOT NULL AND w IS NOT NULL AND m IS NOT NULL AND response IS NOT NULL)::INT AS ok, d IS NOT NULL AND w IS NOT NULL AND m IS NOT NULL AS has_features FROM design)),
status AS (SELECT *, CASE WHEN NOT has_features THEN 'not_issued_missing_origin_features' WHEN n_expanding < 30 THEN 'not_issued_insufficient_training_history' ELSE 'issued' END AS status FROM counts)"""

LEDGER = HAR + """,
fits AS (SELECT *, count(*) FILTER (d IS NOT NULL AND response IS NOT NULL) OVER b AS n_train, regr_slope(response, d) OVER b AS slope, regr_intercept(response, d) OVER b AS icept
  FROM design WINDOW b AS (PARTITION BY symbol ORDER BY session_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
issued AS (SELECT * FROM fits WHERE n_train >= 30 AND d IS NOT NULL AND m IS NOT NULL AND slope IS NOT NULL AND target_no IS NOT NULL),
ledger AS (SELECT symbol, session_no AS origin_no, target_no, target_day, exp(d) AS origin_level, 'persistence' AS model, exp(d) AS forecast FROM issued
  UNION ALL SELECT symbol, session_no, target_no, target_day, exp(d), 'month_mean', exp(m) FROM issued
  UNION ALL SELECT symbol, session_no, target_no, target_day, exp(d), 'own_har', exp(icept + slope * d) FROM issued),
quality AS (SELECT session_no AS target_no, count(y) >= 4 AS eligible FROM panel GROUP BY 1),
joined AS (SELECT l.*, p.level AS outcome, CASE WHEN p.level IS NULL THEN 'outcome_unavailable' WHEN NOT q.eligible THEN 'insufficient_symbols' WHEN p.level <= 0 THEN 'nonpositive_target' ELSE 'scored' END AS status
  FROM ledger l LEFT JOIN panel p ON p.session_no = l.target_no AND p.symbol = l.symbol LEFT JOIN quality q ON q.target_no = l.target_no),
scored AS (SELECT *, CASE WHEN status = 'scored' THEN outcome / forecast - ln(outcome / forecast) - 1 END AS qlike,
  (ln(outcome) - ln(forecast)) ** 2 AS log_mse, abs(ln(outcome) - ln(forecast)) AS log_mae, count(*) FILTER (status = 'scored') OVER (PARTITION BY symbol, target_no) = count(*) OVER (PARTITION BY symbol, target_no) AS comparison_eligible FROM joined)"""

PAIRS = LEDGER + """,
pairs AS (SELECT a.symbol, a.target_no, a.target_day, a.qlike - b.qlike AS d_qlike, a.log_mse - b.log_mse AS d_log_mse, a.log_mae - b.log_mae AS d_log_mae, b.qlike AS bench_qlike, a.qlike AS model_qlike
  FROM scored a JOIN scored b ON a.symbol = b.symbol AND a.target_no = b.target_no AND a.model = 'own_har' AND b.model = 'persistence' WHERE a.comparison_eligible),
dates AS (SELECT target_no, avg(d_qlike) AS x FROM pairs GROUP BY 1)"""

EDGES = DAYS + """,
edges AS (SELECT origin, source, target, horizon, round(c, 6) AS coefficient, abs(round(c, 6)) >= 0.15 AS selected FROM (
  SELECT year(t.day) * 4 + quarter(t.day) AS origin, s.symbol AS source, t.symbol AS target, h.horizon, count(*) AS n, corr(t.y, s.y) AS c
  FROM panel t CROSS JOIN (VALUES ('D', 1), ('W', 5), ('M', 22)) h(horizon, lag) JOIN panel s ON s.session_no = t.session_no - h.lag AND s.symbol <> t.symbol
  WHERE t.y IS NOT NULL AND s.y IS NOT NULL GROUP BY ALL) WHERE n >= 10),
by_origin AS (SELECT origin, source, target, max(selected::INT) AS selected_any, round(sum(abs(coefficient)), 6) AS absolute_strength, round(sum(coefficient), 6) AS signed_strength FROM edges GROUP BY 1, 2, 3)"""

STABLE = EDGES + """,
base AS (SELECT source, target, count(*) FILTER (selected) AS n_selected, count(*) FILTER (selected AND coefficient > 0) AS pos, count(*) FILTER (selected AND coefficient < 0) AS neg,
  quantile_cont(coefficient, [0.25, 0.5, 0.75]) FILTER (selected) AS q, min(origin) FILTER (selected) AS first_selection, max(origin) FILTER (selected) AS last_selection FROM edges GROUP BY 1, 2),
per AS (SELECT source, target, count(*) AS n_origins, avg(selected_any) AS p, median(absolute_strength) AS ms FROM by_origin GROUP BY 1, 2),
supp AS (SELECT source, target, origin, coalesce(list(DISTINCT horizon) FILTER (selected), []) AS s FROM edges GROUP BY 1, 2, 3),
jac AS (SELECT source, target, avg(CASE WHEN len(list_distinct(list_concat(s, l))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(s, l))::DOUBLE / len(list_distinct(list_concat(s, l))) END) AS j
  FROM (SELECT *, lag(s) OVER (PARTITION BY source, target ORDER BY origin) AS l FROM supp) WHERE l IS NOT NULL GROUP BY 1, 2),
stable AS (SELECT b.source, b.target, n_origins, round(p, 6) AS selection_probability, CASE WHEN n_selected > 0 THEN round(greatest(pos, neg)::DOUBLE / n_selected, 6) END AS sign_consistency,
  round(coalesce(q[2], 0), 8) AS median_coefficient, round(coalesce(q[1], 0), 8) AS coefficient_q1, round(coalesce(q[3], 0), 8) AS coefficient_q3, round(ms, 8) AS median_absolute_strength, round(j, 6) AS support_jaccard,
  first_selection, last_selection, p >= 0.70 AS stable_edge FROM base b JOIN per USING (source, target) LEFT JOIN jac USING (source, target)),
grp AS (SELECT * FROM (VALUES ('A', 'AF'), ('A', 'AO'), ('N', 'NF'), ('N', 'NO'), ('R', 'RF'), ('R', 'RO'), ('O', 'AO'), ('O', 'NO'), ('O', 'RO')) g(grp, symbol))"""

WIDE = DAYS + """,
wide AS (SELECT session_no, day, max(y) FILTER (symbol = 'AF') AS AF, max(y) FILTER (symbol = 'AO') AS AO, max(y) FILTER (symbol = 'NF') AS NF, max(y) FILTER (symbol = 'NO') AS NO, max(y) FILTER (symbol = 'RF') AS RF, max(y) FILTER (symbol = 'RO') AS RO FROM panel GROUP BY 1, 2),
complete AS (SELECT * FROM wide WHERE AF IS NOT NULL AND AO IS NOT NULL AND NF IS NOT NULL AND NO IS NOT NULL AND RF IS NOT NULL AND RO IS NOT NULL),
tidy AS (SELECT session_no, symbol, y, AF AS x1, AO AS x2 FROM (SELECT session_no, AF, AO, unnest(['NF', 'NO', 'RF', 'RO']) AS symbol, unnest([NF, NO, RF, RO]) AS y FROM complete)),
fit0 AS (SELECT symbol, count(*) AS n, var_samp(x1) AS v11, var_samp(x2) AS v22, covar_samp(x1, x2) AS v12, covar_samp(x1, y) AS c1, covar_samp(x2, y) AS c2, var_samp(y) AS vy, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM tidy GROUP BY 1),
fit1 AS (SELECT *, (c1 * v22 - c2 * v12) / (v11 * v22 - v12 * v12) AS beta1, (c2 * v11 - c1 * v12) / (v11 * v22 - v12 * v12) AS beta2 FROM fit0 WHERE v11 * v22 - v12 * v12 > 0),
fit AS (SELECT *, my - beta1 * m1 - beta2 * m2 AS alpha, (beta1 * c1 + beta2 * c2) / vy AS r2 FROM fit1),
resid AS (SELECT t.*, t.y - f.alpha - f.beta1 * t.x1 - f.beta2 * t.x2 AS e FROM tidy t JOIN fit f USING (symbol))"""

ROLL = DAYS + """,
top AS (SELECT max(session_no) AS n FROM days),
starts AS (SELECT DISTINCT s AS start_no FROM (SELECT unnest(list_append(range(1, n - 59 + 1, 20), n - 59)) AS s FROM top WHERE n >= 60)),
win AS (SELECT (row_number() OVER (ORDER BY start_no) - 1)::BIGINT AS window_no, start_no::BIGINT AS start_no, (start_no + 59)::BIGINT AS end_no FROM starts)"""
