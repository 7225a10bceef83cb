"""The queries in SQL, written apart from the DataFrame operators, as their oracle."""

BIND = """
bind_raw AS (
  SELECT o_custkey AS simple_id, CAST(year(o_orderdate) AS INT) AS ja, o_orderkey AS ord,
    CAST(1930 + o_custkey % 45 AS INT) AS gbja, CAST(1 + o_custkey % 2 AS INT) AS ge,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_totalprice END AS entgelt,
    CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice * 0.4 END AS rtzb,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 30 ELSE 10 END END AS code,
    CASE WHEN o_custkey % 29 = 0 THEN 2000 END AS death_year
  FROM orders),
bind_dedup AS (
  SELECT * EXCLUDE rn FROM (
    SELECT *, row_number() OVER (PARTITION BY simple_id, ja ORDER BY (entgelt IS NULL)::INT + (rtzb IS NULL)::INT + (code IS NULL)::INT + (death_year IS NULL)::INT, ord) AS rn
    FROM bind_raw) WHERE rn = 1),
bind_panel AS (
  SELECT *, (code IS NOT NULL)::INT AS rehab, coalesce((code = 20)::INT, 0) AS msk,
    min(CASE WHEN simple_id % 6 = 0 AND ja >= 1998 + CAST(floor(simple_id / 6) AS BIGINT) % 3 THEN ja END) OVER (PARTITION BY simple_id) AS first_exposure_year,
    CAST(sum((code IS NOT NULL)::INT) OVER h AS BIGINT) AS cum_rehab,
    CAST(sum(coalesce((code = 20)::INT, 0)) OVER h AS BIGINT) AS cum_msk,
    ja - max(CASE WHEN code IS NOT NULL THEN ja END) OVER h AS years_since_rehab
  FROM bind_dedup WINDOW h AS (PARTITION BY simple_id ORDER BY ja ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cand AS (
  SELECT b.*, b.ja AS t0, coalesce((b.first_exposure_year = b.ja)::INT, 0) AS treated, l.ge AS lag1_ge, l.ja AS lag1_source_year,
    l.ja - l.gbja AS lag1_age, l.entgelt AS lag1_entgelt, l.rtzb AS lag1_rtzb, l.cum_rehab AS lag1_cum_rehab, l.cum_msk AS lag1_cum_msk, (l.cum_rehab > 0)::INT AS lag1_ever_rehab
  FROM bind_panel b LEFT JOIN bind_panel l ON l.simple_id = b.simple_id AND l.ja = b.ja - 1 WHERE b.ja BETWEEN 1998 AND 1999),
passing AS (
  SELECT * FROM cand WHERE (first_exposure_year IS NULL OR first_exposure_year >= t0) AND (death_year IS NULL OR death_year > t0)
    AND msk = 0 AND lag1_source_year IS NOT NULL AND lag1_age BETWEEN 0 AND 125 AND lag1_cum_msk = 0),
risk AS (SELECT * FROM passing WHERE t0 IN (SELECT t0 FROM passing WHERE treated = 1)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t0, lag1_ge, lag1_ever_rehab, treated ORDER BY simple_id) AS k FROM risk),
pairs AS (
  SELECT t.simple_id * 10000 + t.t0 AS match_group, t.t0, t.simple_id AS t_id, c.simple_id AS c_id
  FROM ranked t JOIN ranked c USING (t0, lag1_ge, lag1_ever_rehab, k) WHERE t.treated = 1 AND c.treated = 0),
members AS (
  SELECT match_group, t0, t_id AS simple_id, 1 AS treated FROM pairs UNION ALL SELECT match_group, t0, c_id, 0 FROM pairs),
deaths AS (SELECT simple_id, max(death_year) AS dy FROM bind_panel GROUP BY 1),
grid0 AS (
  SELECT m.*, y.follow_year, m.t0 + y.follow_year AS ja FROM members m, (SELECT unnest([1, 2, 3]) AS follow_year) y),
grid1 AS (
  SELECT g.match_group, g.treated, g.t0, g.simple_id, g.follow_year, g.ja, (p.ja IS NOT NULL)::INT AS observed,
    CASE WHEN p.rehab = 1 THEN 1 WHEN d.dy <= g.ja THEN 2 ELSE 0 END AS event_type
  FROM grid0 g LEFT JOIN bind_panel p ON p.simple_id = g.simple_id AND p.ja = g.ja LEFT JOIN deaths d ON d.simple_id = g.simple_id),
follow AS (
  SELECT a.* FROM grid1 a WHERE NOT EXISTS (SELECT 1 FROM grid1 e WHERE e.match_group = a.match_group AND e.treated = a.treated AND e.follow_year < a.follow_year AND e.event_type > 0)),
mort AS (
  SELECT match_group, treated, t0, m.simple_id, y.ja, y.ja - t0 AS follow_year, coalesce((d.dy = y.ja)::INT, 0) AS death_event
  FROM members m LEFT JOIN deaths d USING (simple_id) JOIN (SELECT unnest(range(1999, 2002)) AS ja) y
    ON y.ja > t0 AND y.ja <= t0 + 5 AND (d.dy IS NULL OR y.ja <= d.dy)),
pair_years AS (
  SELECT m.match_group, m.t0, p.ja - m.t0 AS event_time, max(CASE WHEN treated = 1 THEN rehab END) AS treated_rehab, max(CASE WHEN treated = 0 THEN rehab END) AS control_rehab
  FROM members m JOIN bind_panel p USING (simple_id) WHERE p.ja - m.t0 BETWEEN -2 AND 2 GROUP BY ALL HAVING count(DISTINCT treated) = 2),
events2 AS (SELECT *, treated_rehab - control_rehab AS pair_diff FROM pair_years),
scored AS (
  SELECT *, CAST(round(greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(-4 + 0.03 * lag1_age + 0.5 * lag1_ever_rehab + 0.2 * lag1_ge))))) * 1e6) AS BIGINT) AS score_ppm FROM risk),
samples AS (
  SELECT 'pre' AS sample, simple_id, t0, treated, lag1_age, lag1_entgelt, lag1_rtzb, lag1_cum_rehab FROM risk
  UNION ALL SELECT 'post', simple_id, t0, treated, lag1_age, lag1_entgelt, lag1_rtzb, lag1_cum_rehab FROM members JOIN risk USING (simple_id, t0, treated)),
long AS (
  SELECT sample, treated, 'lag1_age' AS variable, CAST(lag1_age AS DOUBLE) AS value FROM samples UNION ALL SELECT sample, treated, 'lag1_entgelt', lag1_entgelt FROM samples
  UNION ALL SELECT sample, treated, 'lag1_rtzb', lag1_rtzb FROM samples UNION ALL SELECT sample, treated, 'lag1_cum_rehab', CAST(lag1_cum_rehab AS DOUBLE) FROM samples),
stats AS (SELECT sample, treated, variable, avg(value) AS mean, var_pop(value) AS var, avg((value IS NULL)::INT) AS missing FROM long GROUP BY ALL),
med0 AS (
  SELECT r.simple_id, r.t0, r.treated, y.follow_year, p.rehab, coalesce(p.msk, 0) AS m, p.ja IS NULL AS gap
  FROM risk r CROSS JOIN (SELECT unnest([1, 2, 3]) AS follow_year) y LEFT JOIN bind_panel p ON p.simple_id = r.simple_id AND p.ja = r.t0 + y.follow_year),
med AS (
  SELECT simple_id, t0, treated, follow_year, min(CASE WHEN gap THEN follow_year END) OVER (PARTITION BY simple_id, t0) AS gap_year,
    coalesce(max(m) OVER b, 0) AS mediator_before, CASE WHEN coalesce(max(m) OVER b, 0) = 0 AND m = 1 THEN 1 ELSE 0 END AS mediator_new,
    greatest(coalesce(max(m) OVER b, 0), m) AS mediator_now, coalesce(lag(rehab) OVER (PARTITION BY simple_id, t0 ORDER BY follow_year), 0) AS prior_rehab
  FROM med0 WINDOW b AS (PARTITION BY simple_id, t0 ORDER BY follow_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""

BAND = "CASE WHEN {0} < 20 THEN '<20' WHEN {0} >= 90 THEN '90+' ELSE CAST(floor({0} / 5) * 5 AS INT) || '-' || CAST(floor({0} / 5) * 5 + 4 AS INT) END"
SMD = "CASE WHEN sqrt(({vt} + {vc}) / 2) > 0 THEN ({mt} - {mc}) / sqrt(({vt} + {vc}) / 2) WHEN {mt} = {mc} THEN 0.0 END"
P = "{0} * (1 - {0})"
LEVELS = f"""lev AS (
  SELECT sample, {BAND.format("lag1_age")} AS level, CAST(count(*) FILTER (treated = 1) AS DOUBLE) AS t, CAST(count(*) FILTER (treated = 0) AS DOUBLE) AS c FROM samples GROUP BY ALL),
lev2 AS (SELECT sample, level, t / sum(t) OVER (PARTITION BY sample) AS pt, c / sum(c) OVER (PARTITION BY sample) AS pc FROM lev),
lev3 AS (SELECT *, {SMD.format(mt="pt", mc="pc", vt=P.format("pt"), vc=P.format("pc"))} AS smd FROM lev2)"""
CIF = """c AS (SELECT treated, follow_year, count(*) AS n, count(*) FILTER (event_type = 1) AS d1, count(*) FILTER (event_type = 2) AS d2 FROM follow GROUP BY ALL),
s AS (SELECT a.*, coalesce((SELECT product(1.0 - (b.d1 + b.d2) / b.n) FROM c b WHERE b.treated = a.treated AND b.follow_year < a.follow_year), 1.0) AS before FROM c a)"""
EVENT = """mean AS (SELECT event_time, count(*) AS n, avg(pair_diff) AS mean FROM events2 GROUP BY 1),
e AS (SELECT match_group, event_time, pair_diff - mean AS e FROM events2 JOIN mean USING (event_time)),
g AS (SELECT count(DISTINCT match_group) AS g, count(*) AS nrow, count(DISTINCT event_time) AS k FROM events2),
infl AS (
  SELECT k.event_time, c.match_group, coalesce((SELECT sum(e) FROM e WHERE e.match_group = c.match_group AND e.event_time = k.event_time), 0) / k.n
    - coalesce((SELECT sum(e) FROM e WHERE e.match_group = c.match_group AND e.event_time = -1), 0) / (SELECT n FROM mean WHERE event_time = -1) AS f
  FROM mean k, (SELECT DISTINCT match_group FROM events2) c WHERE k.event_time <> -1)"""

SPELLS = """sp AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS ja,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) END AS s1, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INT) END AS s2,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) END AS e1, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 350 AS INT) END AS e2,
    CAST(o_orderkey % 4 * 10 AS INT) AS c1, CAST(o_orderkey % 3 * 10 AS INT) AS c2 FROM orders)"""
STARTS = "coalesce(year({0}) = ja, false)"

SELECTS = {
    "spell_slots": f""", {SPELLS}, f AS (SELECT *, {STARTS.format("s1")} AS b1, {STARTS.format("s2")} AS b2 FROM sp)
SELECT o_orderkey, b1::INT + b2::INT AS n_spells, (b1 AND c1 IN (20, 30))::INT + (b2 AND c2 IN (20, 30))::INT AS n_subset,
  coalesce(CASE WHEN b1 AND e1 >= s1 THEN e1 - s1 + 1 END, 0) + coalesce(CASE WHEN b2 AND e2 >= s2 THEN e2 - s2 + 1 END, 0) AS spell_days,
  ({STARTS.format("e1")} OR {STARTS.format("e2")})::INT AS ended, CASE WHEN day <= e2 AND (e1 IS NULL OR e1 >= e2) THEN greatest(year(e2) - year(day), 0) END AS years FROM f""",
    "value_missing_pairs": """SELECT simple_id, ja, coalesce(entgelt, 0) AS entgelt, coalesce(rtzb, 0) AS rtzb, (entgelt IS NULL)::INT AS entgelt_missing, (rtzb IS NULL)::INT AS rtzb_missing,
  coalesce(CAST(code AS VARCHAR), '__MISSING__') AS code, CASE WHEN (death_year IS NULL OR ja <= death_year) AND ja - gbja BETWEEN 0 AND 125 THEN ja - gbja END AS age FROM bind_panel""",
    "status_labels": """, c AS (SELECT CASE WHEN simple_id % 9 <> 0 THEN simple_id % 5 END AS c FROM bind_panel)
SELECT CASE WHEN c IS NULL THEN 'missing' WHEN c = 1 THEN 'married' WHEN c = 2 THEN 'divorced' WHEN c = 3 THEN 'widowed' ELSE 'code_' || c END AS label, count(*) AS n FROM c GROUP BY 1""",
    "event_time_flags": "SELECT ja - first_exposure_year AS et, coalesce(ja < first_exposure_year, false) AS pre, coalesce(ja >= first_exposure_year, false) AS post, count(*) AS n, count(DISTINCT simple_id) AS persons, CAST(sum(rehab) AS BIGINT) AS rehabs FROM bind_panel GROUP BY ALL",
    "sample_overview": """, o AS (SELECT count(*) AS person_years, count(DISTINCT simple_id) AS persons, CAST(sum(rehab) AS BIGINT) AS rehabs, CAST(sum(msk) AS BIGINT) AS msk, count(DISTINCT simple_id) FILTER (first_exposure_year IS NOT NULL) AS exposed FROM bind_panel)
SELECT 'person_years' AS metric, person_years AS value FROM o UNION ALL SELECT 'persons', persons FROM o UNION ALL SELECT 'rehabs', rehabs FROM o UNION ALL SELECT 'msk', msk FROM o UNION ALL SELECT 'exposed', exposed FROM o""",
    "annual_panel": "SELECT ja, count(*) AS rows, count(DISTINCT simple_id) AS persons, count(DISTINCT simple_id) FILTER (msk = 1) AS msk_persons, min(simple_id) FILTER (rehab = 1) AS first_rehab_person, round(avg(entgelt), 3) AS mean_earnings FROM bind_panel GROUP BY 1",
    "matched_vs_unmatched": """, f AS (SELECT *, ((simple_id, t0) IN (SELECT c_id, t0 FROM pairs))::INT AS matched FROM risk WHERE treated = 0)
SELECT matched, count(*) AS n, round(avg(lag1_age), 5) AS age, round(avg(lag1_ever_rehab), 6) AS ever_rehab, round(quantile_cont(lag1_entgelt, 0.5), 3) AS median_earnings, round(avg((lag1_rtzb IS NULL)::INT), 6) AS no_pension FROM f GROUP BY 1""",
    "code_shares": f""", {SPELLS}, n AS (SELECT ja, slot, code, count(*) AS n FROM (SELECT ja, 1 AS slot, c1 AS code FROM sp UNION ALL SELECT ja, 2, c2 FROM sp) GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY ja, slot), 6) AS share FROM n""",
    "sex_incidence": """, c AS (SELECT treated, 1 + simple_id % 2 AS sex, follow_year, count(*) AS n, count(*) FILTER (event_type = 1) AS d1, count(*) FILTER (event_type = 2) AS d2 FROM follow GROUP BY ALL),
s AS (SELECT a.*, coalesce((SELECT product(1.0 - (b.d1 + b.d2) / b.n) FROM c b WHERE b.treated = a.treated AND b.sex = a.sex AND b.follow_year < a.follow_year), 1.0) AS before FROM c a),
r AS (SELECT treated, sex, sum(before * d1 / n) AS risk FROM s GROUP BY ALL), t AS (SELECT sex, risk AS t FROM r WHERE treated = 1), u AS (SELECT sex, risk AS c FROM r WHERE treated = 0)
SELECT sex, round(t, 6) AS treated_risk, round(c, 6) AS control_risk, round(t - c, 6) AS risk_difference FROM t FULL JOIN u USING (sex)""",
    "dedup_least_missing": "SELECT simple_id, ja, ord, entgelt, rtzb, code, death_year FROM bind_dedup",
    "duplicate_key_audit": "SELECT simple_id, ja, count(*) AS n_rows FROM bind_raw GROUP BY ALL HAVING count(*) > 1 ORDER BY n_rows DESC, simple_id, ja LIMIT 100000",
    "death_conflict_audit": """, dc AS (SELECT simple_id, CASE WHEN ord % 5 = 0 THEN ja ELSE death_year END AS y FROM bind_raw)
SELECT simple_id, count(DISTINCT y) AS n_years, string_agg(DISTINCT CAST(y AS VARCHAR), '|' ORDER BY CAST(y AS VARCHAR)) AS death_years FROM dc WHERE y IS NOT NULL GROUP BY 1 HAVING count(DISTINCT y) > 1""",
    "exclusion_balance": """, dc AS (SELECT simple_id, code, CASE WHEN ord % 50 = 0 THEN ja ELSE death_year END AS y FROM bind_raw),
per AS (SELECT simple_id, (count(DISTINCT y) > 1)::INT AS excluded, max((code IS NOT NULL)::INT) AS flag FROM dc GROUP BY 1)
SELECT excluded, count(*) AS n, round(avg(flag), 6) AS share FROM per GROUP BY 1""",
    "age_band": f"SELECT {BAND.format('(ja - gbja)')} AS band, ge, count(*) AS n, count(DISTINCT simple_id) AS persons FROM bind_panel GROUP BY ALL",
    "income_source_status": "SELECT CASE WHEN entgelt IS NOT NULL AND rtzb IS NOT NULL THEN 'both' WHEN entgelt IS NOT NULL THEN 'earnings_only' WHEN rtzb IS NOT NULL THEN 'pension_only' ELSE 'neither' END AS status, count(*) AS n, round(coalesce(sum(entgelt), 0), 2) AS earnings FROM bind_panel GROUP BY 1",
    "history_windows": "SELECT simple_id, ja, first_exposure_year, cum_rehab, cum_msk, years_since_rehab FROM bind_panel",
    "relabel_codes": "SELECT simple_id, ja, coalesce((code IN (20, 30))::INT, 0) AS msk, CAST(sum(coalesce((code IN (20, 30))::INT, 0)) OVER (PARTITION BY simple_id ORDER BY ja) AS BIGINT) AS cum_msk FROM bind_dedup",
    "relabel_audit": "SELECT ja, CAST(sum(msk) AS BIGINT) AS before, count(*) AS n_rows, count(*) FILTER (code IN (20, 30)) AS after, round((count(*) FILTER (code IN (20, 30)) - sum(msk)) / count(*), 6) AS share FROM bind_panel GROUP BY 1",
    "panel_coverage": """, per AS (SELECT simple_id, max(ja) - min(ja) + 1 AS span, max(ja) - min(ja) + 1 - count(*) AS gaps, max(death_year) < max(ja) AS after FROM bind_panel GROUP BY 1)
SELECT span, gaps, count(*) AS persons, count(*) FILTER (after) AS rows_after_death FROM per GROUP BY ALL""",
    "annual_counts_full_join": """, a AS (SELECT ja, count(*) AS n, sum(rehab) AS rehabs FROM bind_panel GROUP BY 1), b AS (SELECT death_year AS ja, count(DISTINCT simple_id) AS deaths FROM bind_panel WHERE death_year IS NOT NULL GROUP BY 1)
SELECT ja, coalesce(n, 0) AS n, CAST(coalesce(rehabs, 0) AS BIGINT) AS rehabs, coalesce(deaths, 0) AS deaths FROM a FULL JOIN b USING (ja)""",
    "lag_self_join": """SELECT p.simple_id, p.ja AS t0, a.ja AS lag1_source_year, a.cum_rehab AS lag1_cum_rehab, b.ja AS lag3_source_year, b.rehab AS lag3_rehab
FROM bind_panel p LEFT JOIN bind_panel a ON a.simple_id = p.simple_id AND a.ja = p.ja - 1 LEFT JOIN bind_panel b ON b.simple_id = p.simple_id AND b.ja = p.ja - 3""",
    "riskset_attrition": """, f AS (
  SELECT treated, simple_id, 1 AS s0, coalesce(first_exposure_year >= t0, true) AS s1, coalesce(death_year > t0, true) AS s2, msk = 0 AS s3, lag1_source_year IS NOT NULL AS s4,
    coalesce(lag1_age BETWEEN 0 AND 125, false) AS s5, coalesce(lag1_cum_msk = 0, false) AS s6 FROM cand),
st AS (SELECT treated, simple_id, CASE WHEN NOT s1 THEN 1 WHEN NOT s2 THEN 2 WHEN NOT s3 THEN 3 WHEN NOT s4 THEN 4 WHEN NOT s5 THEN 5 WHEN NOT s6 THEN 6 ELSE 7 END AS passed FROM f),
names AS (SELECT * FROM (VALUES (0, 'in_window'), (1, 'exposure_rule'), (2, 'alive'), (3, 'no_msk_now'), (4, 'has_lag'), (5, 'valid_age'), (6, 'no_prior_msk')) v(ord, stage)),
n AS (SELECT a.treated, ord, stage, count(*) FILTER (passed > ord) AS n_rows, count(DISTINCT simple_id) FILTER (passed > ord) AS n_persons FROM st a, names GROUP BY ALL)
SELECT treated, stage, n_rows, n_persons, coalesce(lag(n_rows) OVER (PARTITION BY treated ORDER BY ord) - n_rows, 0) AS removed FROM n""",
    "riskset_treated": "SELECT simple_id, t0, lag1_ge, lag1_age, lag1_ever_rehab, lag1_source_year FROM risk WHERE treated = 1",
    "riskset_controls": "SELECT simple_id, t0, lag1_ge, lag1_age, lag1_ever_rehab, lag1_source_year FROM risk WHERE treated = 0",
    "cohort_spine": """, y AS (SELECT CAST(unnest(range(1996, 2002)) AS INT) AS t0), r AS (SELECT t0, sum(treated) AS treated, sum(1 - treated) AS controls FROM risk GROUP BY 1), g AS (SELECT t0, count(*) AS pairs FROM pairs GROUP BY 1)
SELECT t0, CAST(coalesce(treated, 0) AS BIGINT) AS treated, CAST(coalesce(controls, 0) AS BIGINT) AS controls, coalesce(pairs, 0) AS pairs, round(CASE WHEN treated > 0 THEN coalesce(pairs, 0) / treated END, 6) AS match_rate FROM y LEFT JOIN r USING (t0) LEFT JOIN g USING (t0)""",
    "matched_semi": "SELECT simple_id, t0 FROM risk WHERE treated = 1 AND (simple_id, t0) IN (SELECT t_id, t0 FROM pairs)",
    "unmatched_anti": "SELECT simple_id, t0 FROM risk WHERE treated = 0 AND (simple_id, t0) NOT IN (SELECT c_id, t0 FROM pairs)",
    "weighted_smd_continuous": f"SELECT t.sample, t.variable, round(t.mean, 4) AS treated_value, round(c.mean, 4) AS control_value, round({SMD.format(mt='t.mean', mc='c.mean', vt='t.var', vc='c.var')}, 5) AS smd FROM stats t JOIN stats c USING (sample, variable) WHERE t.treated = 1 AND c.treated = 0",
    "weighted_smd_missingness": f"SELECT t.sample, t.variable, round(t.missing, 6) AS treated_missing, round(c.missing, 6) AS control_missing, round({SMD.format(mt='t.missing', mc='c.missing', vt=P.format('t.missing'), vc=P.format('c.missing'))}, 5) AS smd FROM stats t JOIN stats c USING (sample, variable) WHERE t.treated = 1 AND c.treated = 0",
    "weighted_smd_levels": f", {LEVELS} SELECT sample, level, round(pt, 6) AS treated_value, round(pc, 6) AS control_value, round(smd, 5) AS smd FROM lev3",
    "balance_summary": f", {LEVELS} SELECT sample, count(*) AS n_levels, round(max(abs(smd)), 5) AS max_smd, round(avg(abs(smd)), 5) AS mean_smd, count(*) FILTER (abs(smd) > 0.1) AS n_over FROM lev3 GROUP BY 1",
    "descriptives": "SELECT sample, treated, variable, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(stddev_samp(value), 4) AS sd, round(min(value), 4) AS lo, round(max(value), 4) AS hi FROM long GROUP BY ALL",
    "score_fixed_formula": "SELECT simple_id, t0, treated, score_ppm FROM scored",
    "score_distribution": """, o AS (SELECT t0, treated, score_ppm, row_number() OVER (PARTITION BY t0, treated ORDER BY score_ppm) AS rn, count(*) OVER (PARTITION BY t0, treated) AS n FROM scored)
SELECT t0, treated, count(*) AS n, min(score_ppm) AS lo, max(score_ppm) AS hi, round(avg(score_ppm), 3) AS mean, round(quantile_cont(score_ppm, 0.5), 1) AS median, max(CASE WHEN rn = round(0.9 * (n - 1)) + 1 THEN score_ppm END) AS q90 FROM o GROUP BY ALL""",
    "score_overlap": """, b AS (SELECT t0, greatest(min(score_ppm) FILTER (treated = 1), min(score_ppm) FILTER (treated = 0)) AS low, least(max(score_ppm) FILTER (treated = 1), max(score_ppm) FILTER (treated = 0)) AS high FROM scored GROUP BY 1)
SELECT t0, low, high, count(*) FILTER (treated = 1 AND NOT score_ppm BETWEEN low AND high) AS treated_outside, count(*) FILTER (treated = 0 AND NOT score_ppm BETWEEN low AND high) AS controls_outside FROM scored JOIN b USING (t0) GROUP BY ALL""",
    "caliper_edges": """, t AS (SELECT * FROM scored WHERE treated = 1), c AS (SELECT * FROM scored WHERE treated = 0),
k AS (SELECT t.t0, t.lag1_ge, t.lag1_ever_rehab, t.simple_id, count(c.simple_id) AS edges FROM t LEFT JOIN c ON c.t0 = t.t0 AND c.lag1_ge = t.lag1_ge AND c.lag1_ever_rehab = t.lag1_ever_rehab AND abs(c.score_ppm - t.score_ppm) <= 10000 GROUP BY ALL)
SELECT t0, lag1_ge, lag1_ever_rehab, count(*) AS n_treated, (SELECT count(*) FROM c WHERE c.t0 = k.t0 AND c.lag1_ge = k.lag1_ge AND c.lag1_ever_rehab = k.lag1_ever_rehab) AS n_controls, CAST(sum(edges) AS BIGINT) AS n_edges, count(*) FILTER (edges > 0) AS n_matchable FROM k GROUP BY ALL""",
    "marital_composition": """, st AS (SELECT simple_id, ja, 1 + (simple_id + ja) % 3 AS state FROM bind_panel),
n AS (SELECT treated, step, coalesce(CAST(state AS VARCHAR), '__MISSING__') AS state, count(*) AS n FROM members CROSS JOIN (SELECT unnest([-1, 0, 1]) AS step) LEFT JOIN st ON st.simple_id = members.simple_id AND st.ja = t0 + step GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY treated, step), 6) AS share FROM n""",
    "state_sequences": """, st AS (SELECT simple_id, ja, CAST(1 + (simple_id + ja) % 3 AS VARCHAR) AS state FROM bind_panel),
n AS (SELECT treated, coalesce(a.state, 'x') || '>' || coalesce(b.state, 'x') || '>' || coalesce(c.state, 'x') AS path, count(*) AS n FROM members m
  LEFT JOIN st a ON a.simple_id = m.simple_id AND a.ja = t0 - 1 LEFT JOIN st b ON b.simple_id = m.simple_id AND b.ja = t0 LEFT JOIN st c ON c.simple_id = m.simple_id AND c.ja = t0 + 1 GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY treated), 6) AS share FROM n""",
    "role_overlap": """, per AS (SELECT simple_id, count(*) FILTER (treated = 1) AS as_treated, count(*) FILTER (treated = 0) AS as_control, min(t0) FILTER (treated = 0) < min(t0) FILTER (treated = 1) AS cf FROM members GROUP BY 1)
SELECT as_treated, as_control, count(*) AS persons, count(*) FILTER (cf) AS control_first FROM per GROUP BY ALL""",
    "followup_grid": "SELECT match_group, treated, t0, simple_id, follow_year, ja, observed, event_type FROM follow",
    "pair_censor": """, g AS (SELECT match_group, min(follow_year) AS gap FROM follow WHERE observed = 0 GROUP BY 1)
SELECT treated, follow_year, count(*) AS n, count(*) FILTER (event_type = 1) AS events FROM follow LEFT JOIN g USING (match_group) WHERE gap IS NULL OR follow_year < gap GROUP BY ALL""",
    "mortality_grid": "SELECT match_group, treated, t0, simple_id, CAST(ja AS INT) AS ja, CAST(follow_year AS INT) AS follow_year, death_event FROM mort",
    "cumulative_incidence": f", {CIF} SELECT treated, follow_year, n, d1, d2, round(sum(before * d1 / n) OVER (PARTITION BY treated ORDER BY follow_year), 6) AS cif FROM s",
    "kaplan_meier": """, c AS (SELECT treated, CAST(follow_year AS INT) AS follow_year, count(*) AS n, CAST(sum(death_event) AS BIGINT) AS d FROM mort GROUP BY ALL)
SELECT treated, follow_year, n, d, round(1 - (SELECT product(1.0 - b.d / b.n) FROM c b WHERE b.treated = a.treated AND b.follow_year <= a.follow_year), 6) AS risk FROM c a""",
    "event_study_panel": "SELECT match_group, t0, event_time, treated_rehab, control_rehab, pair_diff FROM events2",
    "event_study_estimates": f", {EVENT} SELECT event_time, n, round(mean - (SELECT mean FROM mean WHERE event_time = -1), 6) AS estimate FROM mean WHERE event_time <> -1",
    "event_study_cluster_se": f", {EVENT} SELECT event_time, round(sqrt(sum(f * f) * max(g) / greatest(max(g) - 1, 1) * (max(nrow) - 1) / greatest(max(nrow) - max(k), 1)), 6) AS se FROM infl, g GROUP BY 1",
    "ipcw_cumprod": """, w AS (SELECT match_group, treated, follow_year, 1 / greatest(0.02, 0.01 + ((simple_id + follow_year) % 10) / 10.0) AS f FROM follow)
SELECT match_group, treated, follow_year, round(least(20.0, product(f) OVER (PARTITION BY match_group, treated ORDER BY follow_year)), 5) AS weight FROM w""",
    "mediation_grid": "SELECT * FROM med",
    "event_cells": "SELECT treated, follow_year, mediator_now, count(*) AS n, count(*) FILTER (gap_year <= follow_year) AS gaps, CAST(sum(mediator_new) AS BIGINT) AS new_events FROM med GROUP BY ALL",
    "cluster_row_constancy": "SELECT n, count(*) AS persons FROM (SELECT simple_id, count(DISTINCT (ge, gbja)) AS n FROM bind_panel GROUP BY 1) GROUP BY 1",
}

PLAIN = {
    "dedup_lineitem": """
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (qty IS NULL)::INT + (tax IS NULL)::INT, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS qty, CASE WHEN l_linestatus = 'F' THEN l_tax END AS tax, l_extendedprice FROM lineitem)) WHERE rn = 1""",
    "occupation_major_group": """
SELECT substr(CASE WHEN length(c) < 3 THEN lpad(c, 3, '0') ELSE c END, 1, 1) AS grp, count(*) AS n FROM (SELECT CAST(CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 1200 END AS VARCHAR) AS c FROM part) GROUP BY 1""",
    "date_normalize": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 4 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "pool_small_cells": """
WITH p AS (SELECT c_custkey AS id, c_mktsegment AS seg, CAST(c_custkey % 37 * (c_custkey % 11) % 41 AS VARCHAR) AS code FROM customer),
c AS (SELECT seg, code, count(DISTINCT id) AS people, count(*) AS events FROM p GROUP BY ALL),
lone AS (SELECT seg, count(*) FILTER (people < 3) AS small FROM c GROUP BY 1),
extra AS (SELECT seg, code FROM (SELECT c.*, row_number() OVER (PARTITION BY seg ORDER BY people, events, code) AS r FROM c WHERE people >= 3) JOIN lone USING (seg) WHERE small = 1 AND r = 1),
t AS (SELECT c.seg, c.code, CASE WHEN people < 3 OR extra.code IS NOT NULL THEN 'pooled' ELSE c.code END AS grp FROM c LEFT JOIN extra ON extra.seg = c.seg AND extra.code = c.code),
o AS (SELECT seg, grp, count(DISTINCT id) AS people, count(*) AS events, count(DISTINCT code) AS codes FROM p JOIN t USING (seg, code) GROUP BY ALL)
SELECT seg, grp AS code, grp = 'pooled' AS pooled, CASE WHEN grp = 'pooled' AND people < 3 THEN NULL ELSE people END AS people, CASE WHEN grp = 'pooled' AND people < 3 THEN NULL ELSE events END AS events, codes FROM o""",
    "complementary_suppression": """
WITH c AS (SELECT c_nationkey AS grp, c_mktsegment AS cell, count(*) FILTER (c_acctbal > 7000) AS v FROM customer GROUP BY ALL),
h AS (SELECT *, v > 0 AND v < 3 AS hid, count(*) FILTER (v > 0 AND v < 3) OVER (PARTITION BY grp) AS n FROM c),
m AS (SELECT grp, arg_min(cell, (v, cell)) AS first FROM h WHERE v >= 3 GROUP BY 1),
s AS (SELECT h.*, CASE WHEN hid THEN 'withheld' WHEN n = 1 AND cell = first THEN 'complement' ELSE 'reported' END AS status FROM h LEFT JOIN m USING (grp))
SELECT grp, cell, CASE WHEN status = 'reported' THEN v END AS value, status FROM s""",
    "holm_adjust": """
WITH t AS (SELECT n_regionkey AS family, n_nationkey AS test, n_nationkey * 7919 % 101 / 1000.0 AS p FROM nation),
r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS k FROM t)
SELECT family, test, round(p, 6) AS p, round(max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY family ORDER BY k), 6) AS p_holm FROM r""",
}

#: One specification of lag_comparison: {n} its name, {y} its first year, {b} the rows needed in the second and third year before t0.
SPECIFICATION = """
{n}_all AS (SELECT * FROM passing WHERE t0 >= {y} AND (SELECT count(*) FROM bind_panel b WHERE b.simple_id = passing.simple_id AND b.ja IN (t0 - 2, t0 - 3)) >= {b}),
{n}_risk AS (SELECT *, row_number() OVER (PARTITION BY t0, lag1_ge, lag1_ever_rehab, treated ORDER BY simple_id) AS k FROM {n}_all WHERE t0 IN (SELECT t0 FROM {n}_all WHERE treated = 1)),
{n}_pairs AS (SELECT t.t0, t.simple_id AS t_id, c.simple_id AS c_id FROM {n}_risk t JOIN {n}_risk c USING (t0, lag1_ge, lag1_ever_rehab, k) WHERE t.treated = 1 AND c.treated = 0),
{n}_years AS (
  SELECT m.treated, m.simple_id, m.t0, p.ja FROM (SELECT t0, t_id AS simple_id, 1 AS treated FROM {n}_pairs UNION ALL SELECT t0, c_id, 0 FROM {n}_pairs) m
  JOIN bind_panel p ON p.simple_id = m.simple_id AND p.ja BETWEEN m.t0 + 1 AND m.t0 + 3 WHERE p.rehab = 1),
{n}_events AS (
  SELECT treated, simple_id, t0 FROM (SELECT treated, simple_id, t0, min(ja) AS ja FROM {n}_years GROUP BY ALL) e LEFT JOIN deaths d USING (simple_id) WHERE d.dy IS NULL OR d.dy >= e.ja)"""
SPECIFICATIONS = (("lag1", 1998, 0), ("lag1_common", 1999, 0), ("lag3", 1999, 2))
SELECTS["lag_comparison"] = "".join("," + SPECIFICATION.format(n=n, y=y, b=b) for n, y, b in SPECIFICATIONS) + " UNION ALL ".join(
    f" SELECT '{n}' AS specification, (SELECT count(*) FROM {n}_risk WHERE treated = 1) AS treated, (SELECT count(*) FROM {n}_risk WHERE treated = 0) AS controls, (SELECT count(*) FROM {n}_pairs) AS pairs,"
    f" (SELECT count(*) FROM {n}_events WHERE treated = 1) AS treated_events, (SELECT count(*) FROM {n}_events WHERE treated = 0) AS control_events"
    for n, _, _ in SPECIFICATIONS
)


def nudged(sql: str, by: float) -> str:
    """sql with `by` added to what each round(value, digits) rounds."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, i = 0, -1, start + len("round")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            if depth == 0:
                break
            i += 1
        body = start + len("round(")
        out += sql[at:body] if comma < 0 else f"{sql[at:body]}{by!r} + ({nudged(sql[body:comma], by)})"
        at = body if comma < 0 else comma
    return out + sql[at:]


def oracle_sql() -> dict[str, str]:
    """SELECTS stand on the common table expressions of BIND; a leading comma adds more of them."""
    from tessera.plans import sql_tables
    from tessera.plans.catalog import NUDGE

    return {k: f"WITH {BIND}{nudged(v, NUDGE)}" for k, v in (SELECTS | sql_tables.SELECTS).items()} | {k: nudged(v, NUDGE) for k, v in (PLAIN | sql_tables.PLAIN).items()}
