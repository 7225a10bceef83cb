"""SQL of the queries in tables.py, on the common table expressions of sql.BIND, written apart from the operators."""

from tessera.plans.sql import CIF, P, SMD, SPELLS

INCOME = "CASE WHEN lag1_entgelt IS NOT NULL AND lag1_rtzb IS NOT NULL THEN 'both' WHEN lag1_entgelt IS NOT NULL THEN 'earnings_only' WHEN lag1_rtzb IS NOT NULL THEN 'pension_only' ELSE 'neither' END"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
STAGE_NAMES = ("in_window", "exposure_rule", "alive", "no_msk_now", "has_lag", "valid_age", "no_prior_msk")

STAGES = """rules AS (
  SELECT treated, simple_id, coalesce(first_exposure_year >= t0, true) AS a, coalesce(death_year > t0, true) AS b, msk = 0 AS c, lag1_source_year IS NOT NULL AS d,
    coalesce(lag1_age BETWEEN 0 AND 125, false) AS e, coalesce(lag1_cum_msk = 0, false) AS f FROM cand),
depth AS (
  SELECT treated, simple_id, 1 + CASE WHEN NOT a THEN 0 WHEN NOT b THEN 1 WHEN NOT c THEN 2 WHEN NOT d THEN 3 WHEN NOT e THEN 4 WHEN NOT f THEN 5 ELSE 6 END AS depth FROM rules),
stage AS (
  SELECT treated, k AS ord, name AS stage, count(*) FILTER (depth >= k) AS n_rows, count(DISTINCT simple_id) FILTER (depth >= k) AS n_persons
  FROM depth, (VALUES {}) v(k, name) GROUP BY ALL)""".format(", ".join(f"({i}, '{n}')" for i, n in enumerate(STAGE_NAMES, 1)))

CONFLICTED = """crow AS (
  SELECT *  EXCLUDE death_year, CASE WHEN ord % 50 = 0 THEN ja ELSE death_year END AS death_year FROM bind_raw),
cper AS (SELECT simple_id, count(DISTINCT death_year) > 1 AS two, max((simple_id % 6 = 0 AND ja >= 1998 + CAST(floor(simple_id / 6) AS BIGINT) % 3)::INT) AS exposed FROM crow GROUP BY 1)"""

DISTANCES = """dist AS (
  SELECT p.*, abs(a.score_ppm - b.score_ppm) AS distance FROM pairs p JOIN scored a ON a.simple_id = p.t_id AND a.t0 = p.t0 JOIN scored b ON b.simple_id = p.c_id AND b.t0 = p.t0),
cellsize AS (SELECT t0, lag1_ge, lag1_ever_rehab, sum(treated) AS t, sum(1 - treated) AS c FROM scored GROUP BY ALL),
size AS (SELECT sum(t) AS eligible, coalesce(sum(t) FILTER (c = 0), 0) AS noexact FROM cellsize),
used AS (SELECT count(*) AS n, count(DISTINCT t_id) AS nt, count(DISTINCT c_id) AS nc, avg(distance) AS mean, quantile_cont(distance, 0.5) AS median, max(distance) AS top,
  list_sort(list(distance)) AS l FROM dist),
overall AS (
  SELECT 'eligible_treated' AS metric, CAST(eligible AS DOUBLE) AS value FROM size UNION ALL SELECT 'treated_without_exact_control', noexact FROM size
  UNION ALL SELECT 'matched_pairs', n FROM used UNION ALL SELECT 'unique_matched_treated', nt FROM used UNION ALL SELECT 'unique_matched_controls', nc FROM used
  UNION ALL SELECT 'mean_distance', mean FROM used UNION ALL SELECT 'median_distance', median FROM used UNION ALL SELECT 'max_distance', top FROM used
  UNION ALL SELECT 'p90_distance', l[CAST(floor(0.9 * (n - 1) + 0.5) AS BIGINT) + 1] FROM used UNION ALL SELECT 'p95_distance', l[CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT) + 1] FROM used
  UNION ALL SELECT 'unmatched_treated', eligible - nt FROM size, used UNION ALL SELECT 'match_rate', nt / eligible FROM size, used
  UNION ALL SELECT 'controls_reused', n - nc FROM used UNION ALL SELECT 'caliper', 10000 UNION ALL SELECT 'unmatched_after_exact', eligible - nt - noexact FROM size, used),
yearly AS (
  SELECT t0, CAST(sum(t) AS BIGINT) AS n_treated, CAST(sum(c) AS BIGINT) AS n_controls, CAST(coalesce(sum(t) FILTER (c = 0), 0) AS BIGINT) AS n_without_exact,
    (SELECT count(*) FROM pairs p WHERE p.t0 = cellsize.t0) AS n_matched FROM cellsize GROUP BY t0)"""

GROUPS = f"""base AS (SELECT simple_id, t0, treated, lag1_ge AS sex, {INCOME} AS income FROM risk),
own AS (
  SELECT m.*, sex, income, min(income) OVER p AS lo, max(income) OVER p AS hi, count(*) OVER p AS members_n, max(CASE WHEN m.treated = 1 THEN m.simple_id % 4 - 1 END) OVER p AS points
  FROM members m JOIN base b ON b.simple_id = m.simple_id AND b.t0 = m.t0 AND b.treated = m.treated WINDOW p AS (PARTITION BY match_group)),
ends AS (SELECT match_group, treated, max((event_type = 1)::INT) AS event, max((event_type = 2)::INT) AS dead FROM follow GROUP BY ALL),
joined AS (SELECT own.*, e.match_group IS NOT NULL AS entered, coalesce(event, 0) = 1 AS event, coalesce(dead, 0) = 1 AS dead FROM own LEFT JOIN ends e ON e.match_group = own.match_group AND e.treated = own.treated),
parts AS (
  SELECT 'all' AS scheme, sex, 'all' AS level, treated, entered, event, dead FROM joined UNION ALL SELECT 'own_income', sex, income, treated, entered, event, dead FROM joined
  UNION ALL SELECT 'same_income', sex, income, treated, entered, event, dead FROM joined WHERE lo = hi AND members_n = 2
  UNION ALL SELECT 'points', sex, CASE WHEN points IS NULL THEN 'unknown' WHEN points > 0 THEN 'gain' WHEN points < 0 THEN 'loss' ELSE 'zero' END, treated, entered, event, dead FROM joined),
grouped AS (
  SELECT scheme, CAST(sex AS VARCHAR) AS part, level, {", ".join(f"count(*) FILTER (treated = {a} AND {c}) AS {arm}_{n}" for a, arm in ((0, "control"), (1, "treated")) for n, c in (("assigned", "true"), ("entered", "entered"), ("events", "event"), ("deaths", "dead"), ("without", "entered AND NOT event AND NOT dead")))}
  FROM parts GROUP BY ALL)"""

_TOLD = [f"{a}_{n}" for a in ("control", "treated") for n in ("entered", "events", "deaths", "without")]


def _protected(least: int) -> str:
    """grouped with withheld rows, one count after the other."""
    unsafe = " OR ".join([f"({n} > 0 AND {n} < {least})" for n in _TOLD] + [f"{a}_entered < {least}" for a in ("control", "treated")])
    out = f"h0 AS (SELECT *, {unsafe} AS hide FROM grouped)"
    for i, n in enumerate(_TOLD):
        out += f""",
m{i} AS (SELECT scheme, part, count(*) FILTER (hide AND {n} > 0) AS k, arg_min(level, ({n}, level)) FILTER (NOT hide AND {n} > 0) AS least FROM h{i} WHERE scheme <> 'all' GROUP BY ALL),
h{i + 1} AS (SELECT h.* EXCLUDE hide, hide OR coalesce(m.k = 1 AND m.least = h.level, false) AS hide FROM h{i} h LEFT JOIN m{i} m ON m.scheme = h.scheme AND m.part = h.part)"""
    return out


STATS = "count(value) AS n, count(*) - count(value) AS missing, round(avg(value), 3) AS mean"

SELECTS = {
    "optional_columns": f", {SPELLS} SELECT o_orderkey, (o_orderkey % 4 * 10) || '.0' AS slot, CAST(NULL AS DOUBLE) AS byvlgs, CAST(NULL AS INT) AS whot_bland, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS DATE) AS court_decision FROM sp",
    "first_marriage_rules": f""", {SPELLS}, f AS (
  SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN s1 ELSE s2 END AS first, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 2 END AS flag, o_orderkey % 4 < 2 AS divorcing FROM sp)
SELECT o_orderkey, coalesce(divorcing AND s1 = first, false) AS date_fields, coalesce(divorcing AND flag = 1, false) AS is_first_marriage,
  CASE WHEN flag = 1 THEN s1 END AS first_marriage_start, CASE WHEN flag = 1 THEN coalesce(e2, e1) END AS first_marriage_end FROM f""",
    "csv_round_trip": "SELECT ja, count(*) AS n, max(entgelt) AS most, max(death_year) AS death_year FROM bind_panel GROUP BY 1",
    "edge_preflight": """, c AS (SELECT t0, lag1_ge, lag1_ever_rehab, sum(treated) AS t, sum(1 - treated) AS c FROM scored GROUP BY ALL)
SELECT t0, count(*) AS strata, CAST(sum(t) AS BIGINT) AS n_treated, CAST(sum(c) AS BIGINT) AS n_controls, CAST(sum(t * c) AS BIGINT) AS dense, CAST(max(t * c) AS BIGINT) AS largest FROM c WHERE t0 BETWEEN 1998 AND 1999 GROUP BY 1""",
    "prefixed_columns": "SELECT p.simple_id, p.ja AS t0, p.ge AS current_ge, p.rehab AS current_rehab, l.ge AS lag1_ge, l.rehab AS lag1_rehab FROM bind_panel p JOIN bind_panel l ON l.simple_id = p.simple_id AND l.ja = p.ja - 1",
    "panel_without_conflicts": f""", {CONFLICTED}, cdedup AS (
  SELECT r.*, row_number() OVER (PARTITION BY simple_id, ja ORDER BY (entgelt IS NULL)::INT + (rtzb IS NULL)::INT + (code IS NULL)::INT + (death_year IS NULL)::INT, ord) AS rn
  FROM crow r WHERE simple_id NOT IN (SELECT simple_id FROM cper WHERE two)),
crun AS (SELECT ja, death_year, sum((code IS NOT NULL)::INT) OVER (PARTITION BY simple_id ORDER BY ja) AS cum FROM cdedup WHERE rn = 1)
SELECT ja, count(*) AS n, count(DISTINCT death_year) AS death_years, CAST(sum(cum) AS BIGINT) AS cum_rehab FROM crun GROUP BY 1""",
    "panel_diagnostics": f""", {CONFLICTED}, k AS (SELECT simple_id, ja, count(*) AS n FROM crow GROUP BY ALL)
SELECT 'duplicate_keys' AS metric, round(CAST(count(*) FILTER (n > 1) AS DOUBLE), 6) AS value FROM k UNION ALL SELECT 'excess_rows', round(CAST(sum(n) - count(*) AS DOUBLE), 6) FROM k
UNION ALL SELECT 'persons', round(CAST(count(*) AS DOUBLE), 6) FROM cper UNION ALL SELECT 'conflicted_persons', round(CAST(count(*) FILTER (two) AS DOUBLE), 6) FROM cper
UNION ALL SELECT 'exposed_share_excluded', round(avg(exposed) FILTER (two), 6) FROM cper UNION ALL SELECT 'exposed_share_retained', round(avg(exposed) FILTER (NOT two), 6) FROM cper""",
    "definition_audit": """, f AS (
  SELECT m.match_group, m.treated, m.simple_id, m.t0, coalesce(bool_or(p.ja < m.t0), false) AS b, coalesce(bool_or(p.ja = m.t0), false) AS n
  FROM members m LEFT JOIN bind_panel p ON p.simple_id = m.simple_id AND p.code IN (20, 30) GROUP BY ALL)
SELECT treated, count(*) AS matched, count(*) FILTER (b) AS before_t0, count(*) FILTER (n) AS in_t0, count(*) FILTER (b OR n) AS would_fail FROM f GROUP BY 1""",
    "recovered_codes": """, k AS (SELECT DISTINCT simple_id, t0 - 1 AS ja FROM members)
SELECT k.simple_id, CAST(k.ja AS INT) AS ja, b.code, count(r.ord) AS n_rows, count(DISTINCT coalesce(r.code, -1)) FILTER (r.ord IS NOT NULL) > 1 AS disagree
FROM k LEFT JOIN bind_dedup b ON b.simple_id = k.simple_id AND b.ja = k.ja LEFT JOIN bind_raw r ON r.simple_id = k.simple_id AND r.ja = k.ja GROUP BY k.simple_id, k.ja, b.code""",
    "ranked_nulls_last": "SELECT simple_id, ja, row_number() OVER (PARTITION BY ja ORDER BY code DESC NULLS LAST, entgelt ASC NULLS LAST, simple_id) AS rank FROM bind_panel",
    "final_stage": f", {STAGES} SELECT treated, stage, n_rows, n_persons FROM stage WHERE ord = {len(STAGE_NAMES)}",
    "grouped_statistics": f"""SELECT sample, treated, variable, {STATS}, round(stddev_samp(value), 3) AS sd, round(min(value), 3) AS lo, round(max(value), 3) AS hi,
  {", ".join(f"round(quantile_cont(value, {q}), 3) AS {n}" for n, q in (("q01", 0.01), ("q05", 0.05), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q95", 0.95), ("q99", 0.99)))} FROM long GROUP BY ALL""",
    "descriptives_full": f""", s2 AS (SELECT 'pre' AS sample, treated, lag1_age, lag1_ever_rehab, lag1_rtzb FROM risk UNION ALL SELECT 'post', treated, lag1_age, lag1_ever_rehab, lag1_rtzb FROM members JOIN risk USING (simple_id, t0, treated)),
l2 AS (SELECT sample, treated, 'lag1_age' AS variable, CAST(lag1_age AS DOUBLE) AS value FROM s2 UNION ALL SELECT sample, treated, 'lag1_ever_rehab', lag1_ever_rehab FROM s2 UNION ALL SELECT sample, treated, 'lag1_rtzb', lag1_rtzb FROM s2)
SELECT sample, treated, variable, {STATS}, round(quantile_cont(value, 0.5), 3) AS median, CASE WHEN variable = 'lag1_ever_rehab' THEN round(100 * avg((value = 1)::INT), 3) END AS percent FROM l2 GROUP BY sample, treated, variable""",
    "imbalanced_covariates": f""", arms AS (SELECT sample, variable, max(mean) FILTER (treated = 1) AS mt, max(var) FILTER (treated = 1) AS vt, max(missing) FILTER (treated = 1) AS qt, max(mean) FILTER (treated = 0) AS mc, max(var) FILTER (treated = 0) AS vc, max(missing) FILTER (treated = 0) AS qc FROM stats GROUP BY ALL),
d AS (SELECT variable AS base, variable, abs({SMD.format(mt="mt", mc="mc", vt="vt", vc="vc")}) AS size FROM arms WHERE sample = 'post'
  UNION ALL SELECT variable, variable || '__missing', abs({SMD.format(mt="qt", mc="qc", vt=P.format("qt"), vc=P.format("qc"))}) FROM arms WHERE sample = 'post')
SELECT base AS variable, arg_min(variable, (-size, variable)) AS component, round(max(size), 5) AS max_abs_smd FROM d WHERE size > 0.01 AND base IN ('lag1_age', 'lag1_entgelt', 'lag1_rtzb') GROUP BY 1""",
    "matching_overall": f", {DISTANCES} SELECT metric, round(value, 3) AS value FROM overall",
    "matching_overall_released": f""", {DISTANCES}, n AS (
  SELECT *, CASE WHEN metric IN ('eligible_treated', 'unmatched_treated', 'match_rate') AND (SELECT value FROM overall WHERE metric = 'unmatched_treated') < 200 THEN 'complement of few unmatched'
    WHEN value >= 0 AND value < 200 AND metric IN ('eligible_treated', 'matched_pairs', 'unique_matched_treated', 'unique_matched_controls', 'unmatched_treated', 'treated_without_exact_control', 'unmatched_after_exact') THEN 'below the limit' END AS note FROM overall)
SELECT metric, CASE WHEN note IS NULL THEN round(value, 3) END AS value, note FROM n""",
    "matching_by_year": f", {DISTANCES} SELECT t0, n_treated, n_controls, n_without_exact, n_matched, n_treated - n_matched - n_without_exact AS n_unmatched_after, round(n_matched / n_treated, 6) AS match_rate FROM yearly",
    "matching_by_year_released": f""", {DISTANCES}, y AS (SELECT *, n_treated - n_matched - n_without_exact AS n_unmatched_after, n_treated - n_matched < 100 AS few FROM yearly)
SELECT t0, CASE WHEN n_controls >= 100 THEN n_controls END AS n_controls, CASE WHEN n_matched >= 100 THEN n_matched END AS n_matched, CASE WHEN n_treated >= 100 AND NOT few THEN n_treated END AS n_treated,
  CASE WHEN n_unmatched_after >= 100 THEN n_unmatched_after END AS n_unmatched_after, CASE WHEN n_without_exact >= 100 THEN n_without_exact END AS n_without_exact, CASE WHEN NOT few THEN round(n_matched / n_treated, 6) END AS match_rate,
  nullif(concat_ws('; ', {", ".join(f"CASE WHEN {c} < 100 THEN '{c} withheld' END" for c in ("n_controls", "n_matched", "n_treated", "n_unmatched_after", "n_without_exact"))}, CASE WHEN few THEN 'total and rate withheld' END), '') AS note FROM y""",
    "attrition_released": f""", {STAGES}, {DISTANCES}, s AS (
  SELECT *, lag(n_rows) OVER w - n_rows AS removed, lag(n_persons) OVER w - n_persons AS removed_persons, treated = 1 AND ord = {len(STAGE_NAMES)} AND (SELECT sum(n_treated - n_matched) FROM yearly) < 1000000 AS hide FROM stage WINDOW w AS (PARTITION BY treated ORDER BY ord))
SELECT treated, stage, CASE WHEN NOT hide THEN n_rows END AS n_rows, CASE WHEN NOT hide THEN n_persons END AS n_persons, CASE WHEN NOT hide THEN coalesce(removed, 0) END AS removed, CASE WHEN NOT hide THEN removed_persons END AS removed_persons,
  CASE WHEN treated = 1 THEN 'assignments, one a person' ELSE 'assignments, persons may repeat' END AS unit, CASE WHEN hide THEN 'withheld: few unmatched' END AS note FROM s""",
    "overlap_detail": """, o AS (
  SELECT simple_id, count(*) AS n, count(*) FILTER (treated = 1) AS n_treated, count(*) FILTER (treated = 0) AS n_control, min(t0) FILTER (treated = 1) AS treated_t0, min(t0) FILTER (treated = 0) AS first_control, max(t0) FILTER (treated = 0) AS last_control,
    count(DISTINCT match_group) AS n_groups FROM members GROUP BY 1)
SELECT *, n_treated > 0 AND n_control > 0 AS both_roles, n_control > 1 AS repeated_control, coalesce(last_control < treated_t0, false) AS control_first, CASE WHEN n_treated > 0 AND n_control > 0 THEN treated_t0 - last_control END AS years_between FROM o""",
    "group_definitions": f", {GROUPS} SELECT * FROM grouped",
    "protected_groups": f""", {GROUPS}, {_protected(12)}
SELECT scheme, part, level, CASE WHEN hide THEN 'withheld' ELSE 'reported' END AS disclosure, CASE WHEN NOT hide AND NOT gap THEN treated_assigned END AS treated_assigned, CASE WHEN NOT hide AND NOT gap THEN treated_entered END AS treated_entered,
  CASE WHEN NOT hide THEN treated_events END AS treated_events, CASE WHEN NOT hide THEN control_without END AS control_without FROM (SELECT *, treated_assigned - treated_entered BETWEEN 1 AND 11 AS gap FROM h{len(_TOLD)})""",
    "export_six_cells": f""", c AS (
  SELECT 1 + simple_id % 2 AS sex, t0, {", ".join(f"count(DISTINCT match_group) FILTER (treated = {a}{e}) AS {n}_{arm}" for a, arm in ((0, "controls"), (1, "treated")) for n, e in (("people", ""), ("events", " AND event_type = 1")))} FROM follow GROUP BY ALL),
f AS (SELECT *, least(people_controls, people_treated, events_controls, events_treated, people_controls - events_controls, people_treated - events_treated) < 5 AS few FROM c)
SELECT sex, t0, {", ".join(f"CASE WHEN NOT few THEN {n} END AS {n}" for n in ("people_controls", "people_treated", "events_controls", "events_treated"))}, CASE WHEN few THEN 'withheld_small_cell' ELSE 'reported' END AS status FROM f""",
    "code_counts_by_arm": """, r AS (SELECT m.treated, coalesce(CAST(p.code AS VARCHAR), '__MISSING__') AS code FROM members m JOIN bind_panel p ON p.simple_id = m.simple_id AND p.ja = m.t0 - 1),
n AS (SELECT coalesce(v.code, r.code) AS code, count(*) FILTER (treated = 1) AS treated_n, count(*) FILTER (treated = 0) AS control_n FROM (VALUES ('__MISSING__'), ('10'), ('20'), ('30'), ('40')) v(code) FULL JOIN r ON r.code = v.code GROUP BY 1)
SELECT code, treated_n, control_n, round(coalesce(100 * treated_n / nullif(sum(treated_n) OVER (), 0), 0), 6) AS treated_pct, round(coalesce(100 * control_n / nullif(sum(control_n) OVER (), 0), 0), 6) AS control_pct FROM n""",
    "weighted_incidence": """, c AS (
  SELECT treated, follow_year, CAST(sum(w) AS BIGINT) AS n, CAST(coalesce(sum(w) FILTER (event_type = 1), 0) AS BIGINT) AS d1, CAST(coalesce(sum(w) FILTER (event_type = 2), 0) AS BIGINT) AS d2 FROM (SELECT *, 1 + match_group % 3 AS w FROM follow) GROUP BY ALL),
s AS (SELECT a.*, coalesce((SELECT product(1.0 - (b.d1 + b.d2) / b.n) FROM c b WHERE b.treated = a.treated AND b.follow_year < a.follow_year), 1.0) AS before FROM c a)
SELECT treated, follow_year, n, d1, d2, round(sum(before * d1 / n) OVER (PARTITION BY treated ORDER BY follow_year), 6) AS cif FROM s""",
    "followup_checks": " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(0 AS BIGINT) AS violations" for r in ("null_cell", "unknown_value", "year_index", "outside_window", "repeated_arm_year", "second_event", "changing_person", "years_after_event", "repeated_pair", "own_partner", "other_person"))
    + " UNION ALL SELECT 'without_followup', (SELECT count(*) FROM members m WHERE NOT EXISTS (SELECT 1 FROM follow f WHERE f.match_group = m.match_group AND f.treated = m.treated))",
    "event_pair_means": f"""SELECT event_time, round(avg(treated_rehab), 6) AS treated_mean, round(avg(control_rehab), 6) AS control_mean, count(*) AS n_pairs,
  count(*) < 20 OR {" OR ".join(f"count(*) FILTER ({a}_rehab {c} 0) BETWEEN 1 AND 19" for a in ("treated", "control") for c in (">", "="))} AS review FROM events2 WHERE treated_rehab IS NOT NULL AND control_rehab IS NOT NULL GROUP BY 1""",
    "hazard_score_checks": "SELECT DISTINCT 'year_' || follow_year AS term, true AS solved FROM follow UNION ALL SELECT 'treated', true",
    "greedy_checks": "SELECT t0, lag1_ge, lag1_ever_rehab, true AS bounded, true AS \"some\", true AS near FROM scored GROUP BY ALL HAVING count(DISTINCT treated) = 2",
    "pointwise_estimates": f", {CIF} SELECT treated, follow_year, round(sum(before * d1 / n) OVER (PARTITION BY treated ORDER BY follow_year), 6) AS cif, n AS n_at_risk, true AS ordered FROM s",
    "history_checks": "SELECT 'n_rows' AS rule, count(*) AS value FROM bind_panel a JOIN bind_panel b ON b.simple_id = a.simple_id AND b.ja = a.ja - 1"
    + "".join(f" UNION ALL SELECT '{r}', 0" for r in ("unknown_status", "earnings_without_status", "pension_without_status", "negative_amount", "not_binary", "state_not_carried", "null_draw")),
    "chain_checks": "SELECT 'eligible_treated' AS \"check\", CAST(coalesce(sum(treated), 0) AS BIGINT) AS value FROM risk UNION ALL SELECT 'eligible_controls', CAST(coalesce(sum(1 - treated), 0) AS BIGINT) FROM risk"
    " UNION ALL SELECT 'scored', count(*) FROM risk WHERE t0 IN (SELECT t0 FROM risk GROUP BY 1 HAVING count(DISTINCT treated) = 2)"
    + "".join(f" UNION ALL SELECT '{r}', 0" for r in ("scores_outside", "treated_twice", "control_twice", "no_candidate", "strata_differ", "over_caliper", "null_cell", "unknown_value", "year_index", "outside_window", "repeated_arm_year", "second_event", "changing_person", "years_after_event", "repeated_pair", "own_partner", "other_person", "without_followup")),
}

PLAIN = {
    "source_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n_rows FROM {t}" for t in TABLES),
    "column_inventory": " UNION ALL ".join(
        f"SELECT '{s}' AS source, '{c}' AS \"column\", count({c}) AS n_values FROM {s}"
        for s, c in (("customer", "c_mktsegment"), ("part", "p_retailprice"), ("orders", "o_totalprice"), ("orders", "o_orderdate"),
                     ("lineitem", "l_extendedprice"), ("lineitem", "l_shipdate"))
    ),
    "application_activity": """WITH f AS (SELECT (o_orderkey % 5 = 0)::INT AS a, (o_orderkey % 7 = 0)::INT AS b, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 11 = 0)::INT END AS c, o_orderkey % 3 AS starts, (o_orderkey % 4 = 0)::INT AS sub FROM orders)
SELECT (starts > sub)::INT AS non_subset, greatest(a, b, coalesce(c, 0)) AS non_success, a + b + c + (starts > 0)::INT AS n_types, count(*) AS n FROM f GROUP BY ALL""",
    "original_codes": """WITH c AS (
  SELECT CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'abc' WHEN p_partkey % 17 = 0 THEN 'inf' WHEN p_partkey % 7 = 0 THEN '1234' WHEN p_partkey % 5 = 0 THEN ' 999 ' WHEN p_partkey % 3 = 0 THEN '0'
    WHEN p_partkey % 2 = 0 THEN (p_partkey % 998) || '.0' WHEN p_partkey % 19 = 0 THEN p_partkey || '.5' ELSE CAST(p_partkey % 998 AS VARCHAR) END AS raw FROM part),
n AS (SELECT raw, trim(raw) AS t, CASE WHEN raw <> 'inf' THEN TRY_CAST(trim(raw) AS DOUBLE) END AS v FROM c),
w AS (SELECT *, CAST(trunc(v) AS BIGINT) AS i FROM n),
s AS (SELECT CASE WHEN raw IS NULL THEN '__MISSING__' WHEN v = i AND i <= 999 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE t END AS display,
  CASE WHEN raw IS NULL THEN 'missing' WHEN v IS NULL THEN 'invalid_value' WHEN v <> i OR i > 999 THEN 'invalid_width_or_value' WHEN i = 0 THEN 'zero_no_information' WHEN i = 999 THEN 'no_information_999'
    WHEN i BETWEEN 970 AND 998 THEN 'special_status' WHEN i = 121 THEN 'occupation_unspecified' WHEN i BETWEEN 100 AND 899 AND (i - 100) % 7 = 0 THEN 'occupation' ELSE 'unrecognised_three_digit_code' END AS status,
  CASE WHEN v IS NULL THEN '__MISSING__' WHEN i < 100 THEN '0' ELSE CAST(i AS VARCHAR)[1] END AS broad FROM w)
SELECT display, status, broad, count(*) AS n FROM s GROUP BY ALL""",
    "normal_sex": "SELECT CASE c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE 'unknown' END AS sex, count(*) AS n FROM customer GROUP BY 1",
    "validated_merge": """SELECT CASE WHEN c_custkey IS NULL THEN 'left_only' WHEN o_orderkey IS NULL THEN 'right_only' ELSE 'both' END AS side, c_nationkey, count(*) AS n
FROM orders FULL JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
}

#: Covariates of feature_plan: role, place, column, and whether a source without earnings has it (and at which place).
PLANNED = (
    ("numeric", 0, "lag1_age", 0), ("numeric", 1, "lag1_entgelt_value", None), ("numeric", 2, "lag2_entgelt_value", None),
    ("numeric", 3, "lag2_rtzb_value", 1), ("numeric", 4, "lag3_entgelt_value", None), ("numeric", 5, "lag3_rtzb_value", 2),
    ("binary", 0, "lag1_entgelt_missing", None), ("categorical", 0, "lag1_income_source_status", None),
    ("categorical", 1, "lag2_income_source_status", None), ("categorical", 2, "lag3_income_source_status", None),
    ("exact", 0, "lag1_ge", 0), ("exact", 1, "lag1_ever_rehab", 1),
)
_STATUS = "CASE WHEN {b}.entgelt IS NOT NULL AND {b}.rtzb IS NOT NULL THEN 'both' WHEN {b}.entgelt IS NOT NULL THEN 'earnings_only' WHEN {b}.rtzb IS NOT NULL THEN 'pension_only' ELSE 'neither' END"
SELECTS["feature_plan"] = f""", lags AS (
  SELECT r.lag1_ge, r.lag1_ever_rehab, r.lag1_age, r.lag1_entgelt AS lag1_entgelt_value, (r.lag1_entgelt IS NULL)::INT AS lag1_entgelt_missing,
    {INCOME} AS lag1_income_source_status, b.rtzb AS lag2_rtzb_value, b.entgelt AS lag2_entgelt_value, c.rtzb AS lag3_rtzb_value, c.entgelt AS lag3_entgelt_value,
    CASE WHEN b.ja IS NOT NULL THEN {_STATUS.format(b="b")} END AS lag2_income_source_status, CASE WHEN c.ja IS NOT NULL THEN {_STATUS.format(b="c")} END AS lag3_income_source_status
  FROM risk r LEFT JOIN bind_panel b ON b.simple_id = r.simple_id AND b.ja = r.t0 - 2 LEFT JOIN bind_panel c ON c.simple_id = r.simple_id AND c.ja = r.t0 - 3)
""" + " UNION ALL ".join(
    f"SELECT {str(earned).lower()} AS earnings, '{role}' AS role, {place} AS place, '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS levels FROM lags"
    for role, first, c, other in PLANNED
    for earned, place in ((True, first), (False, other))
    if place is not None
)
_LAST = "CASE WHEN follow_year = 1 THEN {first} ELSE lag({c}) OVER o END"
SELECTS["mediation_lives"] = f""", years AS (
  SELECT m.*, y.follow_year, m.t0 + y.follow_year AS ja, r.lag1_age, r.lag1_cum_rehab, r.lag1_ever_rehab, r.lag1_ge, {INCOME} AS first_income,
    coalesce(r.lag1_entgelt, 0.0) AS first_entgelt, coalesce(r.lag1_rtzb, 0.0) AS first_rtzb, d.dy
  FROM members m JOIN risk r USING (simple_id, t0, treated) LEFT JOIN deaths d USING (simple_id), (SELECT unnest([1, 2, 3]) AS follow_year) y),
seen AS (
  SELECT y.*, coalesce((dy = y.ja)::INT, 0) AS death, (p.ja IS NOT NULL OR coalesce(dy = y.ja, false))::INT AS observed, coalesce(p.msk, 0) AS m, dy IS NULL OR dy >= y.ja AS alive,
    {_STATUS.format(b="p")} AS income, coalesce(p.entgelt, 0.0) AS entgelt, coalesce(p.rtzb, 0.0) AS rtzb, CAST(coalesce((p.rehab = 1 AND p.msk = 0)::INT, 0) AS DOUBLE) AS other_rehab
  FROM years y LEFT JOIN bind_panel p ON p.simple_id = y.simple_id AND p.ja = y.ja),
so_far AS (
  SELECT *, coalesce(min(observed) OVER b, 1) = 1 AS no_gap, coalesce(max(m) OVER b, 0) AS prev, {_LAST.format(first="first_income", c="income")} AS prior_income,
    {_LAST.format(first="first_entgelt", c="entgelt")} AS prior_entgelt, {_LAST.format(first="first_rtzb", c="rtzb")} AS prior_rtzb, {_LAST.format(first="0.0", c="other_rehab")} AS prior_other_rehab
  FROM seen WINDOW o AS (PARTITION BY match_group, treated ORDER BY follow_year),
    b AS (PARTITION BY match_group, treated ORDER BY follow_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_group, treated, simple_id, t0, follow_year, death, observed, lag1_age, lag1_cum_rehab, lag1_ever_rehab, lag1_ge, (alive AND no_gap)::INT AS at_risk,
  (alive AND no_gap AND observed = 1)::INT AS used, prev AS mediator_prev, (prev = 0 AND m = 1)::INT AS mediator_new, greatest(prev, m) AS mediator_now, prior_income,
  round(prior_entgelt, 4) AS prior_entgelt, round(prior_rtzb, 4) AS prior_rtzb, prior_other_rehab, income AS current_income, round(entgelt, 4) AS current_entgelt,
  round(rtzb, 4) AS current_rtzb, other_rehab AS current_other_rehab FROM so_far"""
SELECTS["resampled_pairs"] = """ SELECT r.lag1_ge AS sex, k.replicate, CAST(count(*) AS BIGINT) AS draws, count(*) AS pairs
FROM pairs p JOIN risk r ON r.simple_id = p.t_id AND r.t0 = p.t0 AND r.treated = 1, (SELECT unnest(range(1, 11)) AS replicate) k GROUP BY ALL"""
SELECTS["caliper_edge_list"] = """ SELECT t.t0, t.lag1_ge, t.lag1_ever_rehab, t.simple_id AS t_id, c.simple_id AS c_id, abs(t.score_ppm - c.score_ppm) AS distance
FROM scored t JOIN scored c ON c.t0 = t.t0 AND c.lag1_ge IS NOT DISTINCT FROM t.lag1_ge AND c.lag1_ever_rehab IS NOT DISTINCT FROM t.lag1_ever_rehab
  AND c.score_ppm BETWEEN t.score_ppm - 5000 AND t.score_ppm + 5000 WHERE t.treated = 1 AND c.treated = 0"""
SELECTS["aligned_shards"] = """ SELECT ja, ge, count(*) AS n, count(code) AS codes, 0 AS absent, round(sum(entgelt), 2) AS entgelt, CAST(sum(simple_id) AS BIGINT) AS sum_simple_id,
  CAST(sum(code) AS BIGINT) AS sum_code FROM (SELECT ja, ge, entgelt, simple_id, CASE WHEN ja < 1997 OR (ja > 1998 AND code = 30) THEN NULL ELSE code END AS code FROM bind_raw) GROUP BY ALL"""
SELECTS["panel_written_by_year"] = " SELECT ja, count(*) AS n, count(DISTINCT simple_id) AS persons, CAST(sum(cum_rehab) AS BIGINT) AS cum_rehab FROM bind_panel GROUP BY 1"
SELECTS["modes_and_counts"] = """, k AS (SELECT ja, code, count(*) AS n FROM bind_panel WHERE code IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ja ORDER BY n DESC, code) AS r, count(*) OVER (PARTITION BY ja) AS codes FROM k)
SELECT ja, code AS mode, n, codes, code AS built_in FROM r WHERE r = 1"""
_FILL = "ln(1 + greatest(0, coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM f), 0)))"
_SCALED = "round((x.{c} - s.m_{c}) / CASE WHEN s.s_{c} > 1e-12 THEN s.s_{c} ELSE 1 END, 5)"
_COLUMNS = {
    "intercept": "1.0", "treated": "treated", "year_2": "(follow_year = 2)::INT", "year_3": "(follow_year = 3)::INT", "lag1_age": _SCALED.format(c="a"), "lag1_entgelt": _SCALED.format(c="e"),
    "lag1_rtzb": _SCALED.format(c="p"), "lag1_ever_rehab": "lag1_ever_rehab", "lag1_entgelt_missing": "(lag1_entgelt IS NULL)::INT", "lag1_rtzb_missing": "(lag1_rtzb IS NULL)::INT",
    "event_type_1": "(event_type = 1)::INT", "event_type_2": "(event_type = 2)::INT",
}
SELECTS["design_matrix"] = f""", f AS (
  SELECT w.match_group, w.treated, w.follow_year, w.event_type, r.lag1_age, r.lag1_entgelt, r.lag1_rtzb, r.lag1_ever_rehab FROM follow w JOIN risk r ON r.simple_id = w.simple_id AND r.t0 = w.t0 AND r.treated = w.treated),
x AS (SELECT *, CAST(coalesce(lag1_age, (SELECT quantile_cont(lag1_age, 0.5) FROM f), 0) AS DOUBLE) AS a, {_FILL.format(c="lag1_entgelt")} AS e, {_FILL.format(c="lag1_rtzb")} AS p FROM f),
s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in "aep")} FROM x),
each AS (SELECT match_group, treated, follow_year, unnest([{", ".join(f"'{c}'" for c in _COLUMNS)}]) AS "column", unnest([{", ".join(f"CAST({v} AS DOUBLE)" for v in _COLUMNS.values())}]) AS value FROM x, s)
SELECT * FROM each WHERE value <> 0"""
_MENTAL = "coalesce((code = {c})::INT, 0)"
SELECTS["panel_features"] = f""", m AS (SELECT *, {_MENTAL.format(c=30)} AS mental, CAST(sum({_MENTAL.format(c=30)}) OVER (PARTITION BY simple_id ORDER BY ja) AS BIGINT) AS cum_mental,
  CASE WHEN (death_year IS NULL OR ja <= death_year) AND ja - gbja BETWEEN 0 AND 125 THEN ja - gbja END AS age FROM bind_panel)
SELECT simple_id, ja, CAST(ge AS VARCHAR) AS ge_cat, age, CASE WHEN age < 20 THEN '<20' WHEN age >= 90 THEN '90+' ELSE CAST(age // 5 * 5 AS VARCHAR) || '-' || CAST(age // 5 * 5 + 4 AS VARCHAR) END AS age_band,
  rehab AS rehab_starts_this_year, cum_rehab AS cum_rehabs_by_year, (cum_rehab > 0)::INT AS ever_rehab_to_date, years_since_rehab AS years_since_last_rehab, msk AS msk_starts_this_year,
  (cum_msk > 0)::INT AS ever_msk_rehab_to_date, (rehab = 1 AND msk = 0)::INT AS non_msk_rehab_this_year, mental AS mental_health_rehab_this_year, cum_mental AS cum_mental_health_rehabs_by_year,
  (cum_mental > 0)::INT AS ever_mental_health_rehab_to_date, round(coalesce(entgelt, 0.0), 4) AS entgelt_value, (entgelt IS NULL)::INT AS entgelt_missing, round(coalesce(rtzb, 0.0), 4) AS rtzb_value,
  (rtzb IS NULL)::INT AS rtzb_missing, {_STATUS.format(b="m")} AS income_source_status FROM m"""
SELECTS["relabelled_features"] = f""", m AS (SELECT simple_id, ja, code, coalesce((code IN (20, 30))::INT, 0) AS msk, {_MENTAL.format(c=10)} AS mental, (code IS NOT NULL)::INT AS rehab FROM bind_panel),
c AS (SELECT *, sum(msk) OVER w AS cum_msk, sum(mental) OVER w AS cum_mental, sum(rehab) OVER w AS cum_rehab FROM m WINDOW w AS (PARTITION BY simple_id ORDER BY ja))
SELECT ja, CAST(sum(msk) AS BIGINT) AS msk_starts_this_year, CAST(sum((cum_msk > 0)::INT) AS BIGINT) AS ever_msk_rehab_to_date, CAST(sum((rehab = 1 AND msk = 0)::INT) AS BIGINT) AS non_msk_rehab_this_year,
  CAST(sum(mental) AS BIGINT) AS mental_health_rehab_this_year, CAST(sum(cum_mental) AS BIGINT) AS cum_mental_health_rehabs_by_year,
  CAST(sum((cum_mental > 0)::INT) AS BIGINT) AS ever_mental_health_rehab_to_date, CAST(sum(cum_rehab) AS BIGINT) AS cum_rehabs_by_year FROM c GROUP BY 1"""

_PROPORTION = "CASE WHEN sqrt(({a} * (1 - {a}) + {b} * (1 - {b})) / 2) > 0 THEN ({a} - {b}) / sqrt(({a} * (1 - {a}) + {b} * (1 - {b})) / 2) WHEN {a} = {b} THEN 0.0 END"
_ARMS = lambda c: ", ".join(f"count(*) FILTER (matched = {a} AND {c}) AS {n}" for a, n in ((1, "cm"), (0, "cu")))
COMPARED = f""", g AS (
  SELECT (p.c_id IS NOT NULL)::INT AS matched, lag1_age, lag1_rtzb, lag1_ever_rehab, {INCOME} AS income, CASE WHEN lag1_age < 20 THEN '<20' WHEN lag1_age >= 90 THEN '90+'
    ELSE CAST(lag1_age // 5 * 5 AS VARCHAR) || '-' || CAST(lag1_age // 5 * 5 + 4 AS VARCHAR) END AS band, r.t0
  FROM risk r LEFT JOIN (SELECT DISTINCT c_id, t0 FROM pairs) p ON p.c_id = r.simple_id AND p.t0 = r.t0 WHERE r.treated = 0),
size AS (SELECT count(*) FILTER (matched = 1) AS nm, count(*) FILTER (matched = 0) AS nu FROM g),
num AS (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, {_ARMS(f'{v} IS NOT NULL')}, count(*) FILTER (matched = 1 AND {v} IS NULL) AS rm, count(*) FILTER (matched = 0 AND {v} IS NULL) AS ru, avg({v}) FILTER (matched = 1) AS vm, avg({v}) FILTER (matched = 0) AS vu,"
    f" var_pop({v}) FILTER (matched = 1) AS sm, var_pop({v}) FILTER (matched = 0) AS su FROM g" for v in ("lag1_age", "lag1_rtzb")
) + f"""),
flat AS (
  SELECT variable, CAST(NULL AS VARCHAR) AS level, 'continuous' AS kind, vm, vu, {SMD.format(mt="vm", vt="sm", mc="vu", vc="su")} AS smd, cm, cu, rm, ru FROM num
  UNION ALL SELECT variable || '__missing', 'missing', 'binary_missingness', a, b, {_PROPORTION.format(a="a", b="b")}, rm, ru, cm, cu
    FROM (SELECT *, rm / greatest(rm + cm, 1) AS a, ru / greatest(ru + cu, 1) AS b FROM num)
  UNION ALL SELECT 'lag1_ever_rehab', '1', 'binary', a, b, {_PROPORTION.format(a="a", b="b")}, cm, cu, rm, ru
    FROM (SELECT {_ARMS("lag1_ever_rehab = 1")}, count(*) FILTER (matched = 1 AND lag1_ever_rehab = 0) AS rm, count(*) FILTER (matched = 0 AND lag1_ever_rehab = 0) AS ru,
      avg(lag1_ever_rehab) FILTER (matched = 1) AS a, avg(lag1_ever_rehab) FILTER (matched = 0) AS b FROM g)),
lev AS (
  SELECT variable, level, count(*) FILTER (matched = 1) AS cm, count(*) FILTER (matched = 0) AS cu FROM (
    SELECT matched, 'income' AS variable, income AS level FROM g UNION ALL SELECT matched, 'band', coalesce(band, '__MISSING__') FROM g UNION ALL SELECT matched, 't0', CAST(t0 AS VARCHAR) FROM g) GROUP BY ALL),
"""
_SHARES = f"SELECT variable, level, 'categorical_level' AS kind, a AS vm, b AS vu, {_PROPORTION.format(a='a', b='b')} AS smd, cm, cu, nm - cm AS rm, nu - cu AS ru{{more}} FROM (SELECT *, cm / greatest(nm, 1) AS a, cu / greatest(nu, 1) AS b FROM {{of}}, size)"
_NAMED = "round(vm, 5) AS matched_value, round(vu, 5) AS unmatched_value, round(smd, 5) AS smd, cm AS matched_count, cu AS unmatched_count, rm AS matched_rest, ru AS unmatched_rest"
SELECTS["matchability"] = COMPARED + "shares AS (" + _SHARES.format(more="", of="lev") + f") SELECT variable, level, kind, {_NAMED} FROM (SELECT * FROM flat UNION ALL SELECT * FROM shares)"
_KEEP = lambda c, n: f"CASE WHEN ok THEN {c} END AS {n}"
SELECTS["matchability_released"] = COMPARED + f"""small AS (SELECT *, cm < 5 OR cu < 5 AS few FROM lev),
placed AS (SELECT *, count(*) FILTER (few) OVER (PARTITION BY variable) AS n_few, row_number() OVER (PARTITION BY variable ORDER BY few, least(cm, cu), cm + cu, level) AS r FROM small),
joint AS (
  SELECT variable, CASE WHEN pool THEN '__POOLED_LEVELS_BELOW_THRESHOLD__' ELSE level END AS level, CAST(sum(cm) AS BIGINT) AS cm, CAST(sum(cu) AS BIGINT) AS cu, CASE WHEN pool THEN count(*) END AS pooled
  FROM (SELECT *, few OR (n_few = 1 AND r = 1) AS pool FROM placed) GROUP BY 1, 2, pool),
shares AS ({_SHARES.format(more=", pooled", of="joint")}),
judged AS (
  SELECT a.*, nm < 5 OR nu < 5 AS tiny, nu, CASE WHEN kind IN ('continuous', 'categorical_level') THEN cm >= 5 AND cu >= 5 ELSE least(cm, cu, rm, ru) >= 5 END AS fine
  FROM (SELECT *, CAST(NULL AS BIGINT) AS pooled FROM flat UNION ALL SELECT * FROM shares) a, size),
told AS (SELECT *, fine AND NOT tiny AS ok FROM judged)
SELECT variable, level, kind, {_KEEP("round(vm, 5)", "matched_value")}, {_KEEP("round(vu, 5)", "unmatched_value")}, {_KEEP("round(smd, 5)", "smd")}, {_KEEP("cm", "matched_count")}, {_KEEP("cu", "unmatched_count")},
  {_KEEP("rm", "matched_rest")}, {_KEEP("ru", "unmatched_rest")}, pooled, CASE WHEN nu = 0 THEN 'no unmatched rows' WHEN tiny THEN 'a group is under the limit' WHEN NOT ok THEN 'a cell or its complement is under the limit'
    WHEN pooled IS NOT NULL THEN pooled || ' levels pooled' END AS note FROM told"""
SELECTS["gap_sensitivity_counts"] = """, h AS (SELECT *, 1 + match_group % 2 AS half, min(CASE WHEN observed = 0 THEN follow_year END) OVER (PARTITION BY match_group) AS gap FROM follow),
b AS (SELECT *, 'ordinary' AS rule FROM h UNION ALL SELECT *, 'pair_censored' FROM h WHERE gap IS NULL OR follow_year < gap),
n AS (SELECT half, count(DISTINCT match_group) AS gaps FROM h WHERE observed = 0 GROUP BY 1)
SELECT b.half, rule, count(DISTINCT match_group) AS pairs, count(DISTINCT match_group) FILTER (treated = 0) AS people_controls, count(DISTINCT match_group) FILTER (treated = 0 AND event_type = 1) AS events_controls,
  count(DISTINCT match_group) FILTER (treated = 1) AS people_treated, count(DISTINCT match_group) FILTER (treated = 1 AND event_type = 1) AS events_treated, coalesce(max(n.gaps), 0) AS gaps
FROM b LEFT JOIN n ON n.half = b.half GROUP BY b.half, rule"""
SELECTS["group_risks"] = f""", {GROUPS},
each AS (
  SELECT 'all' AS scheme, sex, 'all' AS level, match_group, treated FROM joined UNION ALL SELECT 'own_income', sex, income, match_group, treated FROM joined
  UNION ALL SELECT 'same_income', sex, income, match_group, treated FROM joined WHERE lo = hi AND members_n = 2
  UNION ALL SELECT 'points', sex, CASE WHEN points IS NULL THEN 'unknown' WHEN points > 0 THEN 'gain' WHEN points < 0 THEN 'loss' ELSE 'zero' END, match_group, treated FROM joined),
n AS (
  SELECT scheme, CAST(sex AS VARCHAR) AS part, level, f.treated, follow_year, count(*) AS n, count(*) FILTER (event_type = 1) AS d1, count(*) FILTER (event_type = 2) AS d2
  FROM each e JOIN follow f ON f.match_group = e.match_group AND f.treated = e.treated GROUP BY ALL),
r AS (
  SELECT a.scheme, a.part, a.level, a.treated, sum(coalesce((SELECT product(1.0 - (b.d1 + b.d2) / b.n) FROM n b WHERE b.scheme = a.scheme AND b.part = a.part AND b.level = a.level
    AND b.treated = a.treated AND b.follow_year < a.follow_year), 1.0) * a.d1 / a.n) AS risk FROM n a GROUP BY ALL),
b AS (SELECT scheme, part, level, max(risk) FILTER (treated = 0) AS c, max(risk) FILTER (treated = 1) AS t FROM r GROUP BY ALL)
SELECT scheme, part, level, round(c, 6) AS control_risk, round(t, 6) AS treated_risk, round(t - c, 6) AS risk_difference, round(CASE WHEN c > 0 THEN t / c END, 6) AS risk_ratio FROM b"""
