"""SQL fragments (common table expressions) that queries' oracle statements are put together from."""

from __future__ import annotations

from vigil.operators.scoring import DEFAULT_RULES
from vigil.plans.tables import STAND_IN_RULES

TXN = """txn AS (SELECT CAST(user_id AS VARCHAR) AS source_account_id, json_extract_string(props, '$.k') AS target_account_id,
  value AS amount, ts AS event_time, CAST(ts AS DATE) AS event_date FROM events)"""
BOTH = """both_ways AS (SELECT source_account_id AS account_id, target_account_id AS counterparty_id, amount, event_time, event_date FROM txn
  UNION ALL SELECT target_account_id, source_account_id, amount, event_time, event_date FROM txn)"""
DAY = "day0 AS (SELECT max(event_date) AS d FROM txn)"
MATCHES = """mt AS (SELECT CAST(c_custkey AS VARCHAR) AS account_id, sha256('ofac:' || CAST(c_custkey % 90 + 1 AS VARCHAR)) AS entity_id,
  CASE WHEN c_custkey % 50 = 7 THEN 'exact' WHEN c_custkey % 50 = 13 THEN 'strong' ELSE 'weak' END AS match_confidence_band
  FROM customer WHERE c_custkey % 50 IN (7, 13) OR c_custkey % 20 = 3)"""
NETWORK = "net AS (SELECT CAST(c_custkey AS VARCHAR) AS account_id, CAST((c_custkey % 7) / 10.0 AS DOUBLE) AS network_risk_exposure FROM customer WHERE c_custkey % 20 = 1)"
ACCOUNTS = """acc AS (SELECT CAST(c_custkey AS VARCHAR) AS account_id, c_name AS synthetic_holder_name, n_name AS synthetic_country,
  '19' || CAST(c_custkey % 90 + 10 AS VARCHAR) || '-01-01' AS synthetic_dob, c_acctbal AS init_balance
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)"""
ACTIVITY = """act AS (SELECT account_id,
  COUNT(CASE WHEN event_time >= d - INTERVAL 1 DAY THEN 1 END) AS velocity_1d,
  COUNT(CASE WHEN event_time >= d - INTERVAL 7 DAY THEN 1 END) AS velocity_7d,
  COUNT(CASE WHEN event_time >= d - INTERVAL 30 DAY THEN 1 END) AS velocity_30d,
  COUNT(DISTINCT CASE WHEN event_time >= d - INTERVAL 30 DAY THEN counterparty_id END) AS counterparty_diversity_30d,
  CAST(SUM(CASE WHEN amount = round(amount, 0) AND event_time >= d - INTERVAL 30 DAY THEN 1 ELSE 0 END) AS BIGINT) AS round_dollar_count_30d
  FROM both_ways CROSS JOIN day0 GROUP BY account_id)"""
BURST = """burst AS (SELECT account_id, MAX(n) AS max_daily_count, AVG(n) AS avg_daily_count FROM (
  SELECT account_id, event_date, COUNT(*) AS n FROM both_ways CROSS JOIN day0 WHERE event_date >= d - INTERVAL 30 DAY GROUP BY account_id, event_date) x GROUP BY account_id)"""
EXPOSURE = "expo AS (SELECT DISTINCT b.account_id FROM both_ways b JOIN (SELECT DISTINCT account_id FROM mt WHERE match_confidence_band IN ('exact', 'strong')) r ON r.account_id = b.counterparty_id)"
SUMMARY = """ws AS (SELECT account_id, MAX(CASE match_confidence_band WHEN 'exact' THEN 3 WHEN 'strong' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END) AS best_band_rank,
  COUNT(*) AS watchlist_match_count FROM mt GROUP BY account_id)"""
JOINED = """joined AS (SELECT a.account_id AS entity_id, a.account_id, d AS as_of_date, COALESCE(f.velocity_1d, 0) AS velocity_1d, COALESCE(f.velocity_7d, 0) AS velocity_7d,
  COALESCE(f.velocity_30d, 0) AS velocity_30d, COALESCE(f.counterparty_diversity_30d, 0) AS counterparty_diversity_30d,
  CASE WHEN COALESCE(f.velocity_30d, 0) > 0 THEN f.round_dollar_count_30d / f.velocity_30d ELSE 0.0 END AS round_dollar_ratio,
  b.max_daily_count, b.avg_daily_count, e.account_id IS NOT NULL AS risky_counterparty_exposure, n.network_risk_exposure,
  COALESCE(w.best_band_rank, 0) AS best_band_rank, COALESCE(w.watchlist_match_count, 0) AS watchlist_match_count
  FROM acc a CROSS JOIN day0 LEFT JOIN act f ON f.account_id = a.account_id LEFT JOIN burst b ON b.account_id = a.account_id LEFT JOIN expo e ON e.account_id = a.account_id
  LEFT JOIN net n ON n.account_id = a.account_id LEFT JOIN ws w ON w.account_id = a.account_id)"""


def scored(rules: dict[str, float]) -> str:
    r = {k: f"{v}" for k, v in rules.items()}
    points = f"""CASE best_band_rank WHEN 3 THEN {r["pts_watchlist_exact"]} WHEN 2 THEN {r["pts_watchlist_strong"]} WHEN 1 THEN {r["pts_watchlist_weak"]} ELSE 0 END AS pts_watchlist,
  CASE WHEN velocity_7d > {r["thr_velocity_7d"]} THEN {r["pts_velocity"]} ELSE 0 END AS pts_velocity,
  CASE WHEN counterparty_diversity_30d > {r["thr_diversity_30d"]} THEN {r["pts_diversity"]} ELSE 0 END AS pts_diversity,
  CASE WHEN round_dollar_ratio > {r["thr_round_dollar_ratio"]} THEN {r["pts_round_dollar"]} ELSE 0 END AS pts_round_dollar,
  CASE WHEN COALESCE(max_daily_count > {r["thr_burst_multiplier"]} * avg_daily_count, false) THEN {r["pts_burst"]} ELSE 0 END AS pts_burst,
  CASE WHEN risky_counterparty_exposure THEN {r["pts_risky_counterparty"]} ELSE 0 END AS pts_risky_counterparty,
  CASE WHEN network_risk_exposure > {r["thr_network_risk"]} THEN {r["pts_network_risk"]} ELSE 0 END AS pts_network_risk"""
    return f"""pts AS (SELECT *, COALESCE(max_daily_count > {r["thr_burst_multiplier"]} * avg_daily_count, false) AS burst_flag, {points} FROM joined),
prof AS (SELECT *, CAST(LEAST({r["score_cap"]}, pts_watchlist + pts_velocity + pts_diversity + pts_round_dollar + pts_burst + pts_risky_counterparty + pts_network_risk) AS INTEGER) AS composite_risk_score FROM pts),
banded AS (SELECT *, CASE WHEN composite_risk_score >= {r["band_high_min"]} THEN 'high' WHEN composite_risk_score >= {r["band_medium_min"]} THEN 'medium' ELSE 'low' END AS score_band FROM prof),
alerts AS (SELECT sha256(entity_id || '-' || CAST(as_of_date AS VARCHAR)) AS alert_id, entity_id, account_id, CAST(RANK() OVER (ORDER BY composite_risk_score DESC) AS INTEGER) AS priority_rank, composite_risk_score,
  CASE WHEN best_band_rank = 3 THEN 'sanctions_hard_override' ELSE 'behavioral_threshold' END AS escalation_reason, 'new' AS status FROM banded WHERE best_band_rank = 3 OR composite_risk_score >= {r["alert_min_score"]})"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


BEHAVIOUR = (TXN, BOTH, DAY, ACTIVITY, BURST)
PROFILE = (*BEHAVIOUR, MATCHES, NETWORK, ACCOUNTS, EXPOSURE, SUMMARY, JOINED)
SCORED = (*PROFILE, scored(STAND_IN_RULES))
SCORED_DEFAULT = (*PROFILE, scored(DEFAULT_RULES))
#: The same profile a week earlier, for comparisons of two runs.
EARLIER = tuple(p.replace("max(event_date) AS d", "max(event_date) - INTERVAL 7 DAY AS d") for p in SCORED)
RAW = """raw AS (SELECT event_id, CAST(user_id AS VARCHAR) AS src,
  CASE WHEN event_id % 100 = 7 AND (event_id // 100) % 3 = 1 THEN NULL ELSE json_extract_string(props, '$.k') END AS dst,
  CASE WHEN event_id % 100 = 7 AND (event_id // 100) % 3 = 0 THEN 'not_a_number' ELSE printf('%.2f', value) END AS value,
  CASE WHEN event_id % 100 = 7 AND (event_id // 100) % 3 = 2 THEN '-1' ELSE CAST(CAST(floor((epoch(date_trunc('second', ts)) - 1704067200) / 3600) AS BIGINT) + 1 AS VARCHAR) END AS step FROM events)"""
VALID = """checked AS (SELECT *, COALESCE(regexp_matches(src, '^\\d+$') AND regexp_matches(dst, '^\\d+$') AND TRY_CAST(value AS DOUBLE) IS NOT NULL AND TRY_CAST(step AS INTEGER) > 0, false) AS good FROM raw)"""
CONTROL = """ctl0 AS (SELECT event_type, CAST(ts AS DATE) AS d, COUNT(*) AS n, COUNT(CASE WHEN event_id % 100 = 7 THEN 1 END) AS dead, MAX(ts) AS last FROM events GROUP BY 1, 2),
ctl AS (SELECT CASE WHEN event_type = 'purchase' THEN 'gold_month_end_publish' ELSE 'ingest_' || event_type END AS pipeline_name, 'monitoring' AS business_process, 'events_' || event_type AS impacted_table,
  strftime(d, '%Y%m%d') || '-' || event_type AS batch_id, CAST(n - dead AS INTEGER) AS processed_row_count, CAST(dead AS INTEGER) AS dead_letter_count,
  CAST(epoch(CAST(d + INTERVAL 1 DAY AS TIMESTAMP)) - epoch(date_trunc('second', last)) AS DOUBLE) AS lag_seconds, CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS recorded_at,
  CAST(n - dead AS INTEGER) / 100.0 AS runtime_seconds, CAST(n - dead AS INTEGER) * 2e-6 AS estimated_cloud_cost_usd FROM ctl0),
control AS (SELECT *, CASE WHEN lag_seconds <= 900 THEN 'fresh' WHEN lag_seconds <= 2700 THEN 'stale' ELSE 'degraded' END AS freshness_status, lag_seconds / 60.0 AS last_good_batch_age_minutes,
  'team_' || substr(impacted_table, 8, 3) AS upstream_owner FROM ctl)"""
EDGES = "ed AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src, 's' || CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
CLASSES = """cl AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS node, CASE WHEN c_acctbal < 0 THEN '1' WHEN c_acctbal >= 5000 THEN '2' ELSE 'unknown' END AS class FROM customer
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'unknown' FROM supplier)"""
RATIO = """nb AS (SELECT src AS node, dst AS other FROM ed UNION ALL SELECT dst, src FROM ed),
ratio AS (SELECT node, CASE WHEN SUM(CASE WHEN class IN ('1', '2') THEN 1 ELSE 0 END) > 0
  THEN SUM(CASE WHEN class = '1' THEN 1 ELSE 0 END) / CAST(SUM(CASE WHEN class IN ('1', '2') THEN 1 ELSE 0 END) AS DOUBLE) END AS r FROM nb JOIN cl ON cl.node = nb.other GROUP BY nb.node)""".replace("SELECT node, CASE", "SELECT nb.node, CASE")
DEGREES = "deg AS (SELECT node, CAST(SUM(o) AS BIGINT) AS out_degree, CAST(SUM(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM ed UNION ALL SELECT dst, 0, 1 FROM ed) x GROUP BY node)"
SDN = """sdn AS (SELECT CAST(p_partkey AS VARCHAR) AS ent_num, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS sdn_name,
  CASE p_size % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'vessel' WHEN 2 THEN 'organization' WHEN 3 THEN 'aircraft' ELSE 'other' END AS entity_type,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS program FROM part)"""
TARGETS = """tgt AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' WHEN 2 THEN 'vessel' ELSE 'other' END AS entity_type,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '1970-01-01' END AS birth_date, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'c' || CAST(s_nationkey AS VARCHAR) || ',c' || CAST(s_nationkey + 1 AS VARCHAR) END AS countries,
  CASE WHEN s_suppkey % 2 = 0 THEN 'opensanctions_sanctions' ELSE 'opensanctions_peps' END AS source_system FROM supplier)"""
ENTITIES = """ent AS (SELECT sha256('ofac:' || ent_num) AS entity_id, 'ofac' AS source_system, ent_num AS source_entity_id, sdn_name AS primary_name, entity_type, program AS watchlist_program, CAST(NULL AS VARCHAR) AS birth_date, CAST(NULL AS VARCHAR) AS countries FROM sdn
  UNION ALL SELECT sha256(source_system || ':' || id), source_system, id, name, entity_type, 'PRG', birth_date, countries FROM tgt)"""
