"""The registered queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .views import NOW

_M = """m AS (
  SELECT o_orderkey AS match_id, o_custkey AS series_id, CAST(c_nationkey AS BIGINT) AS league_id,
         CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1000000 END AS r, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS d,
         CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS win, o_orderdate AS t
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_L = """l AS (
  SELECT CAST(n_nationkey AS BIGINT) AS league_id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'tier1' WHEN 1 THEN 'tier2' WHEN 2 THEN 'tier3' WHEN 3 THEN 'unknown' END AS tier,
         CASE n_nationkey % 5 WHEN 0 THEN 'professional' WHEN 1 THEN 'premium' WHEN 2 THEN 'excluded' WHEN 3 THEN 'amateur' END AS valve FROM nation)"""
_P = """p AS (
  SELECT l_orderkey AS match_id, CAST(l_quantity AS INT) - 1 AS minute, 0.01::DOUBLE + 9.8::DOUBLE * l_discount AS p, 'v' || l_linestatus AS model_version, l_shipdate AS predicted_at,
         CASE l_returnflag WHEN 'A' THEN 'professional' WHEN 'N' THEN 'excluded' END AS valve_tier, l_suppkey % 25 AS league_id, l_partkey AS k1, l_suppkey AS k2, l_extendedprice AS k3
  FROM lineitem)"""
_SEG = """CASE WHEN p.valve_tier IN ('professional', 'premium') THEN CASE WHEN (CASE WHEN coalesce(nullif(l.tier, ''), 'unknown') = 'unknown' AND p.valve_tier = 'premium' THEN 'tier1' ELSE coalesce(nullif(l.tier, ''), 'unknown') END) = 'tier1' THEN 'tier1' ELSE 'pro' END
  WHEN p.valve_tier IN ('excluded', 'amateur') THEN 'excluded' END"""
_S = f"""{_M}, {_L}, {_P}, ps AS (SELECT p.*, {_SEG} AS segment FROM p LEFT JOIN l ON p.league_id = l.league_id),
s AS (
  SELECT * FROM (SELECT ps.*, m.win, m.t, row_number() OVER (PARTITION BY ps.match_id, minute, model_version, segment ORDER BY predicted_at, k1, k2, k3) AS rn
    FROM ps JOIN m ON ps.match_id = m.match_id WHERE m.win IS NOT NULL) WHERE rn = 1)"""
_SER = """ser AS (
  SELECT c_custkey AS series_id, CAST(c_nationkey AS BIGINT) AS league_id, c_custkey AS a, c_custkey + 1000000 AS b,
         CASE c_custkey % 5 WHEN 0 THEN 'bo1' WHEN 1 THEN 'bo2' WHEN 2 THEN 'bo3' WHEN 3 THEN 'bo5' END AS format, c_custkey % 7 = 0 AS is_draw FROM customer)"""
_SC = f"""{_M}, {_SER}, sc AS (
  SELECT ser.*, CAST(count(*) FILTER (win AND r = a OR NOT win AND d = a) AS BIGINT) AS sa, CAST(count(*) FILTER (win AND r = b OR NOT win AND d = b) AS BIGINT) AS sb
  FROM ser LEFT JOIN m ON ser.series_id = m.series_id AND m.win IS NOT NULL GROUP BY ALL)"""
_RES = f"""{_SC}, pl AS (SELECT series_id, min(t) AS first_t, max(t) AS last_t, count(*) AS maps, string_agg(match_id::VARCHAR, ',' ORDER BY t NULLS LAST, match_id) AS ids FROM m GROUP BY series_id),
res AS (
  SELECT sc.*, coalesce(maps, 0) AS maps, coalesce(ids, '') AS ids, first_t,
    NOT is_draw AND sa <> sb AND coalesce(date_diff('second', last_t, TIMESTAMP '{NOW}') >= 43200, false) AS inferred
  FROM sc LEFT JOIN pl ON sc.series_id = pl.series_id),
out AS (SELECT *, CASE WHEN inferred THEN CASE WHEN sa > sb THEN a ELSE b END END AS winner FROM res)"""
_T = """two AS (SELECT match_id, t, 'radiant' AS side, r AS team, win AS won FROM m WHERE win IS NOT NULL AND t IS NOT NULL UNION ALL SELECT match_id, t, 'dire', d, NOT win FROM m WHERE win IS NOT NULL AND t IS NOT NULL),
nb AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY t, match_id) AS n FROM two)"""
_ST = """st AS (
  SELECT n_nationkey * 10 + k AS stage_id, CAST(n_nationkey AS BIGINT) AS league_id, ['bo1', 'bo3', 'bo5'][k + 1] AS fmt, [1, 3, 5][k + 1] AS most,
         DATE '1992-01-01' + CAST(k * 700 + n_nationkey * 10 AS INT) AS s, DATE '1992-01-01' + CAST(k * 700 + n_nationkey * 10 + 900 AS INT) AS e
  FROM nation, (SELECT unnest([0, 1, 2]) AS k))"""
_BUCKET = "CASE least(minute // 5 * 5, 30) WHEN 0 THEN '0-4' WHEN 5 THEN '5-9' WHEN 10 THEN '10-14' WHEN 15 THEN '15-19' WHEN 20 THEN '20-24' WHEN 25 THEN '25-29' ELSE '30+' END"


def _r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


_LL = "-ln(CASE WHEN win THEN greatest(least(p, 1 - 1e-15), 1e-15) ELSE 1 - greatest(least(p, 1 - 1e-15), 1e-15) END)"
_AGE = "date_diff('second', b.t, x.t)::DOUBLE"
_DECAY = f"pow(0.5::DOUBLE, {_AGE} / (86400.0::DOUBLE * 30.0::DOUBLE))"
_SIG = "(1 / (1 + exp(-greatest(least({z}, 20.0::DOUBLE), -20.0::DOUBLE))))"
_PICKS = f"""{_M}, pk AS (
  SELECT DISTINCT l_orderkey AS match_id, l_partkey % 127 AS hero_id, l_linenumber % 2 = 1 AS is_radiant FROM lineitem),
pj AS (SELECT pk.*, m.t, (is_radiant = m.win)::INT AS w FROM pk JOIN m USING (match_id) WHERE m.win IS NOT NULL),
pm AS (SELECT hero_id, t, match_id, sum(w) AS w, count(*) AS n FROM pj GROUP BY ALL),
pr AS (
  SELECT hero_id, match_id, (coalesce(sum(w) OVER b, 0) + 25.0::DOUBLE) / (coalesce(sum(n) OVER b, 0) + 50.0::DOUBLE) AS rate FROM pm
  WINDOW b AS (PARTITION BY hero_id ORDER BY t, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hw AS (SELECT pj.match_id, pj.hero_id, pj.is_radiant, rate FROM pj JOIN pr USING (hero_id, match_id))"""
_ORD = f"""{_M}, o AS (SELECT match_id, t, row_number() OVER (ORDER BY t, match_id) - 1 AS place, count(*) OVER () AS total FROM m WHERE {{cond}})"""

ORACLE = {
    "q01_scored_metrics": f"""WITH {_S} SELECT model_version, segment, {_BUCKET} AS bucket, {_r4(f"avg({_LL})")} AS log_loss, {_r4("avg(pow(p - win::INT, 2))")} AS brier,
      {_r4("avg(((p >= 0.5) = win)::INT)")} AS accuracy, count(*) AS n, count(DISTINCT match_id) AS matches FROM s GROUP BY ALL""",
    "m06_reliability": f"""WITH {_S} SELECT model_version, CAST(least(floor(p * 10), 9) AS INT) AS bin, {_r4("avg(p)")} AS predicted, {_r4("avg(win::INT)")} AS observed, count(*) AS n FROM s GROUP BY ALL""",
    "q06_calibration_error": f"""WITH {_S}, b AS (SELECT model_version, segment, least(floor(p * 10), 9) AS bin, abs(avg(win::INT) - avg(p)) * count(*) AS gap, count(*) AS n FROM s GROUP BY ALL)
      SELECT model_version, segment, {_r4("sum(gap) / sum(n)")} AS ece FROM b GROUP BY ALL""",
    "q03_versions": f"WITH {_S} SELECT model_version, count(*) AS n FROM s GROUP BY ALL",
    "q04_serving_progress": f"WITH {_P} SELECT model_version, count(DISTINCT match_id) AS matches, min(predicted_at) AS first_at, max(predicted_at) AS last_at FROM p GROUP BY ALL",
    "q05_segment_counts": f"""WITH {_L}, {_P}, ps AS (SELECT p.*, {_SEG} AS segment FROM p LEFT JOIN l ON p.league_id = l.league_id),
      c AS (SELECT model_version, segment, count(DISTINCT match_id) AS n FROM ps GROUP BY ALL)
      SELECT v.model_version, g.segment, coalesce(c.n, 0) AS matches FROM (SELECT DISTINCT model_version FROM p) v CROSS JOIN (SELECT unnest(['tier1', 'pro', 'excluded']) AS segment) g
      LEFT JOIN c ON c.model_version = v.model_version AND c.segment = g.segment UNION ALL SELECT model_version, segment, n FROM c WHERE segment IS NULL""",
    "w01_game_numbers": f"""WITH {_M}, {_SER}, g AS (SELECT match_id, series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t NULLS LAST, match_id) AS INT) AS game FROM m)
      SELECT match_id, game, game > CASE format WHEN 'bo1' THEN 1 WHEN 'bo2' THEN 2 WHEN 'bo3' THEN 2 WHEN 'bo5' THEN 3 END AS is_conditional FROM g JOIN ser USING (series_id)""",
    "a09_series_scores": f"""WITH {_SC}, f AS (SELECT *, coalesce(format, 'bo1') AS fm, CASE coalesce(format, 'bo1') WHEN 'bo1' THEN 1 WHEN 'bo2' THEN 2 WHEN 'bo3' THEN 2 ELSE 3 END AS need FROM sc),
      o AS (SELECT *, CASE WHEN fm = 'bo2' THEN sa + sb >= 2 ELSE sa >= need OR sb >= need END AS over FROM f)
      SELECT series_id, sa AS score_a, sb AS score_b, CASE WHEN over AND NOT (fm = 'bo2' AND sa = sb) THEN CASE WHEN fm = 'bo2' THEN sa > sb ELSE sa >= need END END AS winner_is_a,
        fm = 'bo2' AND over AND sa = sb AS drawn, over AS is_decided FROM o""",
    "w18_series_wins_before": f"""WITH {_M}, g AS (SELECT *, CASE WHEN win THEN r WHEN NOT win THEN d END AS winner, row_number() OVER (PARTITION BY series_id ORDER BY t NULLS LAST, match_id) AS game FROM m)
      SELECT x.match_id, count(*) FILTER (b.winner = x.r) AS radiant_series_wins, count(*) FILTER (b.winner = x.d) AS dire_series_wins
      FROM g x LEFT JOIN g b ON b.series_id = x.series_id AND b.game < x.game GROUP BY x.match_id""",
    "w05_team_history": f"""WITH {_M}, {_T}, h AS (
        SELECT x.match_id, x.side, sum(CASE WHEN {_AGE} <= 120 * 86400 THEN {_DECAY} END) AS total, sum(CASE WHEN {_AGE} <= 120 * 86400 THEN {_DECAY} * b.won::INT END) AS wins,
               count(b.n) FILTER ({_AGE} <= 86400) AS m24, min({_AGE}) AS rest
        FROM nb x LEFT JOIN nb b ON b.team = x.team AND b.n < x.n AND b.n >= x.n - 400 GROUP BY ALL)
      SELECT match_id, side, {_r4("CASE WHEN total > 0 THEN wins / total ELSE 0.5 END")} AS form, m24 AS maps_24h, {_r4("rest / 86400.0::DOUBLE")} AS rest_days FROM h""",
    "w09_head_to_head": f"""WITH {_M}, q AS (SELECT match_id, t, least(r, d) AS lo, r, (win = (r = least(r, d))) AS low_won, row_number() OVER (PARTITION BY least(r, d), greatest(r, d) ORDER BY t, match_id) AS n FROM m WHERE win IS NOT NULL AND t IS NOT NULL),
      h AS (SELECT x.match_id, any_value(x.r = x.lo) AS is_low, sum(CASE WHEN {_AGE} <= 180 * 86400 THEN {_DECAY} END) AS total, sum(CASE WHEN {_AGE} <= 180 * 86400 THEN {_DECAY} * b.low_won::INT END) AS wins
        FROM q x LEFT JOIN q b ON b.lo = x.lo AND b.n < x.n AND b.n >= x.n - 100 GROUP BY x.match_id),
      s AS (SELECT match_id, is_low, CASE WHEN total > 0 THEN wins / total ELSE 0.5 END AS share FROM h)
      SELECT match_id, {_r4("CASE WHEN is_low THEN share ELSE 1 - share END")} AS h2h FROM s""",
    "w02_hero_winrates": f"WITH {_PICKS} SELECT match_id, hero_id, is_radiant, {_r4('rate')} AS winrate FROM hw",
    "w03_draft_advantage": f"WITH {_PICKS} SELECT match_id, {_r4('coalesce(avg(rate) FILTER (is_radiant) - avg(rate) FILTER (NOT is_radiant), 0.0)')} AS draft_advantage FROM hw GROUP BY match_id",
    "w20_as_of": """WITH r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click'), x AS (SELECT event_id, user_id, ts AS at_ FROM events WHERE event_type = 'purchase')
      SELECT x.event_id, r.value AS as_of_value FROM x ASOF LEFT JOIN r ON x.user_id = r.user_id AND x.at_ >= r.ts""",
    "q07_recent": f"""WITH {_M}, {_L}, {_P}, pro AS (SELECT DISTINCT m.match_id, m.t, m.win, m.league_id FROM p JOIN m ON p.match_id = m.match_id WHERE m.win IS NOT NULL AND p.valve_tier IN ('professional', 'premium')),
      top AS (SELECT * FROM pro ORDER BY t DESC NULLS LAST, match_id DESC LIMIT 20), pm AS (SELECT p.match_id, minute, max(p) AS p FROM p JOIN top USING (match_id) GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY minute) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS c FROM pm),
      th AS (SELECT match_id, unnest(CASE WHEN any_value(c) <= 30 THEN range(any_value(c)) ELSE [CASE WHEN k = 29 THEN any_value(c) - 1 ELSE CAST(floor(k * (any_value(c) / 30.0::DOUBLE)) AS BIGINT) END for k in range(30)] END) AS i FROM n GROUP BY match_id),
      cv AS (SELECT n.match_id, string_agg(minute || ':' || CAST(floor(p * 1000 + 0.5) AS BIGINT), ',' ORDER BY minute) AS curve FROM n JOIN th ON n.match_id = th.match_id AND n.i = th.i GROUP BY n.match_id),
      te AS (SELECT match_id, min(minute) FILTER (minute BETWEEN 10 AND 14) AS tenth FROM pm GROUP BY match_id), vt AS (SELECT match_id, max(valve_tier) AS valve FROM p GROUP BY match_id)
      SELECT top.match_id, top.win AS radiant_win, top.league_id, CASE WHEN coalesce(l.tier, 'unknown') = 'unknown' AND vt.valve = 'premium' THEN 'tier1' ELSE coalesce(l.tier, 'unknown') END AS tier, tenth AS tenth_minute, curve
      FROM top JOIN cv USING (match_id) JOIN te USING (match_id) JOIN vt USING (match_id) LEFT JOIN l ON top.league_id = l.league_id""",
    "q14_calendar": f"""WITH {_M}, {_L}, {_ST}, g AS (SELECT league_id, min(t) AS first_at, max(t) AS last_at, count(*) AS maps FROM m GROUP BY league_id), k AS (SELECT league_id, count(*) AS stages FROM st GROUP BY league_id)
      SELECT league_id, name, first_at, last_at, maps, coalesce(stages, 0) AS stages,
        CASE WHEN league_id % 6 = 1 THEN 'current' WHEN date_diff('second', last_at, TIMESTAMP '{NOW}') BETWEEN 0 AND 108000 THEN 'current' ELSE 'past' END AS status
      FROM l JOIN g USING (league_id) LEFT JOIN k USING (league_id)""",
    "q15_league_counts": f"WITH {_SER} SELECT league_id, count(*) AS series, count(*) FILTER (is_draw) AS draws, count(*) FILTER (format IS NULL) AS without_format FROM ser GROUP BY league_id",
    "q16_series_results": f"WITH {_RES} SELECT series_id, maps, ids AS match_ids, winner AS winner_team_id, CASE WHEN inferred THEN 'maps' END AS outcome_source FROM out",
    "q17_participants": f"""WITH {_RES}, sides AS (SELECT league_id, series_id, first_t, 0 AS side, a AS team, sa AS own, sb AS other, winner, is_draw FROM out UNION ALL SELECT league_id, series_id, first_t, 1, b, sb, sa, winner, is_draw FROM out),
      t AS (SELECT league_id, team AS team_id, count(*) FILTER (NOT is_draw AND winner = team) AS series_won, count(*) FILTER (NOT is_draw AND winner <> team) AS series_lost, count(*) FILTER (is_draw) AS series_drawn,
        CAST(sum(own) AS BIGINT) AS maps_won, CAST(sum(other) AS BIGINT) AS maps_lost, min(first_t) AS f, min(series_id) AS si, min(side) AS sd FROM sides GROUP BY ALL)
      SELECT league_id, team_id, series_won, series_lost, series_drawn, maps_won, maps_lost,
        CAST(row_number() OVER (PARTITION BY league_id ORDER BY series_won DESC, series_lost, maps_won - maps_lost DESC, f NULLS LAST, si, sd) AS INT) AS place FROM t""",
    "q18_unresolved": f"""WITH {_M}, {_P} SELECT match_id FROM p WHERE match_id NOT IN (SELECT match_id FROM m WHERE win IS NOT NULL) AND match_id NOT IN (SELECT user_id FROM events WHERE user_id % 2 = 0)
      GROUP BY match_id HAVING date_diff('second', max(predicted_at), TIMESTAMP '{NOW}') > 600""",
    "q19_missing_details": f"WITH {_M} SELECT match_id FROM m WHERE match_id NOT IN (SELECT user_id * 4 FROM events) ORDER BY t DESC NULLS LAST, match_id DESC LIMIT 50",
    "q20_league_context": f"""WITH {_L}, {_ST}, c AS (SELECT league_id, arg_max(fmt, s) AS format FROM st WHERE s <= TIMESTAMP '1994-06-01' AND e >= TIMESTAMP '1994-06-01' GROUP BY league_id)
      SELECT league_id, tier, valve AS valve_tier, format FROM l LEFT JOIN c USING (league_id)""",
    "q22_team_history": f"WITH {_M} SELECT team_id, count(*) AS maps FROM (SELECT r AS team_id FROM m UNION ALL SELECT d FROM m) WHERE team_id > 0 GROUP BY team_id",
    "q23_place_series": f"""WITH {_M}, {_SER}, {_ST}, f AS (SELECT series_id, CAST(min(t) AS DATE) AS day, count(*) AS maps FROM m GROUP BY series_id),
      c AS (SELECT series_id, maps, count(stage_id) AS covering, count(*) FILTER (most >= maps) AS possible, count(DISTINCT fmt) FILTER (most >= maps) AS formats,
          min(stage_id) AS any_id, arg_min(fmt, stage_id) AS any_f, min(stage_id) FILTER (most >= maps) AS fit_id, arg_min(fmt, stage_id) FILTER (most >= maps) AS fit_f
        FROM f JOIN ser USING (series_id) LEFT JOIN st ON st.league_id = ser.league_id AND day BETWEEN s - 1 AND e + 1 WHERE day IS NOT NULL GROUP BY ALL)
      SELECT series_id, CASE WHEN covering = 1 THEN any_id WHEN possible = 1 OR formats = 1 THEN fit_id END AS stage_id, CASE WHEN covering = 1 THEN any_f WHEN possible = 1 OR formats = 1 THEN fit_f END AS default_format,
        CASE WHEN covering = 0 THEN 'no stage covers the dates' WHEN covering = 1 THEN 'single stage covers the dates' WHEN possible = 1 THEN 'map count ruled out the other stages'
          WHEN possible = 0 THEN 'map count fits no covering stage' WHEN formats = 1 THEN 'overlapping stages agree on the format' ELSE 'several stages overlap and disagree on the format' END AS reason FROM c""",
    "q26_backfill": f"""WITH {_P}, {_L}, n AS (SELECT user_id AS match_id, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS k FROM events GROUP BY user_id),
      f AS (SELECT coalesce(CASE WHEN p.league_id % 3 > 0 THEN p.league_id END, CAST(nullif(n.k, '0') AS BIGINT)) AS league_id, minute FROM p LEFT JOIN n USING (match_id))
      SELECT f.league_id, l.valve AS valve_tier, count(*) AS n, CAST(sum(minute) AS BIGINT) AS minutes FROM f LEFT JOIN l ON f.league_id = l.league_id GROUP BY ALL""",
    "q27_league_evidence": f"""WITH {_M}, b AS (SELECT league_id, CAST(min(t) AS DATE) AS first_match, CAST(max(t) AS DATE) AS last_match, count(DISTINCT r) AS team_count,
          CASE WHEN arg_max(win, (t, match_id)) FILTER (win IS NOT NULL AND t IS NOT NULL) THEN arg_max(r, (t, match_id)) FILTER (win IS NOT NULL AND t IS NOT NULL) ELSE arg_max(d, (t, match_id)) FILTER (win IS NOT NULL AND t IS NOT NULL) END AS ch FROM m GROUP BY league_id),
      n AS (SELECT league_id, string_agg(DISTINCT 'team ' || team % 9, ',' ORDER BY 'team ' || team % 9) AS teams FROM (SELECT league_id, r AS team FROM m UNION ALL SELECT league_id, d FROM m) GROUP BY league_id)
      SELECT league_id, first_match, last_match, team_count, teams, 'team ' || ch % 9 AS champion FROM b JOIN n USING (league_id)""",
    "k06_fill_gaps": f"""WITH {_L}, o AS (SELECT * FROM l WHERE league_id < 18), n AS (SELECT league_id, 'x' || name AS name, coalesce(tier, 'filled') AS tier, coalesce(valve, 'new') AS valve FROM l WHERE league_id > 5)
      SELECT coalesce(o.league_id, n.league_id) AS league_id, coalesce(o.name, n.name) AS name, coalesce(o.tier, n.tier) AS tier, coalesce(o.valve, n.valve) AS valve_tier FROM o FULL JOIN n ON o.league_id = n.league_id""",
    "k01_latest_payload": "SELECT user_id AS match_id, event_type AS source, arg_max(event_id, (ts, -event_id)) AS id FROM events GROUP BY ALL",
    "d14_spread_sample": f"""WITH {_ORD.format(cond='t IS NOT NULL')} SELECT match_id FROM o WHERE total <= 600 OR place IN (SELECT CAST(round_even(i * ((SELECT count(*) FROM m WHERE t IS NOT NULL) - 1) / 599.0::DOUBLE, 0) AS BIGINT) FROM range(600) r(i))""",
    "l01_time_split": f"""WITH {_ORD.format(cond='win IS NOT NULL')}, z AS (SELECT *, greatest(1, CAST(round_even(total * 0.2::DOUBLE, 0) AS BIGINT)) AS h, greatest(1, CAST(round_even(total * 0.1::DOUBLE, 0) AS BIGINT)) AS v FROM o)
      SELECT CASE WHEN place >= total - h THEN 'holdout' WHEN place >= total - h - v THEN 'validation' ELSE 'train' END AS part, count(*) AS matches, min(t) AS first_at, max(t) AS last_at FROM z GROUP BY ALL""",
    "f28_weights": f"""WITH {_M}, {_L}, x AS (SELECT m.league_id, tier, date_diff('second', t, (SELECT max(t) FROM m))::DOUBLE / 86400.0::DOUBLE AS age FROM m LEFT JOIN l ON m.league_id = l.league_id)
      SELECT league_id, {_r4("sum(CASE tier WHEN 'tier1' THEN 1.0::DOUBLE WHEN 'tier2' THEN 0.6::DOUBLE WHEN 'tier3' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * exp(-ln(2.0::DOUBLE) / 180.0::DOUBLE * age))")} AS weight FROM x GROUP BY league_id""",
    "m13_drift": f"""WITH {_S}, k AS (SELECT *, predicted_at >= TIMESTAMP '1998-01-15' - INTERVAL 7 DAYS AS recent FROM s),
      b AS (SELECT model_version, segment, recent, least(floor(p * 10), 9) AS bin, abs(avg(win::INT) - avg(p)) * count(*) AS gap, count(*) AS n FROM k GROUP BY ALL),
      e AS (SELECT model_version, segment, recent, sum(gap) / sum(n) AS ece FROM b GROUP BY ALL), c AS (SELECT model_version, segment, recent, count(DISTINCT match_id) AS n FROM k GROUP BY ALL),
      w AS (SELECT e.model_version, e.segment, max(ece) FILTER (e.recent) AS re, max(ece) FILTER (NOT e.recent) AS ee, max(n) FILTER (e.recent) AS rm, max(n) FILTER (NOT e.recent) AS em
        FROM e JOIN c ON e.model_version = c.model_version AND e.segment = c.segment AND e.recent = c.recent GROUP BY ALL),
      v AS (SELECT *, least(coalesce(rm, 0), coalesce(em, 0)) AS least_n FROM w), u AS (SELECT *, CASE WHEN least_n >= 40 THEN greatest(0.077::DOUBLE * sqrt(85.0::DOUBLE / least_n), 0.02::DOUBLE) END AS th, CASE WHEN least_n >= 40 THEN re - ee END AS rise FROM v)
      SELECT model_version, segment, rm AS recent_matches, em AS earlier_matches, {_r4('rise')} AS rise, CASE WHEN rise IS NULL THEN 'not enough data' WHEN rise > th THEN 'drifting' WHEN rise < -th THEN 'improving' ELSE 'ok' END AS verdict FROM u""",
    "t04_minutes": """WITH a AS (SELECT vec_id AS match_id, [CAST(floor(x * 1000) AS INT) for x in embedding] AS v, unnest(range(71))::INT AS minute FROM embeddings)
      SELECT match_id, minute, v[least(minute + 1, len(v))] AS at, v[least(minute + 2, len(v))] AS lead FROM a""",
    "f02_spread": f"WITH a AS (SELECT vec_id AS match_id, unnest([floor(x * 1000) for x in embedding])::DOUBLE AS x FROM embeddings) SELECT match_id, {_r4('stddev_pop(x) / 100')} AS spread FROM a GROUP BY match_id",
    "t21_masks": "SELECT p_partkey, CAST(bit_count(((p_partkey * 37) % 2048)::INT) AS BIGINT) AS towers, CAST(bit_count(((p_partkey * 11) % 64)::INT) AS BIGINT) AS barracks FROM part",
    "f15_priors": f"""WITH s AS (SELECT s_suppkey, s_acctbal / 400 AS mu, 1.0::DOUBLE + s_suppkey % 8 AS sigma FROM supplier),
      z AS (SELECT *, {_SIG.format(z='0.055::DOUBLE + 0.12::DOUBLE * ((mu - 3 * sigma) - (25.0::DOUBLE - 3 * 8.0::DOUBLE))')} AS prior, {_SIG.format(z='0.067223::DOUBLE + 0.005293::DOUBLE * mu + -0.003425::DOUBLE * sigma')} AS base FROM s)
      SELECT s_suppkey, {_r4('prior')} AS prior, {_r4('greatest(least(prior, 0.99::DOUBLE), 0.01::DOUBLE)')} AS served, {_r4('2 * prior * (1 - prior)')} AS p11, {_r4('base')} AS baseline FROM z""",
    "x01_names": r"""WITH r AS (SELECT p_partkey, lower(p_name || '/The-' || p_brand || ' Season ' || p_size) AS s FROM part)
      SELECT p_partkey, array_to_string([w for w in string_split(trim(regexp_replace(regexp_replace(regexp_replace(s, '[/_]+', ' ', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')
        if w <> '' AND w NOT IN ('dota', 'dota2', 'the', 'presented', 'by', 'powered', 'season', 'tournament', 'esports')], ' ') AS name,
        trim(regexp_replace(regexp_replace(s, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS team FROM r""",
    "x08_descriptions": f"""WITH d AS (SELECT p_partkey, p_size, p_partkey % 12 + 1 AS m1, (p_partkey + 1) % 12 + 1 AS m2 FROM part),
      e AS (SELECT *, make_date(CASE WHEN m2 < m1 THEN 2023 ELSE 2024 END, m1, 3) AS s, make_date(2024, m2, 9) AS e FROM d)
      SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE 'tier' || p_size % 4 END AS tier, true AS is_lan, s AS start_date, e AS end_date, CAST(p_size AS INT) AS team_count, (1000 + p_size)::DOUBLE AS prize_pool, 'USD' AS currency,
        {_r4("CASE WHEN date_diff('day', greatest(s, DATE '2024-03-01'), least(e, DATE '2024-06-30')) + 1 <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (date_diff('day', greatest(s, DATE '2024-03-01'), least(e, DATE '2024-06-30')) + 1) / 122.0::DOUBLE) END")} AS overlap FROM e""",
    "a21_table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "d18_conflicts": """WITH p AS (SELECT c_custkey AS league_id, c_custkey % 60 AS page_title FROM customer WHERE c_custkey % 3 = 0), c AS (SELECT *, count(*) OVER (PARTITION BY page_title) AS claims FROM p)
      SELECT * FROM c WHERE claims > 1""",
    "a17_busiest": f"""WITH {_M}, g AS (SELECT league_id, count(*) AS maps FROM m WHERE t >= TIMESTAMP '{NOW}' - INTERVAL 365 DAYS GROUP BY league_id)
      SELECT league_id, maps, CAST(row_number() OVER (ORDER BY maps DESC, league_id) AS INT) AS place FROM g""",
}
