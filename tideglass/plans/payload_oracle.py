"""The payload queries as DuckDB SQL: the same tables computed from the star schema's keys, without JSON."""

from __future__ import annotations

from .oracle import _AGE, _BUCKET, _DECAY, _L, _LL, _M, _P, _SER, _SIG, _T, _r4
from .payloads import EVENTS, KEYS, LANES

_K = """k AS (
  SELECT match_id AS k, series_id AS c, league_id, r, d, win, t, CAST(epoch(t) AS BIGINT) AS started, CAST((match_id * 7) % 500 + 700 AS INT) AS dur FROM m)"""
_SLOTS = """sl AS (SELECT *, CAST(unnest(range(10)) AS INT) AS s FROM k)"""
_ACC = "CASE WHEN NOT (k % 29 = 0 AND s = 9) THEN c * 10 + (s + CASE WHEN k % 2 = 0 THEN 0 ELSE 5 END) % 10 END"
_SLOT = "CASE WHEN s < 5 THEN s ELSE s + 123 END"
# buildings by id: side, kind, lane and name
_BLD = """bld AS (
  SELECT npc, npc <= 25 OR npc BETWEEN 38 AND 43 OR npc = 50 AS rad, CASE WHEN npc <= 35 THEN 'tower' WHEN npc <= 49 THEN 'barracks' ELSE 'ancient' END AS kind,
         CASE WHEN npc IN (25, 35, 50, 51) THEN 'base' ELSE ['top', 'mid', 'bot'][CAST((npc - CASE WHEN npc <= 24 THEN 16 WHEN npc <= 34 THEN 26 WHEN npc <= 43 THEN 38 ELSE 44 END) % 3 + 1 AS INT)] END AS lane,
         CASE WHEN npc <= 34 THEN (npc - CASE WHEN npc <= 24 THEN 16 ELSE 26 END) // 3 + 1 END AS tier, npc - CASE WHEN npc <= 43 THEN 38 ELSE 44 END < 3 AS melee
  FROM (SELECT CAST(unnest(range(16, 52)) AS INT) AS npc) WHERE npc NOT IN (36, 37)),
bn AS (
  SELECT *, 'npc_dota_' || CASE WHEN rad THEN 'goodguys_' ELSE 'badguys_' END || CASE WHEN kind = 'ancient' THEN 'fort' WHEN kind = 'barracks' THEN CASE WHEN melee THEN 'melee' ELSE 'range' END || '_rax_' || lane
    WHEN lane = 'base' THEN 'tower4' ELSE 'tower' || tier || '_' || lane END AS name FROM bld)"""
_B_OBJ = """bo AS (
  SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INT) AS ordinal, time, name, rad, kind, lane
  FROM (SELECT k, unnest(range(14)) AS i, CAST((k * 13 + unnest(range(14)) * 101) % 1200 AS INT) AS time, (k + unnest(range(14)) * 5) % 36 + 16 AS npc FROM k) JOIN bn USING (npc))"""
_A_OBJ = f"""ak AS (SELECT unnest({list(KEYS)}) AS key, unnest(range(8)) AS spot, unnest(['tower', 'tower', 'tower', 'barracks', NULL, 'ancient', 'tower', 'barracks']) AS kind,
  unnest([true, false, true, false, NULL, false, false, true]) AS rad, unnest(['top', 'mid', 'base', 'bot', NULL, 'base', 'bot', 'mid']) AS lane),
ai AS (SELECT k, CAST(unnest(range(16)) AS INT) AS i FROM k),
ao AS (SELECT k, i AS ordinal, CAST(i * 60 + (k + i) % 60 AS INT) AS time, {list(EVENTS)}[CAST((k + i) % 5 + 1 AS INT)] AS type, CAST((k + i) % 2 + 2 AS INT) AS team, CASE WHEN (k + i) % 5 = 2 THEN (k + i * 3) % 8 END AS spot FROM ai)"""
_BLDG = f"{_K}, {_BLD}, {_B_OBJ}, {_A_OBJ}"
_MIN = "mi AS (SELECT k, CAST(unnest(range(dur // 60 + 1)) AS INT) AS minute FROM {src})"
_LEAD = "CAST((k * 7 + least(minute + {shift}, {n} - 1) * 13) % 2001 - 1000 AS INT)"
#: Players' net worth at a minute, and kills up to it, summed by side.
_SIDES = f"""pw AS (
  SELECT mi.k, minute, s, CAST((mi.k + s * 31 + least(minute, (mi.k + s) % 8 + 7) * 97) % 9000 AS INT) AS worth,
         (SELECT count(*) FROM range(3) j(j) WHERE (mi.k * 11 + s * 37 + j * 401) % 1300 <= minute * 60) AS kills
  FROM mi, (SELECT unnest(range(10)) AS s) WHERE s < {{players}}),
ps AS (
  SELECT k, minute, CAST(sum(kills) FILTER (s < 5) AS INT) AS rs, CAST(sum(kills) FILTER (s >= 5) AS INT) AS ds, CAST(sum(worth) FILTER (s < 5) AS BIGINT) AS rw, CAST(sum(worth) FILTER (s >= 5) AS BIGINT) AS dw,
         stddev_pop(worth) FILTER (s < 5) AS rsp, stddev_pop(worth) FILTER (s >= 5) AS dsp FROM pw GROUP BY ALL)"""
#: Buildings that stand: each lane loses what was destroyed before the minute's end, never below none.
_STAND = """lost AS (SELECT mi.k, minute, rad, kind, lane, count(*) AS gone FROM mi JOIN {obj} o ON o.k = mi.k AND o.time < (minute + 1) * 60 WHERE kind IN ('tower', 'barracks') GROUP BY ALL),
full_base AS (SELECT * FROM (VALUES ('tower', 'top', 3), ('tower', 'mid', 3), ('tower', 'bot', 3), ('tower', 'base', 2), ('barracks', 'top', 2), ('barracks', 'mid', 2), ('barracks', 'bot', 2)) f(kind, lane, n), (VALUES (true), (false)) g(rad)),
st AS (
  SELECT k, minute, coalesce(sum(loss) FILTER (rad AND kind = 'tower'), 0) AS rt, coalesce(sum(loss) FILTER (NOT rad AND kind = 'tower'), 0) AS dt,
         coalesce(sum(loss) FILTER (rad AND kind = 'barracks'), 0) AS rb, coalesce(sum(loss) FILTER (NOT rad AND kind = 'barracks'), 0) AS db
  FROM (SELECT k, minute, rad, kind, least(gone, n) AS loss FROM lost JOIN full_base USING (rad, kind, lane)) GROUP BY ALL)"""
_TOWERS = "CAST(11 - coalesce(rt, 0) AS INT) AS radiant_towers, CAST(6 - coalesce(rb, 0) AS INT) AS radiant_barracks, CAST(11 - coalesce(dt, 0) AS INT) AS dire_towers, CAST(6 - coalesce(db, 0) AS INT) AS dire_barracks"
_PARSED = "k % 11 <> 0 AND k % 17 <> 0"
_STATES = f"""{_M}, {_BLDG}, pk AS (SELECT * FROM k WHERE {_PARSED}), {_MIN.format(src='pk')}, {_SIDES.format(players='CASE WHEN mi.k % 19 = 0 THEN 9 ELSE 10 END')}, {_STAND.format(obj='bo')},
pick AS (SELECT k, string_agg(h::VARCHAR, ',' ORDER BY i) AS picks FROM (SELECT k, i, (k + i * 3) % 127 AS h FROM k, (SELECT unnest([0, 4, 8]) AS i)) WHERE h > 0 GROUP BY k),
sb AS (SELECT mi.k, mi.minute, pk.win, {_LEAD.format(shift=1, n='(mi.k % 8 + 10)').replace('(k ', '(mi.k ').replace('minute +', 'mi.minute +')} AS gold, rs, ds, rw, dw, rsp, dsp, {_TOWERS}, coalesce(picks, '') AS picks
  FROM mi JOIN pk USING (k) JOIN ps USING (k, minute) LEFT JOIN st USING (k, minute) LEFT JOIN pick ON pick.k = mi.k)"""
_REASON = f"""CASE WHEN NOT ({_PARSED}) THEN 'not parsed' WHEN win IS NULL THEN 'no outcome to label with' WHEN dur < 720 THEN 'shorter than 12 minutes' WHEN k % 19 = 0 THEN 'incomplete roster'
  WHEN k % 23 = 0 THEN 'somebody abandoned' WHEN k % 13 = 0 OR r = 0 OR d = 0 THEN 'a side has no team' ELSE 'used' END"""
_BLOCK = ("skill_diff", "skill_sigma_sum", "established_diff", "form_diff", "h2h_advantage", "draft_advantage", "rest_days_diff", "maps_last_24h_diff")
_FEAT = f"""{_STATES}, {_SER}, {_L}, g AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t NULLS LAST, match_id) AS game, CASE WHEN win THEN r WHEN NOT win THEN d END AS winner FROM m),
sw AS (SELECT x.match_id, count(*) FILTER (b.winner = x.r) AS rwin, count(*) FILTER (b.winner = x.d) AS dwin FROM g x LEFT JOIN g b ON b.series_id = x.series_id AND b.game < x.game GROUP BY x.match_id),
cx AS (
  SELECT g.match_id AS k, g.game, ser.format, g.game > CASE format WHEN 'bo1' THEN 1 WHEN 'bo2' THEN 2 WHEN 'bo3' THEN 2 WHEN 'bo5' THEN 3 END AS cond, rwin, dwin,
         CASE WHEN g.league_id % 3 < 2 THEN g.league_id % 3 = 0 END AS lan FROM g JOIN ser USING (series_id) JOIN sw USING (match_id)),
ft AS (SELECT sb.*, cx.* EXCLUDE (k) FROM sb JOIN cx USING (k) WHERE k IN (SELECT k FROM k WHERE {_REASON} = 'used'))"""
_NET = "CASE WHEN net <> 0 THEN net ELSE worth END"
_LIVE = """c AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS n FROM customer),
sd AS (SELECT *, unnest([0, 1]) AS sh FROM c),
lp AS (SELECT k, sh, CAST(unnest(range(5)) AS INT) AS s FROM sd),
pl AS (SELECT k, sh, s, (k * 7 + s * 3 + sh) % 2000 AS account, CAST((k * 5 + s * 211 + sh) % 20000 AS INT) AS worth FROM lp),
ls AS (
  SELECT sd.k, sd.sh, CAST((sd.k + sd.sh) % 40 AS INT) AS score, CAST(CASE WHEN sd.k % 3 > 0 THEN (sd.k * 3 + sd.sh) % 50000 ELSE 0 END AS BIGINT) AS net, CAST(bit_count(((sd.k * 37 + sd.sh) % 2048)::INT) AS INT) AS towers,
         CAST(bit_count(((sd.k * 11 + sd.sh) % 64)::INT) AS INT) AS barracks, sum(worth)::BIGINT AS worth, coalesce(string_agg(account::VARCHAR, ',' ORDER BY s) FILTER (account > 0), '') AS accounts
  FROM sd JOIN pl ON pl.k = sd.k AND pl.sh = sd.sh GROUP BY ALL),
on_air AS (SELECT * FROM c WHERE k % 7 > 0 AND k % 10 > 0),
lv AS (
  SELECT on_air.k, n, CAST(floor(greatest((on_air.k * 17) % 3000 - 60, 0) / 60) AS INT) AS minute, a.score AS rsc, b.score AS dsc, CASE WHEN a.net <> 0 THEN a.net ELSE a.worth END AS rnw, CASE WHEN b.net <> 0 THEN b.net ELSE b.worth END AS dnw,
         a.towers AS rt, b.towers AS dt, a.barracks AS rb, b.barracks AS db, a.accounts AS acc
  FROM on_air JOIN ls a ON a.k = on_air.k AND a.sh = 0 JOIN ls b ON b.k = on_air.k AND b.sh = 1)"""
_COMPLETE = "k % 19 <> 0 AND k % 29 <> 0"
_CM = f"""m0 AS ({_M.removeprefix('m AS (').removesuffix(')')}), m AS (SELECT * FROM m0 WHERE win IS NOT NULL AND t IS NOT NULL AND match_id % 19 <> 0 AND match_id % 29 <> 0)"""


def _or(x: str, other: str) -> str:
    return f"coalesce({x}, {other})"


PAYLOAD_ORACLE = {
    "p06_match_players": f"""WITH {_M}, {_K}, {_SLOTS} SELECT k AS match_id, {_SLOT} AS player_slot, {_ACC} AS account_id, CAST((k + s * 11) % 127 AS INT) AS hero_id, s < 5 AS is_radiant,
        CASE WHEN (k + s) % 5 < 4 THEN CAST((k + s) % 5 + 1 AS INT) END AS lane_role, CAST((k + s) % 15 AS INT) AS kills, CASE WHEN k % 23 = 0 AND s = 3 THEN 3 ELSE 0 END AS leaver_status
        FROM sl WHERE k % 3 > 0 AND NOT (k % 19 = 0 AND s = 9)
      UNION ALL SELECT k, {_SLOT}, {_ACC}, CAST((k + s * 13) % 127 AS INT), s < 5, CAST((k + s) % 3 AS INT), CAST((k + s * 2) % 15 AS INT), NULL FROM sl WHERE k % 3 = 0""",
    "p07_match_drafts": f"""WITH {_M}, {_K}, i AS (SELECT k, CAST(unnest(range(10)) AS INT) AS i FROM k)
      SELECT k AS match_id, i AS "order", i % 2 = 0 AS is_pick, CAST(CASE WHEN i % 2 = 0 THEN (k + i * 3) % 127 ELSE (k + i * 5) % 127 END AS INT) AS hero_id, CASE WHEN i % 4 < 2 THEN 0 ELSE 1 END AS team FROM i WHERE k % 3 > 0
      UNION ALL SELECT k, i, i % 2 = 1, CAST((k + i * 3) % 127 AS INT), i % 2 FROM i WHERE k % 3 = 0 AND i < 8""",
    "p08_match_objectives": f"""WITH {_M}, {_BLDG} SELECT k AS match_id, ordinal, time, 'building_kill' AS type, CASE WHEN rad THEN 2 ELSE 3 END AS team, name AS key FROM bo WHERE k % 3 > 0
      UNION ALL SELECT k, ordinal, time, type, team, key FROM ao LEFT JOIN ak USING (spot) WHERE k % 3 = 0""",
    "p09_match_rows": f"""WITH {_M}, {_K} SELECT k AS match_id, win AS radiant_win, started, dur AS duration, CASE WHEN k % 3 > 0 THEN {_PARSED} ELSE k % 5 <> 0 END AS is_parsed, CASE WHEN k % 3 = 0 THEN 58 END AS patch FROM k""",
    "q11_timeline": f"""WITH {_M}, {_BLDG} SELECT k AS match_id, ordinal, CAST(time // 60 AS INT) AS minute, kind, rad AS is_radiant, lane FROM bo WHERE k % 3 > 0
      UNION ALL SELECT k, ordinal, CAST(time // 60 AS INT), CASE WHEN type = 'building_kill' THEN kind WHEN type LIKE '%ROSHAN%' THEN 'roshan' WHEN type LIKE '%AEGIS%' THEN 'aegis' ELSE 'first_blood' END,
        CASE WHEN type = 'building_kill' THEN rad ELSE team = 2 END, CASE WHEN type = 'building_kill' THEN lane END FROM ao LEFT JOIN ak USING (spot) WHERE k % 3 = 0 AND (type <> 'building_kill' OR kind IS NOT NULL)""",
    "p01_matches": f"""WITH {_M}, {_K} SELECT k AS match_id, nullif(league_id, 0) AS league_id, league_id <> 0 AND c % 97 <> 0 AS in_series, CASE WHEN k % 31 > 0 THEN nullif(r, 0) END AS radiant_team_id, nullif(d, 0) AS dire_team_id, win AS radiant_win, started,
      dur AS duration, k % 4 > 0 AS is_parsed FROM k""",
    "p01_teams": f"""WITH {_M}, {_K}, t AS (SELECT k, r AS team FROM k WHERE k % 31 > 0 AND r <> 0 UNION ALL SELECT k, d FROM k WHERE d <> 0)
      SELECT 'team' AS kind, team AS id, 'T' || team || '-' || max(k) % 3 AS name FROM t GROUP BY team UNION ALL SELECT 'league', league_id, 'L' || max(k) FROM k WHERE league_id <> 0 GROUP BY league_id""",
    "p01_series": f"""WITH {_M}, {_K}, f AS (SELECT league_id, c % 97 AS vs, min(k) AS k FROM k WHERE league_id <> 0 AND c % 97 <> 0 GROUP BY ALL)
      SELECT f.league_id, vs AS valve_series_id, CASE WHEN f.k % 31 > 0 THEN nullif(r, 0) END AS team_a_id, nullif(d, 0) AS team_b_id, CAST(f.k % 3 AS INT) AS valve_series_type FROM f JOIN k ON k.k = f.k""",
    "t12_snapshots_b": f"""WITH {_STATES} SELECT k AS match_id, minute, win AS radiant_win, gold AS gold_adv, rs AS radiant_score, ds AS dire_score, rw AS radiant_net_worth, dw AS dire_net_worth,
      radiant_towers, radiant_barracks, dire_towers, dire_barracks, picks AS radiant_picks, {_r4('rsp')} AS radiant_spread FROM sb""",
    "t13_snapshots_a": f"""WITH {_M}, {_BLDG}, pa AS (SELECT * FROM k WHERE k % 5 <> 0), {_MIN.format(src='pa')}, {_SIDES.format(players=10)},
      aob AS (SELECT k, time, rad, kind, lane FROM ao JOIN ak USING (spot) WHERE kind IS NOT NULL), {_STAND.format(obj='aob')},
      ro AS (SELECT mi.k, mi.minute, count(*) AS n, max(time) AS last FROM mi JOIN ao o ON o.k = mi.k AND o.time < (mi.minute + 1) * 60 WHERE type = 'CHAT_MESSAGE_ROSHAN_KILL' GROUP BY ALL),
      ae AS (SELECT mi.k, mi.minute, max(time) AS last, arg_max(team, ordinal) AS team FROM mi JOIN ao o ON o.k = mi.k AND o.time < (mi.minute + 1) * 60 WHERE type LIKE '%AEGIS%' GROUP BY ALL)
      SELECT mi.k AS match_id, mi.minute, {_LEAD.format(shift=0, n='(mi.k % 8 + 10)').replace('(k ', '(mi.k ').replace('minute +', 'mi.minute +')} AS gold_adv, rs AS radiant_score, ds AS dire_score, rw AS radiant_net_worth, dw AS dire_net_worth, {_TOWERS},
        CAST(coalesce(ro.n, 0) AS INT) AS roshan_kills, CASE WHEN (mi.minute + 1) * 60 - ae.last <= 300 THEN ae.team = 2 END AS aegis_is_radiant,
        CASE WHEN ro.last + 570 - (mi.minute + 1) * 60 > 0 THEN ro.last + 570 - (mi.minute + 1) * 60 END AS roshan_respawn_in
      FROM mi JOIN ps USING (k, minute) LEFT JOIN st USING (k, minute) LEFT JOIN ro ON ro.k = mi.k AND ro.minute = mi.minute LEFT JOIN ae ON ae.k = mi.k AND ae.minute = mi.minute""",
    "f01_featurize": f"""WITH {_FEAT} SELECT k AS match_id, minute, win AS radiant_win, {_r4('ln(minute + 1)')} AS log_minute, {_r4('gold')} AS gold_adv, {_r4('gold / (minute + 5.0::DOUBLE)')} AS gold_adv_norm,
      {_r4('radiant_towers - dire_towers')} AS tower_diff, {_r4('radiant_barracks - dire_barracks')} AS barracks_diff, {_r4('radiant_towers')} AS radiant_towers, {_r4('dire_towers')} AS dire_towers, {_r4('rs - ds')} AS kill_diff,
      {_r4('rw - dw')} AS net_worth_diff, {_r4('rsp')} AS radiant_nw_spread, {_r4('dsp')} AS dire_nw_spread, {_r4('coalesce(lan::INT, 0)')} AS is_lan, {_r4('(lan IS NOT NULL)::INT')} AS is_lan_known, {_r4('(format IS NOT NULL)::INT')} AS series_format_known,
      {_r4('game')} AS game_in_series, {_r4('coalesce(cond::INT, 0)')} AS is_conditional_game, {_r4("CASE coalesce(format, 'bo1') WHEN 'bo1' THEN 1 WHEN 'bo2' THEN 2 WHEN 'bo3' THEN 3 ELSE 5 END")} AS series_len, {_r4('rwin - dwin')} AS series_wins_diff,
      {_r4('CASE WHEN k % 3 = 0 THEN 0.3::DOUBLE + (k % 400) / 1000.0::DOUBLE ELSE 0.5::DOUBLE END')} AS prematch_prior, {', '.join(_r4(f'CASE WHEN k % 3 = 0 THEN (k % {7 + i}) / 2.0::DOUBLE ELSE 0 END') + f' AS {c}' for i, c in enumerate(_BLOCK))} FROM ft""",
    "f08_skips": f"WITH {_M}, {_K} SELECT {_REASON} AS reason, count(*) AS n FROM k GROUP BY ALL",
    "f04_serving_view": f"WITH {_FEAT} SELECT minute, count(*) AS n, {_r4('count(*) * 0.5::DOUBLE')} AS prior, {_r4('count(*) * 0')} AS skill, {_r4('sum(gold)')} AS gold FROM ft GROUP BY minute",
    "w15_rosters": f"""WITH {_M}, {_K}, {_SLOTS}, a AS (SELECT k, s < 5 AS rad, {_ACC} AS a FROM sl WHERE {_COMPLETE})
      SELECT k AS match_id, string_agg(a::VARCHAR, ',' ORDER BY a) FILTER (rad) AS radiant, string_agg(a::VARCHAR, ',' ORDER BY a) FILTER (NOT rad) AS dire FROM a GROUP BY k""",
    "w11_history_block": f"""WITH {_CM}, {_T}, h AS (
        SELECT x.match_id, x.side, sum(CASE WHEN {_AGE} <= 120 * 86400 THEN {_DECAY} END) AS total, sum(CASE WHEN {_AGE} <= 120 * 86400 THEN {_DECAY} * b.won::INT END) AS wins, count(b.n) FILTER ({_AGE} <= 86400) AS m24, min({_AGE}) / 86400.0::DOUBLE AS rest
        FROM nb x LEFT JOIN nb b ON b.team = x.team AND b.n < x.n AND b.n >= x.n - 400 GROUP BY ALL),
      f AS (SELECT *, CASE WHEN total > 0 THEN wins / total ELSE 0.5 END AS form FROM h),
      tm AS (SELECT match_id, any_value(form) FILTER (side = 'radiant') - any_value(form) FILTER (side = 'dire') AS form_diff, any_value(rest) FILTER (side = 'radiant') - any_value(rest) FILTER (side = 'dire') AS rest_diff,
        any_value(m24) FILTER (side = 'radiant') - any_value(m24) FILTER (side = 'dire') AS m24_diff FROM f GROUP BY match_id),
      q AS (SELECT match_id, t, least(r, d) AS lo, r, (win = (r = least(r, d))) AS low_won, row_number() OVER (PARTITION BY least(r, d), greatest(r, d) ORDER BY t, match_id) AS n FROM m),
      hh AS (SELECT x.match_id, any_value(x.r = x.lo) AS is_low, sum(CASE WHEN {_AGE} <= 180 * 86400 THEN {_DECAY} END) AS total, sum(CASE WHEN {_AGE} <= 180 * 86400 THEN {_DECAY} * b.low_won::INT END) AS wins
        FROM q x LEFT JOIN q b ON b.lo = x.lo AND b.n < x.n AND b.n >= x.n - 100 GROUP BY x.match_id),
      hs AS (SELECT match_id, is_low, CASE WHEN total > 0 THEN wins / total ELSE 0.5 END AS share FROM hh),
      pj AS (SELECT match_id, t, (match_id + s * 11) % 127 AS hero_id, s < 5 AS is_radiant, ((s < 5) = win)::INT AS w FROM m, (SELECT unnest(range(10)) AS s)),
      pm AS (SELECT hero_id, t, match_id, sum(w) AS w, count(*) AS n FROM pj GROUP BY ALL),
      pr AS (SELECT hero_id, match_id, (coalesce(sum(w) OVER b, 0) + 25.0::DOUBLE) / (coalesce(sum(n) OVER b, 0) + 50.0::DOUBLE) AS rate FROM pm WINDOW b AS (PARTITION BY hero_id ORDER BY t, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      dr AS (SELECT match_id, avg(rate) FILTER (is_radiant) - avg(rate) FILTER (NOT is_radiant) AS draft FROM pj JOIN pr USING (hero_id, match_id) GROUP BY match_id)
      SELECT match_id, {_r4('form_diff')} AS form_diff, {_r4('CASE WHEN is_low THEN share ELSE 1 - share END - 0.5::DOUBLE')} AS h2h_advantage, {_r4('draft')} AS draft_advantage, {_r4('coalesce(rest_diff, 0)')} AS rest_days_diff, {_r4('m24_diff')} AS maps_last_24h_diff
      FROM tm JOIN hs USING (match_id) JOIN dr USING (match_id)""",
    "t24_live_states": f"""WITH {_LIVE} SELECT k AS match_id, minute, rnw - dnw AS gold_adv, nullif(n, 0) AS league_id, CASE WHEN k % 9 > 0 THEN k * 2 ELSE 0 END AS radiant_team_id, CAST(k % 200 AS INT) AS stream_delay_s,
      rsc AS radiant_score, dsc AS dire_score, rnw AS radiant_net_worth, dnw AS dire_net_worth, rt AS radiant_towers, dt AS dire_towers, rb AS radiant_barracks, db AS dire_barracks, acc AS radiant_accounts FROM lv""",
    "p21_live_draft": f"""WITH {_LIVE}, e AS (
        SELECT k, sh, false AS is_pick, 0 AS i, (k * 3 + sh) % 127 AS hero FROM sd WHERE (k + sh) % 2 = 1
        UNION ALL SELECT k, sh, true, i, (k + i * 7 + sh) % 127 FROM sd, (SELECT unnest([0, 1]) AS i) WHERE i < (k + sh) % 3)
      SELECT k AS match_id, CAST(row_number() OVER (PARTITION BY k ORDER BY sh, is_pick, i) - 1 AS INT) AS "order", CAST(hero AS INT) AS hero_id, is_pick, sh = 0 AS is_radiant FROM e WHERE k % 7 > 0 AND NOT (sh = 1 AND k % 10 = 0)""",
    "p22_live_players": f"""WITH {_LIVE} SELECT k AS match_id, CAST(s + sh * 128 AS INT) AS player_slot, nullif(account, 0) AS account_id, CAST((k + s + sh) % 127 AS INT) AS hero_id, CAST((k + s) % 9 AS INT) AS kills, CAST((k + s) % 4 AS INT) AS deaths
      FROM pl WHERE k % 7 > 0 AND NOT (sh = 1 AND k % 10 = 0)""",
    "p16_live_teams": f"WITH {_LIVE} SELECT DISTINCT k * 2 + sh AS team_id, 't' || (k * 2 + sh) AS name FROM sd WHERE k % 9 > 0 AND k % 8 > 0",
    "w21_live_block": f"""WITH {_LIVE}, rt AS (SELECT user_id AS account, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY user_id),
      st AS (SELECT pl.k, sh, CASE WHEN id IS NULL THEN 25.0::DOUBLE ELSE 20.0::DOUBLE + id % 11 END AS mu, CASE WHEN id IS NULL THEN 25.0::DOUBLE / 3 ELSE 1.0::DOUBLE + id % 7 END AS sigma, coalesce(id % 40, 0) AS games
        FROM pl JOIN on_air USING (k) LEFT JOIN rt ON rt.account = pl.account WHERE pl.account > 0),
      sk AS (SELECT k, sh, avg(mu) AS mu, sqrt(sum(sigma * sigma)) / count(*) AS sigma, count(*) FILTER (games >= 20) AS est FROM st GROUP BY ALL),
      z AS (SELECT a.k, (a.mu - 3 * a.sigma) - (b.mu - 3 * b.sigma) AS gap, a.sigma + b.sigma AS sigma, a.est - b.est AS est FROM sk a JOIN sk b ON a.k = b.k AND a.sh = 0 AND b.sh = 1)
      SELECT k AS match_id, {_r4('gap')} AS skill_diff, {_r4('sigma')} AS skill_sigma_sum, {_r4('est')} AS established_diff, {_r4(_SIG.format(z='0.055::DOUBLE + 0.12::DOUBLE * gap'))} AS prematch_prior FROM z""",
    "r03_live_scores": f"""WITH {_M}, {_L}, {_LIVE}, th AS (SELECT team, count(*) AS maps FROM (SELECT r AS team FROM m UNION ALL SELECT d FROM m) WHERE team > 0 GROUP BY team),
      x AS (SELECT lv.*, nullif(n, 0) AS lid, l.tier, l.valve, CASE n % 4 WHEN 0 THEN 'bo1' WHEN 1 THEN 'bo3' WHEN 2 THEN 'bo5' END AS f0, k % 2 + k % 3 + 1 AS game, CASE WHEN k % 9 > 0 THEN k * 2 ELSE 0 END AS ra, CASE WHEN k % 9 > 0 THEN k * 2 + 1 ELSE 0 END AS da
        FROM lv LEFT JOIN l ON l.league_id = nullif(n, 0)),
      y AS (SELECT *, CASE WHEN lid IS NOT NULL THEN f0 END AS f FROM x)
      SELECT k AS match_id, CAST(minute AS BIGINT) AS minute, lid AS league_id, CASE WHEN coalesce(nullif(tier, ''), 'unknown') = 'unknown' AND valve = 'premium' THEN 'tier1' ELSE coalesce(nullif(tier, ''), 'unknown') END AS tier,
        game::DOUBLE AS game_in_series, coalesce(game > CASE f WHEN 'bo1' THEN 1 WHEN 'bo3' THEN 2 WHEN 'bo5' THEN 3 END, false)::INT::DOUBLE AS is_conditional_game, CASE coalesce(f, 'bo1') WHEN 'bo1' THEN 1 WHEN 'bo3' THEN 3 ELSE 5 END::DOUBLE AS series_len,
        {_r4('greatest(least(' + _SIG.format(z='0.067223::DOUBLE + 0.005293::DOUBLE * ((rnw - dnw) / (minute + 5.0::DOUBLE)) + -0.003425::DOUBLE * minute') + ', 0.99::DOUBLE), 0.01::DOUBLE)')} AS p, least(coalesce(t1.maps, 0), coalesce(t2.maps, 0)) AS team_history
      FROM y LEFT JOIN th t1 ON t1.team = ra LEFT JOIN th t2 ON t2.team = da""",
    "q13_public_feed": f"WITH {_L} SELECT league_id, tier, league_id % 6 AS team_history FROM l WHERE valve IN ('professional', 'premium')",
    "k03_supplied": f"""WITH {_L}, o AS (SELECT * FROM l WHERE league_id < 18), n AS (SELECT league_id, 'x' || name AS name, CASE WHEN league_id % 2 = 0 THEN 'new' END AS valve FROM l WHERE league_id > 5)
      SELECT coalesce(o.league_id, n.league_id) AS league_id, CASE WHEN n.league_id IS NOT NULL THEN n.name ELSE o.name END AS name, o.tier, CASE WHEN n.league_id IS NOT NULL THEN n.valve ELSE o.valve END AS valve_tier FROM o FULL JOIN n ON o.league_id = n.league_id""",
    "k09_absent": f"WITH {_L} SELECT league_id, name, tier, valve AS valve_tier FROM l WHERE league_id < 18 UNION ALL SELECT league_id, 'added', NULL, NULL FROM l WHERE league_id >= 18",
    "k12_children": f"""WITH {_P}, q AS (SELECT match_id, minute, count(*) AS n FROM p GROUP BY ALL), w AS (SELECT match_id, minute, -n AS n FROM q WHERE match_id % 2 = 0 AND minute < 20),
      z AS (SELECT * FROM q WHERE match_id NOT IN (SELECT match_id FROM w) UNION ALL SELECT * FROM w) SELECT match_id, count(*) AS minutes, CAST(sum(n) AS BIGINT) AS n FROM z GROUP BY match_id""",
    "k13_supersede": f"""WITH {_L} SELECT league_id, tier, 1997 AS decided, CASE WHEN league_id % 4 = 0 THEN 1998 WHEN league_id % 3 = 0 THEN 1999 END AS superseded FROM l WHERE league_id < 20
      UNION ALL SELECT league_id, 'decided', 1999, NULL FROM l WHERE league_id % 3 = 0""",
    "l10_platt": f"""WITH {_P}, q AS (SELECT *, greatest(least(p, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS c FROM p), z AS (SELECT *, ln(c / (1 - c)) AS z FROM q)
      SELECT model_version, minute, {_r4('sum(1 / (1 + exp(-greatest(least(1.2::DOUBLE * z - 0.1::DOUBLE, 35.0::DOUBLE), -35.0::DOUBLE))))')} AS p, {_r4('sum(1 / (1 + exp(-z)))')} AS same FROM z GROUP BY ALL""",
    "f22_rules": f"""WITH a AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'professional' WHEN 1 THEN 'premium' WHEN 2 THEN 'excluded' WHEN 3 THEN 'amateur' END AS v, CASE p_partkey % 6 WHEN 0 THEN 'tier1' WHEN 1 THEN 'tier2' WHEN 2 THEN 'unknown' WHEN 3 THEN '' WHEN 4 THEN 'tier3' END AS w,
        CASE WHEN p_partkey % 7 = 0 THEN 'bo2' WHEN p_partkey % 3 = 0 THEN 'bo5' ELSE CASE p_partkey % 4 WHEN 0 THEN 'bo1' WHEN 1 THEN 'bo3' WHEN 2 THEN 'bo5' ELSE 'bo1' END END AS f, p_partkey % 4 AS x, p_partkey % 3 AS y FROM part),
      b AS (SELECT *, CASE WHEN coalesce(nullif(w, ''), 'unknown') = 'unknown' AND v = 'premium' THEN 'tier1' ELSE coalesce(nullif(w, ''), 'unknown') END AS t, coalesce(v IN ('professional', 'premium'), false) AS pro,
        CASE f WHEN 'bo1' THEN 1 WHEN 'bo2' THEN 2 WHEN 'bo3' THEN 2 ELSE 3 END AS need FROM a),
      c AS (SELECT *, CASE WHEN f = 'bo2' THEN x + y >= 2 ELSE x >= need OR y >= need END AS over FROM b)
      SELECT k AS p_partkey, t AS tier, CASE WHEN pro AND t = 'tier1' THEN 'tier1' WHEN pro THEN 'pro' WHEN v IN ('excluded', 'amateur') THEN 'excluded' END AS segment, pro, f AS format,
        CASE WHEN over AND NOT (f = 'bo2' AND x = y) THEN CASE WHEN f = 'bo2' THEN x > y ELSE x >= need END END AS winner_is_a, f = 'bo2' AND over AND x = y AS drawn,
        CAST(CASE k % 3 WHEN 0 THEN k % 8 WHEN 1 THEN CASE WHEN k % 8 < 7 THEN k % 8 ELSE 0 END ELSE 0 END AS INT) AS leaver, least(CASE WHEN k % 4 > 0 THEN k % 9 ELSE 0 END, k % 5) AS known,
        {_r4('pow(0.5::DOUBLE, k * 3600.0::DOUBLE / (86400.0::DOUBLE * 30.0::DOUBLE))')} AS decay, {_r4('0.077::DOUBLE * sqrt(85.0::DOUBLE / (k + 1))')} AS noise, {_r4('k / 550.0::DOUBLE')} AS eta, k * 3.0::DOUBLE AS timeout, nullif(k % 4, 0) AS id,
        {_r4("CASE w WHEN 'tier1' THEN 1.0::DOUBLE WHEN 'tier2' THEN 0.6::DOUBLE WHEN 'tier3' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * exp(-ln(2.0::DOUBLE) / 180.0::DOUBLE * (k % 100))")} AS weight FROM c""",
    "s02_transient": """SELECT p_partkey, 'http://h/x?api_key=***&y=' || p_size || '&token=***' AS url, left(p_name || p_name || p_name, 64) AS key,
      'lgbm-' || strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(p_partkey * 977), '%Y%m%d-%H%M%S') AS version FROM part""",
    "m16_bias": f"""WITH {_M}, x AS (SELECT (sum(win::INT) + 1.0::DOUBLE) / (count(*) + 2) AS b FROM m WHERE win IS NOT NULL) SELECT league_id, count(*) AS n, 0.5::DOUBLE AS half, {_r4('any_value(b)')} AS bias FROM m, x WHERE win IS NOT NULL GROUP BY league_id""",
    "ratings_of_sides": f"""SELECT l_orderkey AS match_id, l_linenumber % 2 = 1 AS is_radiant, {_r4('avg(l_suppkey % 40 + 5.0::DOUBLE)')} AS mu, {_r4('sqrt(sum((l_partkey % 8 + 1.0::DOUBLE) * (l_partkey % 8 + 1.0::DOUBLE))) / count(*)')} AS sigma,
      min(l_suppkey % 45) AS min_games, count(*) FILTER (l_suppkey % 45 >= 20) AS established FROM lineitem GROUP BY ALL""",
    "p13_heroes": """SELECT CAST(n_nationkey AS INT) AS hero_id, 'npc_' || lower(n_name) AS name, CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE 'npc_' || lower(n_name) END AS localized_name, 'agi' AS primary_attr
      FROM nation WHERE n_nationkey <> 0 AND n_nationkey % 7 > 0""",
    "p14_pro_players": """WITH f AS (SELECT s_suppkey % 60 AS a, min(s_suppkey) AS k FROM supplier WHERE s_suppkey % 60 <> 0 GROUP BY 1)
      SELECT a AS account_id, CASE WHEN k % 4 > 0 THEN 'n' ELSE 'p' END || k AS name, CASE WHEN a % 2 = 0 THEN 'xx' END AS country, CAST(a % 3 AS INT) AS fantasy_role FROM f""",
    "p15_leagues": """SELECT CAST(n_nationkey AS BIGINT) AS league_id, n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN 'professional' WHEN 1 THEN 'premium' WHEN 2 THEN 'excluded' WHEN 3 THEN 'amateur' END AS valve_tier FROM nation WHERE n_nationkey <> 0""",
    "t26_realtime": f"""WITH b AS (SELECT s_suppkey AS k, unnest(range(18)) AS i FROM supplier), c AS (
        SELECT k, count(*) FILTER (i % 2 = 0 AND (k + i) % 3 = 0) AS rt, count(*) FILTER (i % 2 = 1 AND (k + i) % 3 = 0) AS dt, count(*) FILTER (i % 2 = 0 AND (k + i) % 3 = 1) AS rb, count(*) FILTER (i % 2 = 1 AND (k + i) % 3 = 1) AS db
        FROM b WHERE i < k % 18 AND (k + i) % 4 <> 0 GROUP BY k),
      w AS (SELECT s_suppkey AS k, unnest([(s_suppkey * 7 + s * 262) % 9000 for s in range(5)]) AS w FROM supplier), sp AS (SELECT k, stddev_pop(w) AS sp FROM w GROUP BY k)
      SELECT s_suppkey AS match_id, CAST(greatest(s_suppkey * 37 % 3000 - 90, 0) // 60 AS INT) AS minute,
        CAST(CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey * 3 + (s_suppkey % 4 - 1) * 17) % 5000 - 2500 ELSE (s_suppkey * 62) % 40000 - (s_suppkey * 93) % 40000 END AS INT) AS gold_adv,
        CAST(s_suppkey * 2 % 50 AS INT) AS radiant_score, CAST(s_suppkey * 3 % 50 AS INT) AS dire_score, CAST(s_suppkey * 62 % 40000 AS INT) AS radiant_net_worth, CAST(s_suppkey * 93 % 40000 AS INT) AS dire_net_worth,
        CAST(coalesce(rt, 0) AS INT) AS radiant_towers, CAST(coalesce(dt, 0) AS INT) AS dire_towers, CAST(coalesce(rb, 0) AS INT) AS radiant_barracks, CAST(coalesce(db, 0) AS INT) AS dire_barracks, {_r4('sp')} AS radiant_spread
      FROM supplier LEFT JOIN c ON c.k = s_suppkey JOIN sp ON sp.k = s_suppkey""",
    "h26_outcomes": f"""WITH {_M}, x AS (SELECT *, win IS NULL AND series_id % 3 = 0 AS late FROM m)
      SELECT match_id, CASE WHEN late THEN match_id % 2 = 0 ELSE win END AS radiant_win, CASE WHEN late THEN CAST(match_id * 7 % 500 + 700 AS INT) END AS duration, series_id FROM x""",
    "h27_to_fetch": f"WITH {_M} SELECT DISTINCT l_orderkey AS match_id FROM lineitem WHERE l_orderkey NOT IN (SELECT match_id FROM m WHERE series_id % 3 = 0) ORDER BY match_id DESC LIMIT 100",
    "f20_map_score": f"""WITH {_M}, {_K}, {_SLOTS}, ro AS (SELECT k, CAST(sum((k + s) % 15) FILTER (s < 5) AS INT) AS r, CAST(sum((k + s) % 15) FILTER (s >= 5) AS INT) AS d FROM sl WHERE k % 3 > 0 AND NOT (k % 19 = 0 AND s = 9) GROUP BY k)
      SELECT k.k AS match_id, CASE WHEN k.k % 2 = 0 AND k.k % 4 > 0 THEN CAST(k.k % 60 AS INT) WHEN ro.k IS NOT NULL THEN ro.r WHEN k.k % 4 > 0 THEN CAST(k.k % 60 AS INT) END AS radiant,
        CASE WHEN k.k % 2 = 0 AND k.k % 4 > 0 THEN CAST(k.k % 50 AS INT) WHEN ro.k IS NOT NULL THEN ro.d WHEN k.k % 4 > 0 THEN CAST(k.k % 50 AS INT) END AS dire FROM k LEFT JOIN ro ON ro.k = k.k""",
    "q09_card_players": f"""WITH {_M}, {_K}, {_SLOTS}, p AS (SELECT k, s, (k + s * 11) % 127 AS hero, {_ACC} AS account FROM sl WHERE NOT (k % 19 = 0 AND s = 9))
      SELECT k AS match_id, {_SLOT} AS player_slot, n_name AS hero_name, CASE WHEN account % 10 = 0 THEN 'c' || account // 10 END AS player_name FROM p LEFT JOIN nation ON n_nationkey = hero""",
    "q10_card_draft": f"""WITH {_M}, {_K}, i AS (SELECT k, CAST(unnest(range(10)) AS INT) AS i FROM k), d AS (
        SELECT k, i, i % 4 < 2 AS rad, CASE WHEN i % 2 = 0 THEN (k + i * 3) % 127 ELSE (k + i * 5) % 127 END AS hero FROM i WHERE k % 3 > 0 UNION ALL SELECT k, i, i % 2 = 0, (k + i * 3) % 127 FROM i WHERE k % 3 = 0 AND i < 8)
      SELECT k AS match_id, i AS "order", rad AS is_radiant, n_name AS hero_name FROM d LEFT JOIN nation ON n_nationkey = hero""",
    "x23_stage_formats": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 > 0 THEN 2020 + p_partkey % 5 END AS y FROM part),
      q AS (SELECT *, ['bo1', 'bo2', 'bo3', 'bo5'] AS f, make_date(y, 5, k % 20 + 1) AS s, make_date(y, 6, k % 9 + 1) AS e FROM p)
      SELECT k AS page_id, 'Group Stage' AS name, 'group' AS stage_type, f[k % 4 + 1] AS default_format, f[k % 4 + 1] || ',' || f[(k + 1) % 4 + 1] AS formats_seen, s AS start_date, e AS end_date FROM q
      UNION ALL SELECT k, 'Playoffs', 'playoff', f[(k + 2) % 4 + 1], 'bo5,' || f[(k + 2) % 4 + 1], s, e FROM q
      UNION ALL SELECT k, 'Playoffs / Lower Bracket', 'playoff', f[(k + 3) % 4 + 1], f[(k + 3) % 4 + 1], s, e FROM q""",
    "m16_report": f"""WITH {_M}, {_P}, s AS (SELECT p.*, win FROM p JOIN m ON p.match_id = m.match_id WHERE win IS NOT NULL), b AS (
        SELECT {_BUCKET} AS bucket, round(avg({_LL}), 3) AS ll, round(avg(pow(p - win::INT, 2)), 3) AS br, round(avg(((p >= 0.5) = win)::INT), 3) AS ac, count(*) AS n FROM s GROUP BY ALL)
      SELECT printf('%-6s log loss %.4f  brier %.4f  accuracy %.3f  n %d', bucket, ll, br, ac, n) AS line FROM b""",
    "p26_wiki_candidates": """WITH h AS (SELECT p_partkey AS k, CAST(unnest(range(8)) AS INT) AS i FROM part),
      f AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 3 > 0 THEN 2 ELSE 0 END AS n, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 4 < 3 THEN 'tier' || (p_partkey % 4 + 1) ELSE 'unknown' END AS tier,
        CASE WHEN p_partkey % 2 = 0 THEN 'tournament of ' || p_brand END AS d FROM part WHERE p_partkey % 11 > 0)
      SELECT k AS league_id, i AS position, 'Page/' || (k + i) AS title, CAST(coalesce(n, 0) AS INT) AS n_categories, coalesce(tier, 'unknown') AS tier, d AS description FROM h LEFT JOIN f ON p = k + i WHERE i < least(k % 8, 5)""",
    "h16_wiki_text": "SELECT 'Page/' || p_partkey AS page_title, CASE WHEN p_partkey % 5 > 0 THEN 'text ' || p_brand ELSE '' END AS wikitext FROM part WHERE p_partkey % 7 > 0",
}
