"""SQL with the same rows as the queries of `commerce`, for any engine with window functions."""

from __future__ import annotations

SEASONS = """
lines AS (SELECT l_orderkey, count(*) AS games, sum(l_quantity::BIGINT)::BIGINT AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents,
                 count(*) FILTER (l_returnflag = 'R') AS returns FROM lineitem GROUP BY 1),
sums AS (SELECT o_custkey AS player, year(o_orderdate)::INT AS season, sum(games)::BIGINT AS games, sum(qty)::BIGINT AS qty, sum(cents)::BIGINT AS cents, sum(returns)::BIGINT AS returns
         FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
seasons AS (SELECT player, c_mktsegment AS position, c_nationkey AS team, season, (season - (1970 + player % 8))::INT AS age, games, qty, cents, returns,
                   (qty * 2 + returns * 15 + floor(cents / 200000))::DOUBLE AS points
            FROM sums JOIN customer ON player = c_custkey),
s AS (SELECT *, points / greatest(games, 1) AS rate FROM seasons WHERE games >= 4 AND season >= 1980)"""

CAREER = """
c AS (SELECT player, position, min(season) AS first_season, max(season) AS last_season, count(*) AS n_seasons, sum(games)::BIGINT AS career_games,
             sum(points) AS career_points, max(age) AS max_age FROM s GROUP BY 1, 2)"""

# active players, and finished careers of two seasons or more
SPAN = """
span AS (SELECT player, max(season) AS last, count(*) AS n FROM s GROUP BY 1),
now_p AS (SELECT player FROM span WHERE last >= 2000),
done_p AS (SELECT player FROM span WHERE last < 2000 AND n >= 2)"""
DONE, NOW = "player IN (SELECT player FROM done_p)", "player IN (SELECT player FROM now_p)"

STAGES = """
st AS (SELECT player, position, season, row_number() OVER w AS stage, sum(points) OVER (PARTITION BY player ORDER BY season ROWS UNBOUNDED PRECEDING) AS total
       FROM s WINDOW w AS (PARTITION BY player ORDER BY season))"""


def _vectors(name: str, where: str) -> str:
    """Vectors of the seasons that `where` admits, season by season against the seasons up to it."""
    return f"""
{name}_i AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season) AS k FROM s WHERE {where}),
{name}_w AS (SELECT a.player, a.k, max((SELECT sum(points) / sum(games) FROM {name}_i q WHERE q.player = a.player AND q.k BETWEEN b.k AND least(b.k + 2, a.k))) AS peak3
             FROM {name}_i a JOIN {name}_i b ON a.player = b.player AND b.k <= a.k GROUP BY 1, 2),
{name}_a AS (SELECT a.player, a.position, a.season, a.age, a.k AS stage, a.rate,
        coalesce(max(CASE WHEN b.age = a.age - 1 THEN b.rate END), 0) AS b1, coalesce(max(CASE WHEN b.age = a.age - 2 THEN b.rate END), 0) AS b2,
        sum(b.points) AS total, sum(b.games) AS g, max(b.rate) AS peak1,
        coalesce(arg_max(b.rate, b.season) FILTER (b.rate <> 0), 0) AS last_good,
        CASE WHEN a.k > 1 THEN round((a.k * sum((b.k - 1) * b.rate) - sum(b.k - 1) * sum(b.rate)) / (a.k * sum((b.k - 1) * (b.k - 1)) - sum(b.k - 1) * sum(b.k - 1))::DOUBLE, 6) ELSE 0 END AS slope
     FROM {name}_i a JOIN {name}_i b ON a.player = b.player AND b.k <= a.k GROUP BY 1, 2, 3, 4, 5, 6),
{name}_p AS (SELECT v.player, v.stage, coalesce(count(m.total) FILTER (m.total < v.total) / nullif(count(m.total), 0), 0.5) AS pct
     FROM {name}_a v LEFT JOIN (SELECT * FROM st WHERE player IN (SELECT player FROM done_p)) m ON m.position = v.position AND m.stage = v.stage GROUP BY 1, 2),
{name} AS (SELECT a.player, position, season, age, a.stage,
        CASE WHEN rate <> 0 THEN rate ELSE last_good END AS v0, 0.7::DOUBLE * b1 AS v1, 0.5::DOUBLE * b2 AS v2, total / g AS v3, greatest(peak3, 0) AS v4, peak1 AS v5, total / 100.0::DOUBLE AS v6,
        slope::DOUBLE AS v7, 10.0::DOUBLE * least(1.0::DOUBLE, g / (17.0::DOUBLE * a.stage)) AS v8, 30.0::DOUBLE * pct AS v9, 0.5::DOUBLE * age AS v10
     FROM {name}_a a JOIN {name}_w w ON a.player = w.player AND a.stage = w.k JOIN {name}_p p ON a.player = p.player AND a.stage = p.stage)"""


_D2 = " + ".join(f"{w}::DOUBLE * (t.v{k} - p.v{k}) * (t.v{k} - p.v{k})" for k, w in enumerate((2.0, 1.5, 1.0, 3.0, 4.0, 3.0, 0.8, 0.2, 0.3, 0.5, 5.0)))
EDGES = f"""
{SPAN.strip()},{STAGES.strip()},{_vectors("pool", DONE)},{_vectors("own", NOW)},
t AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY player ORDER BY season DESC) = 1),
spans AS (SELECT player AS comp, count(*) AS comp_seasons, max(age) AS comp_max_age FROM s WHERE {DONE} GROUP BY 1),
met AS (SELECT t.player, p.player AS comp, p.age AS comp_age, p.season AS comp_season, p.stage AS comp_stage, t.stage AS stage,
               1.0::DOUBLE / (1.0::DOUBLE + sqrt(0.0::DOUBLE + {_D2}) / 20.0::DOUBLE) AS raw_sim
        FROM t JOIN pool p ON p.position = t.position AND p.player <> t.player AND abs(p.age - t.age) <= 1
        JOIN spans ON comp = p.player AND comp_seasons >= CASE WHEN t.stage >= 9 THEN greatest(t.stage - 2, 3) ELSE greatest(t.stage, 3) END AND comp_max_age > t.age
        QUALIFY row_number() OVER (PARTITION BY t.player, p.player ORDER BY CASE p.age - t.age WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END) = 1),
edges AS (SELECT player, comp, comp_age, comp_season, CASE WHEN comp_season < 1996 THEN raw_sim * 0.9::DOUBLE ELSE raw_sim END AS sim, raw_sim
          FROM met WHERE abs(comp_stage - stage) <= 1),
top AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY sim DESC, comp) AS rank FROM edges QUALIFY rank <= 25)"""

FUTURE = """
fut_rows AS (SELECT a.player, a.age AS snapshot_age, b.points, row_number() OVER (PARTITION BY a.player, a.age ORDER BY b.season) - 1 AS n
             FROM s a JOIN s b ON a.player = b.player AND b.age > a.age),
fut AS (SELECT player, snapshot_age, sum(points * pow(0.95::DOUBLE, n)) AS future_points, count(*) AS future_seasons FROM fut_rows GROUP BY 1, 2)"""

PEAK3 = """
pk AS (SELECT player, greatest(max(r), 0) AS peak3 FROM (SELECT player, sum(points) OVER w / sum(games) OVER w AS r FROM {s} WINDOW w AS (PARTITION BY player ORDER BY season ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) GROUP BY 1)"""

PROJECTION = f"""
cm AS (SELECT e.player, sum(sim * coalesce(future_points, 0)) / CASE WHEN sum(sim) = 0 THEN 1 ELSE sum(sim) END AS comp_mean,
              sum(sim * coalesce(future_seasons, 0)) / CASE WHEN sum(sim) = 0 THEN 1 ELSE sum(sim) END AS years, max(coalesce(future_points, 0)) AS best_comp, count(*) AS n_comps
       FROM top e LEFT JOIN fut f ON f.player = e.comp AND f.snapshot_age = e.comp_age GROUP BY 1),
own_s AS (SELECT * FROM s WHERE {NOW}),
r3 AS (SELECT player, sum(points) / sum(games) AS recent3 FROM (SELECT * FROM own_s QUALIFY row_number() OVER (PARTITION BY player ORDER BY season DESC) <= 3) GROUP BY 1),
{PEAK3.strip().format(s="own_s")},
ow AS (SELECT player, position, sum(games) AS career_games, max(season) AS last_season, arg_max(games, season) AS last_games, sum(CASE WHEN season >= 2000 THEN games ELSE 0 END) AS recent_games,
              arg_min(age, season) FILTER (games >= 10) AS breakout_age, max(age) AS age FROM own_s GROUP BY 1, 2),
an AS (SELECT *, least(CASE WHEN n_comps >= 3 THEN greatest(1.1::DOUBLE * recent3, 0.9::DOUBLE * peak3) * 17.0::DOUBLE * years * pow(0.95::DOUBLE, years / 2.0::DOUBLE) ELSE 0 END, 1.25::DOUBLE * best_comp) AS anchor,
              0.4::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (recent3 - 19.0::DOUBLE) / 5.0::DOUBLE)) AS share
       FROM cm JOIN r3 USING (player) JOIN pk USING (player) JOIN ow USING (player)),
pr AS (SELECT *, CASE WHEN anchor > comp_mean THEN comp_mean * (1.0::DOUBLE - share) + anchor * share ELSE comp_mean END AS projection FROM an)"""

SURVIVAL = """
cc AS (SELECT player AS comp, max(age) AS la, count(*) AS ns, max(season) <= 1998 AS retired FROM s WHERE player IN (SELECT player FROM done_p) GROUP BY 1),
sv0 AS (SELECT e.player, sum(CASE WHEN retired AND la <= 30 AND ns < 8 THEN sim ELSE 0 END) / sum(sim) AS bust_rate,
               sum(CASE WHEN CASE WHEN retired THEN ns <= 5 ELSE ns <= 2 END THEN sim ELSE 0 END) / sum(sim) AS short_rate,
               count(*) FILTER (retired AND la <= 30 AND ns < 8 AND rank <= 5) AS top5_busts
        FROM top e JOIN cc USING (comp) GROUP BY 1),
sv AS (SELECT *, least(1.0, greatest(0.3, (0.5::DOUBLE * (1 - bust_rate) + 0.2::DOUBLE * (1 - short_rate) + 0.3::DOUBLE) * (1 - 0.08::DOUBLE * least(top5_busts, 5)))) AS survival FROM sv0)"""

CONF = "CASE WHEN {qb} THEN CASE WHEN {g} < 16 THEN least({g} / 32.0::DOUBLE, 0.5::DOUBLE) ELSE least({g} / 32.0::DOUBLE, 1.0::DOUBLE) END ELSE least(1.0::DOUBLE, {g} / 30.0::DOUBLE) END"
TIER = "CASE WHEN rank <= 12 THEN 1 WHEN rank <= 24 THEN 2 WHEN rank <= 48 THEN 3 WHEN rank <= 72 THEN 4 WHEN rank <= 108 THEN 5 WHEN rank <= 144 THEN 6 WHEN rank <= 200 THEN 7 WHEN rank <= 260 THEN 8 ELSE 9 END"
ERA = "CASE WHEN {0} <= 1996 THEN 1 WHEN {0} <= 1998 THEN 2 WHEN {0} <= 1999 THEN 3 ELSE 4 END"
PAIRS = """
early AS (SELECT player, position, sum(points) AS early, sum(games)::DOUBLE AS g FROM s WHERE season <= 1998 GROUP BY 1, 2),
late AS (SELECT player, sum(points) AS late FROM s WHERE season > 1998 GROUP BY 1),
pairs AS (SELECT early.*, coalesce(late, 0) AS late FROM early LEFT JOIN late USING (player))"""
HITS = "hits AS (SELECT position, count(*) FILTER (p <= 24 AND a <= 24) / least(24, count(*)) AS hit_rate FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY early DESC, player) AS p, row_number() OVER (PARTITION BY position ORDER BY late DESC, player) AS a FROM pairs) GROUP BY 1)"
ZRATES = """
nat AS (SELECT season, team, avg(games) AS strength FROM s GROUP BY 1, 2),
zs AS (SELECT season, team, (strength - avg(strength) OVER w) / CASE WHEN stddev_pop(strength) OVER w <= 1e-9 OR count(*) OVER w < 2 THEN 1 ELSE stddev_pop(strength) OVER w END AS z FROM nat WINDOW w AS (PARTITION BY season)),
zr AS (SELECT s.*, z, rate * least(1.10::DOUBLE, greatest(0.65::DOUBLE, 1 + 0.15::DOUBLE * coalesce(z, 0))) AS adjusted FROM s LEFT JOIN zs USING (season, team))"""
ROSTER = """
sc AS (SELECT player, sum(points) AS score FROM s GROUP BY 1 HAVING sum(games) >= 20)"""
TRADES = """
sides AS (SELECT DISTINCT l_orderkey AS trade, l_suppkey % 12 AS team, l_partkey % 1500 + 1 AS player FROM lineitem),
got AS (SELECT trade, team, sum(coalesce(score, 0)) AS received FROM sides LEFT JOIN sc USING (player) GROUP BY 1, 2),
tr AS (SELECT trade, team, received * 2 - sum(received) OVER (PARTITION BY trade) AS delta FROM got)"""
ROOKIES = """
ro AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season) - 1 AS k FROM s),
lt AS (SELECT player, sum(points) AS later, sum(points * pow(0.95::DOUBLE, k - 1)) AS later_discounted, count(*) AS later_seasons FROM ro WHERE k > 0 GROUP BY 1),
f AS (SELECT player, position, age, season, games, rate, qty / games AS qpg, returns / games AS rpg, cents / games AS cpg, games / 17.0::DOUBLE AS played, coalesce(later, 0.0) AS later, coalesce(later_discounted, 0.0) AS later_discounted, coalesce(later_seasons, 0) AS later_seasons FROM ro LEFT JOIN lt USING (player) WHERE k = 0)"""
ROOKIE_EDGES = """
pe AS (SELECT t.player, t.games AS t_games, c.player AS comp, abs(c.age - t.age) AS gap, c.later, c.later_discounted, c.later_seasons, count(*) FILTER (abs(c.age - t.age) <= 2) OVER (PARTITION BY t.player) AS n_near,
              1.0::DOUBLE / (1.0::DOUBLE + sqrt(0.0::DOUBLE + 8.0::DOUBLE * (t.rate - c.rate) * (t.rate - c.rate) + 0.1::DOUBLE * (t.played - c.played) * (t.played - c.played) + 0.1::DOUBLE * (t.qpg - c.qpg) * (t.qpg - c.qpg) + 0.3::DOUBLE * (t.rpg - c.rpg) * (t.rpg - c.rpg)
                + 0.0000001::DOUBLE * (t.cpg - c.cpg) * (t.cpg - c.cpg) + 20.0::DOUBLE * (t.age - c.age) * (t.age - c.age)) / 15.0::DOUBLE) AS raw,
              CASE WHEN t.games >= 10 THEN 1 + 0.3::DOUBLE * log2(1 + greatest(c.later, 0) / 1500.0::DOUBLE) ELSE 1.0::DOUBLE END * (1 + 0.25::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (c.season - 1995) / 6.0::DOUBLE))) AS boost
       FROM f t JOIN f c ON t.position = c.position AND t.season >= 1997 AND c.season < 1997 AND abs(c.age - t.age) <= 3),
re AS (SELECT *, round(raw * boost, 9) AS sim, row_number() OVER (PARTITION BY player ORDER BY round(raw * boost, 9) DESC, comp) AS rank FROM pe WHERE gap <= 2 OR n_near < 25 QUALIFY rank <= 25)"""
RANKED = f"""
m AS (SELECT player, row_number() OVER (ORDER BY career_points DESC, player) AS model_rank FROM (SELECT player, sum(points) AS career_points FROM s GROUP BY 1 HAVING sum(games) >= 25)),
o AS (SELECT c_custkey AS player, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS outside_rank FROM customer WHERE c_acctbal > 0)"""
NAMES = """
nm AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\n\\t\\r]', ' ', 'g'), ' ') || [' Žan Dončić Jr.', ' III', ', Jr.', ' J.R. sr', ' O''Neil-Smith Őrsi', ' V jr'][doc_id % 6 + 1] AS name FROM documents)"""
FOLD = "strip_accents(name)"
TAIL = "jr|sr|ii|iii|iv|v"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'), ' ')"


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + " " + select


def _prospect(x: str) -> str:
    for s in TAIL.split("|"):
        x = rf"regexp_replace({x}, ' {s}\.?$', '')"
    return x


ORACLES: dict[str, str] = {
    "q_scan_filter": with_(SEASONS, select="SELECT player, position, season, age, games, points FROM s"),
    "q_career_rollup": with_(SEASONS, CAREER, select="SELECT *, last_season <= 1999 AS retired, last_season <= 1999 OR n_seasons >= 8 OR (max_age >= 33 AND n_seasons >= 6) AS long_arc, last_season >= 2000 AS active FROM c"),
    "q_era_ratio_median": with_(SEASONS, f"l AS (SELECT position, {ERA.format('season')} AS era, unnest(['qty', 'returns']) AS stat, unnest([qty::DOUBLE / games, returns::DOUBLE / games]) AS rate FROM s), md AS (SELECT position, stat, era, median(rate) AS med FROM l GROUP BY 1, 2, 3)", select="SELECT md.position, md.stat, md.era, round(md.med, 6) AS med, round(CASE WHEN md.med <= 1e-6 OR b.med IS NULL THEN 1.0 ELSE least(2.0, greatest(0.6, b.med / md.med)) END, 6) AS multiplier FROM md LEFT JOIN md b ON b.position = md.position AND b.stat = md.stat AND b.era = 4"),
    "q_scoring_6fmt": with_(SEASONS, "f(format, kq, kr, bonus) AS (VALUES ('std', 2.0::DOUBLE, 15.0::DOUBLE, 0.0::DOUBLE), ('ppr', 3.0, 15.0, 0.0), ('half', 2.5, 15.0, 0.0), ('sf', 2.0, 10.0, 5.0), ('deep', 1.0, 20.0, 5.0), ('flat', 1.0, 1.0, 0.0)), x AS (SELECT player, season, games, format, qty * kq + returns * kr + CASE WHEN position = 'BUILDING' THEN bonus * games ELSE 0 END AS total FROM s, f)", select="SELECT player, season, format, total, round(total / greatest(games, 1), 6) AS per_game FROM x"),
    "q_peak3_rolling": with_(SEASONS, PEAK3.format(s="s"), select="SELECT player, round(peak3, 6) AS peak3 FROM pk"),
    "q_recent_n": with_(SEASONS, "r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season DESC) AS rn FROM s)", select="SELECT player, " + ", ".join(f"round(sum(points) FILTER (rn <= {n}) / sum(games) FILTER (rn <= {n}), 6) AS recent{n}" for n in (1, 2, 3)) + " FROM r GROUP BY 1"),
    "q_running_total_stage": with_(SEASONS, STAGES, select="SELECT * FROM st"),
    "q_percentile_strict": with_(SEASONS, SPAN, STAGES, select=f"SELECT v.player, v.position, v.stage, v.total, round(coalesce(count(m.total) FILTER (m.total < v.total) / nullif(count(m.total), 0), 0.5), 6) AS pct FROM st v LEFT JOIN (SELECT * FROM st WHERE {DONE}) m ON m.position = v.position AND m.stage = v.stage WHERE v.{NOW} GROUP BY 1, 2, 3, 4"),
    "q_trend_slope": with_(SEASONS, "x AS (SELECT player, rate, row_number() OVER (PARTITION BY player ORDER BY season) - 1 AS x FROM s)", select="SELECT player, round(CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(rate, x) END, 6) AS slope FROM x GROUP BY 1"),
    "q_discounted_future": with_(SEASONS, FUTURE, select="SELECT player, snapshot_age, round(future_points::DECIMAL(30, 9), 4)::DOUBLE AS future_points, future_seasons FROM fut"),
    "q_vector11": with_(SEASONS, SPAN, STAGES, _vectors("vec", "true"), select="SELECT player, position, season, age, stage, " + ", ".join(f"round(v{k}, {6 if k == 7 else 5}) AS v{k}" for k in range(11)) + " FROM vec"),
    "q_knn_top25": with_(SEASONS, EDGES, select="SELECT player, comp, comp_age, comp_season, round(sim, 6) AS sim, round(raw_sim, 6) AS raw_sim, rank FROM top"),
    "q_weighted_projection": with_(SEASONS, EDGES, FUTURE, PROJECTION, select="SELECT player, round(comp_mean, 3) AS comp_mean, round(years, 5) AS years, round(best_comp, 3) AS best_comp, n_comps, round(anchor, 3) AS anchor, round(projection, 3) AS projection FROM pr"),
    "q_survival": with_(SEASONS, EDGES, SURVIVAL, select="SELECT player, round(bust_rate, 5) AS bust_rate, round(short_rate, 5) AS short_rate, top5_busts, round(survival, 5) AS survival FROM sv"),
    "q_confidence": with_(SEASONS, CAREER, select=f"SELECT player, career_games, round({CONF.format(qb="position = 'MACHINERY'", g="career_games::DOUBLE")}, 6) AS confidence FROM c"),
    "q_missed_season": with_(SEASONS, "g AS (SELECT player, max(season) AS last_season, arg_max(games, season) AS last_games FROM s GROUP BY 1)", select="SELECT *, CASE WHEN 2001 - last_season >= 2 THEN 0.45::DOUBLE WHEN 2001 - last_season = 1 THEN 0.70::DOUBLE WHEN last_games < 8 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM g"),
    "q_late_breakout": with_(SEASONS, "g AS (SELECT player, arg_min(age, season) AS breakout_age FROM s WHERE games >= 10 GROUP BY 1)", select="SELECT *, CASE WHEN breakout_age <= 22 THEN 1.0::DOUBLE WHEN breakout_age = 23 THEN 0.95::DOUBLE WHEN breakout_age = 24 THEN 0.88::DOUBLE ELSE 0.80::DOUBLE END AS multiplier FROM g"),
    "q_penalty_stack": with_(SEASONS, EDGES, FUTURE, PROJECTION, SURVIVAL, f"""
        tp AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY projection DESC, player) AS rn FROM pr JOIN sv USING (player) QUALIFY rn <= 50),
        bl AS (SELECT a.position, a.projection AS baseline FROM tp a JOIN (SELECT position, count(*) // 2 + 1 AS place FROM tp GROUP BY 1) b ON a.position = b.position AND a.rn = b.place),
        x AS (SELECT player, position, projection, baseline, survival, projection * survival AS ps, recent_games < 12 AS stale, {CONF.format(qb="position = 'MACHINERY'", g="career_games::DOUBLE")} AS conf,
                     CASE WHEN position <> 'MACHINERY' OR breakout_age IS NULL OR breakout_age <= 22 THEN 1.0::DOUBLE WHEN breakout_age = 23 THEN 0.95::DOUBLE WHEN breakout_age = 24 THEN 0.88::DOUBLE ELSE 0.80::DOUBLE END AS late,
                     CASE WHEN 2001 - last_season >= 2 THEN 0.45::DOUBLE WHEN 2001 - last_season = 1 THEN 0.70::DOUBLE WHEN last_games < 8 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS missed
              FROM pr JOIN sv USING (player) LEFT JOIN bl USING (position)),
        y AS (SELECT *, CASE WHEN ps > baseline AND NOT stale THEN ps * conf + baseline * (1 - conf) ELSE ps * conf END AS shrunk FROM x)""",
        select="SELECT player, position, round(projection, 3) AS projection, round(baseline, 3) AS baseline, round(survival, 5) AS survival, late, stale, missed, round(least(projection, greatest(0.2::DOUBLE * projection, shrunk * (1.0::DOUBLE - (1.0::DOUBLE - late) * conf) * missed)), 3) AS final FROM y"),
    "q_upper_median_top50": with_(SEASONS, CAREER, "tp AS (SELECT position, career_points, row_number() OVER (PARTITION BY position ORDER BY career_points DESC) AS rn FROM c QUALIFY rn <= 50)", select="SELECT a.position, career_points AS baseline FROM tp a JOIN (SELECT position, count(*) // 2 + 1 AS place FROM tp GROUP BY 1) b ON a.position = b.position AND rn = place"),
    "q_rank_tier": with_(SEASONS, CAREER, "r AS (SELECT player, position, career_points, row_number() OVER (ORDER BY career_points DESC, player) AS rank, row_number() OVER (PARTITION BY position ORDER BY career_points DESC, player) AS position_rank FROM c)", select=f"SELECT *, {TIER} AS tier FROM r"),
    "q_overlay_baseline": with_(SEASONS, CAREER, "n(position, n) AS (VALUES ('AUTOMOBILE', 28), ('BUILDING', 35), ('FURNITURE', 49), ('HOUSEHOLD', 20), ('MACHINERY', 16)), r AS (SELECT player, position, career_points, row_number() OVER (PARTITION BY position ORDER BY career_points DESC, player) AS rk, count(*) OVER (PARTITION BY position) AS cnt, row_number() OVER (ORDER BY career_points DESC, player) AS base_rank FROM c), b AS (SELECT position, career_points AS baseline FROM r JOIN n USING (position) WHERE rk = least(n, cnt)), v AS (SELECT player, position, career_points - baseline AS value, base_rank FROM r JOIN b USING (position)), w AS (SELECT *, row_number() OVER (ORDER BY value DESC, player) AS new_rank FROM v)", select="SELECT *, base_rank - new_rank AS rank_delta FROM w"),
    "q_rookie_profile": with_(SEASONS, ROOKIES, select="SELECT player, position, season, age, games, round(rate, 6) AS rate, round(games / 17.0::DOUBLE, 6) AS played, round(qpg, 6) AS qty_pg, round(rpg, 6) AS returns_pg, round(cpg, 5) AS cents_pg, later, round(later_discounted::DECIMAL(30, 9), 4)::DOUBLE AS later_discounted, later_seasons FROM f"),
    "q_rookie_knn_widen": with_(SEASONS, ROOKIES, ROOKIE_EDGES, select="SELECT player, comp, round(raw, 6) AS raw, round(sim, 6) AS sim, rank, n_near FROM re"),
    "q_rookie_projection": with_(SEASONS, ROOKIES, ROOKIE_EDGES, """
        g AS (SELECT player, sum(sim * later_discounted) / CASE WHEN sum(sim) = 0 THEN 1 ELSE sum(sim) END AS comp_mean, max(later) AS best, count(*) AS n_comps, count(*) FILTER (later <= 0) / count(*) AS bust_rate FROM re GROUP BY 1),
        x AS (SELECT f.player, games, coalesce(n_comps, 0) AS n_comps, coalesce(comp_mean, 0.0) AS comp_mean, coalesce(best, 0.0) AS best, coalesce(bust_rate, 0.0) AS bust_rate, rate,
                     CASE position WHEN 'MACHINERY' THEN 12.0::DOUBLE WHEN 'BUILDING' THEN 7.0::DOUBLE ELSE 8.0::DOUBLE END AS len, CASE position WHEN 'MACHINERY' THEN 0.75::DOUBLE WHEN 'BUILDING' THEN 0.8::DOUBLE ELSE 0.8::DOUBLE END AS disc FROM f LEFT JOIN g USING (player) WHERE season >= 1997),
        y AS (SELECT *, CASE WHEN n_comps > 0 THEN rate * 17.0::DOUBLE * len * disc ELSE 0 END AS anchor, CASE WHEN n_comps > 0 THEN least(1.0::DOUBLE, greatest(0.35::DOUBLE, games / 8.0::DOUBLE)) ELSE 0 END AS confidence FROM x),
        z AS (SELECT *, CASE WHEN best > 0 THEN least(anchor, 1.25::DOUBLE * best) ELSE anchor END AS capped FROM y)""",
        select="SELECT player, n_comps, round(comp_mean, 3) AS comp_mean, round(anchor, 3) AS anchor, round(confidence, 6) AS confidence, round(CASE WHEN capped > comp_mean THEN 0.7::DOUBLE * comp_mean + (1.0::DOUBLE - 0.7::DOUBLE) * capped ELSE comp_mean END * confidence, 3) AS projection, round(len * confidence, 5) AS years, round(bust_rate, 6) AS bust_rate FROM z"),
    "q_zscore_clip": with_(SEASONS, ZRATES, select="SELECT player, season, round(z, 6) AS z, round(adjusted, 6) AS adjusted FROM zr"),
    "q_prospect_knn": with_(SEASONS, ZRATES, """
        g AS (SELECT player, position, round(avg(adjusted), 6) AS a, round(max(adjusted), 6) AS b, round(arg_max(adjusted, season), 6) AS l, max(age) AS age, max(season) AS last_season FROM zr WHERE season <= 1998 GROUP BY 1, 2),
        z AS (SELECT player, position, age, last_season, """ + ", ".join(f"round(({x} - avg({x}) OVER w) / CASE WHEN stddev_pop({x}) OVER w <= 1e-9 OR count(*) OVER w < 2 THEN 1 ELSE stddev_pop({x}) OVER w END, 6) AS z{x}" for x in "abl") + """ FROM g WINDOW w AS (PARTITION BY position)),
        e AS (SELECT t.player AS target, p.player AS comp, sqrt(3.0::DOUBLE * (t.za - p.za) * (t.za - p.za) + 2.0::DOUBLE * (t.zb - p.zb) * (t.zb - p.zb) + 2.0::DOUBLE * (t.zl - p.zl) * (t.zl - p.zl) + 1.5::DOUBLE * (t.age - p.age) * (t.age - p.age)) AS distance
              FROM z t JOIN z p ON t.position = p.position AND p.player <> t.player AND p.last_season < t.last_season),
        r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, comp) AS rank FROM e QUALIFY rank <= 10)""", select="SELECT target, comp, round(distance, 5) AS distance, round(1.0::DOUBLE / (1.0::DOUBLE + distance), 5) AS sim, rank FROM r"),
    "q_pick_tier_blend": """
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 260 END AS pick, floor(o_totalprice) AS price, least(1.0::DOUBLE, (o_orderkey % 9) / 8.0::DOUBLE) AS share FROM orders),
        t AS (SELECT *, CASE WHEN pick IS NULL THEN 'UDFA' WHEN pick <= 10 THEN 'R1_top10' WHEN pick <= 32 THEN 'R1' WHEN pick <= 64 THEN 'R2' WHEN pick <= 100 THEN 'R3' WHEN pick <= 150 THEN 'R4_5' WHEN pick <= 200 THEN 'R6' ELSE 'R7' END AS tier FROM o),
        b AS (SELECT *, CASE tier WHEN 'R1_top10' THEN 1600 WHEN 'R1' THEN 1250 WHEN 'R2' THEN 900 WHEN 'R3' THEN 600 WHEN 'R4_5' THEN 400 WHEN 'R6' THEN 250 WHEN 'R7' THEN 180 ELSE 100 END AS base, coalesce(pick, 999) AS p FROM t)
        SELECT o_orderkey, tier, round(CASE WHEN p <= 0 THEN 100.0::DOUBLE WHEN p > 250 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (1 - (p - 1) / 250.0::DOUBLE) END, 6) AS expected, round(price * share + base * (1 - share), 6) AS blend FROM b""",
    "q_crosswalk_cascade": """
        WITH n AS (SELECT regexp_replace(regexp_replace(lower(c_name), '[ ](jr|sr|ii|iii|iv|v)\\.?$', ''), '[^a-z0-9]', '', 'g') AS name, c_mktsegment AS position, 'N' || c_custkey AS gid, c_custkey, c_acctbal AS bal, c_nationkey AS nat FROM customer),
        f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY gid) = 1)
        SELECT n.c_custkey, CASE WHEN n.bal >= 5000 AND n.nat < 15 THEN 'A' || n.c_custkey WHEN n.bal BETWEEN 0 AND 4999 AND n.nat >= 10 THEN 'B' || n.c_custkey ELSE f.gid END AS resolved
        FROM n LEFT JOIN f ON f.name = n.name AND f.position = n.position""",
    "q_unique_match_cascade": """
        WITH p AS (SELECT p_partkey AS id, p_brand AS b, p_type AS t, p_size AS z FROM part),
        u1 AS (SELECT b, t, z, min(id) AS id FROM p GROUP BY 1, 2, 3 HAVING count(*) = 1), u2 AS (SELECT b, z, min(id) AS id FROM p GROUP BY 1, 2 HAVING count(*) = 1), u3 AS (SELECT t, z, min(id) AS id FROM p GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT p.id AS row_id, coalesce(u1.id, u2.id, u3.id) AS resolved FROM p LEFT JOIN u1 USING (b, t, z) LEFT JOIN u2 ON u2.b = p.b AND u2.z = p.z LEFT JOIN u3 ON u3.t = p.t AND u3.z = p.z""",
    "q_nearest_season": with_(SEASONS, "a AS (SELECT player AS row_id, position, max(season) AS season FROM s GROUP BY 1, 2), b AS (SELECT player AS id, position, min(season) AS season FROM s GROUP BY 1, 2), j AS (SELECT row_id, id, abs(a.season - b.season) AS delta FROM a LEFT JOIN b USING (position) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY delta NULLS LAST, b.season DESC, id) = 1)", select="SELECT row_id, CASE WHEN delta <= 2 THEN id END AS found, CASE WHEN delta <= 2 THEN delta END AS delta FROM j"),
    "q_consensus_rows": with_(SEASONS, RANKED, select="SELECT player, model_rank, outside_rank, model_rank - outside_rank AS delta FROM m JOIN o USING (player)"),
    "q_consensus_counts": with_(SEASONS, RANKED, select="SELECT count(*) FILTER (m.player IS NOT NULL AND o.player IS NOT NULL) AS matched, count(*) FILTER (o.player IS NULL) AS model_only, count(*) FILTER (m.player IS NULL) AS outside_only FROM m FULL JOIN o ON m.player = o.player"),
    "q_latest_snapshot": "SELECT event_type, user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q_latest_before": "WITH c AS (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 AS cut FROM events) SELECT user_id, event_id, event_type FROM events, c WHERE epoch_us(ts) < cut QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q_spearman_avg_ties": with_(SEASONS, PAIRS, "r AS (SELECT position, rank() OVER (PARTITION BY position ORDER BY early) + (count(*) OVER (PARTITION BY position, early) - 1) / 2.0 AS x, rank() OVER (PARTITION BY position ORDER BY late) + (count(*) OVER (PARTITION BY position, late) - 1) / 2.0 AS y FROM pairs)", select="SELECT position, round(CASE WHEN count(*) < 2 OR stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(x, y) END, 6) AS rho, count(*) AS n FROM r GROUP BY 1"),
    "q_hit_at_k": with_(SEASONS, PAIRS, HITS, select="SELECT position, round(hit_rate, 6) AS hit_rate FROM hits"),
    "q_gates": with_(SEASONS, PAIRS, HITS, select="SELECT position, CASE WHEN (0.2 - hit_rate) / 0.2 <= 0 THEN 'pass' WHEN (0.2 - hit_rate) / 0.2 <= 0.05 THEN 'soft_fail' ELSE 'hard_fail' END AS gate FROM hits"),
    "q_pair_h2h": with_(SEASONS, PAIRS, "r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY early DESC, player) AS m, row_number() OVER (PARTITION BY position ORDER BY g DESC, player) AS o FROM pairs)", select="SELECT a.position, count(*) AS pairs, round(avg((a.late > b.late)::INT::DOUBLE), 6) AS model_share FROM r a JOIN r b ON a.position = b.position AND b.m - a.m BETWEEN 1 AND 5 AND a.late <> b.late AND a.o > b.o GROUP BY 1"),
    "q_percentile_cutoffs": with_(SEASONS, PEAK3.format(s="s"), select="SELECT c_mktsegment AS position, round(quantile_cont(peak3, 0.8), 5) AS elite, round(quantile_cont(peak3, 0.3), 5) AS bust FROM pk JOIN customer ON player = c_custkey GROUP BY 1"),
    "q_ras_minmax": "WITH g AS (SELECT *, min(p_size) OVER w AS lo, max(p_size) OVER w AS hi, min(p_retailprice) OVER w AS l2, max(p_retailprice) OVER w AS h2, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand)) SELECT p_partkey, CASE WHEN n >= 5 THEN round((10.0::DOUBLE - (p_size::DOUBLE - lo) / (hi - lo) * 10.0::DOUBLE + (p_retailprice - l2) / (h2 - l2) * 10.0::DOUBLE) / 2.0::DOUBLE, 5) END AS ras FROM g",
    "q_multi_row_collapse": "WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN '3TM' ELSE 'S' || (l_suppkey % 7) END AS team, l_partkey, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey} AS o FROM lineitem), r AS (SELECT l_orderkey, arg_max(team, o) FILTER (team <> '3TM') AS recent_team FROM l GROUP BY 1) SELECT l_orderkey, l_linenumber, team, l_partkey, recent_team FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (team <> '3TM')::INT, o) = 1) l JOIN r USING (l_orderkey)",
    "q_full_outer_first_nonnull": with_(SEASONS, "a AS (SELECT player, season, CASE WHEN games > 6 THEN points END AS x, games::DOUBLE AS y FROM s WHERE games >= 6), b AS (SELECT player, season, qty::DOUBLE AS x FROM s WHERE returns >= 2), d AS (SELECT player, season, returns::DOUBLE AS y, cents / 100 AS z FROM s WHERE qty >= 250), k AS (SELECT player, season FROM a UNION SELECT player, season FROM b UNION SELECT player, season FROM d)", select="SELECT k.player, k.season, coalesce(a.x, b.x) AS x, coalesce(a.y, d.y) AS y, d.z FROM k LEFT JOIN a USING (player, season) LEFT JOIN b USING (player, season) LEFT JOIN d USING (player, season)"),
    "q_roster_rollup": with_(SEASONS, ROSTER, select="SELECT c_nationkey AS team, c_mktsegment AS position, sum(coalesce(score, 0)) AS total, count(score) AS rated, count(*) FILTER (score IS NULL) AS unrated, arg_max(c_custkey, {'a': score, 'b': c_custkey}) FILTER (score IS NOT NULL) AS best FROM customer LEFT JOIN sc ON player = c_custkey GROUP BY 1, 2"),
    "q_power_ranks": with_(SEASONS, ROSTER, "t AS (SELECT c_nationkey AS team, sum(coalesce(score, 0)) AS total FROM customer LEFT JOIN sc ON player = c_custkey GROUP BY 1)", select="SELECT team, total, row_number() OVER (ORDER BY total DESC, team) AS power_rank, round(total - avg(total) OVER (), 4) AS above_mean FROM t"),
    "q_trade_deltas": with_(SEASONS, ROSTER, TRADES, select="SELECT * FROM tr"),
    "q_trade_delta_z": with_(SEASONS, ROSTER, TRADES, "g AS (SELECT team, count(*) AS trades, avg(delta) AS mean_delta FROM tr GROUP BY 1)", select="SELECT team, trades, round(mean_delta, 5) AS mean_delta, round((mean_delta - avg(mean_delta) OVER ()) / stddev_pop(mean_delta) OVER (), 5) AS trade_z FROM g"),
    "q_set_ops": with_(SEASONS, "a AS (SELECT player FROM s WHERE season = 1996), b AS (SELECT player FROM s WHERE season = 1997)", select="SELECT 'union' AS kind, player FROM (SELECT player FROM a UNION SELECT player FROM b) UNION ALL SELECT 'both', player FROM (SELECT player FROM a INTERSECT SELECT player FROM b) UNION ALL SELECT 'first_only', player FROM a WHERE player NOT IN (SELECT player FROM b)"),
    "q_html_fields": r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs FROM pages",
    "q_json_props": "WITH e AS (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM e GROUP BY 1",
    "q_grouping_overall": with_(SEASONS, select="SELECT position, count(*) AS n, sum(points) AS total FROM s GROUP BY GROUPING SETS ((position), ())"),
    "q_career_length_lift": with_(SEASONS, f"""
        g AS (SELECT player, count(*) AS n, sum(returns) / sum(games) * 100 AS per, floor((min(season) + max(season)) / 2) AS mid FROM s GROUP BY 1 HAVING count(*) >= 2),
        k AS (SELECT n, CASE WHEN per < 20 THEN 'low' WHEN per < 28 THEN 'mid' ELSE 'high' END AS style, least({ERA.format('mid')}, 3) AS era FROM g),
        md AS (SELECT style, era, median(n) AS med, count(*) AS careers FROM k GROUP BY 1, 2)""", select="SELECT md.style, md.era, md.careers, round(CASE WHEN md.careers < 3 THEN 1.0 WHEN l.med IS NULL THEN 1.0 ELSE least(1.5, greatest(1.0, l.med / md.med)) END, 6) AS lift FROM md LEFT JOIN md l ON l.era = md.era AND l.style = 'low'"),
    "q_conference_tier": "WITH x AS (SELECT CASE n_regionkey WHEN 0 THEN 'Big East' WHEN 1 THEN 'WAC' WHEN 2 THEN 'SEC' WHEN 3 THEN 'MAC' WHEN 4 THEN 'American' END AS conference, year(o_orderdate)::INT + 12 AS year FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) SELECT conference, year, CASE WHEN conference = 'SEC' THEN 'P5' WHEN conference = 'Big East' THEN CASE WHEN year <= 2012 THEN 'P5' ELSE 'G5_top' END WHEN conference = 'WAC' THEN CASE WHEN year BETWEEN 2007 AND 2012 THEN 'G5_top' ELSE 'G5' END WHEN conference = 'American' THEN 'G5_top' WHEN conference = 'MAC' THEN 'G5' ELSE 'FCS' END AS tier, count(*) AS orders FROM x GROUP BY 1, 2, 3",
    "q_name_normalise_1": with_(NAMES, select=rf"SELECT doc_id, nullif({_squeeze('regexp_replace(regexp_replace(' + _squeeze(f'lower({FOLD})') + rf", '((,\s*|\s+)({TAIL})\.?)+$', ''), '[.]', '', 'g')")}, '') AS normal FROM nm"),
    "q_name_normalise_2": with_(NAMES, select=rf"SELECT doc_id, regexp_replace(regexp_replace(trim(lower({FOLD}), ' '), '\s+({TAIL})\.?$', ''), '[^a-z0-9]', '', 'g') AS normal FROM nm"),
    "q_name_normalise_3": with_(NAMES, select=f"SELECT doc_id, {_prospect('trim(lower(name), chr(32))')} AS normal FROM nm"),
    "q_name_normalise_4": with_(NAMES, select=rf"SELECT doc_id, regexp_replace({_squeeze('regexp_replace(lower(name), ' + chr(39) + '[.,' + chr(39) * 2 + '`-]' + chr(39) + ', chr(32), ' + chr(39) + 'g' + chr(39) + ')')}, ' ({TAIL})$', '') AS normal FROM nm"),
    "q_name_normalise_5": with_(NAMES, select=f"SELECT doc_id, {_squeeze('regexp_replace(lower(name), ' + chr(39) + '[.,' + chr(39) * 2 + '`-]' + chr(39) + ', chr(32), ' + chr(39) + 'g' + chr(39) + ')')} AS normal FROM nm"),
    "q_name_normalise_6": with_(NAMES, select=rf"SELECT doc_id, regexp_replace(regexp_replace(lower(trim(name, chr(32))), ' ({TAIL})\.?$', ''), '[^a-z0-9 ]', '', 'g') AS normal FROM nm"),
    "q_name_normalise_7": with_(NAMES, select=rf"SELECT doc_id, regexp_replace({_squeeze('name')}, '^\S+ ?', '') AS normal FROM nm"),
}
