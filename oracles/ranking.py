"""DuckDB counterparts of the ranking products."""

from oracles.base import AS_OF, cte, months, r

cte("overrides", """
SELECT competitor, division, '1' AS rank, NULL::VARCHAR AS remove_from FROM external_rank WHERE rank='5'
UNION ALL
SELECT competitor, CASE division WHEN 'AFRICA' THEN 'AMERICA' WHEN 'AMERICA' THEN 'ASIA' WHEN 'ASIA' THEN 'EUROPE'
  WHEN 'EUROPE' THEN 'MIDDLE EAST' ELSE 'AFRICA' END, 'NR', division FROM external_rank WHERE rank='9'""")
cte("outside", """
SELECT *, CASE tier WHEN 'tier2' THEN 0.78 WHEN 'tier2_5' THEN 0.68 WHEN 'tier3' THEN 0.55 WHEN 'historical' THEN 0.68
  ELSE 0.35 END::DOUBLE AS tier_multiplier FROM (
SELECT o_orderkey AS outside_id, o_custkey//15 AS competitor, (o_orderdate::DATE - 2192)::DATE AS date, c_mktsegment AS organisation,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'tier2' WHEN 'BUILDING' THEN 'tier2_5' WHEN 'FURNITURE' THEN 'tier3'
   WHEN 'HOUSEHOLD' THEN 'historical' ELSE 'tier4' END AS tier,
  'X' || ((o_custkey*7+o_orderkey%3)%400) AS opponent_id,
  CASE WHEN o_orderstatus='F' THEN 'win' WHEN o_orderstatus='O' THEN 'loss' WHEN o_orderpriority='1-URGENT' THEN 'draw' ELSE 'nc' END AS result,
  strftime(o_orderdate, 'Night %Y%m') AS event_name
FROM orders JOIN customer ON c_custkey=o_custkey)""")
cte("pedigree", """
SELECT competitor, wins, losses, contests, top_multiplier,
  least(CASE WHEN wins+losses>0 THEN wins/(wins+losses) ELSE 0 END * least(contests/5,1) * top_multiplier, 0.75) AS strength
FROM (SELECT o.competitor, count(*) FILTER (result='win') AS wins, count(*) FILTER (result='loss') AS losses, count(*) AS contests,
   max(greatest(tier_multiplier,0)) AS top_multiplier
  FROM outside o LEFT JOIN (SELECT competitor, min(date) AS debut FROM sides GROUP BY 1) d USING (competitor)
  WHERE tier<>'historical' AND (debut IS NULL OR o.date IS NULL OR o.date<debut) AND result IN ('win','loss','draw') GROUP BY 1)""")
cte("removals", "SELECT DISTINCT remove_from AS division, competitor FROM overrides WHERE remove_from IS NOT NULL")
SEED = ("CASE external_rank WHEN 'C' THEN 100 WHEN '1' THEN 90 WHEN '2' THEN 85 WHEN '3' THEN 85 WHEN '4' THEN 78 WHEN '5' THEN 78 "
        "WHEN '6' THEN 78 WHEN '7' THEN 70 WHEN '8' THEN 70 WHEN '9' THEN 70 WHEN '10' THEN 70 WHEN '11' THEN 62 WHEN '12' THEN 62 "
        "WHEN '13' THEN 62 WHEN '14' THEN 62 WHEN '15' THEN 62 ELSE 0 END")
cte("members", f"""
SELECT *, {SEED} AS seed FROM (SELECT division, competitor, arg_min(rank, (priority, rank)) AS external_rank FROM (
  SELECT division, competitor, rank, 0 AS priority FROM overrides
  UNION ALL SELECT e.division, e.competitor, e.rank, 1 FROM external_rank e ANTI JOIN removals x USING (division, competitor)) GROUP BY 1,2)""")
cte("cand", """
SELECT c.*, m.external_rank, m.seed FROM (SELECT competitor, home_division AS division FROM competitors WHERE home_division<>''
  UNION SELECT competitor, division FROM members) c ANTI JOIN removals x USING (division, competitor)
LEFT JOIN members m USING (division, competitor)""")
cte("divs", f"""
SELECT s.competitor, c.division, s.contest_id, s.date, {months('s.date', AS_OF)} AS age, s.opponent, s.result, s.has_metrics,
  s.str_self, s.str_opp, s.acc_self, s.acc_opp, s.kd_self, s.td_self, s.td_opp, s.division=c.division AS counts
FROM sides s JOIN cand c USING (competitor) WHERE {months('s.date', AS_OF)} <= 48""")
cte("elig", """
SELECT c.division, c.external_rank, c.seed, p.*, a.div_contests, a.last_div_date
FROM cand c JOIN competitors p USING (competitor)
LEFT JOIN (SELECT division, competitor, count(*) FILTER (counts) AS div_contests, arg_max(counts, (date, contest_id)) AS latest_counts,
  max(date) FILTER (counts) AS last_div_date FROM divs GROUP BY 1,2) a USING (division, competitor)
WHERE p.contests>=3 AND (c.external_rank IS NOT NULL OR (p.home_division=c.division AND a.div_contests>=2 AND a.latest_counts))""")
cte("schedule", """
SELECT d.division, d.competitor, sum(coalesce(t.rating,1500)*w)/sum(w) AS schedule_rating
FROM (SELECT *, CASE WHEN age<0 THEN 1 ELSE pow(0.5::DOUBLE, age/15) END AS w FROM divs WHERE counts AND age/12<=3) d
LEFT JOIN ratings t ON t.competitor=d.opponent GROUP BY 1,2""")


def clamp(x, lo, hi):
    return f"greatest(least({x},{hi}),{lo})"


cte("composite", f"""
SELECT division, competitor, {clamp('sum((str_self-str_opp)*w)/sum(w)/40',-1,1)}*0.4 + {clamp('sum((acc_self-acc_opp)*w)/sum(w)/0.25',-1,1)}*0.2
  + {clamp('sum(kd_self*w)/sum(w)/1.5',0,1)}*0.2 + {clamp('sum((td_self-td_opp)*w)/sum(w)/3',-1,1)}*0.2 AS composite
FROM (SELECT *, CASE WHEN age<0 THEN 1 ELSE pow(0.5::DOUBLE, age/15) END AS w,
  row_number() OVER (PARTITION BY division, competitor ORDER BY date DESC, contest_id DESC) AS rn
  FROM divs WHERE counts AND has_metrics) WHERE rn<=5 GROUP BY 1,2""")


def display(x):
    pts = [(1427, 25), (1500, 42), (1560, 62), (1610, 80), (1645, 91), (1680, 97), (1715, 99), (1760, 100)]
    arms = " ".join(f"WHEN {x}<={b[0]} THEN {a[1]}::DOUBLE+({x}-{a[0]}::DOUBLE)/{b[0]-a[0]}::DOUBLE*{b[1]-a[1]}::DOUBLE"
                    for a, b in zip(pts, pts[1:]))
    return f"CASE WHEN {x}<=1427 THEN 25::DOUBLE {arms} ELSE 100::DOUBLE END"


cte("scored_raw", f"""
SELECT e.*, coalesce(t.rating,1500) AS b0, coalesce(t.peak,1500) AS p0, coalesce(s.schedule_rating,1500) AS s0,
  {clamp('(coalesce(s.schedule_rating,1500)-1500)*0.05::DOUBLE',-30,30)} AS n0,
  coalesce(m.composite*30*least(coalesce(e.div_contests,0)/5,1),0) AS m0, coalesce(e.seed,0)*0.4::DOUBLE AS x0,
  coalesce(g.strength*25*greatest(0,1-e.contests/6),0) AS g0, coalesce(g.strength,0) AS st,
  coalesce({months('coalesce(e.last_div_date, t.last_date)', AS_OF)},999) AS since
FROM elig e LEFT JOIN schedule s USING (division, competitor) LEFT JOIN composite m USING (division, competitor)
LEFT JOIN ratings t USING (competitor) LEFT JOIN pedigree g USING (competitor)""")
cte("scored", f"""
SELECT division, competitor, name, external_rank, wins||'-'||losses||'-'||draws AS record,
  {r('tot',2)} AS final_rating, {r(display('tot'),2)} AS rank_score, {r('b0',2)} AS base_rating, {r('p0',2)} AS peak_rating,
  {r('m0',2)} AS metrics_bonus, {r('n0',2)} AS schedule_nudge, {r('x0',2)} AS external_bonus, {r('g0',2)} AS pedigree_bonus,
  {r('st',3)} AS pedigree_strength, {r('s0',2)} AS schedule_rating, {r('q',2)} AS schedule_quality,
  {r('q*(0.7::DOUBLE+0.3::DOUBLE*act)',2)} AS schedule_strength, {r('act',3)} AS schedule_activity, {r('since',1)} AS months_since,
  coalesce(div_contests,0) AS recent_contests, contests, accuracy, ko_rate, sub_rate, {r('ko_rate+sub_rate',2)} AS finish_rate
FROM (SELECT *, b0+m0+n0+x0+g0 AS tot, {display('s0')} AS q,
  0.7::DOUBLE*{clamp('1-(since-12)/21',0,1)}+0.3::DOUBLE*{clamp('coalesce(div_contests,0)/6',0,1)} AS act FROM scored_raw)""")
cte("ranked", """
SELECT *, row_number() OVER (PARTITION BY division ORDER BY final_rating DESC, schedule_rating DESC, competitor) AS pos FROM scored""")
cte("meetings", f"""
SELECT least(c1,c2) AS lo, greatest(c1,c2) AS hi, division AS label, arg_max(CASE WHEN result1='W' THEN c1 ELSE c2 END, (date, contest_id)) AS winner,
  max(date) AS met_on FROM contests WHERE {months('date', AS_OF)}<=48 AND (result1='W' OR result2='W') AND method<>'S-DEC' GROUP BY 1,2,3""")
cte("edge_raw", f"""
SELECT a.division, w.competitor AS winner, l.competitor AS loser, w.pos AS winner_pos, l.pos AS loser_pos, m.met_on,
  l.final_rating-w.final_rating AS gap
FROM meetings m JOIN ranked a ON a.competitor=m.lo AND a.division=m.label JOIN ranked b ON b.competitor=m.hi AND b.division=m.label
JOIN ranked w ON w.division=m.label AND w.competitor=m.winner
JOIN ranked l ON l.division=m.label AND l.competitor=CASE WHEN m.winner=m.lo THEN m.hi ELSE m.lo END
WHERE w.pos>l.pos AND l.final_rating-w.final_rating<=50 AND {months('m.met_on', AS_OF)}<=18""")
cte("edges", """
SELECT * FROM edge_raw e WHERE NOT EXISTS (
  SELECT 1 FROM sides s LEFT JOIN ranked o ON o.division=e.division AND o.competitor=s.opponent
  WHERE s.competitor=e.winner AND s.result='L' AND s.date>e.met_on
   AND (s.opponent=e.loser OR (o.pos IS NOT NULL AND coalesce(o.external_rank,'')<>'C' AND o.pos>=e.loser_pos)))""")
cte("parents", "SELECT division, winner AS competitor, min(loser_pos) AS up, max(winner_pos) AS pos FROM edges GROUP BY 1,2")
cte("walk", """(division, competitor, path) AS (
 SELECT k.division, k.competitor, [k.pos] FROM ranked k ANTI JOIN parents p USING (division, competitor)
 UNION ALL
 SELECT p.division, p.competitor, list_append(w.path, p.pos) FROM parents p
 JOIN ranked u ON u.division=p.division AND u.pos=p.up JOIN walk w ON w.division=u.division AND w.competitor=u.competitor)""")
cte("moved", """
SELECT k.*, row_number() OVER (PARTITION BY k.division ORDER BY list_append(w.path, 2147483647)) AS pos_h2h
FROM ranked k JOIN walk w USING (division, competitor)""")
cte("streaks", """
SELECT competitor, max(nth)-coalesce(max(nth) FILTER (result<>'L'),-1) AS loss_streak FROM (
 SELECT *, row_number() OVER (PARTITION BY competitor ORDER BY date, contest_id)-1 AS nth FROM sides) GROUP BY 1""")
cte("tie1", """
SELECT *, coalesce(external_rank='C',false) AS champ, sum((NOT coalesce(external_rank='C',false))::INT) OVER (PARTITION BY division ORDER BY pos_h2h) AS grp
FROM moved LEFT JOIN streaks USING (competitor)""")
cte("tie2", """
SELECT *, champ AND coalesce(x_rating-final_rating>0 AND x_rating-final_rating<=8, false) AS fits FROM (
 SELECT *, last_value(CASE WHEN NOT champ THEN final_rating END IGNORE NULLS) OVER (PARTITION BY division ORDER BY pos_h2h) AS x_rating FROM tie1)""")
cte("tie3", """
SELECT *, champ AND min(CASE WHEN champ THEN fits::INT END) OVER (PARTITION BY division, grp ORDER BY pos_h2h)=1 AS lifted FROM tie2""")
cte("floor0", """
SELECT * EXCLUDE (okey), row_number() OVER (PARTITION BY division ORDER BY okey, pos_h2h) AS i0 FROM (
  SELECT *, CASE WHEN lifted THEN pos_h2h-1 WHEN NOT champ
   THEN pos_h2h+sum(lifted::INT) OVER (PARTITION BY division, grp) ELSE pos_h2h END AS okey FROM tie3)""")


def floor_pass(name, src, col, out, member, floor):
    cte(name, f"""
SELECT *, row_number() OVER (PARTITION BY division ORDER BY CASE WHEN {col}<{floor} THEN 0 WHEN {member} AND {col}>{floor} THEN 1 ELSE 2 END,
  CASE WHEN {member} AND {col}>{floor} THEN -{col} ELSE {col} END) AS {out} FROM {src}""")


_no = "coalesce(TRY_CAST(external_rank AS INT) BETWEEN {} AND {} AND loss_streak<2, false)"
floor_pass("floor1", "floor0", "i0", "i1", _no.format(6, 15), 25)
floor_pass("floor2", "floor1", "i1", "i2", _no.format(1, 5), 8)
floor_pass("floor3", "floor2", "i2", "i3", "champ", 2)
cte("final_rank", """
SELECT * EXCLUDE (pos_h2h, grp, x_rating, fits, lifted, i0, i1, i2, i3, champ, ds), champ AS is_champion, i3 AS rank,
  CASE WHEN champ THEN max(ds) OVER (PARTITION BY division) ELSE ds END AS display_score,
  CASE WHEN NOT champ THEN row_number() OVER (PARTITION BY division, champ ORDER BY i3) END AS contender_rank
FROM (SELECT *, max(rank_score) OVER (PARTITION BY division ORDER BY i3 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ds FROM floor3)
QUALIFY i3<=40""")
