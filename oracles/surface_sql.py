"""Oracles of discovery, surface, quality, pages and ledger."""

from oracles.base import AS_OF, BODIES, cte, months, r, sql
from oracles import ranking, analytics, analytics_sql, market, etl_sql, market_sql  # noqa: F401
from oracles.analytics import years
from oracles.market import norm, scored
from oracles.ranking import clamp

R6 = lambda *cs: ", ".join(f"{r(c, 6)} AS {c}" for c in cs)
U = lambda x: clamp(x, 0, 1)
P1 = lambda c: f"(CASE WHEN {c}>1 THEN {c}/100 ELSE {c} END)"
cte("pool", "SELECT f.* FROM final_rank f JOIN (SELECT competitor, arg_min(division, (-final_rating, division)) AS division FROM final_rank GROUP BY 1) USING (competitor, division)")
cte("org", "SELECT o.competitor, organisation, count(*) FILTER (result='win') AS wins, count(*) FILTER (result='loss') AS losses, count(*) FILTER (result='draw') AS draws, max(tier_multiplier) AS m FROM outside o JOIN (SELECT competitor, min(date) AS debut FROM sides GROUP BY 1) USING (competitor) WHERE organisation<>'HOUSEHOLD' AND result IN ('win','loss','draw') AND date<debut GROUP BY 1,2")
W = "(0.7::DOUBLE+0.3::DOUBLE*" + U("f.contests/10") + ")"
BOARDS = {
    "finishers": f"finish_rate*{W}", "knockouts": f"(f.ko_rate*0.7::DOUBLE+{U('kd_total/n')}*0.3::DOUBLE)*{W}", "submissions": f"(f.sub_rate*0.7::DOUBLE+{U('sub_total/n/1.5')}*0.3::DOUBLE)*{W}",
    "strikers": f"{P1('c.accuracy')}*0.4::DOUBLE+{P1('distance_share')}*0.3::DOUBLE+{U('kd_total/n')}*0.3::DOUBLE",
    "grapplers": f"{U('td_total/n/3')}*0.4::DOUBLE+{P1('ground_share')}*0.3::DOUBLE+{U('ctrl_total/n/300')}*0.3::DOUBLE"}
cte("board_rows", " UNION ALL ".join(f"SELECT f.competitor, f.division, '{b}' AS board, {r(e,6)} AS score FROM (SELECT *, greatest(contests,1) AS n FROM pool) f JOIN competitors c USING (competitor)" for b, e in BOARDS.items()))
UM = lambda x: f"list_sort(list({x}))[(count({x})//2+1)::INT]"
cte("bench", "SELECT f.division, w.ratio_career AS ratio, w.cl AS landed15, p.absorbed15 FROM final_rank f JOIN wide w USING (competitor) JOIN (FROM pace WHERE \"window\"='career') p USING (competitor) WHERE w.ratio_career IS NOT NULL")
cte("depths", f"SELECT division, {UM('final_rating')} AS depth FROM final_rank WHERE contender_rank<=15 GROUP BY 1")
cte("next_up", f"""SELECT competitor, arg_min(slot_id,(date,slot_id)) AS slot_id, min(date) AS date, arg_min(event_id,(date,slot_id)) AS event_id, arg_min(division,(date,slot_id)) AS division, arg_min(main_event,(date,slot_id)) AS main_event,
 arg_min_null(opponent,(date,slot_id)) AS opponent, arg_min(opponent_name,(date,slot_id)) AS opponent_name FROM (SELECT c1 AS competitor, c2 AS opponent, name2 AS opponent_name, * EXCLUDE (c1,c2,name1,name2) FROM upcoming UNION ALL SELECT c2, c1, name1, * EXCLUDE (c1,c2,name1,name2) FROM upcoming) WHERE competitor IS NOT NULL AND date>={AS_OF} GROUP BY 1""")
SHORT = "CASE method WHEN 'KO/TKO' THEN 'KO R'||round WHEN 'SUB' THEN 'SUB R'||round WHEN 'U-DEC' THEN 'UD' WHEN 'S-DEC' THEN 'SD' WHEN 'M-DEC' THEN 'MD' END"
PC = lambda s: f"(SELECT competitor, age, rating, form_nudge, is_champion, shown_rank, ranked_division, style, finish_rate, schedule_quality FROM profile) {s}"
RL = lambda s: f"CASE WHEN {s}.is_champion THEN 'C' WHEN {s}.shown_rank IS NOT NULL THEN '#'||{s}.shown_rank||' '||{s}.ranked_division END"
WP = lambda a, b: f"1/(1+pow(10::DOUBLE,(({b})-({a}))/400))"
cte("enriched", f"""SELECT u.*, {RL('a')} AS rank_label1, {RL('b')} AS rank_label2, a.style AS style1, b.style AS style2, a.age AS age1, b.age AS age2, a.finish_rate AS f1, b.finish_rate AS f2, a.schedule_quality AS s1, b.schedule_quality AS s2,
 CASE WHEN a.rating IS NOT NULL AND b.rating IS NOT NULL THEN {WP('a.rating','b.rating')} END AS prob1,
 CASE WHEN a.rating IS NOT NULL AND b.rating IS NOT NULL AND (a.form_nudge<>0 OR b.form_nudge<>0) THEN {WP('a.rating+a.form_nudge','b.rating+b.form_nudge')} END AS form_prob1
FROM upcoming u LEFT JOIN {PC('a')} ON a.competitor=u.c1 LEFT JOIN {PC('b')} ON b.competitor=u.c2 WHERE u.date>={AS_OF}""")
cte("rivals", "SELECT division AS pair_id, max(competitor) FILTER (pos=1) AS a, max(competitor) FILTER (pos=2) AS b FROM ranked WHERE pos<=2 GROUP BY 1")
cte("gold_old", "SELECT division, competitor, pos AS rank, rank_score AS score FROM ranked WHERE pos<=15")
cte("gold_new", "SELECT division, competitor, rank, display_score AS score FROM final_rank WHERE rank<=15")
cte("gold", """SELECT division, competitor, o.rank AS old_rank, n.rank AS new_rank, CASE WHEN o.rank IS NULL THEN 'added' WHEN n.rank IS NULL THEN 'removed' WHEN o.rank<>n.rank THEN 'reordered' ELSE 'same' END AS kind, coalesce(abs(o.score-n.score)>0.5,false) AS drift
FROM gold_old o FULL JOIN gold_new n USING (division, competitor)""")
cte("hrefs", """SELECT page_id, unnest(x) AS href, unnest(range(len(x)))::INT AS pos FROM (SELECT page_id, regexp_extract_all(html,'href="([^"]+)"',1) AS x FROM pages)""")
AMER = lambda p: f"(CASE WHEN {p}>=2 THEN {r(f'({p}-1)*100')} ELSE {r(f'-100/({p}-1)')} END)::INT"
cte("cells", f"SELECT book, side, contest_id, american, {r('CASE WHEN american>0 THEN 1+american/100 ELSE 1+100/abs(american) END',6)} AS price FROM (SELECT contest_id, side, book, CASE side WHEN 1 THEN {AMER('price1')} ELSE {AMER('price2')} END AS american FROM side_prices, (VALUES (28),(1)) b(book), (VALUES (1),(2)) s(side))")
cte("slot_preds", f"""SELECT c.contest_id AS slot_id, (c.date+(c.contest_id%5-2)::INT)::DATE AS date, CASE WHEN c.contest_id%23=0 THEN c1+500000 ELSE c1 END AS c1, c2,
 coalesce({WP('h.rating_before','h.opponent_rating')},0.5) AS prob1, CASE WHEN c.contest_id%2=0 THEN coalesce({WP('h.rating_before','h.opponent_rating')},0.5)*0.9 END AS form_prob1
FROM contests c LEFT JOIN history h ON h.contest_id=c.contest_id AND h.competitor=c.c1""")
cte("day_results", "SELECT least(c1,c2) AS lo, greatest(c1,c2) AS hi, date, min((st, w)) AS r FROM (SELECT *, CASE WHEN result1='W' OR result2='W' THEN 'settled' WHEN result1='D' THEN 'void_draw' ELSE 'void_nc' END AS st, CASE WHEN result1='W' THEN c1 WHEN result2='W' THEN c2 END AS w FROM contests) GROUP BY 1,2,3")
cte("led", f"""SELECT s.*, h.r, s.date<{AS_OF} AS due, CASE WHEN s.date<{AS_OF} AND h.r IS NOT NULL THEN h.r[1] WHEN s.date<{AS_OF} AND date_diff('day',s.date,{AS_OF})>14 THEN 'void_scratched' ELSE 'pending' END AS status,
 CASE WHEN s.date<{AS_OF} THEN h.r[2] END AS winner
FROM slot_preds s LEFT JOIN (SELECT s.slot_id, arg_min(d.r, (abs(date_diff('day',s.date,d.date)), d.date)) AS r FROM slot_preds s JOIN day_results d ON d.lo=least(s.c1,s.c2) AND d.hi=greatest(s.c1,s.c2) AND abs(date_diff('day',s.date,d.date))<=3 GROUP BY 1) h USING (slot_id)""")
cte("reaches", "SELECT competitor, (nation+55)::INT AS reach FROM competitors WHERE nation>=5")
cte("pcmp", """SELECT p.*, r.reach, w.diff15 FROM profile p LEFT JOIN reaches r USING (competitor) LEFT JOIN (FROM pace WHERE "window"='career') w USING (competitor)""")
cte("tforms", f"""SELECT l.competitor, string_agg(l.result||' '||{SHORT}||' vs. '||opponent_name||CASE WHEN EXISTS (SELECT 1 FROM titles t WHERE least(t.champion,t.challenger)=least(l.competitor,l.opponent) AND greatest(t.champion,t.challenger)=greatest(l.competitor,l.opponent) AND abs(date_diff('day',t.date,l.date))<=3) THEN ' (title)' ELSE '' END, '; ' ORDER BY rev) AS form FROM log l WHERE rev<=5 GROUP BY 1""")
STATS = ("rating", "age", "finish_rate", "schedule_quality", "ratio_career", "ratio_last3", "accuracy", "reach", "diff15")
ORACLES = {
    "E7_pedigree_by_organisation": sql(f"""SELECT competitor, sum(wins)::BIGINT AS wins, sum(losses)::BIGINT AS losses, sum(draws)::BIGINT AS draws, {r('least(CASE WHEN sum(wins+losses)>0 THEN sum(wins)/sum(wins+losses) ELSE 0 END*least(sum(wins+losses+draws)/5,1)*max(m),0.75)',6)} AS strength,
      string_agg(organisation||':'||wins||':'||losses||':'||draws,'; ' ORDER BY wins+losses DESC, organisation) AS by_organisation FROM org GROUP BY 1"""),
    "F1_ranked_pool": sql("SELECT competitor, division, final_rating, is_champion FROM pool"),
    "F2_top_list": sql("SELECT row_number() OVER (ORDER BY final_rating DESC, competitor)::INT AS place, competitor, division, final_rating, schedule_quality FROM pool QUALIFY place<=30"),
    "F3_leaderboards": sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY score DESC, competitor)::INT AS place FROM board_rows WHERE score>0) WHERE place<=15"),
    "F4_division_benchmarks": sql(f"SELECT division, {UM('ratio')} AS ratio, {UM('landed15')} AS landed15, {UM('absorbed15')} AS absorbed15, count(*) AS sample FROM bench GROUP BY 1 HAVING count(*)>=10"),
    "F5_division_depth": sql(f"SELECT division, depth, {r('CASE WHEN hi>lo THEN pow((depth-lo)/(hi-lo),1.35::DOUBLE) ELSE 0 END',6)} AS heat FROM depths, (SELECT min(depth) AS lo, max(depth) AS hi FROM depths)"),
    "F6_prospects": sql(f"""SELECT x.competitor, c.name, c.home_division, w||'-'||l AS record, n, {years('b.born')} AS age, f.our_rank, CASE WHEN p.contests>=3 THEN p.wins||'-'||p.losses END AS outside_record,
      {r('t.rating')}::BIGINT AS elo, {r('(t.rating-1500)/n',1)} AS climb, last1, last2, u.date AS next_date FROM (
      SELECT career AS competitor, any_value(competitor) AS holder, count(*) AS n, count(*) FILTER (result='W') AS w, count(*) FILTER (result='L') AS l, max(date) AS latest, max(lab) FILTER (back=1) AS last1, max(lab) FILTER (back=2) AS last2
      FROM (SELECT *, result||' '||{SHORT}||' vs. '||opponent_name AS lab, row_number() OVER (PARTITION BY career ORDER BY seq DESC) AS back
       FROM (SELECT *, competitor + CASE WHEN competitor%2=1 THEN date_diff('day',date,{AS_OF})//30 ELSE 0 END*1000000 AS career FROM log)) GROUP BY 1) x
      JOIN ratings t ON t.competitor=holder JOIN competitors c ON c.competitor=holder LEFT JOIN next_up u ON u.competitor=x.competitor LEFT JOIN births b ON b.competitor=holder
      LEFT JOIN (SELECT competitor, min(contender_rank) AS our_rank FROM final_rank GROUP BY 1) f ON f.competitor=x.competitor LEFT JOIN pedigree p ON p.competitor=holder
      WHERE n<=5 AND w>l AND x.competitor NOT IN (SELECT competitor FROM final_rank WHERE is_champion) AND ({months('latest',AS_OF)}<=15 OR u.date IS NOT NULL) ORDER BY t.rating DESC, x.competitor LIMIT 20"""),
    "F7_outside_prospects": sql("""SELECT a.*, b.notable, last_date>=DATE '1995-01-01' AS active FROM (SELECT opponent_id, count(*) FILTER (result='loss') AS beat, count(*) FILTER (result='win') AS lost_to, max(tier_multiplier) AS top_multiplier, max(date) AS last_date, 'Rival '||opponent_id AS name
      FROM outside WHERE result IN ('win','loss') AND opponent_id NOT IN (SELECT 'X'||n_nationkey FROM nation) GROUP BY 1) a JOIN (SELECT opponent_id, string_agg('beat '||coalesce(name,'?')||' ('||date||')', '; ' ORDER BY rn) AS notable FROM (
       SELECT o.*, r.name, row_number() OVER (PARTITION BY opponent_id ORDER BY date DESC, outside_id DESC) AS rn FROM outside o LEFT JOIN roster r USING (competitor) WHERE result='loss') WHERE rn<=4 GROUP BY 1) b USING (opponent_id) WHERE beat>0"""),
    "F9_pedigree_coverage": sql(f"""SELECT count(*) AS competitors, count(*) FILTER (a) AS active, count(*) FILTER (a AND s>0) AS active_with_signal, count(*) FILTER (contests<6) AS low_sample, count(*) FILTER (contests<6 AND s>0) AS low_sample_with_signal, {r('avg(s) FILTER (s>0)',6)} AS mean_strength
      FROM (SELECT c.competitor, c.contests, coalesce({months('l.d',AS_OF)}<=24,false) AS a, p.strength AS s FROM competitors c LEFT JOIN (SELECT competitor, max(date) AS d FROM sides GROUP BY 1) l USING (competitor) LEFT JOIN pedigree p USING (competitor))"""),
    "I1_division_ranking": sql("SELECT rank, competitor, name, final_rating, display_score FROM final_rank WHERE division='EUROPE'"),
    "I2_dashboard": sql("""SELECT division, max(name) FILTER (is_champion) AS champion, string_agg(contender_rank||':'||name,'; ' ORDER BY contender_rank) FILTER (contender_rank<=5) AS contenders,
      (count(*) FILTER (contender_rank<=15))::INT AS depth_size, max(final_rating) FILTER (contender_rank<=15) AS deepest FROM final_rank GROUP BY 1"""),
    "I3_competitor_profile": sql("SELECT * FROM profile ORDER BY rating DESC, competitor LIMIT 1"),
    "I4_name_search": sql(f"""SELECT competitor, name, home_division, contests, s AS score FROM (SELECT *, CASE WHEN k='vanb' THEN 3.0 WHEN starts_with(k,'vanb') THEN 2.0 WHEN contains(' '||k,' vanb') THEN 1.5 WHEN contains(k,'vanb') THEN 1.0 END::DOUBLE AS s FROM (SELECT *, {norm('name','search')} AS k FROM competitors))
      WHERE s IS NOT NULL ORDER BY s DESC, contests DESC, competitor LIMIT 8"""),
    "I4_index_search": sql(" UNION ALL ".join(f"""SELECT * FROM (SELECT competitor, name, home_division, contests, s AS score, '{t}' AS asked FROM (
      SELECT *, CASE WHEN k='{q}' THEN 3.0 WHEN starts_with(k,'{q}') THEN 2.0 WHEN contains(' '||k,' {q}') THEN 1.5 WHEN contains(k,'{q}') THEN 1.0 END::DOUBLE AS s FROM (SELECT *, {norm('name','search')} AS k FROM competitors))
      WHERE s IS NOT NULL ORDER BY s DESC, contests DESC, competitor LIMIT {8 if len(q) > 1 else 0})""" for t, q in (("vanb", "vanb"), ("AN", "an"), ("3", "3"), ("zzzz", "zzzz"), ("vanbu", "vanbu")))),
    "I5_upcoming_events": sql(f"SELECT event_id, min(date) AS date, arg_min(event_name,bout_order) AS event_name, string_agg(bout_order||':'||name1||':'||name2,'; ' ORDER BY bout_order) AS bouts FROM upcoming WHERE date>={AS_OF} GROUP BY 1"),
    "I6_next_contest": sql("SELECT * FROM next_up"),
    "I7_upcoming_cards": sql(f"""SELECT slot_id, c1, c2, rank_label1, rank_label2, style1, style2, age1, age2, (SELECT record FROM profile p WHERE p.competitor=c1) AS record1, (SELECT record FROM profile p WHERE p.competitor=c2) AS record2,
      (SELECT form FROM tforms f WHERE f.competitor=c1) AS form1, (SELECT form FROM tforms f WHERE f.competitor=c2) AS form2, (SELECT reach FROM reaches f WHERE f.competitor=c1) AS reach1, (SELECT reach FROM reaches f WHERE f.competitor=c2) AS reach2, {R6('prob1','form_prob1')} FROM enriched"""),
    "I3_competitor_with_hint": sql("""SELECT p.competitor, p.name, p.record, p.age, p.rating, p.peak, f.division, f.rank, f.contender_rank, forms.form, u.date AS next_date, u.opponent_name AS next_opponent FROM profile p
      JOIN (SELECT *, row_number() OVER (PARTITION BY competitor ORDER BY (competitor=(SELECT min(competitor) FROM final_rank) AND division=(SELECT max(division) FROM final_rank WHERE competitor=(SELECT min(competitor) FROM final_rank))) DESC, final_rating DESC) AS rn FROM final_rank) f
        ON f.competitor=p.competitor AND rn=1 LEFT JOIN next_up u ON u.competitor=p.competitor LEFT JOIN forms ON forms.competitor=p.competitor
      WHERE p.competitor IN ((SELECT min(competitor) FROM final_rank), (SELECT max(competitor) FROM final_rank))"""),
    "I8_event_list": sql(f"SELECT event_id, min(date) AS date, count(*) AS contests, arg_min(name1||' vs. '||name2, bout_order) AS main_event FROM upcoming WHERE date>={AS_OF} GROUP BY 1"),
    "I8_find_event": sql(f"SELECT event_id, date, event_name, CASE WHEN lower(event_name)='hugo van' THEN 1 WHEN contains(lower(event_name),'hugo van') THEN 2 ELSE 3 END AS matched FROM (SELECT event_id, min(date) AS date, arg_min(event_name,bout_order) AS event_name FROM upcoming WHERE date>={AS_OF} GROUP BY 1) WHERE contains(lower(event_name),'hugo van') OR contains('hugo van',lower(event_name)) ORDER BY matched, date, event_id LIMIT 1"),
    "I9_compare_probabilities": sql(f"""SELECT pair_id, {r('100*'+WP('a.rating','b.rating'))}::INT AS percent_a, CASE WHEN a.form_nudge<>0 OR b.form_nudge<>0 THEN {r('100*'+WP('a.rating+a.form_nudge','b.rating+b.form_nudge'))}::INT END AS form_percent_a, a.contests<=5 OR b.contests<=5 AS thin_sample
      FROM rivals v JOIN profile a ON a.competitor=v.a JOIN profile b ON b.competitor=v.b"""),
    "I9_compare_statistics": sql("SELECT *, CASE WHEN value_a IS NULL OR value_b IS NULL OR value_a=value_b THEN 'none' WHEN (value_a>value_b)<>(statistic='age') THEN 'a' ELSE 'b' END AS leader FROM (" + " UNION ALL ".join(f"SELECT pair_id, '{s}' AS statistic, a.{s}::DOUBLE AS value_a, b.{s}::DOUBLE AS value_b FROM rivals v JOIN pcmp a ON a.competitor=v.a JOIN pcmp b ON b.competitor=v.b" for s in STATS) + ")"),
    "I10_summary": sql(f"""SELECT p.competitor, p.name, p.record, coalesce(ranked_division, home_division) AS division, age, p.contests<=5 AS provisional, p.is_champion, p.shown_rank, b.external_rank, {r('p.rating')}::INT AS rating, {r('p.peak')}::INT AS peak,
      {r('b.base_rating')}::INT AS core, {r('b.metrics_bonus',1)} AS metrics, {r('b.schedule_nudge',1)} AS schedule, {r('b.external_bonus',1)} AS external, {r('b.final_rating')}::INT AS final, p.months_since,
      (SELECT string_agg(rev||':'||result||':'||opponent_name||':'||({r('delta',1)}+0.0)::VARCHAR,'; ' ORDER BY rev) FROM log l WHERE l.competitor=p.competitor AND rev<=8) AS last_contests FROM profile p LEFT JOIN (SELECT * FROM pool) b USING (competitor)"""),
    "I11_card_view": sql(f"""SELECT slot_id, p1 AS percent1, 100-p1 AS percent2, CASE WHEN abs(fp-p1)>=2 THEN fp END AS form_percent1, tr AS tape_rows, tr>=2 AS show_tape, date_diff('day',{AS_OF},date)::INT AS days_until,
      split_part(event_name,' - ',1) AS title, CASE WHEN contains(event_name,' - ') THEN substr(event_name, strpos(event_name,' - ')+3) END AS subtitle
      FROM (SELECT *, {r('prob1*100')}::INT AS p1, {r('form_prob1*100')}::INT AS fp, (s1 IS NOT NULL AND s2 IS NOT NULL)::INT+(f1 IS NOT NULL AND f2 IS NOT NULL)::INT+(age1 IS NOT NULL AND age2 IS NOT NULL)::INT AS tr FROM enriched)"""),
    "J1_golden_diff": sql("SELECT * FROM gold"),
    "J1_golden_verdict": sql("SELECT count(*) FILTER (kind='added') AS added, count(*) FILTER (kind='removed') AS removed, count(*) FILTER (kind='reordered') AS reordered, count(*) FILTER (drift) AS drift, count(*) FILTER (kind IN ('added','removed','reordered'))=0 AS passed FROM gold"),
    "J2_load_summary": sql("""SELECT * FROM (SELECT count(*) AS contests, count(*) FILTER (date IS NULL) AS undated, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (NOT has_metrics) AS without_metrics, count(DISTINCT event_id) AS events, count(*) FILTER (c1=c2) AS self_contests FROM contests),
      (SELECT count(*) AS competitors, count(*) FILTER (home_division='') AS without_division, count(*) FILTER (contests=0) AS without_contests FROM competitors)"""),
    "J3_invariants": sql("""SELECT 'excluded_organisation' AS rule, count(*) FILTER (organisation='HOUSEHOLD') AS violations FROM org UNION ALL SELECT 'strength_cap', count(*) FILTER (strength>0.75 OR strength<0) FROM pedigree
      UNION ALL SELECT 'nudge_cap', count(*) FILTER (abs(schedule_nudge)>30) FROM final_rank UNION ALL SELECT 'unique_ranks', count(*) FROM (SELECT division, rank FROM final_rank GROUP BY 1,2 HAVING count(*)>1)"""),
    "K1_page_links": sql("SELECT * FROM hrefs"),
    "K1_numbered_links": sql("SELECT page_id, number, min(pos) AS pos, arg_min(href,pos) AS href FROM (SELECT *, regexp_extract(href,'(\\d+)(?:[?#].*)?$',1) AS number FROM (SELECT page_id, pos, href FROM hrefs UNION ALL SELECT page_id, -1, url FROM pages)) WHERE number<>'' GROUP BY 1,2"),
    "K1_slug_ids": sql("SELECT contest_id AS page_id, c1::VARCHAR AS number, 0::INT AS pos, replace(name1,' ','-')||'-'||c1 AS slug FROM contests UNION ALL SELECT contest_id, c2::VARCHAR, 2, replace(name2,' ','-')||'-'||c2 FROM contests"),
    "K2_date_shapes": sql("SELECT contest_id, s::INT AS shape, CASE WHEN s<3 THEN date END AS date FROM contests, (VALUES (0),(1),(2),(3)) v(s)"),
    "K3_price_cells": sql("SELECT * FROM cells"),
    "K4_slug_names": sql("SELECT name, count(*) AS pages FROM (SELECT name1 AS name FROM contests UNION ALL SELECT name2 FROM contests) GROUP BY 1"),
    "K4_event_titles": sql("SELECT slot_id, CASE WHEN slot_id%4=0 OR NOT contains(event_name,' - ') THEN split_part(CASE WHEN slot_id%4=0 THEN event_id ELSE event_name END,' - ',1) ELSE split_part(event_name,' - ',1) END AS title, CASE WHEN slot_id%4<>0 AND contains(event_name,' - ') THEN substr(event_name, strpos(event_name,' - ')+3) WHEN slot_id%4=0 AND contains(event_id,' - ') THEN substr(event_id, strpos(event_id,' - ')+3) END AS subtitle FROM upcoming"),
    "K5_search_queries": sql("SELECT DISTINCT CASE WHEN contest_id%3=0 THEN 'Promo '||contest_id%400 ELSE 'Promo '||list_last(string_split(name1,' '))||' '||string_split(name2,' ')[1] END AS query FROM contests"),
    "H27_prediction_ledger": sql(f"SELECT slot_id, date, status, winner, CASE WHEN status<>'pending' THEN {AS_OF} END AS settled_on, {r('prob1',6)} AS prob1 FROM led"),
    "H27_ledger_scores": sql(f"SELECT model, {scored()} FROM (SELECT winner=c1 AS fav_won, unnest(['pure','form']) AS model, unnest([prob1, coalesce(form_prob1,prob1)]) AS p FROM led WHERE status='settled') GROUP BY 1"),
}
ORACLES["G18_I3_nested_profile"] = sql(f"""SELECT p.competitor, p.name, p.rating, q.reach, {r('x.strike',6)} AS strike, {r('x.activity',6)} AS activity, t.codes, g.total_overperformance, g.upset_contest,
  b.ratio AS peer_ratio, b.sample AS peer_sample, m.avatar, m.nationality, u.date AS next_date, u.opponent_name AS next_opponent
FROM profile p LEFT JOIN radar x USING (competitor) LEFT JOIN reaches q USING (competitor) LEFT JOIN ({BODIES[analytics_sql.ORACLES["G11_trend_codes"]]}) t USING (competitor)
LEFT JOIN ({BODIES[analytics_sql.ORACLES["G10_gauntlet_summary"]]}) g USING (competitor) LEFT JOIN ({BODIES[ORACLES["F4_division_benchmarks"]]}) b ON b.division=coalesce(p.ranked_division,p.home_division)
LEFT JOIN (SELECT competitor::VARCHAR AS canonical_id, CASE WHEN competitor%3=0 THEN '' ELSE 'Nation_'||(competitor%40) END AS nationality,
  CASE WHEN competitor%5<>0 AND competitor%7=0 THEN 'h' WHEN competitor%3<>0 AND competitor%4<>0 THEN 'p'||competitor WHEN competitor%5<>0 AND competitor%2=0 THEN 'b' ELSE '' END AS avatar
  FROM roster WHERE competitor%3<>0 OR competitor%5<>0) m ON m.canonical_id=p.competitor::VARCHAR LEFT JOIN next_up u ON u.competitor=p.competitor""")
