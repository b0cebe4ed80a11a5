"""DuckDB counterparts of the analytics products."""

from oracles.base import AS_OF, cte, months, r
from oracles.ranking import clamp, display

cte("log", """
SELECT x.*, x.division AS label, row_number() OVER (PARTITION BY x.competitor ORDER BY x.seq DESC) AS rev, s.method, s.round, s.details, s.event_id, s.name, s.opponent_name
FROM history x JOIN sides s USING (contest_id, competitor)""")
cte("births", """
SELECT s_suppkey AS competitor, (DATE '1955-01-01' + (s_suppkey*97%9000)::INT)::DATE AS born,
 CASE WHEN s_suppkey%4=3 THEN 'year' ELSE 'day' END AS precision FROM supplier WHERE s_nationkey<>13""")
cte("samples", """
SELECT *, row_number() OVER (PARTITION BY competitor ORDER BY seq DESC) AS rev,
  count(*) OVER (PARTITION BY competitor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nth
FROM (SELECT *, (round-1)*300+split_part(clock,':',1)::BIGINT*60+split_part(clock,':',2)::BIGINT AS secs
  FROM sides WHERE has_metrics AND clock LIKE '%:%') WHERE secs>0 AND secs<=3600 AND str_self+str_opp<>0""")


def per15(x, k=1):
    return r(f"{x}/(secs/60e0)*15", k)


cte("pace", f"""
SELECT competitor, "window", contests, {r('secs/60e0')}::BIGINT AS minutes, {per15('landed')} AS landed15, {per15('absorbed')} AS absorbed15,
 {per15('(landed-absorbed)')} AS diff15, {per15('td')} AS td15, {per15('td_abs')} AS td_absorbed15, {per15('kd',2)} AS kd15, {per15('sub')} AS sub15,
 {r('ctrl/(secs/60e0*60)*100',1)} AS ctrl_share, CASE WHEN n_acc>0 THEN {r('acc100/n_acc/100',3)} END AS accuracy, kd_abs
FROM (SELECT competitor, w AS "window", count(*) AS contests, sum(secs)::BIGINT AS secs, sum(str_self) AS landed, sum(str_opp) AS absorbed,
  sum(td_self)::BIGINT AS td, sum(td_opp)::BIGINT AS td_abs, sum(kd_self)::BIGINT AS kd, sum(kd_opp)::BIGINT AS kd_abs, sum(sub_self)::BIGINT AS sub, sum(ctrl_self)::BIGINT AS ctrl,
  count(*) FILTER (acc_self>0) AS n_acc, sum(round(acc_self*100)) FILTER (acc_self>0) AS acc100
  FROM samples, (VALUES ('career',1000000000),('recent',5),('last3',3)) v(w,k) WHERE rev<=k GROUP BY 1,2)
WHERE "window"='career' OR contests>=3""")


def ratio(l, a):
    return f"CASE WHEN {l} IS NULL OR {l}<=0 THEN NULL WHEN {a}<1 THEN 9.99 ELSE {r(f'{l}/{a}',2)} END"


cte("wide", f"""
SELECT c.competitor, c.contests AS n_career, c.landed15 AS cl, t.landed15 AS tl, t.competitor IS NULL AS no_last3,
 {r('q.landed15-c.landed15',1)} AS landed15_delta, CASE WHEN c.landed15>=5 THEN {r('q.landed15/c.landed15-1',3)} END AS landed_pct_change,
 {r('q.diff15-c.diff15',1)} AS diff15_delta, {r('q.td15-c.td15',1)} AS td15_delta, {r('q.accuracy-c.accuracy',3)} AS accuracy_delta,
 {ratio('c.landed15','c.absorbed15')} AS ratio_career, {ratio('t.landed15','t.absorbed15')} AS ratio_last3
FROM (FROM pace WHERE "window"='career') c LEFT JOIN (FROM pace WHERE "window"='recent') q USING (competitor)
LEFT JOIN (FROM pace WHERE "window"='last3') t USING (competitor)""")
NUDGE = "coalesce(" + clamp(r("(diff15_delta*0.7+td15_delta*5*0.3)*2.2", 1), -45, 45) + ",0)"
cte("durable", f"""
SELECT *, ko_losses+sub_losses AS times_finished FROM (
SELECT competitor, count(*) FILTER (result='L' AND method='KO/TKO') AS ko_losses, count(*) FILTER (result='L' AND method='SUB') AS sub_losses,
  count(*) FILTER (result='L' AND method LIKE '%DEC') AS decision_losses, max(year(date)) FILTER (result='L' AND method IN ('KO/TKO','SUB'))::INT AS last_finished_year
FROM sides GROUP BY 1) JOIN (SELECT competitor, CASE WHEN minutes>0 THEN {r('kd_abs/minutes*15',2)} ELSE 0 END AS kd_absorbed15, absorbed15 AS strikes_absorbed15
  FROM pace WHERE "window"='career') USING (competitor)""")
cte("points", """
SELECT *, sum(ou) OVER (PARTITION BY competitor ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM (
 SELECT *, score-exp AS ou FROM (SELECT *, 1/(1+pow(10::DOUBLE,(opponent_rating-rating_before)/400)) AS exp FROM log))""")


def years(born):
    return (f"(year({AS_OF})-year({born})-(month({AS_OF})*100+day({AS_OF}) < month({born})*100+day({born}))::INT)::INT")


cte("trendctx", f"""
SELECT a.*, t.rating, t.peak, {years('b.born')} AS age, date_diff('day',debut,{AS_OF})/365.25::DOUBLE AS tenure_years,
  {months('latest',AS_OF)} AS months_since, {r('opp_recent-opp_career')} AS opp_step
FROM (SELECT competitor, min(date) AS debut, max(date) AS latest, avg(opponent_rating) AS opp_career, avg(opponent_rating) FILTER (rev<=3) AS opp_recent
  FROM log GROUP BY 1) a JOIN ratings t USING (competitor) LEFT JOIN births b USING (competitor)""")
cte("best_rank", "SELECT competitor, max(final_rating) AS fr, arg_max(schedule_quality, final_rating) AS sq, arg_max(division, final_rating) AS rd, arg_max(contender_rank, final_rating) AS cr, arg_max(is_champion, final_rating) AS ch FROM final_rank GROUP BY 1")
cte("radarctx", f"""
SELECT c.competitor, coalesce(sq, {display('coalesce(t.rating,1500)')}) AS sos, coalesce({months('latest',AS_OF)},999) AS months_since,
  ko_rate+sub_rate AS finish_rate, c.accuracy, ground_share
FROM competitors c LEFT JOIN best_rank USING (competitor) LEFT JOIN ratings t USING (competitor) LEFT JOIN (SELECT competitor, max(date) AS latest FROM log GROUP BY 1) USING (competitor)""")
U = lambda x: clamp(x, 0, 1)
SG = lambda x: f"(({clamp(x, -1, 1)})+1)/2"
PCT = lambda x: f"(CASE WHEN {x}>1 THEN {x}/100 ELSE {x} END)"
cte("radar", f"""
SELECT competitor, CASE WHEN coalesce(w,0)=0 THEN {U('0.6::DOUBLE*'+U(PCT('accuracy')+'/0.6')+'+0.4::DOUBLE*'+U('finish_rate'))} ELSE
  {U('0.3::DOUBLE*'+U('vol/90')+'+0.3::DOUBLE*'+U('kd/1.5')+'+0.25::DOUBLE*'+U('acc/0.6')+'+0.15::DOUBLE*'+SG('edge/40'))} END AS strike,
 CASE WHEN coalesce(w,0)=0 THEN {U(PCT('ground_share'))} ELSE {U('0.45::DOUBLE*'+SG('td/3')+'+0.4::DOUBLE*'+U('ctrl/300')+'+0.15::DOUBLE*'+U(PCT('ground_share')))} END AS grappling,
 CASE WHEN coalesce(w,0)=0 THEN {U('finish_rate')} ELSE {U('0.6::DOUBLE*'+U('finish_rate')+'+0.4::DOUBLE*'+U('kd/1.5'))} END AS finishing,
 {U('1-months_since/24')} AS activity, {U('sos/100')} AS opp_quality
FROM radarctx LEFT JOIN (SELECT competitor, sum(w) AS w, sum(str_self*w)/sum(w) AS vol, sum((str_self-str_opp)*w)/sum(w) AS edge, sum({PCT('acc_self')}*w)/sum(w) AS acc,
  sum(kd_self*w)/sum(w) AS kd, sum((td_self-td_opp)*w)/sum(w) AS td, sum(ctrl_self*w)/sum(w) AS ctrl
  FROM (SELECT *, pow(0.5::DOUBLE,{months('date',AS_OF)}/15) AS w, row_number() OVER (PARTITION BY competitor ORDER BY seq DESC) AS rn FROM sides WHERE has_metrics) WHERE rn<=5 GROUP BY 1) USING (competitor)""")
STYLE = """CASE WHEN {k}>=0.5 AND {k}>={s}*1.5 THEN 'knockout artist' WHEN {s}>=0.4 AND {s}>={k} THEN 'submission specialist'
 WHEN {k}>=0.35 AND {s}>=0.25 THEN 'all-action finisher' WHEN {f}>=0.6 THEN 'finisher' WHEN {a}>=0.55 AND {f}<0.4 THEN 'accurate striker'
 WHEN {s}>=0.25 THEN 'grappling technician' WHEN {f}<=0.3 THEN 'decision grinder' ELSE 'well-rounded' END""".format(
    k="ko_rate", s="sub_rate", f="(ko_rate+sub_rate)", a="accuracy")
cte("profile", f"""
SELECT c.competitor, c.name, c.gender, c.home_division, wins||'-'||losses||'-'||draws AS record, contests, coalesce(contests_rated,0) AS contests_rated,
 {years('b.born')} AS age, rd AS ranked_division, cr AS shown_rank, coalesce(ch,false) AS is_champion, {r('coalesce(t.rating,1500)',2)} AS rating,
 {r('coalesce(t.peak,1500)',2)} AS peak, {r(display('coalesce(t.rating,1500)'),2)} AS display, sq AS schedule_quality,
 {r('coalesce('+months('t.last_date',AS_OF)+',999)',1)} AS months_since, {r('ko_rate+sub_rate',3)} AS finish_rate, ko_rate, sub_rate, accuracy, {STYLE} AS style,
 coalesce({NUDGE},0) AS form_nudge, ratio_career, ratio_last3, coalesce(n_career,0) AS sample_contests
FROM competitors c LEFT JOIN ratings t USING (competitor) LEFT JOIN best_rank USING (competitor) LEFT JOIN wide USING (competitor) LEFT JOIN births b USING (competitor)""")
