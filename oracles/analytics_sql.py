"""Oracles of the competitor analytics."""

from oracles.base import AS_OF, cte, months, r, sql
from oracles import ranking, analytics  # noqa: F401
from oracles.analytics import NUDGE, STYLE, years, per15
from duelgrid.operators.analytics import HOLDS, STRIKES

_q = lambda s: s.replace("'", "''")
_hold = "CASE " + " ".join(f"WHEN contains(d,'{_q(n)}') THEN '{_q(v)}'" for n, v in HOLDS) + " ELSE 'Submission (other)' END"
_hit = "CASE " + " ".join("WHEN " + " AND ".join(f"contains(d,'{x}')" for x in n) + f" THEN '{v}'" for n, v in STRIKES) + " ELSE 'KO/TKO (other)' END"
CHANGE, OUT = "(ratio_last3/ratio_career-1)", "(CASE WHEN cl>=5 THEN tl/cl-1 ELSE 0 END)"
DEEP = "(coalesce(age,0)>=34 OR tenure_years>=9 OR n_career>=18)"
ORDER = "CASE {} WHEN 'AFRICA' THEN 1 WHEN 'AMERICA' THEN 2 WHEN 'ASIA' THEN 3 WHEN 'EUROPE' THEN 4 WHEN 'MIDDLE EAST' THEN 5 END"
M = months("date", AS_OF)
cte("forms", """SELECT competitor, string_agg(result||' '||CASE method WHEN 'KO/TKO' THEN 'KO R'||round WHEN 'SUB' THEN 'SUB R'||round WHEN 'U-DEC' THEN 'UD' WHEN 'S-DEC' THEN 'SD' WHEN 'M-DEC' THEN 'MD' END||' vs. '||opponent_name, '; ' ORDER BY rev) AS form FROM log WHERE rev<=5 GROUP BY 1""")
ORACLES = {
    "G1_elapsed_minutes": sql(f"SELECT contest_id, CASE WHEN clock LIKE '%:%' THEN CASE WHEN m>0 AND m<=60 THEN {r('m',4)} END END AS minutes FROM (SELECT contest_id, clock, (round-1)*5+TRY_CAST(split_part(clock,':',1) AS INT)+TRY_CAST(split_part(clock,':',2) AS INT)/60e0 AS m FROM contests)"),
    "G2_metric_samples": sql("SELECT competitor, contest_id, secs, nth, rev FROM samples"),
    "G3_pace_windows": sql("SELECT * FROM pace"),
    "G4_G9_drift_and_ratio": sql("SELECT competitor, landed15_delta, landed_pct_change, diff15_delta, td15_delta, accuracy_delta, ratio_career, ratio_last3 FROM wide"),
    "G5_G6_form_timeline": sql(f"""SELECT * EXCLUDE (seq), floor(avg(round(landed15*10)) OVER (PARTITION BY competitor ORDER BY seq ROWS 2 PRECEDING)+0.5)/10 AS rolling_landed
      FROM (SELECT competitor, contest_id, date, result, opponent, method, nth, seq, {r('secs/60e0',1)} AS minutes, {per15('str_self')} AS landed15, {per15('str_opp')} AS absorbed15, {per15('td_self')} AS td15, kd_self AS kd FROM samples)"""),
    "G7_durability": sql("SELECT * FROM durable"),
    "G8_finish_breakdown": sql(f"""SELECT competitor, side, label, n, place FROM (SELECT *, row_number() OVER (PARTITION BY competitor, side ORDER BY n DESC, f) AS place FROM (
      SELECT competitor, CASE result WHEN 'W' THEN 'win' ELSE 'loss' END AS side, CASE method WHEN 'SUB' THEN {_hold} ELSE {_hit} END AS label, count(*) AS n, min(seq) AS f
      FROM (SELECT *, lower(details) AS d FROM sides WHERE result IN ('W','L') AND method IN ('SUB','KO/TKO')) GROUP BY 1,2,3)) WHERE place<=5"""),
    "G10_gauntlet_points": sql(f"""SELECT competitor, contest_id, date, opponent, result, CASE method WHEN 'KO/TKO' THEN 'ko' WHEN 'SUB' THEN 'sub' END AS finish_type,
      {r('opponent_rating')}::BIGINT AS opponent_elo, {r('rating_after')}::BIGINT AS own_elo, {r('delta')}::BIGINT AS swing, {r('exp',2)} AS expected, {r('ou',2)} AS over_under, {r('cum',2)} AS running FROM points"""),
    "G10_gauntlet_summary": sql(f"""SELECT competitor, count(*) AS contests, {r('arg_max(cum,seq)',1)} AS total_overperformance, arg_max(contest_id,(ou,-seq)) FILTER (result='W') AS upset_contest,
      {r("max(ou) FILTER (result='W')",2)} AS upset_over_under, {r('min(least(opponent_rating,rating_after))')}::BIGINT AS elo_min, {r('max(greatest(opponent_rating,rating_after))')}::BIGINT AS elo_max FROM points GROUP BY 1 HAVING count(*)>=2"""),
    "G11_trend_codes": sql(f"""SELECT competitor, CASE WHEN no_last3 OR ratio_career IS NULL OR ratio_last3 IS NULL THEN 'thin_sample' WHEN len(c)=0 THEN 'steady' ELSE array_to_string(c[1:4],',') END AS codes,
      {r(CHANGE,3)} AS ratio_change, opp_step, age FROM (SELECT *, list_filter([
       CASE WHEN {CHANGE}<=-0.15 AND opp_step>=40 THEN 'margin_tight_step_up' WHEN {CHANGE}<=-0.15 AND {DEEP} THEN 'margin_tight_wear' WHEN {CHANGE}<=-0.15 THEN 'margin_tight_lean' END,
       CASE WHEN {CHANGE}>=0.15 AND {OUT}>=-0.05 AND opp_step>=40 THEN 'margin_wide_step_up' WHEN {CHANGE}>=0.15 AND {OUT}>=-0.05 THEN 'margin_wide' END,
       CASE WHEN coalesce(age,0)>=36 AND {CHANGE}>-0.15 THEN 'age_risk' END, CASE WHEN {OUT}<=-0.2 AND {CHANGE}>-0.15 THEN 'volume_down' END,
       CASE WHEN times_finished>=4 OR (kd_absorbed15>=0.3 AND {DEEP}) THEN 'damage' END, CASE WHEN months_since>=12 THEN 'layoff' END,
       CASE WHEN peak-rating>=120 AND {DEEP} THEN 'below_peak' END], lambda x: x IS NOT NULL) AS c
      FROM wide JOIN trendctx USING (competitor) LEFT JOIN durable USING (competitor))"""),
    "G12_form_nudge": sql(f"SELECT competitor, {NUDGE} AS nudge FROM wide"),
    "G13_style_radar": sql("SELECT competitor, " + ", ".join(f"{r(c,6)} AS {c}" for c in ("strike", "grappling", "finishing", "activity", "opp_quality")) + " FROM radar"),
    "G14_age": sql(f"SELECT competitor, {years('born')} AS age, precision<>'day' AS approximate FROM births"),
    "G15_story_facts": sql(f"""SELECT division, competitor, win_streak, skid, wins5, losses5, quality_wins, best_win, recent_finishes, recent_losses, signature_contest, signature_delta, move, headline,
      array_to_string(list_filter([CASE WHEN headline<>'quality' AND quality_wins>=1 THEN 'quality' END, CASE WHEN headline<>'red_hot' AND recent_finishes>=1 THEN 'finishes' END,
       CASE WHEN headline NOT IN ('red_hot','streak') AND win_streak>=2 THEN 'streak' END, CASE WHEN headline<>'skid' AND skid>=1 AND recent_losses>=1 THEN CASE WHEN skid>=2 THEN 'skid' ELSE 'recent_loss' END END,
       'moved_'||move, CASE WHEN headline<>'inactive' AND months_since>=14 THEN 'inactive' WHEN months_since<=6 AND headline NOT IN ('red_hot','streak','skid') THEN 'active' END,
       CASE WHEN schedule_nudge>=2 THEN 'schedule_tough' WHEN schedule_nudge<=-2 THEN 'schedule_soft' END, CASE WHEN metrics_bonus>=3 THEN 'metrics_strong' WHEN metrics_bonus<=-3 THEN 'metrics_soft' END,
       CASE WHEN headline<>'quality' AND sd>=25 THEN 'signature' END, CASE WHEN NOT is_champion AND external_bonus>0 AND external_rank IS NOT NULL THEN 'external' END], lambda x: x IS NOT NULL)[1:5], ',') AS codes
      FROM (SELECT *, CASE WHEN is_champion THEN 'champion' WHEN skid>=2 OR (losses5>wins5 AND n5>=4) THEN 'skid' WHEN win_streak>=3 AND recent_finishes>=2 THEN 'red_hot'
         WHEN win_streak>=3 THEN 'streak' WHEN quality_wins>=1 THEN 'quality' WHEN months_since>=14 THEN 'inactive' ELSE 'steady' END AS headline,
         {r('sd',2)} AS signature_delta, CASE WHEN n>=3 AND {ORDER.format('now_in')}>{ORDER.format('prior')} THEN 'up' WHEN n>=3 AND {ORDER.format('now_in')}<{ORDER.format('prior')} THEN 'down' END AS move
       FROM (SELECT a.*, (SELECT arg_min(l.label, l.rev) FROM log l WHERE l.competitor=a.competitor AND l.rev BETWEEN 2 AND 5 AND l.label<>a.now_in) AS prior FROM (
         SELECT competitor, count(*) AS n, max(label) FILTER (rev=1) AS now_in, coalesce(min(rev) FILTER (result<>'W')-1, count(*)) AS win_streak, coalesce(min(rev) FILTER (result<>'L')-1, count(*)) AS skid,
          count(*) FILTER (rev<=5 AND result='W') AS wins5, count(*) FILTER (rev<=5 AND result='L') AS losses5, count(*) FILTER (rev<=5) AS n5,
          count(*) FILTER (result='W' AND {M}<=48 AND opponent_rating>=1520) AS quality_wins,
          arg_max(opponent_name, (opponent_rating, seq)) FILTER (result='W' AND {M}<=48 AND opponent_rating>=1520) AS best_win,
          count(*) FILTER (result='W' AND {M}<=30 AND (method LIKE '%SUB%' OR method LIKE '%KO%')) AS recent_finishes, count(*) FILTER (result='L' AND {M}<=36) AS recent_losses,
          arg_max(contest_id, (delta, seq)) FILTER (result='W') AS signature_contest, max(delta) FILTER (result='W') AS sd FROM log GROUP BY 1) a)
       JOIN (SELECT division, competitor, is_champion, months_since, schedule_nudge, metrics_bonus, external_bonus, external_rank FROM final_rank) USING (competitor))"""),
    "G16_style_and_highlights": sql(f"""SELECT competitor, {STYLE} AS style, array_to_string(list_filter([CASE WHEN ko_rate+sub_rate>0 THEN 'Finish '||{r('(ko_rate+sub_rate)*100')}::INT||'%' END,
      CASE WHEN ko_rate>0 THEN 'KO '||{r('ko_rate*100')}::INT||'%' END, CASE WHEN accuracy>0 THEN 'Acc '||{r('accuracy*100')}::INT||'%' END, CASE WHEN sub_rate>0 THEN 'Sub '||{r('sub_rate*100')}::INT||'%' END], lambda x: x IS NOT NULL)[1:3], ', ') AS highlights FROM competitors"""),
    "G17_hash_pick": sql("SELECT competitor, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(name,''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h,c)*16777619)%4294967296) % 3)::INT AS choice FROM roster"),
    "G18_profile": sql("SELECT * FROM profile"),
    "G19_tenure": sql(f"SELECT competitor, {r(f'''date_diff('day',min(date),{AS_OF})/365.25::DOUBLE''',4)} AS tenure_years, {r(months('max(date)',AS_OF),1)} AS months_since FROM log GROUP BY 1"),
    "G20_strip_scale": sql(f"SELECT l.competitor, greatest(20, max(greatest({per15('str_self')},{per15('str_opp')}))) AS scale FROM log l LEFT JOIN samples s USING (competitor, contest_id) WHERE l.rev<=12 GROUP BY 1"),
    "G21_recent_form": sql("SELECT * FROM forms"),
}
